"""Requests about clusters, and the log of answers: capped documents for a model, and where an asking run stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.keys import estimate_tokens
from setloom.operators.staging import staged

# What a request shows at most, and how many failures in a row end a run.
SAMPLE, EDGES, HITS, NOTE, FAILURES = 3, 12, 3, 100, 10
SEARCH_PREFIX = "Wikidata 検索: "


def shown_hits(hits: Column, most: int = HITS, note: int = NOTE) -> Column:
    """The first `most` hits of different titles, in their order, with notes cut to `note` characters; redirects need no note."""
    title = lambda h: F.coalesce(h["title"], F.lit(""))
    first = F.filter(hits, lambda h, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda g: title(g) == title(h)))
    text = lambda h: F.when((F.coalesce(h["kind"], F.lit("")) != "redirect") & (F.coalesce(h["note"], F.lit("")) != ""), F.substring(F.regexp_replace(h["note"], f"^{SEARCH_PREFIX}", ""), 1, note))
    return F.transform(F.slice(first, 1, most), lambda h: F.struct(F.coalesce(h["source"], F.lit("")).alias("source"), title(h).alias("title"), F.coalesce(h["kind"], F.lit("")).alias("kind"), text(h).alias("note")))


def packed_clusters(clusters: DataFrame, values: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, request, tokens): each cluster as the document that a model is shown, and its estimated size for `pack_batches`.

    clusters (id, hints, edge_kinds, pairs array<struct<a, b, kinds>>); values (id, pos, raw, rows, djs, co_titles, co_artists, co_works,
    cross_field), pos being their order; evidence (raw, hits array<struct<source, title, kind, note>>). Lists are cut to `SAMPLE`, empty
    ones left out; over `EDGES` pairs are given by their kinds alone. A value that was not asked about has no entry among the
    results, one without hits an empty one.
    """
    some = lambda c: F.when(F.size(c) > 0, F.slice(c, 1, SAMPLE))
    card = F.struct("raw", "rows", some("djs").alias("djs"), some("co_titles").alias("coTitles"), some("co_artists").alias("coArtists"), some("co_works").alias("coWorks"), F.when(F.col("cross_field"), True).alias("alsoAnArtistName"))
    asked = values.join(evidence.where("hits is not null").select("raw", shown_hits(F.col("hits")).alias("hits")), "raw", "left")
    found = F.when(F.col("hits").isNotNull(), F.struct("pos", F.struct(F.col("raw").alias("key"), F.col("hits").alias("value")).alias("e")))
    # a cluster has few values: its components are capped
    own = asked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", card.alias("card")))).alias("cards"), F.collect_list(found).alias("found"))
    own = own.select("id", F.transform("cards", lambda x: x["card"]).alias("candidates"), F.map_from_entries(F.transform(F.array_sort("found", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)), lambda x: x["e"])).alias("results"))
    few = F.size(F.coalesce("pairs", F.array().cast("array<struct<a:string,b:string,kinds:array<string>>>"))) <= EDGES
    none = F.array().cast("array<array<string>>")
    edges = F.when(few, F.coalesce(F.transform("pairs", lambda p: F.array(p["a"], p["b"], F.array_join(p["kinds"], ","))), none))
    no_names = F.array().cast("array<string>")
    out = clusters.join(own, "id", "left")
    request = F.to_json(F.struct(F.col("id").alias("cluster_id"), F.coalesce("hints", no_names).alias("hints"), F.coalesce("candidates", F.from_json(F.lit("[]"), own.schema["candidates"].dataType.simpleString())).alias("candidates"), edges.alias("edges"), F.when(~few, F.coalesce("edge_kinds", no_names)).alias("edgeKinds"), F.when(F.size("results") > 0, F.col("results")).alias("api_results")))
    return out.select("id", request.alias("request")).withColumn("tokens", estimate_tokens(F.col("request")))


def dense_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `n`, their number from 0 within `keys` by `order`, without bringing a group into one task."""
    in_order = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    own = staged(in_order.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "dense-order")
    parts = own.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each partition of a group
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = own.join(parts.select(*keys, "_part", "_first", before.alias("_before")), [*keys, "_part"])
    return joined.withColumn("n", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def asking_run(log: DataFrame, most: int = FAILURES, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """What a run of questions asked, and what it left: (rows: run, ord, raw, outcome; totals: run, fetched, hits, misses, failed, left).

    log (run, ord, raw, hits, failed): all questions of a run in their order, as they would be answered. A failure goes on record
    as an answer without hits; `most` failures in a row end the run, and what follows stays to be asked (outcome `left`; else
    `hit`, `miss` or `failed`). The end is where a row and the most - 1 rows before it have all failed, so rows are looked at in
    chunks, each with the last rows of the one before: a long run is nobody's single task.
    """
    own = staged(dense_order(log.select("run", "ord", "raw", "hits", "failed"), ["run"], ["ord", "raw"]), "asking-rows")
    size = max(chunk, most)
    home = F.floor(F.col("n") / size)
    spread = F.when(F.col("n") % size >= size - most + 1, F.array(home, home + 1)).otherwise(F.array(home))
    looked = own.select("run", "n", "failed", home.alias("home"), F.explode(spread).alias("c"))
    last = Window.partitionBy("run", "c").orderBy("n").rowsBetween(-(most - 1), 0)
    ends = looked.withColumn("k", F.count_if("failed").over(last)).where((F.col("k") == most) & (F.col("home") == F.col("c")))
    stop = ends.groupBy("run").agg(F.min("n").alias("stop"))
    # runs differ in size by far, their ends are a row each
    rows = own.join(stop, "run", "left").select("run", "ord", "raw", F.when(F.col("n") > F.col("stop"), "left").when(F.col("failed"), "failed").when(F.col("hits") > 0, "hit").otherwise("miss").alias("outcome"))
    count = lambda *names: F.count_if(F.col("outcome").isin(*names))
    totals = rows.groupBy("run").agg(count("hit", "miss", "failed").alias("fetched"), count("hit").alias("hits"), count("miss", "failed").alias("misses"), count("failed").alias("failed"), count("left").alias("left"))
    return rows, totals
