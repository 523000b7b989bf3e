"""Whole documents (published JSON, TOML dictionaries) as rows of text that give the document when written in order.

No document passes through one task: rows are sorted by range and written as text, and the part files in their order are the
document. The same input gives the same bytes, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.operators.resolve import class_map, variant_conflicts
from setloom.sources.sinks import published

# Characters that TOML's basic strings write with a letter.
SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
CONTROLS = {chr(c): f"\\u{c:04X}" for c in [*range(0x20), 0x7F]}


def _replaced(table: dict[str, str], ch: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[ch], ch)


def toml_string(text: Column) -> Column:
    """A TOML basic string; of several lines where the text has a line feed."""
    chars = F.split(text, "")
    one = F.concat(F.lit('"'), F.array_join(F.transform(chars, lambda c: _replaced(CONTROLS | SHORT, c)), ""), F.lit('"'))
    kept = {c: e for c, e in (CONTROLS | SHORT).items() if c not in '"\n\t'}

    def at(c: Column, i: Column) -> Column:
        # a quote needs its escape before another one and at the end only
        closes = (i == F.size(chars) - 1) | (F.get(chars, i + 1) == '"')
        return F.when((c == '"') & closes, F.lit('\\"')).otherwise(_replaced(kept, c))

    # a line feed right after the opening quotes would be dropped by readers
    several = F.concat(F.lit('"""'), F.array_join(F.transform(chars, lambda c, i: F.when((i == 0) & (c == "\n"), F.lit("\\n")).otherwise(at(c, i))), ""), F.lit('"""'))
    return F.when(text == "", '""').when(F.contains(text, F.lit("\n")), several).otherwise(one)


def toml_blocks(entries: DataFrame, table: str = "entry") -> DataFrame:
    """(ord, text): an array-of-tables block for each entry; missing values are left out."""
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c} = "), toml_string(F.col(c))))
    texts = {c: line(c) for c in ("id", "canonical", "series", "kind", "confidence", "source", "decided_at", "reason") if c in entries.columns}
    variants = F.concat(F.lit("variants = ["), F.array_join(F.transform("variants", toml_string), ", "), F.lit("]"))
    approved = F.when(F.col("approved").isNotNull(), F.concat(F.lit("approved = "), F.col("approved").cast("string")))
    order = [texts.get("id"), texts.get("canonical"), texts.get("series"), texts.get("kind"), variants, approved, *[texts.get(c) for c in ("confidence", "source", "decided_at", "reason")]]
    return entries.select("ord", F.concat_ws("\n", F.lit(f"[[{table}]]"), *[c for c in order if c is not None], F.lit("")).alias("text"))


def _section(rows: DataFrame, place: int, head: str, tail: str) -> DataFrame:
    """(place, key, text) of rows (key, text), a comma before all but the first, between head and tail."""
    spark = rows.sparkSession
    first = rows.agg(F.min("key").alias("least"))
    body = rows.join(F.broadcast(first)).select(F.lit(place + 1).alias("place"), "key", F.when(F.col("key") > F.col("least"), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))
    ends = spark.createDataFrame([(place, "", head), (place + 2, "", tail)], "place int, key string, text string")
    return body.unionByName(ends)


def aliases_document(works: DataFrame, artists: DataFrame, generated_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces: place, key, text; counts: section, classes, spellings; warnings: section, raw, kept, dropped) of the published dictionary."""
    parts, counts, warnings = [], [], []
    for place, name, entries, head, tail in ((0, "works", works, f'{{"generatedAt":"{generated_at}","works":{{', "},"), (3, "artists", artists, '"artists":{', "}}")):
        classes = class_map(entries)
        value = F.to_json(F.struct(F.col("canonical").alias("c"), F.col("series").alias("s"), F.col("kind").alias("k"), F.col("variants").alias("v")))
        key = F.expr("substring(to_json(array(raw)), 2, length(to_json(array(raw))) - 2)")
        parts.append(_section(classes.select(F.col("raw").alias("key"), F.concat(key, F.lit(":"), value).alias("text")), place, head, tail))
        counts.append(classes.agg(F.lit(name).alias("section"), F.countDistinct("canonical").alias("classes"), F.count("*").alias("spellings")))
        warnings.append(variant_conflicts(entries).select(F.lit(name).alias("section"), "raw", "kept", "dropped"))
    return parts[0].unionByName(parts[1]), counts[0].unionByName(counts[1]), warnings[0].unionByName(warnings[1])


def plays_document(plays: DataFrame, generated_at: str) -> DataFrame:
    """(place, key, text): the published log as one JSON document, events by number, then plays in the log's order."""
    rows = published(plays)
    order = F.format_string("%010d", F.col("event_no"))
    events = rows.where("kind = 'event'").select(order.alias("key"), F.col("json").alias("text"))
    each = F.from_json("json", "e int, p int, dj string, n int, t string")
    at = F.format_string("%010d|%05d|%s|%05d|%s", each["e"], F.coalesce(F.nullif(each["p"], F.lit(0)), F.lit(99)), each["dj"], F.coalesce(each["n"], F.lit(0)), F.col("json"))
    own = rows.where("kind = 'play'").withColumn("at", at)
    # plays that are equal in all columns keep a key of their own
    own = own.groupBy("at", "json").agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "at", "json")
    own = own.select(F.concat("at", F.format_string("|%010d", F.col("i"))).alias("key"), F.col("json").alias("text"))
    return _section(events, 0, f'{{"generatedAt":"{generated_at}","events":[', "],").unionByName(_section(own, 3, '"plays":[', "]}"))


def manifest_pieces(djs: DataFrame) -> DataFrame:
    """(event_no, json): an event of the manifest with its DJs in folder order, from one row a DJ."""
    d = F.struct("dj_folder", "dj", "play_order", "setlists", "media_files")
    events = djs.groupBy("event_no").agg(F.min("event_date").alias("date"), F.min("event_folder").alias("folder"), F.array_sort(F.collect_list(d)).alias("djs"))
    item = F.transform("djs", lambda x: F.struct(x["dj"].alias("dj"), x["dj_folder"].alias("folder"), x["play_order"].alias("play_order"), x["setlists"].alias("setlists"), x["media_files"].alias("media_files")))
    return events.select("event_no", F.to_json(F.struct(F.col("event_no").alias("no"), F.col("date").cast("string").alias("date"), "folder", item.alias("djs")), {"ignoreNullFields": "false"}).alias("json"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """(rank, id, json): clusters by rows, most first, then by id."""
    body = F.to_json(F.struct("id", "field", "rows", "hints", F.col("edge_kinds").alias("edgeKinds"), "members", "pairs"))
    return clusters.select((-F.col("rows")).alias("rank"), "id", body.alias("json"))


def evidence_lines(evidence: DataFrame) -> DataFrame:
    """(raw, json): what outside sources say of each value, by value."""
    return evidence.select("raw", F.to_json(F.struct("raw", "hits")).alias("json"))


def write_pieces(pieces: DataFrame, path: str) -> None:
    """The text column in the order of the others, over as many files as there are ranges."""
    order = [c for c in pieces.columns if c not in ("text", "json")]
    text = next(c for c in ("text", "json") if c in pieces.columns)
    pieces.orderBy(*order).select(text).write.mode("overwrite").text(path)
