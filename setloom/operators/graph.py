"""Spelling variants as a graph: value profiles, evidence edges, capped components, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.keys import agg_key, bigrams, content_id, edit_ratio, flat_key, jaccard, narrow_script, series_marks, strip_notes
from setloom.operators.staging import connected_components, staged

# Thresholds of the edge kinds, and the kinds from the strongest to the weakest.
BIGRAM_MIN, LENGTH_BAND, EDIT_MIN, EDIT_MIN_LEN, SUBSTR_MIN_LEN, OVERSIZED, SAMPLE = 0.65, 2.0, 0.85, 4, 3, 12, 4
STRENGTH = {"caseonly": 0, "redirect": 1, "agg": 2, "cooccur": 3, "edit": 4, "bigram": 5, "substr": 6}
OTHER = {"source_work": "artist", "artist": "source_work"}


def trimmed(column: Column) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def value_profiles(plays: DataFrame, field: str) -> DataFrame:
    """(raw, rows, events, djs, titles, others, first_event, last_event, dj_sample, title_sample, other_sample, cross_field) of each
    trimmed value of `field`: counts of what is different, and the least `SAMPLE` of each.

    In two steps that merge before each shuffle: first a row for each different thing beside a value, then counts of these. A
    value's things never come together in one row; only the samples do.
    """
    own = plays.withColumn("raw", F.coalesce(trimmed(F.col(field)), F.lit("")))
    none = F.lit(None)
    thing = lambda kind, item, event: F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), event.cast("int").alias("event"))
    things = F.array(thing("event", none, F.col("event_no")), *[thing(kind, item, none) for kind, item in (("dj", F.col("dj")), ("title", F.col("title")), ("other", F.nullif(OTHER[field], F.lit(""))))])
    each = own.select("raw", F.explode(things).alias("x")).select("raw", "x.*")
    # plays without a value keep what stands beside it, for values that stand in both fields: the log is read once
    each = each.where("if(raw <> '', kind = 'event' or item is not null, kind = 'other' and item is not null)")
    all_cells = staged(each.groupBy("raw", "kind", "item", "event").agg(F.count("*").alias("n")), "profile-cells")
    cells = all_cells.where("raw <> ''")
    of = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("item").isNotNull() | F.col("event").isNotNull()))
    counts = cells.groupBy("raw").agg(F.sum(F.when(F.col("kind") == "event", F.col("n"))).alias("rows"), *[of(kind).alias(name) for kind, name in (("event", "events"), ("dj", "djs"), ("title", "titles"), ("other", "others"))], F.min("event").alias("first_event"), F.max("event").alias("last_event"))
    least = cells.where("kind <> 'event'").withColumn("k", F.row_number().over(Window.partitionBy("raw", "kind").orderBy("item"))).where(F.col("k") <= SAMPLE)
    samples = least.groupBy("raw").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("item")))).alias(f"{kind}_sample") for kind in ("dj", "title", "other")])
    both = counts.join(samples, "raw", "left").withColumns({f"{kind}_sample": F.coalesce(f"{kind}_sample", F.array().cast("array<string>")) for kind in ("dj", "title", "other")})
    crossed = counts.select("raw").intersect(all_cells.where("kind = 'other'").select(trimmed(F.col("item")).alias("raw")))
    return both.join(crossed.withColumn("cross_field", F.lit(True)), "raw", "left").withColumn("cross_field", F.coalesce("cross_field", F.lit(False)))


def value_rows(plays: DataFrame, field: str) -> DataFrame:
    """(raw, rows, cross_field): what clusters need of `value_profiles`, without the things beside a value. One pass over the log."""
    pairs = staged(plays.groupBy(F.col(field).alias("own"), F.col(OTHER[field]).alias("other")).agg(F.count("*").alias("n")), "value-rows")
    rows = pairs.select(trimmed(F.col("own")).alias("raw"), "n").where("raw <> ''").groupBy("raw").agg(F.sum("n").alias("rows"))
    crossed = rows.select("raw").intersect(pairs.select(trimmed(F.col("other")).alias("raw")))
    return rows.join(crossed.withColumn("cross_field", F.lit(True)), "raw", "left").withColumn("cross_field", F.coalesce("cross_field", F.lit(False)))


def value_events(plays: DataFrame, field: str) -> DataFrame:
    """(raw, event_no): the different events of each value."""
    return plays.select(trimmed(F.col(field)).alias("raw"), "event_no").where("raw <> '' and event_no is not null").distinct()


def cross_field(plays: DataFrame) -> DataFrame:
    """(raw): values that stand in the work column and in the artist column."""
    sides = [plays.select(trimmed(F.col(c)).alias("raw")).where("raw <> ''") for c in ("source_work", "artist")]
    return sides[0].intersect(sides[1])


def keyed_values(raws: DataFrame, unicode: bool = True) -> DataFrame:
    """raw with the keys that edges are drawn by."""
    raw = F.col("raw")
    return raws.select("raw", agg_key(strip_notes(raw), unicode).alias("key"), agg_key(raw, unicode).alias("plain"), flat_key(raw).alias("flat"), series_marks(raw).alias("marks"))


def pairs_of(pairs: DataFrame) -> DataFrame:
    """Unordered pairs, the smaller value first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_apart_pairs(pairs: DataFrame, unicode: bool = True) -> DataFrame:
    """Declared pairs and the pairs of their keys without notes."""
    keys = [agg_key(strip_notes(F.col(c)), unicode).alias(c) for c in ("a", "b")]
    return pairs_of(pairs.select("a", "b").unionByName(pairs.select(*keys).where("a <> '' and b <> '' and a <> b")))


def _allowed(edges: DataFrame, apart: DataFrame | None) -> DataFrame:
    """Edges (a, b, ka, kb, kind) between values on one line, not kept apart by spelling or key; one for each pair and kind."""
    edges = edges.where(~F.col("a").contains("\n") & ~F.col("b").contains("\n"))
    if apart is not None:
        raw = (F.least(edges.a, edges.b) == apart.a) & (F.greatest(edges.a, edges.b) == apart.b)
        edges = edges.join(apart, raw, "left_anti")
        keys = (F.least(edges.ka, edges.kb) == apart.a) & (F.greatest(edges.ka, edges.kb) == apart.b) & (edges.ka != "") & (edges.kb != "")
        edges = edges.join(apart, keys, "left_anti")
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").distinct()


def star_edges(values: DataFrame, key: str, kind: str) -> DataFrame:
    """Each value of a group to the group's first value."""
    heads = values.groupBy(key).agg(F.min("raw").alias("a"), F.min_by("key", "raw").alias("ka"))
    out = values.join(heads, key).where(F.col("raw") != F.col("a"))
    return out.select("a", F.col("raw").alias("b"), "ka", F.col("key").alias("kb"), F.lit(kind).alias("kind"))


def candidate_keys(keys: DataFrame) -> DataFrame:
    """(k1, k2): different keys that may be joined by containment, shared bigrams or spelling, found by rare bigrams.

    Let n be the length of the shorter key. Contained: all its bigrams are in the longer one. Jaccard 0.65: at most 0.35 of
    its bigrams are missing there. Edit ratio 0.85: unmatched characters and gaps spoil at most 0.503 n of its bigrams.
    So of any 0.51 n + 1 of its bigrams one is shared, and the rarest ones are taken.
    """
    grams = keys.select("key", F.explode(bigrams(F.col("key"))).alias("g"))
    rarity = grams.groupBy("g").agg(F.count("*").alias("n"))
    sorted_ = grams.join(rarity, "g").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    wanted = (F.floor(F.length("key") * 0.51) + 1).cast("int")
    rare = sorted_.select(F.col("key").alias("k1"), F.explode(F.slice("gs", F.lit(1), F.least(wanted, F.size("gs")))).alias("x")).select("k1", F.col("x.g").alias("g"))
    met = rare.join(grams.withColumnRenamed("key", "k2"), "g").where((F.length("k1") < F.length("k2")) | ((F.length("k1") == F.length("k2")) & (F.col("k1") != F.col("k2"))))
    return met.select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct()


def similarity_edges(values: DataFrame) -> DataFrame:
    """substr, bigram and edit edges (a, b, ka, kb, kind): one kind for each pair of values, in that order of preference."""
    known = values.where("key <> ''")
    pairs = candidate_keys(known.select("key").distinct())
    la, lb = F.length("k1"), F.length("k2")
    within = (F.least(la, lb) >= SUBSTR_MIN_LEN) & (F.col("k1").contains(F.col("k2")) | F.col("k2").contains(F.col("k1")))
    band = (F.greatest(la, lb) <= LENGTH_BAND * F.least(la, lb))
    alike = jaccard(bigrams(F.col("k1")), bigrams(F.col("k2"))) >= BIGRAM_MIN
    spelt = (F.least(la, lb) >= EDIT_MIN_LEN) & narrow_script(F.col("k1")) & narrow_script(F.col("k2"))
    judged = pairs.withColumn("kind", F.when(within, "substr").when(band & alike, "bigram").when(band & spelt, "edit?")).where("kind is not null")
    close = judged.where("kind = 'edit?'").where(edit_ratio("k1", "k2") >= EDIT_MIN).withColumn("kind", F.lit("edit"))
    kinds = judged.where("kind <> 'edit?'").unionByName(close)
    one = known.select(F.col("raw").alias("a"), F.col("key").alias("k1"), F.col("marks").alias("m1"))
    two = known.select(F.col("raw").alias("b"), F.col("key").alias("k2"), F.col("marks").alias("m2"))
    out = kinds.join(one, "k1").join(two, "k2").where("kind <> 'edit' or m1 = m2")
    same = one.join(two, F.col("k1") == F.col("k2")).where("a < b").withColumn("kind", F.lit("bigram"))
    return out.select("a", "b", F.col("k1").alias("ka"), F.col("k2").alias("kb"), "kind").unionByName(same.select("a", "b", F.col("k1").alias("ka"), F.col("k2").alias("kb"), "kind"))


def redirect_edges(values: DataFrame, evidence: DataFrame) -> DataFrame:
    """Values that a source names as another spelling of a known value; evidence: raw, pos, kind, title. The first hit counts."""
    hits = evidence.where(F.col("kind").isin("redirect", "alias")).withColumn("b", trimmed(F.col("title"))).where("b <> '' and b <> raw")
    known = values.select("raw")
    hits = hits.join(known, "raw", "left_semi").join(known.withColumnRenamed("raw", "b"), "b", "left_semi")
    return hits.select(F.col("raw").alias("a"), "b", "pos")


def first_redirects(hits: DataFrame, apart: DataFrame | None) -> DataFrame:
    """The first hit of each value that isn't kept apart, as edges."""
    if apart is not None:
        hits = hits.join(apart, (F.least(hits.a, hits.b) == apart.a) & (F.greatest(hits.a, hits.b) == apart.b), "left_anti")
    first = hits.groupBy("a").agg(F.min_by("b", "pos").alias("b"))
    return first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("redirect").alias("kind")).distinct()


def cooccurrence_edges(plays: DataFrame, apart: DataFrame | None, unicode: bool = True) -> DataFrame:
    """Artists that stand with the same title of the same work."""
    songs = plays.select(agg_key(F.col("title"), unicode).alias("t"), agg_key(F.coalesce("source_work", F.lit("")), unicode).alias("w"), trimmed(F.col("artist")).alias("a")).where("a <> '' and t <> ''").distinct()
    several = songs.groupBy("t", "w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    songs = songs.join(several, ["t", "w"])
    pairs = songs.join(songs.withColumnRenamed("a", "b"), ["t", "w"]).where("a < b").select("a", "b").distinct()
    if apart is not None:
        pairs = pairs.join(apart, ["a", "b"], "left_anti")
    return pairs.withColumn("kind", F.lit("cooccur"))


def build_edges(plays: DataFrame, profiles: DataFrame, field: str, apart: DataFrame | None = None, evidence: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """All edges (a, b, kind), a < b."""
    values = staged(keyed_values(profiles.select("raw"), unicode), "graph-values")
    families = [star_edges(values.where("key <> ''"), "key", "agg"), star_edges(values.where("plain <> ''"), "plain", "agg"), star_edges(values, "flat", "caseonly"), similarity_edges(values)]
    edges = _allowed(reduce(lambda x, y: x.unionByName(y), families), apart)
    if evidence is not None:
        edges = edges.unionByName(first_redirects(redirect_edges(values, evidence), apart))
    if field == "artist":
        edges = edges.unionByName(cooccurrence_edges(plays, apart, unicode))
    return edges.distinct()


def strength(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])[kind]


def capped_components(edges: DataFrame, limit: int = OVERSIZED) -> DataFrame:
    """(node, comp, was_split): components; larger ones than `limit` are built again without their weakest kinds of edges.

    All oversized components go through a round together; a value left without an edge leaves. What no round can split, or is
    still too large when no kinds are left, stays whole.
    """
    edges = staged(edges, "capped-edges")
    now = staged(connected_components(edges).select("node", F.col("root").alias("comp"), F.lit(False).alias("was_split")), "capped")
    for level in range(max(STRENGTH.values()), 0, -1):
        large = now.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") > limit)
        if not large.limit(1).count():
            break
        members = now.join(large, "comp")
        kept = edges.where(strength(F.col("kind")) < level)
        kept = kept.join(members.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca = cb")
        parts = members.join(connected_components(kept.select("a", "b")), "node")
        whole = parts.groupBy("comp", "size").agg(F.countDistinct("root").alias("parts"), F.count("*").alias("left")).withColumn("same", (F.col("parts") == 1) & (F.col("left") == F.col("size"))).select("comp", "same")
        after = parts.join(whole, "comp").select("node", F.col("root").alias("comp"), (F.col("was_split") | ~F.col("same")).alias("was_split"))
        now = staged(now.join(large, "comp", "left_anti").unionByName(after), "capped")
    return now


def clusters(field: str, profiles: DataFrame, edges: DataFrame, components: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """(id, field, rows, hints, edge_kinds, members, pairs): one row for each component with an undecided member."""
    marks = components.select("node", "comp", "was_split", F.to_json(series_marks(F.col("node"))).alias("marks"))
    marks = marks.join(profiles.select(F.col("raw").alias("node"), "rows", "cross_field"), "node", "left")
    if decided is not None:
        marks = marks.join(decided.select(F.col("raw").alias("node"), F.lit(True).alias("done")).distinct(), "node", "left")
    else:
        marks = marks.withColumn("done", F.lit(None).cast("boolean"))
    # each member is a row of its own; only the list of a cluster's members is gathered, which the cap keeps short
    comps = marks.groupBy("comp").agg(F.sum("rows").alias("rows"), F.max("was_split").alias("split"), (F.countDistinct("marks") > 1).alias("mixed"), F.coalesce(F.bool_or("cross_field"), F.lit(False)).alias("crossed"), F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"), F.array_sort(F.collect_set("node")).alias("members"))
    where = components.select("node", "comp")
    inner = edges.join(where.withColumnsRenamed({"node": "a", "comp": "comp"}), "a").join(where.withColumnsRenamed({"node": "b", "comp": "comp_b"}), "b").where("comp = comp_b")
    pairs = inner.groupBy("comp", "a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    kinds = pairs.groupBy("comp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("edge_kinds"), F.array_sort(F.collect_list(F.struct("a", "b", "kinds"))).alias("pairs"))
    out = comps.where("not all_done").join(kinds, "comp", "left")
    hint = lambda test, name: F.when(test, F.lit(name))
    hints = F.array_compact(F.array(hint(F.array_contains("edge_kinds", "substr"), "series-risk"), hint(F.col("mixed"), "series-mark-mismatch"), hint(F.col("crossed"), "artist-as-work"), hint(F.col("split"), "split-from-large")))
    return out.select(content_id(field, F.col("members")).alias("id"), F.lit(field).alias("field"), F.coalesce("rows", F.lit(0)).alias("rows"), hints.alias("hints"), F.coalesce("edge_kinds", F.array().cast("array<string>")).alias("edge_kinds"), "members", "pairs")


def cluster_values(clusters_: DataFrame, profiles: DataFrame, field: str, events: DataFrame | None = None) -> DataFrame:
    """(id, raw, rows, djs, co_titles, co_other, cross_field, base, first_event, last_event): the profile of each member, with samples;
    base only for works, where notes come off. With events (`value_events`), also the list of a member's events."""
    out = clusters_.select("id", F.explode("members").alias("raw")).join(profiles, "raw")
    base = F.nullif(strip_notes(F.col("raw")), F.col("raw")) if field == "work" else F.lit(None).cast("string")
    out = out.select("id", "raw", "rows", F.col("dj_sample").alias("djs"), F.col("title_sample").alias("co_titles"), F.col("other_sample").alias("co_other"), "cross_field", base.alias("base"), "first_event", "last_event")
    if events is None:
        return out
    lists = events.join(out.select("raw").distinct(), "raw", "left_semi").groupBy("raw").agg(F.array_sort(F.collect_list("event_no")).alias("events"))
    return out.join(lists, "raw", "left")


def cluster_totals(profiles: DataFrame, clusters_: DataFrame) -> DataFrame:
    """(total_values, clustered, singletons)."""
    total = profiles.agg(F.count("*").alias("total_values"))
    inside = clusters_.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("clustered"))
    return total.crossJoin(inside).withColumn("singletons", F.col("total_values") - F.col("clustered"))
