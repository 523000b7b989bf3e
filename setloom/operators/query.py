"""Questions to the play log: search, "already played?", rankings, summaries, set lists."""

from __future__ import annotations

from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType, StructField

from setloom.functions.keys import base_key, may_match_partly, norm_key
from setloom.operators.staging import discard, staged


def matches(haystack: Column, query: str) -> Column:
    """All words of the query stand in the haystack; a query without words matches everything."""
    spark_terms = [norm_key(F.lit(w)) for w in query.replace("　", " ").split()]
    return reduce(lambda a, b: a & b, [haystack.contains(t) for t in spark_terms], F.lit(True))


def search(plays: DataFrame, query: str = "", event_no: int | None = None, dj: str | None = None, remix: str | None = None) -> DataFrame:
    """Plays by facets and words. remix: "yes", "no" (an unknown one is neither) or None. Cheap facets come first."""
    if event_no is not None:
        plays = plays.where(F.col("event_no") == event_no)
    if dj is not None:
        plays = plays.where(F.col("dj") == dj)
    if remix is not None:
        plays = plays.where(F.col("is_remix") == F.lit(remix == "yes"))
    return plays.where(matches(F.col("haystack"), query)) if query.strip() else plays


def page(hits: DataFrame, order: list[Column], size: int = 300) -> DataFrame:
    """The first `size` hits."""
    return hits.orderBy(*order).limit(size)


def played_tiers(plays: DataFrame, asked: DataFrame, unicode: bool = True) -> DataFrame:
    """(query, tier, then the play): tier 1 the same title, 2 the same original, 3 one title within the other.

    plays: key, base and more; asked: query. A play stands in one tier of a query. Tiers 1 and 2 are equi-joins. Tier 3
    compares different title keys only, not plays: a key goes to its grams of `size` characters and meets the queries by them,
    and what shares a gram is tested for containment; keys too short for a gram are few by their nature and tested directly.
    """
    q = asked.select("query").distinct().select("query", norm_key(F.col("query"), unicode).alias("qkey"), base_key(F.col("query"), unicode).alias("qbase"))
    # the different titles feed seven joins; staged, the plays behind them are read once
    titles = staged(plays.select("key", "base").where("key is not null").distinct(), "played-titles")
    exact = titles.where("key <> ''").join(q, F.col("key") == F.col("qkey")).select("query", "key", "base", F.lit(1).alias("tier"))
    same = titles.where("base <> ''").join(q, (F.col("base") == F.col("qbase")) & ((F.col("key") != F.col("qkey")) | (F.col("key") == ""))).select("query", "key", "base", F.lit(2).alias("tier"))
    partly = contained(titles.select("key").where("key <> ''").distinct(), q.where(may_match_partly(F.col("qkey"))).select("qkey").distinct())
    third = partly.join(q, "qkey").join(titles, "key").where("key <> qkey and not (base <=> qbase and base <> '')").select("query", "key", "base", F.lit(3).alias("tier"))
    tiers = exact.unionByName(same).unionByName(third)
    return plays.join(tiers, ["key", "base"]).select("query", "tier", *[plays[c] for c in plays.columns])


def contained(keys: DataFrame, asked: DataFrame, gram: int = 2) -> DataFrame:
    """(key, qkey) where one holds the other, by shared grams; asked keys shorter than a gram are looked for letter by letter."""

    def grams(text: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))

    k, q = keys.where(F.length("key") >= gram), asked.where(F.length("qkey") >= gram)
    # the longer one holds all grams of the shorter one, so its first gram is enough to meet it
    forward = q.select("qkey", F.substring("qkey", 1, gram).alias("g")).join(k.select("key", F.explode(grams(F.col("key"), gram)).alias("g")), "g").where(F.col("key").contains(F.col("qkey")))
    backward = k.select("key", F.substring("key", 1, gram).alias("g")).join(q.select("qkey", F.explode(grams(F.col("qkey"), gram)).alias("g")), "g").where(F.col("qkey").contains(F.col("key")))
    letters = asked.select("qkey", F.explode(grams(F.col("qkey"), 1)).alias("g"))
    one_key = keys.where(F.length("key") == 1).join(letters, F.col("key") == F.col("g"))
    one_query = asked.where(F.length("qkey") == 1).join(keys.select("key", F.explode(grams(F.col("key"), 1)).alias("g")), F.col("qkey") == F.col("g"))
    parts = [x.select("key", "qkey") for x in (forward, backward, one_key, one_query)]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def verdicts(tiers: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, exact, same_base, partial, is_new): hits of each asked query by tier."""
    counted = tiers.groupBy("query").agg(*[F.count_if(F.col("tier") == t).alias(n) for t, n in ((1, "exact"), (2, "same_base"), (3, "partial"))])
    out = asked.select("query").distinct().join(counted, "query", "left")
    hits = {n: F.coalesce(n, F.lit(0)) for n in ("exact", "same_base", "partial")}
    return out.select("query", *[v.alias(n) for n, v in hits.items()], (reduce(lambda a, b: a + b, hits.values()) == 0).alias("is_new"))


def lead(order: Column, fields: list[StructField]) -> tuple[Column, list[str]]:
    """A number that sorts as the first fields of `order` do, nulls first, and their names: up to three of at most 32 bits."""
    small = list(takewhile(lambda f: isinstance(f.dataType, (ByteType, ShortType, IntegerType)), fields))[:3]
    number = F.lit(0).cast("decimal(38,0)")
    for f in small:
        number = number * F.lit(1 << 33) + F.coalesce(order[f.name].cast("long") + F.lit((1 << 31) + 1), F.lit(0))
    return number.cast("decimal(38,0)"), [f.name for f in small]


def rank(plays: DataFrame, key: Column, label: Column, order: Column, limit: int | None = 20, raw: Column | None = None, who: str = "dj") -> DataFrame:
    """(label, n, detail) of the largest groups by key, most first, then by label.

    A group's label is that of its first row by `order`, a struct; detail names its DJs as they first appear, after the raw
    spellings that differ from the label. Groups are counted first: with a limit, labels and lists are made of the largest alone.

    Spark finds the least of a struct by sorting all rows of a task. So the least `lead` of the order is found first, a number
    that takes a hash table only, and the first row is looked for among those that have it. DJs need no more than the lead
    where column `who` itself follows it in the order.
    """
    place = [F.desc("n"), F.collate("label", "ja"), F.col("label")]
    rows = plays.select(key.alias("k"), label.alias("l"), order.alias("o"), F.col(who).alias("who"), (raw if raw is not None else F.lit(None).cast("string")).alias("raw")).where("k is not null and k <> ''")
    log = staged(rows, "rank-rows")  # one pass over the log; counts, labels and lists are made from what it leaves
    fields = log.schema["o"].dataType.fields
    number, names = lead(F.col("o"), fields)
    rows = log.withColumn("lead", number)
    counts = staged(rows.groupBy("k", "raw").agg(F.count("*").alias("n"), F.min("lead").alias("lead")), "rank-counts")
    total = counts.groupBy("k").agg(F.sum("n").alias("n"))
    if limit is not None:
        least = total.orderBy(F.desc("n")).limit(limit).agg(F.min("n").alias("least"))  # one row; labels decide between equal counts
        total = total.join(F.broadcast(least), F.col("n") >= F.col("least")).drop("least")
    total = staged(total, "rank-open")

    def firsts(at: DataFrame, column: str) -> DataFrame:
        """(k, column, o, l): the first row of each, at: k, column, lead."""
        at = at.select(F.col("k").alias("_k"), F.col(column).alias("_v"), F.col("lead").alias("_lead"))
        found = rows.join(at, (F.col("k") == F.col("_k")) & F.col(column).eqNullSafe(F.col("_v")) & (F.col("lead") == F.col("_lead")))
        return found.groupBy("k", column).agg(F.min("o").alias("o"), F.min_by("l", "o").alias("l"))

    def listed(first: DataFrame, column: str, sep: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("o", F.col(column).alias("v"))))
        return first.groupBy("k").agg(F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(f"{column}s"))

    spelt = staged(firsts(counts.join(total.select("k"), "k", "left_semi"), "raw"), "rank-first")
    total = total.join(spelt.groupBy("k").agg(F.min_by("l", "o").alias("label")), "k")
    if limit is not None:
        total = F.broadcast(staged(total.orderBy(*place).limit(limit), "rank-top"))  # `limit` rows
        rows = rows.join(total.select("k"), "k", "left_semi")
    djs = rows.where("who is not null").groupBy("k", "who").agg(F.min("lead").alias("lead"))
    next_is_who = [f.name for f in fields[: len(names) + 1]] == [*names, who]
    djs = staged(djs.withColumnRenamed("lead", "o") if next_is_who else firsts(djs, "who"), "rank-djs")
    discard(log, counts)
    out = total.join(listed(djs, "who", "・"), "k", "left")
    detail = F.coalesce("whos", F.lit(""))
    if raw is not None:
        other = spelt.where("raw <> ''").join(total.select("k", "label"), "k").where(F.col("raw") != F.col("label"))
        out = out.join(listed(other, "raw", "、"), "k", "left")
        detail = F.when(F.col("raws").isNotNull(), F.concat("label", F.lit(" ← "), "raws", F.lit(" / "), detail)).otherwise(detail)
    return out.select("label", "n", detail.alias("detail")).orderBy(*place)


def of_event(plays: DataFrame, event_no: int | None) -> DataFrame:
    """The plays of one event, or all of them: what rankings and DJs' figures are limited to."""
    return plays if event_no is None else plays.where(F.col("event_no") == event_no)


def share_of_largest(ranked: DataFrame, column: str = "n") -> DataFrame:
    """ranked with `share`: a row's part of the largest one, for bars."""
    largest = ranked.agg(F.max(column).alias("_most"))
    return ranked.join(F.broadcast(largest)).withColumn("share", F.col(column) / F.nullif("_most", F.lit(0))).drop("_most")  # one row


def top_titles(plays: DataFrame, order: Column, limit: int | None = 20, event_no: int | None = None) -> DataFrame:
    return rank(of_event(plays, event_no), F.col("base"), F.col("title"), order, limit)


def top_works(plays: DataFrame, order: Column, limit: int | None = 20, unicode: bool = True, event_no: int | None = None) -> DataFrame:
    """Works by canonical name; known kinds other than a work are left out, unknown kinds are not."""
    kept = of_event(plays, event_no).where("source_work_canon <> '' and (source_work_kind is null or source_work_kind = '' or source_work_kind = 'work')")
    return rank(kept, norm_key(F.col("source_work_canon"), unicode), F.col("source_work_canon"), order, limit, F.col("source_work"))


def top_artists(plays: DataFrame, order: Column, limit: int | None = 20, unicode: bool = True, event_no: int | None = None) -> DataFrame:
    return rank(of_event(plays, event_no).where("artist_canon <> ''"), norm_key(F.col("artist_canon"), unicode), F.col("artist_canon"), order, limit, F.col("artist"))


def per_dj(plays: DataFrame, event_no: int | None = None) -> DataFrame:
    """(dj, tracks, events, remix_rate): the rate is over plays where it is known."""
    plays = of_event(plays, event_no)
    rate = F.count_if("is_remix") / F.nullif(F.count("is_remix"), F.lit(0))
    return plays.groupBy("dj").agg(F.count("*").alias("tracks"), F.countDistinct("event_no").alias("events"), rate.alias("remix_rate"))


def per_event(plays: DataFrame) -> DataFrame:
    """(event_no, event_date, djs, tracks, new_titles): titles are new in the first event that has their base."""
    first = plays.where("base <> ''").groupBy("base").agg(F.min("event_no").alias("event_no"))
    fresh = first.groupBy("event_no").agg(F.count("*").alias("new_titles"))
    sizes = plays.groupBy("event_no").agg(F.min("event_date").alias("event_date"), F.countDistinct("dj").alias("djs"), F.count("*").alias("tracks"))
    return sizes.join(fresh, "event_no", "left").withColumn("new_titles", F.coalesce("new_titles", F.lit(0)))


def setlist(plays: DataFrame, event_no: int | None = None) -> DataFrame:
    """(dj, dj_order, position, track): an event's sets, DJs by playing order and tracks by number; default: the last event."""
    if event_no is None:
        last = plays.agg(F.max("event_no").alias("event_no"))
        plays = plays.join(F.broadcast(last), "event_no")
    else:
        plays = plays.where(F.col("event_no") == event_no)
    return plays.groupBy("event_no", "dj").agg(
        F.min(F.coalesce("play_order", F.lit(99))).alias("dj_order"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("track_no", F.lit(0)).alias("position"), "title", "source_work", "artist", "is_remix", "url"))).alias("tracks"),
    )


def numbered_tracks(sets: DataFrame) -> DataFrame:
    """(dj, number, title): the number shown is the track's own, else its position."""
    out = sets.select("event_no", "dj", "dj_order", F.posexplode("tracks").alias("at", "t"))
    return out.select("event_no", "dj", "dj_order", F.coalesce(F.nullif("t.position", F.lit(0)), F.col("at") + 1).alias("number"), "t.title")


def djs_without_set(announced: DataFrame, plays: DataFrame) -> DataFrame:
    """Announced (event_no, dj) without a play."""
    return announced.select("event_no", "dj").distinct().join(plays.select("event_no", "dj"), ["event_no", "dj"], "left_anti")


def totals(plays: DataFrame) -> DataFrame:
    return plays.agg(F.count("*").alias("plays"), F.countDistinct("event_no").alias("events"), F.countDistinct("dj").alias("djs"))


def play_order() -> list[Column]:
    """The order of the whole log; a playing order or number of 0 counts as missing."""
    return [F.col("event_no"), F.coalesce(F.nullif("play_order", F.lit(0)), F.lit(99)), F.col("dj"), F.coalesce("track_no", F.lit(0))]


def history(plays: DataFrame) -> DataFrame:
    """Plays of a title in the order of its history: by event, then number, a missing one first."""
    return plays.orderBy("event_no", F.coalesce("track_no", F.lit(0)))


def dj_names(plays: DataFrame) -> DataFrame:
    """(dj): all DJs in Japanese collation order."""
    return plays.select("dj").distinct().orderBy(F.collate("dj", "ja"), "dj")


def search_preview(hits_all: DataFrame, hits_representative: DataFrame, keys: list[str]) -> DataFrame:
    """Hits of any variant that the representative alone does not find."""
    return hits_all.distinct().join(hits_representative.select(*keys).distinct(), keys, "left_anti")
