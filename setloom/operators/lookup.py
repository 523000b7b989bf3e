"""Stored forms of the log for questions by words and by name: an inverted index of grams, and a layout with small indexes.

Both are folders of Parquet written once from a log, to be asked many times. Sizes of files are parameters; no table of theirs
is brought to the driver: it gets the grams of a question with their counts, and places up to a bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.functions.keys import norm_key
from setloom.operators.staging import discard, staged
from setloom.schema import PLAY_COLUMNS

GRAM = 3
PLACES = 1000  # so many candidates are looked up by place; more of them by a join


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text; none if it is shorter."""
    count = F.length(text) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def _written(df: DataFrame, path: str, order: list[str], files: int, rows_a_group: int | None = None) -> None:
    writer = df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite")
    if rows_a_group:
        writer = writer.option("parquet.block.row.count.limit", rows_a_group)
    writer.parquet(path)


def write_index(plays: DataFrame, path: str, files: int = 64, gram: int = GRAM, rows_a_group: int | None = None) -> None:
    """Index plays (with `haystack`) for `search_index`.

    Different haystacks are numbered by a hash of 63 bits (two that collide share a place and are told apart by their text).
    Written are stacks (place, haystack) and plays by place, postings (gram, place), and counts (gram, n), all sorted, so that
    a question reads a few row groups; what is frequent lies over many files.
    """
    own = plays.withColumn("place", F.shiftrightunsigned(F.xxhash64("haystack"), 1))
    stacks = staged(own.select("place", "haystack").where("haystack is not null").distinct(), "stacks")
    postings = staged(stacks.select("place", F.explode(grams(F.col("haystack"), gram)).alias("gram")).distinct(), "postings")
    _written(stacks, f"{path}/stacks", ["place", "haystack"], files, rows_a_group)
    _written(postings, f"{path}/postings", ["gram", "place"], files, rows_a_group)
    _written(postings.groupBy("gram").agg(F.count("*").alias("n")), f"{path}/counts", ["gram"], max(1, files // 8), rows_a_group)
    _written(own, f"{path}/plays", ["place"], files, rows_a_group)
    discard(stacks, postings)


def _at(df: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of df at places (a staged table): read by place if they are few, else joined."""
    few = [r.place for r in places.limit(PLACES + 1).collect()]
    return df.where(F.col("place").isin(few)) if len(few) <= PLACES else df.join(places, "place", "left_semi")


def search_index(spark: SparkSession, path: str, query: str, gram: int = GRAM) -> DataFrame:
    """The plays that `query.search` finds for these words (any order, all of them, parts of words too), by the index.

    Each word of at least `gram` characters gives its rarest gram; the places of these are intersected, and their haystacks read
    and tested for all words. Words that are shorter are only tested. With short words alone all different haystacks are tested,
    but not the log; without any word all plays are found.
    """
    words = [r.k for r in spark.createDataFrame([(w,) for w in query.replace("　", " ").split()], "w string").select(norm_key(F.col("w")).alias("k")).collect()]
    words = [w for w in dict.fromkeys(words) if w]
    plays, stacks = spark.read.parquet(f"{path}/plays"), spark.read.parquet(f"{path}/stacks")
    if not words:
        return plays.drop("place")
    fits = reduce(lambda a, b: a & b, [F.col("haystack").contains(w) for w in words])
    long = [w for w in words if len(w) >= gram]
    if long:
        own = {w: [w[i : i + gram] for i in range(len(w) - gram + 1)] for w in long}
        every = sorted({g for gs in own.values() for g in gs})
        counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(every)).collect()}
        rarest = sorted({min(gs, key=lambda g: (counts.get(g, 0), g)) for gs in own.values()}, key=lambda g: (counts.get(g, 0), g))
        if not counts.get(rarest[0], 0):
            return plays.where("false").drop("place")
        postings = spark.read.parquet(f"{path}/postings")
        sets = [postings.where(F.col("gram") == g).select("place") for g in rarest]
        met = staged(reduce(lambda a, b: a.join(b, "place", "left_semi"), sets), "met")
        stacks = _at(stacks, met)
    found = staged(stacks.where(fits).select("place").distinct(), "found")
    return _at(plays, found).where(fits).drop("place")


# lookups by event, DJ and title ---------------------------------------------------------------------------------------------

INDEXED = ["dj", "title"]


def bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def write_log(plays: DataFrame, path: str, files: int = 64, buckets: int = 64, different: int = 1_000_000) -> None:
    """The log for `lookup`, all values as text but the event.

    plays: a folder for each event, within it sorted by DJ and title, with Bloom filters on both (different: how many values
    they are made for); a large event lies over many files. For DJs and titles each, an index (value, event_no) in folders by
    the value's bucket.
    """
    own = plays.select(*[F.col(c).cast("string").alias(c) if c != "event_no" else F.col(c) for c in PLAY_COLUMNS])
    writer = own.repartitionByRange(files, "event_no", "dj", "title").sortWithinPartitions("event_no", "dj", "title").write.mode("overwrite").partitionBy("event_no")
    for c in INDEXED:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", different)
    writer.parquet(f"{path}/plays")
    for c in INDEXED:
        index = own.select(F.col(c).alias("value"), "event_no").where("value is not null").distinct().withColumn("bucket", bucket(F.col("value"), buckets))
        index.repartition(buckets, "bucket").sortWithinPartitions("bucket", "value").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/by_{c}")


def lookup(spark: SparkSession, path: str, event_no: int | None = None, dj: str | None = None, title: str | None = None, buckets: int = 64) -> DataFrame:
    """Plays of an event, DJ and title, as far as given: the indexes name the events, and only their folders are read."""
    plays = spark.read.parquet(f"{path}/plays")
    if event_no is not None:
        plays = plays.where(F.col("event_no") == event_no)
    for column, value in (("dj", dj), ("title", title)):
        if value is None:
            continue
        index = spark.read.parquet(f"{path}/by_{column}").where((F.col("bucket") == bucket(F.lit(value), buckets)) & (F.col("value") == value))
        plays = plays.where(F.col(column) == value).join(index.select("event_no"), "event_no", "left_semi")
    return plays.select(*PLAY_COLUMNS)
