"""Plays with canonical names and search keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.functions.keys import base_key, norm_key
from setloom.operators.staging import staged


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least `order`, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def resolve_names(plays: DataFrame, column: str, dictionary: DataFrame, unicode: bool = True) -> DataFrame:
    """Look the values of `column` up in dictionary (raw, canonical, series, kind, variants, ord), one row a raw spelling.

    Adds {column}_canon, _series, _kind, _variants: by the raw spelling first, then by key (the first spelling of a key
    counts), else the value itself. Only distinct values are looked up; the plays are joined once.
    """
    values = plays.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("k", norm_key(F.col("value"), unicode))
    exact = first_by(dictionary.select("raw", "canonical", "series", "kind", "variants", "ord"), ["raw"], "ord")
    keyed = first_by(exact.withColumn("k", norm_key(F.col("raw"), unicode)), ["k"], "ord")
    one = exact.select(F.col("raw").alias("value"), F.struct("canonical", "series", "kind", "variants").alias("e1"))
    two = keyed.select("k", F.struct("canonical", "series", "kind", "variants").alias("e2"))
    found = values.where("value <> ''").join(one, "value", "left").join(two, "k", "left")
    entry = F.coalesce("e1", "e2")
    found = found.select(F.col("value").alias(column), entry["canonical"].alias(f"{column}_canon"), entry["series"].alias(f"{column}_series"), entry["kind"].alias(f"{column}_kind"), entry["variants"].alias(f"{column}_variants"))
    return plays.join(found, column, "left").withColumn(f"{column}_canon", F.coalesce(f"{column}_canon", column))


def haystack(title: Column, work: Column, artist: Column, work_variants: Column, work_series: Column, artist_variants: Column, unicode: bool = True) -> Column:
    """All that a search looks at, as one key; matches may span parts."""
    none = F.array().cast("array<string>")
    series = F.when(work_series.isNotNull() & (work_series != ""), F.array(work_series)).otherwise(none)
    parts = F.concat(F.array(title, F.coalesce(work, F.lit("")), F.coalesce(artist, F.lit(""))), F.coalesce(work_variants, none), series, F.coalesce(artist_variants, none))
    return norm_key(F.array_join(parts, " "), unicode)


def looked_up(plays: DataFrame, columns: list[str], lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """plays with what `lookup` adds to their different values of `columns`.

    The log is read for its different values, then joined once with their stored lookup, whose size Spark knows before it plans:
    a short one is broadcast and the plays stay where they are. Joined by shuffles, plays of few different values met in few tasks.
    """
    different = staged(plays.select(*columns).distinct(), "names-different")
    found = lookup(different)
    added = [c for c in found.columns if c not in columns]
    found = staged(found.select(*[F.col(c).alias(f"_{c}") for c in columns], *added), "names-found")
    condition = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return plays.join(found, condition, "left").drop(*[f"_{c}" for c in columns])


def canonical_names(plays: DataFrame, works: DataFrame, artists: DataFrame, unicode: bool = True) -> DataFrame:
    """Plays with the names of their works and artists, see `resolve_names`."""
    return looked_up(plays, ["source_work", "artist"], lambda x: resolve_names(resolve_names(x, "source_work", works, unicode), "artist", artists, unicode))


def enrich(plays: DataFrame, works: DataFrame, artists: DataFrame, unicode: bool = True) -> DataFrame:
    """Plays with canonical names, title keys and haystack, all made once for each different title, work and artist."""
    parts = [F.col(c) for c in ("title", "source_work", "artist", "source_work_variants", "source_work_series", "artist_variants")]

    def lookup(different: DataFrame) -> DataFrame:
        titles = different.select("title").distinct().select("title", norm_key(F.col("title"), unicode).alias("key"), base_key(F.col("title"), unicode).alias("base"))
        named = resolve_names(resolve_names(different, "source_work", works, unicode), "artist", artists, unicode).join(titles, "title", "left")
        return named.withColumn("haystack", haystack(*parts, unicode))

    return looked_up(plays, ["title", "source_work", "artist"], lookup)
