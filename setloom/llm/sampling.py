"""Folds and bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def stratified(rows: DataFrame, label: str, per_label: int, seed: int = 7) -> DataFrame:
    """At most about `per_label` rows of each label, the same ones on each run, chosen by a hash of doc_id."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return rows.where(point < share)


def drawn_parts(text: Column, size: int, most: int, seed: int = 11) -> Column:
    """At most `most` parts of `size` characters of a text (the last one may be shorter), drawn by hash over its whole length."""
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1))
    ranked = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.struct(F.xxhash64(F.lit(seed), F.length(text), i).alias("h"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: F.substring(text, (r["i"] * size + 1).cast("int"), F.lit(size)))
