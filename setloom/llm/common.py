"""What the training-data operators share: staging, Arrow text access, numbering, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.operators import staging
from setloom.operators.staging import discard, shared_dir, staged  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): corpora have nodes with very many edges, which are split."""
    return staging.connected_components(edges, split_hot=True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, handing freed memory back to the system at the end of a task: Python workers live on and serve later stages."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary Arrow column without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off, body


def strings(values: list[bytes]) -> pa.Array:
    """A string column of UTF-8 values."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(values))])


def runs_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row makes a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def is_blank(body: np.ndarray) -> np.ndarray:
    return (body == 32) | ((body >= 9) & (body <= 13))


def parts_of(body: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes of a long text, cut at ASCII white space only."""
    at = 0
    while at < len(body):
        to = min(at + limit, len(body))
        while to < len(body):
            blank = np.flatnonzero(is_blank(body[to : to + limit]))
            if len(blank):
                to += int(blank[0])
                break
            to = min(to + limit, len(body))
        yield at, to
        at = to


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by `keys`; several small groups share a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in map(held[-1].schema.get_field_index, keys)):
            yield pa.Table.from_batches(held)
            held = []
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k))
            same &= np.asarray(pa.compute.equal(c[1:], c[:-1]).fill_null(True)) if len(c) > 1 else True
        ends = np.flatnonzero(~same)
        if len(ends):
            cut = int(ends[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, with the end appended."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]).astype(np.int64) if n else np.zeros(1, np.int64)


def row_key(columns: list[str]) -> Column:
    """MD5 over all named columns of a row, null and empty values told apart."""
    own = [F.md5(F.col("text").cast("binary")).alias("text") if c == "text" else F.col(c) for c in columns]
    return F.unhex(F.md5(F.to_json(F.struct(*own))))


def rows_of(docs: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """One row of docs (columns) for each row_key in `keys` (rk and any others), with the others; texts are shuffled once."""
    own = docs.select(row_key(columns).alias("rk"), *columns).join(keys.select("rk"), "rk", "left_semi")
    # rows with equal keys are equal in all columns
    return own.groupBy("rk").agg(*[F.first(c).alias(c) for c in columns]).join(keys, "rk")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Number the rows of each group of `keys` from 0 without bringing a group into one task.

    Rows are dealt into hash buckets of about `per_bucket` rows (at least 64 buckets); the counts of a group's buckets
    are summed up to give each bucket its first number, and only within a bucket are rows sorted. The numbers depend on
    the values alone, so reruns and recomputed partitions agree. df should be a staged table; rows: its count.
    """
    buckets = max(64, -(-rows // per_bucket))
    # hashed by value: a null and a zero may share a bucket, which does no harm
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    flagged = [c for k in keys for c in (F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k_{k}"), F.col(k).isNull().alias(f"_n_{k}"))]
    df = df.select("*", *flagged)
    plain = [x for k in keys for x in (f"_k_{k}", f"_n_{k}")]
    counts = df.groupBy(*plain, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*plain).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*plain, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*plain, "_bucket").orderBy(*order)
    out = df.withColumn("_at", F.row_number().over(within) - 1).join(firsts, [*plain, "_bucket"])
    return out.withColumn(name, F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first", *plain)


def local_forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index reachable for each of n nodes over the index pairs left, right."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label

