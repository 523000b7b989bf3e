"""Tables between the jobs of an operator, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Held while a staged table is written: its shuffle files go with it, and what Python workers get at once is bounded in bytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, one of our own, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="setloom-"))
        path = f"file://{_own_dir[0]}"
    return path.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once into the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and lets Spark drop the shuffle files of the job that
    made it. The files stay until `discard` (the result of an operator may still read them).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, most: int = 60, split_hot: bool = False) -> DataFrame:
    """(node, root) for the nodes of undirected `edges` (a, b); root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each an aggregation for the least neighbour and an equi-join, on staged
    tables, until nothing changes. split_hot: for graphs over rows of a corpus, where a node may have very many edges; it costs
    two small exchanges a round. Stops with an error rather than with a wrong answer after `most` rounds.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(now)
    side = spread if split_hot else lambda df: df
    for _ in range(most):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = staged(small.where("a <> b").distinct(), "cc")
        was, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew by row into as many parts as shuffles have, however few or large its rows are.

    Of the least neighbours: the join then reads plain shuffles on both sides, so a node with very many edges can be split over tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
