"""The play and decision logs as streams: incremental versions of batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.schema import DECISION


def decision_stream(spark: SparkSession, path: str) -> DataFrame:
    """Decisions as they are added to the log's folder."""
    return spark.readStream.schema(DECISION).json(path)


def decided_stream(decisions: DataFrame) -> DataFrame:
    """Spellings as they are accepted or rejected."""
    return decisions.where(F.col("action").isin("accept", "reject")).select(F.explode("variants").alias("raw")).dropDuplicates(["raw"])


def new_targets(values: DataFrame, known: DataFrame) -> DataFrame:
    """Values of a stream that a static table doesn't know yet."""
    return values.join(known.select("raw").distinct(), "raw", "left_anti")


def first_seen(plays: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first play of each base within the watermark."""
    return plays.withWatermark(time, delay).dropDuplicatesWithinWatermark(["base"])


def new_title_changes(plays: DataFrame) -> DataFrame:
    """(event_no, change) as a stream of plays (base, event_no) goes on: 1 for the event that a base is first seen in, and, when plays of an
    earlier event come late, 1 for that and -1 for the one before. Their sums are each event's new titles, over all time.

    The first event of each base is kept as state, without a limit in time; plays without a base or an event don't count.
    """

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        now = min(int(part["event_no"].min()) for part in parts)
        if was is None or now < was:
            state.update((now,))
            yield pd.DataFrame({"event_no": [now] if was is None else [now, was], "change": [1] if was is None else [1, -1]})

    own = plays.select("base", "event_no").where("base <> '' and event_no is not null")
    return own.groupBy("base").applyInPandasWithState(first, "event_no int, change int", "event_no int", "update", GroupStateTimeout.NoTimeout)


def keep_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there of a stream of changes, a folder for each micro-batch, and stop; a batch that is run again replaces its folder."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_titles(spark: SparkSession, path: str) -> DataFrame:
    """(event_no, new_titles) from the changes kept so far."""
    found = spark.read.schema("event_no int, change int").parquet(path).groupBy("event_no").agg(F.sum("change").alias("new_titles"))
    return found.where("new_titles > 0")


def tracks_per_window(plays: DataFrame, time: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window, tracks) of event time, with late rows up to `delay`."""
    return plays.withWatermark(time, delay).groupBy(F.window(time, length)).agg(F.count("*").alias("tracks"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there as Parquet and stop; run again to go on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


class QueueState:
    """What a review queue shows, kept up from the decision log as it grows, a micro-batch at a time.

    For each batch two small folders are written: the spellings that it decided first, and how many members of which cluster that
    settled. A batch that is run again, after a failure, replaces its own folders, so nothing counts twice. The clusters
    are read for the spellings of a batch only.
    """

    def __init__(self, spark: SparkSession, path: str, clusters: DataFrame) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.members = clusters.select("field", "id", F.explode("members").alias("raw"))
        self.sizes = clusters.select("field", "id", F.size("members").alias("size"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}") if self._has(name) else self.spark.createDataFrame([], f"{schema}, batch long")

    def _has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def apply(self, decisions: DataFrame, batch: int) -> None:
        """Take in a micro-batch of the log; for foreachBatch."""
        given = decisions.where(F.col("action").isin("accept", "reject")).select("field", F.explode("variants").alias("raw")).distinct()
        before = self._read("decided", "field string, raw string").where(F.col("batch") != batch)
        given.join(before.select("field", "raw"), ["field", "raw"], "left_anti").write.mode("overwrite").parquet(f"{self.path}/decided/batch={batch}")
        fresh = self.spark.read.schema("field string, raw string").parquet(f"{self.path}/decided/batch={batch}")
        settled = self.members.join(fresh, ["field", "raw"]).groupBy("field", "id").agg(F.count("*").alias("n"))
        settled.write.mode("overwrite").parquet(f"{self.path}/settled/batch={batch}")

    def counters(self) -> DataFrame:
        """(field, total, decided, open_values), as `resolve.queue_counters` counts them over the whole log."""
        settled = self._read("settled", "field string, id string, n long").groupBy("field", "id").agg(F.sum("n").alias("n"))
        each = self.sizes.join(settled, ["field", "id"], "left").withColumn("open", F.col("size") - F.coalesce("n", F.lit(0)))
        return each.groupBy("field").agg(F.count("*").alias("total"), F.count_if(F.col("open") == 0).alias("decided"), F.sum("open").alias("open_values"))


def follow_queue(decisions: DataFrame, state: QueueState, checkpoint: str) -> StreamingQuery:
    """Bring the state up to the end of the log and stop; run again to go on where it stopped."""
    return decisions.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
