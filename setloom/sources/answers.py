"""A store of answers by the content of their requests: what has been asked once is never asked again.

A request's key is the SHA-256 of the canonical JSON of all its fields. Answers are kept in generations: a writer writes a
folder that no reader looks at, then renames it to the next free number. A rename onto a number that is taken fails, so of two
writers one starts over, leaves out what the other has stored meanwhile, and takes the next number. So a key is stored once,
and a reader sees whole generations only. On local disks Hadoop looks first and renames then: a number that is taken in between
gets the draft inside it, hidden from readers, and its writer, who finds it there, starts over as well. The file system must
rename folders in one step, as HDFS and local disks do; on object stores, put a committer in front.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.operators.staging import staged

SCHEMA = "key string, request string, response string"


def _ordered(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of structs, and the entries of maps, in the order of their names."""
    if isinstance(kind, T.StructType):
        inner = [_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*inner)) if inner else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _ordered(e["value"], kind.valueType))))
    return value


def canonical_json(df: DataFrame) -> Column:
    """All fields of a row of df as JSON: names in order at every level, nulls written out."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def keyed(requests: DataFrame) -> DataFrame:
    """requests with `key` and `request`, the canonical JSON that it is the hash of."""
    return requests.select("*", canonical_json(requests).alias("request")).withColumn("key", F.sha2("request", 256))


class Asked(NamedTuple):
    """answers: the requests with key, response and hit (it was known before); asked: how many were sent out."""

    answers: DataFrame
    asked: int


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._jvm, self._root = jvm, jvm.org.apache.hadoop.fs.Path(self.path)
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._root.getFileSystem(self._conf)

    def generations(self) -> list[str]:
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        return sorted(n for n in names if n.startswith("gen-"))

    def read(self, generations: list[str] | None = None) -> DataFrame:
        """(key, request, response): what is stored."""
        found = self.generations() if generations is None else generations
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{g}" for g in found])

    def misses(self, requests: DataFrame) -> DataFrame:
        """(key, request) of the different requests (key, request) without an answer."""
        return requests.select("key", "request").dropDuplicates(["key"]).join(self.read().select("key"), "key", "left_anti")

    def store(self, answers: DataFrame, tries: int = 20) -> int:
        """Add answers (key, request, response), and say how many were new. A null response is none, and is asked for again;
        of several answers to a request the least counts. answers should be a staged table: it may be read more than once."""
        own = answers.where("response is not null").groupBy("key").agg(F.min(F.struct("response", "request")).alias("a")).select("key", "a.request", "a.response")
        for _ in range(tries):
            known = self.generations()
            draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
            own.join(self.read(known).select("key"), "key", "left_anti").sortWithinPartitions("key").write.parquet(draft)
            added = self.spark.read.schema(SCHEMA).parquet(draft).count()
            if not added or self._take(draft, f"gen-{len(known):06d}"):
                if not added:
                    self._files.delete(self._jvm.org.apache.hadoop.fs.Path(draft), True)
                return added
        raise RuntimeError(f"{tries} other writers came first")

    def _take(self, draft: str, name: str) -> bool:
        """Rename the draft to a generation; false, and no draft, if the number is taken."""
        fs = self._jvm.org.apache.hadoop.fs
        source, target = fs.Path(draft), fs.Path(self._root, name)
        inside = fs.Path(target, source.getName())  # where the draft ends up if the number is taken after rename has looked
        none = self._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(source, target, none)
            if not self._files.exists(inside):
                return True
        except Exception:
            if not self._files.exists(target):
                raise
        for lost in (source, inside):
            self._files.delete(lost, True)
        return False

    def compact(self) -> DataFrame:
        """All answers as one table sorted by key, to be written elsewhere as the first generation of a new store."""
        return self.read().repartitionByRange("key").sortWithinPartitions("key")

    def ask(self, requests: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> Asked:
        """Answer all requests (any columns): known ones from the store, the others by `answer`, which gets (key, request) of each
        different one once, and gives (key, response). What it gives is stored; the requests that it leaves out, or answers with
        null, stay open and come back with a null response."""
        wanted = staged(keyed(requests), "requests")
        open_ones = staged(self.misses(wanted), "misses")
        asked = open_ones.count()
        before = self.generations()
        if asked:
            given = staged(open_ones.join(answer(open_ones).select("key", "response"), "key"), "given")
            self.store(given)
        known = self.read(before).select("key", F.lit(True).alias("hit"))
        found = wanted.drop("request").join(self.read().select("key", "response"), "key", "left").join(known, "key", "left")
        return Asked(found.withColumn("hit", F.coalesce("hit", F.lit(False))), asked)
