"""Dictionaries, overrides, evidence, decisions and published tables as DataFrames."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.schema import CLUSTER_VALUE, DECISION, ENTRY, EVIDENCE, MANIFEST, PROPOSAL
from setloom.sources.keyed_json import members


def _toml(spark: SparkSession, path: str) -> dict[str, Any]:
    """A small file kept by hand; missing: empty."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return {}
        raise
    return tomllib.loads(rows[0][0]) if rows else {}


def overrides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skips: file_id, reason; dropped rows: file_id, title; fixes: kind, from_event, to_event, dj)."""
    t = _toml(spark, path)
    return (
        spark.createDataFrame([(x["file_id"], x.get("reason")) for x in t.get("skip", [])], "file_id string, reason string"),
        spark.createDataFrame([(x["file_id"], x["title"]) for x in t.get("drop_row", [])], "file_id string, title string"),
        spark.createDataFrame([(x.get("kind"), x.get("from_event"), x.get("to_event"), x.get("dj")) for x in t.get("fix", [])], "kind string, from_event int, to_event int, dj string"),
    )


def entries(spark: SparkSession, field: str, *paths: str, table: str = "entry") -> DataFrame:
    """Dictionary entries of one or more files, numbered in the order of reading."""
    found = [x for path in paths for x in _toml(spark, path).get(table, [])]
    rows = [(field, i, x.get("id"), x.get("canonical"), x.get("series"), x.get("kind"), [str(v) for v in x.get("variants", [])], x.get("approved"), x.get("confidence"), x.get("source"), x.get("where"), str(x["decided_at"]) if x.get("decided_at") else None, x.get("reason")) for i, x in enumerate(found)]
    return spark.createDataFrame(rows, ENTRY)


def keep_apart(spark: SparkSession, path: str) -> DataFrame:
    pairs = [(x.get("a"), x.get("b")) for x in _toml(spark, path).get("pair", [])]
    return spark.createDataFrame([p for p in pairs if p[0] and p[1]], "a string, b string")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decision log; lines that don't parse are left out."""
    return spark.read.schema(DECISION.replace("where_", "where")).option("mode", "DROPMALFORMED").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """(raw, pos, source, id, title, kind, note, url): one row a hit, and one with a null pos for a value without hits."""
    raw = spark.read.schema(f"evidence {EVIDENCE}").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    each = raw.where("evidence is not null").select(F.explode("evidence").alias("raw", "hits"))
    return each.select("raw", F.posexplode_outer("hits").alias("pos", "hit")).select("raw", "pos", "hit.*")


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, plays) of a published data set."""
    plays = "array<struct<e:int,p:int,dj:string,n:int,t:string,w:string,a:string,r:boolean,u:string,k:string>>"
    raw = spark.read.schema(f"generatedAt string, events array<struct<no:int,date:string,djs:array<string>>>, plays {plays}").option("multiLine", "true").json(path)
    return raw.select(F.inline("events")), expand_plays(raw.select(F.posexplode("plays").alias("ord", "x")).select("ord", "x.*"))


def expand_plays(compact: DataFrame) -> DataFrame:
    """Published columns under their full names."""
    names = {"e": "event_no", "p": "play_order", "n": "track_no", "t": "title", "w": "source_work", "a": "artist", "r": "is_remix", "u": "url", "k": "source_kind"}
    return compact.withColumnsRenamed(names)


def aliases(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(raw, canonical, series, kind, variants, ord) of a published dictionary; ord: the order of its keys. Read in parallel, whatever
    its size; no file, or an empty one, gives no rows."""
    try:
        found = members(spark, path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "raw string, canonical string, series string, kind string, variants array<string>, ord long")
    value = F.from_json("json", "c string, s string, k string, v array<string>")
    rows = found.where(F.col("section") == field).select(F.col("key").alias("raw"), value.alias("v"), "ord")
    return rows.select("raw", F.col("v.c").alias("canonical"), F.col("v.s").alias("series"), F.col("v.k").alias("kind"), F.coalesce("v.v", F.array().cast("array<string>")).alias("variants"), "ord")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    kind = f"array<struct<id:string,field:string,rows:bigint,hints:array<string>,edgeKinds:array<string>,values:array<{CLUSTER_VALUE}>>>"
    return spark.read.schema(f"field string, clusters {kind}").option("multiLine", "true").json(path).select(F.explode("clusters").alias("c")).select("c.*")


def proposals_from_text(replies: DataFrame) -> DataFrame:
    """Proposals out of model replies (ord, reply): the JSON in the text, whatever stands around it; unreadable ones give none."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    group = "struct<cluster_id:string,canonical:string,series:string,kind:string,variants:array<string>,confidence:string,reason:string>"
    parsed = replies.withColumn("p", F.from_json(body, f"groups array<{group}>"))
    out = parsed.select(F.col("ord").alias("reply_ord"), F.posexplode("p.groups").alias("pos", "g"))
    return out.select((F.col("reply_ord") * 1000 + F.col("pos")).alias("ord"), "g.*").select(*[c.split()[0] for c in PROPOSAL.split(", ")])


def no_groups_reason(replies: DataFrame) -> DataFrame:
    """(ord, reason): why a reply gave no proposals; null if it gave some."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    n = F.size(F.from_json(body, "groups array<string>")["groups"])
    reason = F.when(F.trim(F.coalesce("reply", F.lit(""))) == "", "empty").when(body == "", "no-json").when(n.isNull() | (n < 0), "no-groups").when(n == 0, "nothing-proposed")
    return replies.select("ord", reason.alias("reason"))


# answers of outside sources, as they were received -----------------------------------------------------------------------


def wikipedia_hits(answers: DataFrame) -> DataFrame:
    """(raw, hits) from redirect answers (raw, body): the first redirect."""
    r = F.from_json("body", "query struct<redirects:array<struct<from:string,to:string>>,pages:map<string,struct<pageid:bigint,title:string>>>")
    to = r["query"]["redirects"][0]["to"]
    hit = F.struct(F.lit("wikipedia").alias("source"), F.lit("").alias("id"), to.alias("title"), F.lit("redirect").alias("kind"), F.lit("").alias("note"), F.lit("").alias("url"))
    return answers.select("raw", F.when(to.isNotNull() & (to != F.col("raw")), F.array(hit)).otherwise(F.array().cast("array<struct<source:string,id:string,title:string,kind:string,note:string,url:string>>")).alias("hits"))


def wikidata_hits(answers: DataFrame, most: int = 3) -> DataFrame:
    """(raw, hits) from search answers (raw, body): the first `most` entries with an id."""
    found = F.from_json("body", "search array<struct<id:string,label:string,description:string,concepturi:string>>")["search"]
    top = F.slice(F.filter(F.coalesce(found, F.array().cast("array<struct<id:string,label:string,description:string,concepturi:string>>")), lambda x: x["id"].isNotNull()), 1, most)
    return answers.select("raw", F.transform(top, lambda x: F.struct(F.lit("wikidata").alias("source"), x["id"].alias("id"), x["label"].alias("title"), F.lit("search").alias("kind"), F.coalesce(x["description"], F.lit("")).alias("note"), F.coalesce(x["concepturi"], F.lit("")).alias("url"))).alias("hits"))


def musicbrainz_hits(answers: DataFrame) -> DataFrame:
    """(raw, hits) from artist answers (raw, body): the best hit, as `search`, or `alias` if it lists the spelling as one; none if
    it has no id or no name."""
    a = F.from_json("body", "artists array<struct<id:string,name:string,disambiguation:string,aliases:array<struct<name:string>>>>")["artists"][0]
    given = lambda c: F.trim(F.coalesce(c, F.lit("")))
    mbid, name = given(a["id"]), given(a["name"])
    kind = F.when(name == F.col("raw"), "search").when(F.exists(F.coalesce(a["aliases"], F.array().cast("array<struct<name:string>>")), lambda x: F.coalesce(F.trim(x["name"]) == F.col("raw"), F.lit(False))), "alias").otherwise("search")
    hit = F.struct(F.lit("musicbrainz").alias("source"), mbid.alias("id"), name.alias("title"), kind.alias("kind"), F.coalesce(a["disambiguation"], F.lit("")).alias("note"), F.concat(F.lit("https://musicbrainz.org/artist/"), mbid).alias("url"))
    return answers.select("raw", F.when((mbid != "") & (name != ""), F.array(hit)).otherwise(F.array().cast("array<struct<source:string,id:string,title:string,kind:string,note:string,url:string>>")).alias("hits"))
