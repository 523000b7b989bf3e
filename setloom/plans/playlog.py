"""The driver's tables read as a play log, and small dictionaries for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = "raw string, canonical string, series string, kind string, variants array<string>, ord long"
WORKS = [
    ("ECONOMY", "Economy", "Classic", "work", ["ECONOMY", "Economy"], 0),
    ("promo ", "Promo", None, "vocaloid", ["promo "], 1),
    ("LARGE", "Large", None, None, ["LARGE", "large"], 2),
    ("large", "Big", None, "work", ["large"], 3),
    ("sm all", "Small", "Sizes", "work", ["sm all", "Little"], 4),
]
ARTISTS = [
    ("Brand#1", "Brand One", None, None, ["Brand#1", "Brand One"], 0),
    ("BRAND#2", "Brand Two", None, None, ["BRAND#2", "Zwei"], 1),
    ("brand #21", "Brand Two", None, None, ["brand #21"], 2),
    ("Brand#3", "Brand#3", None, None, ["Brand#3", "Tres"], 3),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays: an order's year is the event, the supplier the DJ, the part the title, its type the work."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("event_no"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    n = F.col("l_linenumber") % 4
    suffix = F.when(n == 0, "").when(n == 1, " (DJ Remix)").when(n == 2, " -2011 remix-").otherwise(" [Bootleg]")
    return rows.select(
        "event_no", F.make_date("event_no", F.lit(1), F.lit(1)).alias("event_date"), F.col("s_nationkey").alias("play_order"), F.col("s_name").alias("dj"), F.col("l_linenumber").alias("track_no"),
        F.concat("p_name", suffix).alias("title"), F.col("p_type").alias("source_work"), F.col("p_brand").alias("artist"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("is_remix"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("ord"),
    )


def works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORKS, ALIASES)


def artists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTISTS, ALIASES)


#: The same in SQL. The tables' texts are ASCII, so case and blanks are all that the keys fold here.
PLAYS_SQL = """plays AS (
    SELECT year(o_orderdate)::INTEGER AS event_no, make_date(year(o_orderdate), 1, 1) AS event_date, s_nationkey AS play_order, s_name AS dj,
        l_linenumber AS track_no, p_name || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN ' (DJ Remix)' WHEN 2 THEN ' -2011 remix-' ELSE ' [Bootleg]' END AS title,
        p_type AS source_work, p_brand AS artist, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS is_remix, l_returnflag AS flag,
        l_orderkey AS ord, replace(p_name, ' ', '') AS base
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def _values(rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, list):
            return "[" + ", ".join(map(lit, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def dictionary_sql(name: str, rows: list[tuple]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {_values(rows)}) t(raw, canonical, series, kind, variants, ord))"


def named_sql() -> str:
    """plays with canonical names, in two stages for each field."""
    parts = [PLAYS_SQL, dictionary_sql("works", WORKS), dictionary_sql("artists", ARTISTS)]
    for d in ("works", "artists"):
        parts.append(f"{d}_key AS (SELECT replace(lower(raw), ' ', '') AS k, arg_min(raw, ord) AS raw FROM {d} GROUP BY 1)")
    parts.append(
        "named AS (SELECT p.*, coalesce(w1.canonical, w2.canonical, p.source_work) AS work_canon, CASE WHEN w1.raw IS NOT NULL THEN w1.series ELSE w2.series END AS work_series, "
        "CASE WHEN w1.raw IS NOT NULL THEN w1.kind ELSE w2.kind END AS work_kind, coalesce(w1.variants, w2.variants) AS work_variants, "
        "coalesce(a1.canonical, a2.canonical, p.artist) AS artist_canon, coalesce(a1.variants, a2.variants) AS artist_variants "
        "FROM plays p LEFT JOIN works w1 ON w1.raw = p.source_work LEFT JOIN works_key wk ON wk.k = replace(lower(p.source_work), ' ', '') LEFT JOIN works w2 ON w2.raw = wk.raw "
        "LEFT JOIN artists a1 ON a1.raw = p.artist LEFT JOIN artists_key ak ON ak.k = replace(lower(p.artist), ' ', '') LEFT JOIN artists a2 ON a2.raw = ak.raw)"
    )
    return ", ".join(parts)
