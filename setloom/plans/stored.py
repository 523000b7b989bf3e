"""Registered queries over stored forms of the tables: files read as one set, answers kept, indexes, layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.operators import lookup, requests, resolve
from setloom.operators.staging import shared_dir, staged
from setloom.plans import folders
from setloom.plans.catalogue import ORDERED_SQL, _ordered, named, registered
from setloom.plans.playlog import PLAYS_SQL, named_sql, plays, read
from setloom.sources import loose_toml, routing
from setloom.sources.answers import AnswerStore


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# files of several formats as one set ------------------------------------------------------------------------------------------

ROUTED_SQL = f"""{ORDERED_SQL}, f AS (
    SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS event_no, o_custkey::VARCHAR AS dj, ['xlsx', 'xlsx', 'txt', 'pdf', 'docx', 'xlsx'][1 + o_orderkey % 6] AS suffix,
        o_orderkey % 10 = 1 AS skip, o_orderkey % 6 = 3 AND o_orderkey % 4 = 3 AS hand, o_orderkey % 6 = 5 AS broken FROM orders
), g AS (SELECT *, CASE WHEN hand THEN 'manual' WHEN suffix IN ('xlsx', 'txt') THEN suffix END AS kind FROM f),
h AS (SELECT *, CASE WHEN skip THEN 'a draft' WHEN kind IS NULL AND suffix = 'pdf' THEN 'no text in PDF; give a transcription' WHEN kind IS NULL THEN 'unsupported: ' || suffix WHEN broken THEN 'unreadable: BadZipFile' END AS reason FROM g),
t AS (
    SELECT h.*, o.title, o.work, o.artist, CASE o.flag WHEN 'R' THEN true WHEN 'A' THEN false END AS mark, o.pos, row_number() OVER (PARTITION BY h.id ORDER BY o.pos) AS nth
    FROM h JOIN o ON o.path = h.id WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM o x WHERE x.path = h.id AND x.path % 7 = 0 AND x.pos = 1 AND x.title = o.title)
), s AS (
    SELECT id, event_no, dj, CASE WHEN kind = 'txt' THEN 1 ELSE 3 + (count(mark) > 0)::INTEGER END AS fields, CASE WHEN count(*) < 3 THEN 0 ELSE round_even(10.0 * count(*) FILTER (pos = nth) / count(*), 0) END AS tenths,
        CASE WHEN kind = 'txt' THEN 0 ELSE 2 * count(*) + count(mark) END AS filled, count(*) AS rows FROM t GROUP BY id, event_no, dj, kind
), b AS (SELECT id, rows, row_number() OVER (PARTITION BY event_no, dj ORDER BY fields DESC, tenths DESC, filled DESC, rows DESC, id) = 1 AS best FROM s)"""


def _routed(spark: SparkSession, d: str) -> routing.Routed:
    return routing.read_set_lists(*folders.set_list_files(spark, d, _ordered(spark, d)))


@registered(f"WITH {ROUTED_SQL} SELECT event_no, dj, id::VARCHAR AS source_file_id, kind AS source_kind, pos::INTEGER AS track_no, title, CASE WHEN kind <> 'txt' THEN work END AS source_work, CASE WHEN kind <> 'txt' THEN artist END AS artist, CASE WHEN kind <> 'txt' THEN mark END AS is_remix FROM t JOIN b USING (id) WHERE best")
def routed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The tracks of each customer's best file of a year."""
    return _routed(spark, d).records.select("event_no", "dj", "source_file_id", "source_kind", "track_no", "title", "source_work", "artist", "is_remix")


@registered(f"WITH {ROUTED_SQL} SELECT event_no, dj, h.id::VARCHAR AS id, id || '.' || suffix AS name, kind AS source_kind, CASE WHEN reason IS NOT NULL THEN NULL WHEN kind = 'manual' THEN id || '.' || suffix WHEN b.rows IS NULL THEN NULL WHEN kind = 'txt' THEN 'bare-title-list' ELSE 'sheet=set' END AS detail, CASE WHEN reason IS NULL THEN coalesce(b.rows, 0) END AS rows, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN best THEN 'chosen' ELSE 'tried' END AS outcome, reason FROM h LEFT JOIN b USING (id)")
def routed_audit(spark: SparkSession, d: str) -> DataFrame:
    """What became of every file: chosen, tried, or skipped and why."""
    return _routed(spark, d).audit.drop("pos")


# answers kept by request -------------------------------------------------------------------------------------------------------


@registered("""WITH a AS (SELECT DISTINCT p_brand AS brand, p_type AS type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT p_brand AS brand, p_type AS type, p_type NOT LIKE 'PROMO%' AND EXISTS (SELECT 1 FROM a WHERE a.brand = p_brand AND a.type = p_type) AS hit FROM part)
SELECT brand, type, sha256('{"ask":{"brand":"' || brand || '","type":"' || type || '"},"model":"m","temperature":null}') AS key, hit, CASE WHEN type NOT LIKE 'PROMO%' THEN lower(type) || '/' || brand END AS response,
    (SELECT count(*) FROM b WHERE NOT hit) AS asked, (SELECT count(*) FROM b WHERE type LIKE 'PROMO%') AS asked_again FROM b""")
def answers_kept(spark: SparkSession, d: str) -> DataFrame:
    """Requests about parts: those of returned lines are asked first, then all, then all again. Some are never answered."""
    part = read(spark, d, "part").select("p_partkey", F.struct(F.col("p_type").alias("type"), F.col("p_brand").alias("brand")).alias("ask"))
    line = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    more = {"model": F.lit("m"), "temperature": F.lit(None).cast("double")}
    wanted = part.select("ask").distinct().withColumns(more)
    first = part.join(line, "p_partkey", "left_semi").select("ask").distinct().withColumns(more)

    def answer(requests: DataFrame) -> DataFrame:
        field = lambda name: F.get_json_object("request", f"$.ask.{name}")
        return requests.select("key", F.when(~field("type").startswith("PROMO"), F.concat(F.lower(field("type")), F.lit("/"), field("brand"))).alias("response"))

    store = AnswerStore(spark, _folder(spark, "answers"))
    store.ask(first, answer)
    second = store.ask(wanted, answer)
    out = staged(second.answers, "answers-kept")
    again = store.ask(wanted, answer)
    return out.select("ask.brand", "ask.type", "key", "hit", "response", F.lit(second.asked).cast("long").alias("asked"), F.lit(again.asked).cast("long").alias("asked_again"))


# lookups -------------------------------------------------------------------------------------------------------------------------

STACK_SQL = "replace(lower(title || ' ' || source_work || ' ' || artist || ' ' || coalesce(array_to_string(work_variants, ' '), '') || ' ' || coalesce(work_series, '') || ' ' || coalesce(array_to_string(artist_variants, ' '), '')), ' ', '')"


@registered(f"WITH {named_sql()}, s AS (SELECT *, {STACK_SQL} AS k FROM named), q AS (SELECT 'ring steel' AS query, ['ring', 'steel'] AS ws UNION ALL SELECT 'e ax nickel', ['e', 'ax', 'nickel'] UNION ALL SELECT '01', ['01'] UNION ALL SELECT 'nowhere ring', ['nowhere', 'ring']) SELECT query, event_no, dj, title, count(*) AS plays FROM s JOIN q ON len(list_filter(ws, lambda w: NOT contains(k, w))) = 0 GROUP BY ALL")
def search_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Words of several lengths, looked up in an index of all plays."""
    path = _folder(spark, "search-index")
    lookup.write_index(named(spark, d), path)
    asked = ("ring steel", "e ax nickel", "01", "nowhere ring")
    hits = [lookup.search_index(spark, path, q).select(F.lit(q).alias("query"), "event_no", "dj", "title") for q in asked]
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return found.groupBy("query", "event_no", "dj", "title").agg(F.count("*").alias("plays"))


LOOKED_UP = [(None, "Supplier#000000003", None), (None, None, "blue anvil (DJ Remix)"), (1995, "Supplier#000000007", None), (None, "Supplier#000000003", "red ring"), (None, "nobody", None)]


def _asked_sql() -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join(f"({n}, {', '.join(map(lit, q))})" for n, q in enumerate(LOOKED_UP))


@registered(f"WITH {PLAYS_SQL}, q AS (SELECT * FROM (VALUES {_asked_sql()}) t(n, e, d, t)) SELECT n::INTEGER AS asked, event_no, dj, title, artist, count(*) AS plays FROM plays JOIN q ON (e IS NULL OR e = event_no) AND (d IS NULL OR d = dj) AND (t IS NULL OR t = title) GROUP BY ALL")
def lookups_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The log written with its indexes, and asked by DJ, title and event."""
    path, none = _folder(spark, "log"), F.lit(None)
    missing = {"dj_folder": "string", "url": "string", "bpm": "double", "year": "int", "note": "string", "source_file_id": "string", "source_file_name": "string", "source_kind": "string", "confidence": "string"}
    lookup.write_log(plays(spark, d).withColumns({c: none.cast(t) for c, t in missing.items()}), path)
    hits = [lookup.lookup(spark, path, *q).select(F.lit(n).alias("asked"), "event_no", "dj", "title", "artist") for n, q in enumerate(LOOKED_UP)]
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return found.groupBy("asked", "event_no", "dj", "title", "artist").agg(F.count("*").alias("plays"))


# requests and runs -----------------------------------------------------------------------------------------------------------------


@registered("""WITH m AS (SELECT CASE WHEN p_size <= 25 THEN p_brand ELSE p_brand || '/' || p_size END AS id, p_partkey AS k, p_name, p_type, p_brand, p_size, 'p' || p_partkey AS raw FROM part),
l AS (SELECT *, lag(raw) OVER (PARTITION BY id ORDER BY k) AS prev FROM m),
j AS (
    SELECT id, k, raw, prev, '{"raw":"' || raw || '","rows":' || k % 7 || CASE WHEN k % 5 > 0 THEN ',"djs":[' || array_to_string(list_transform(range(1, 1 + least(3, k % 5)), lambda i: '"d' || i || '"'), ',') || ']' ELSE '' END
        || ',"coTitles":["' || p_name || '"]' || CASE WHEN k % 2 = 0 THEN ',"coArtists":["' || p_brand || '","' || p_type || '","x"]' ELSE '' END || CASE WHEN k % 4 = 0 THEN ',"alsoAnArtistName":true' ELSE '' END || '}' AS card,
        CASE k % 3 WHEN 1 THEN '"' || raw || '":[]' WHEN 0 THEN '"' || raw || '":[{"source":"wikidata","title":"T' || p_size || '","kind":"search","note":"' || substr(repeat(p_name || ' ', 30), 1, 100) || '"},{"source":"wikidata","title":"' || p_name || '","kind":"redirect"},{"source":"","title":"","kind":""}]' END AS res,
        CASE WHEN prev IS NOT NULL THEN '["' || prev || '","' || raw || '","' || CASE WHEN k % 3 = 0 THEN 'agg,bigram' ELSE 'agg' END || '"]' END AS edge
    FROM l
), r AS (
    SELECT id, '{"cluster_id":"' || id || '","hints":[' || CASE WHEN contains(id, '/') THEN '"series-risk"' ELSE '' END || '],"candidates":[' || string_agg(card, ',' ORDER BY k) || ']'
        || CASE WHEN count(edge) <= 12 THEN ',"edges":[' || coalesce(string_agg(edge, ',' ORDER BY k), '') || ']' ELSE ',"edgeKinds":["agg","bigram"]' END
        || CASE WHEN count(res) > 0 THEN ',"api_results":{' || string_agg(res, ',' ORDER BY k) || '}' ELSE '' END || '}' AS request
    FROM j GROUP BY id
) SELECT id, request, ceil(length(request) / 4)::BIGINT AS tokens FROM r""")
def cluster_requests(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of parts as the documents that a model is shown: some with many edges, some values without answers."""
    k, raw = F.col("p_partkey"), F.concat(F.lit("p"), "p_partkey")
    m = read(spark, d, "part").select(F.when(F.col("p_size") <= 25, F.col("p_brand")).otherwise(F.concat_ws("/", "p_brand", "p_size")).alias("id"), raw.alias("raw"), "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    none = F.array().cast("array<string>")
    djs = F.transform(F.slice(F.array(*[F.lit(f"d{i}") for i in range(1, 5)]), F.lit(1), (k % 5).cast("int")), lambda x: x)
    values = m.select("id", k.alias("pos"), "raw", (k % 7).alias("rows"), djs.alias("djs"), F.array("p_name").alias("co_titles"), F.when(k % 2 == 0, F.array("p_brand", "p_type", F.lit("x"), F.lit("y"))).otherwise(none).alias("co_artists"), none.alias("co_works"), (k % 4 == 0).alias("cross_field"))
    edge = F.struct(F.lag("raw").over(Window.partitionBy("id").orderBy("p_partkey")).alias("a"), F.col("raw").alias("b"), F.when(k % 3 == 0, F.array(F.lit("agg"), F.lit("bigram"))).otherwise(F.array(F.lit("agg"))).alias("kinds"))
    pairs = m.select("id", "p_partkey", edge.alias("e")).where("e.a is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "e"))), lambda x: x["e"]).alias("pairs"))
    clusters = m.select("id").distinct().join(pairs, "id", "left").select("id", F.when(F.col("id").contains("/"), F.array(F.lit("series-risk"))).otherwise(none).alias("hints"), F.array(F.lit("agg"), F.lit("bigram")).alias("edge_kinds"), "pairs")
    text = lambda c: F.lit(None).cast("string") if c is None else c
    hit = lambda s, t, kind, note: F.struct(text(s).alias("source"), text(t).alias("title"), text(kind).alias("kind"), text(note).alias("note"))
    w, title = F.lit("wikidata"), F.concat(F.lit("T"), "p_size")
    hits = F.array(hit(w, title, F.lit("search"), F.concat(F.lit("Wikidata 検索: "), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(30)))), hit(w, title, F.lit("search"), F.lit("again")), hit(w, F.col("p_name"), F.lit("redirect"), F.lit("to it")), hit(None, None, None, None), hit(w, F.lit("one too many"), F.lit("search"), None))
    evidence = m.where(k % 3 != 2).select("raw", F.when(k % 3 == 0, hits).otherwise(F.slice(hits, 1, 0)).alias("hits"))
    return requests.packed_clusters(clusters, values, evidence)


@registered("""WITH n AS (SELECT user_id AS run, event_id AS ord, event_type <> 'click' AS failed, value > 10 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
k AS (SELECT *, sum(failed::INTEGER) OVER (PARTITION BY run ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS bad FROM n),
s AS (SELECT run, min(n) AS stop FROM k WHERE bad = 10 GROUP BY run)
SELECT run, count(*) FILTER (stop IS NULL OR n <= stop) AS fetched, count(*) FILTER ((stop IS NULL OR n <= stop) AND NOT failed AND hit) AS hits, count(*) FILTER ((stop IS NULL OR n <= stop) AND (failed OR NOT hit)) AS misses,
    count(*) FILTER ((stop IS NULL OR n <= stop) AND failed) AS failed, count(*) FILTER (n > stop) AS "left", string_agg(CASE WHEN n > stop THEN ord END, ',' ORDER BY ord) AS open FROM n LEFT JOIN s USING (run) GROUP BY run""")
def asking_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a run of questions: clicks are answered, the rest fails; where runs stop, and what they leave."""
    log = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("raw"), F.when(F.col("value") > 10, 2).otherwise(0).alias("hits"), (F.col("event_type") != "click").alias("failed"))
    rows, totals = requests.asking_run(log)
    left = rows.where("outcome = 'left'").groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("open"))
    return totals.join(left, "run", "left")


@registered("""WITH e AS (SELECT p_brand AS path, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS ord, * FROM part)
SELECT path, ord, 'p' || p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 'say "' || p_name || '"' END AS canonical,
    CASE p_size % 3 WHEN 0 THEN 'size ' || p_size || chr(10) || '[[entry]]' || chr(10) || 'id = "no"' || chr(10) WHEN 1 THEN p_type END AS series, CASE WHEN p_size % 7 = 0 THEN 'cut off' || chr(10) || '[[entry]]' ELSE p_name || '|' || p_type || '|]' END AS variants FROM e""")
def loose_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary files by brand with values over several lines, broken lines, and values that look like headers."""
    size, q = F.col("p_size"), F.lit('"')
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    series = F.when(size % 3 == 0, line('series = """size ', size.cast("string"), '\n[[entry]]\nid = "no"\n"""')).when(size % 3 == 1, line('  series = """', F.col("p_type"), '"""  ')).otherwise("series = 5")
    several = line("variants = [\n  ", q, F.col("p_name"), q, ",\n# ", q, F.col("p_type"), q, "\n", q, "]", q, ",\n ]")
    canonical = F.when(size % 5 == 0, line("canonical = ", F.col("p_name"))).otherwise(line('canonical = "say \\"', F.col("p_name"), '\\""'))
    lists = F.when(size % 7 == 0, line("variants = [\n", q, "cut off\n[[entry]]", q, "\n]")).otherwise(several)
    entry = F.array_join(F.array(F.lit("[[entry]]"), line("id = ", q, "p", F.col("p_partkey").cast("string"), q), F.lit("# a note"), canonical, F.lit("approved = true"), series, F.lit("= broken ["), lists), "\n")
    texts = read(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_join(F.concat(F.array(F.lit('id = "too early"\nx = [')), F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"])), "\n").alias("text"))
    got = loose_toml.loose_tables(texts).groupBy("path", F.col("table").alias("ord"))
    value = lambda c: F.max(F.when(F.col("key") == c, F.col("text"))).alias(c)
    return got.agg(value("id"), value("canonical"), value("series"), F.max(F.when(F.col("key") == "variants", F.array_join("items", "|"))).alias("variants"))


# the review queue ----------------------------------------------------------------------------------------------------------------

QUEUE_SQL = """m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'work' ELSE 'artist' END AS field, p_brand || '/' || p_size AS id, 'p' || p_partkey AS raw, p_partkey AS k FROM part),
l AS (SELECT 'work' AS field, 'p' || ps AS raw FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) UNION SELECT 'artist', 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)"""


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of parts in both fields, and a log that settles what was returned."""
    part = read(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "work").otherwise("artist").alias("field"), F.concat_ws("/", "p_brand", "p_size").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("raw"))
    clusters = part.groupBy("field", "id").agg(F.array_sort(F.collect_list("raw")).alias("members"))
    line = read(spark, d, "lineitem").where("l_linenumber = 1")
    log = line.select(F.when(F.col("l_returnflag") == "R", "work").otherwise("artist").alias("field"), F.when(F.col("l_returnflag") == "R", "accept").when(F.col("l_returnflag") == "A", "reject").otherwise("defer").alias("action"), F.array(F.concat(F.lit("p"), "l_partkey")).alias("variants"))
    return clusters, log


@registered(f"WITH {QUEUE_SQL}, c AS (SELECT m.field, id, count(*) FILTER (l.raw IS NULL) AS open FROM m LEFT JOIN l ON l.field = m.field AND l.raw = m.raw GROUP BY ALL), a AS (SELECT field, count(DISTINCT id) AS auto_approved FROM m WHERE k % 3 = 0 GROUP BY 1) SELECT field, count(*) AS total, count(*) FILTER (open = 0) AS decided, any_value(auto_approved) AS auto_approved, sum(open)::BIGINT AS open_values FROM c JOIN a USING (field) GROUP BY field")
def queue_counters(spark: SparkSession, d: str) -> DataFrame:
    clusters, log = _queue(spark, d)
    auto = clusters.select("field", "id", F.explode("members").alias("raw")).where(F.substring("raw", 2, 20).cast("long") % 3 == 0)
    return resolve.queue_counters(clusters, resolve.decided_by_field(log), auto)


@registered("""WITH h AS (SELECT p_partkey AS k, p_brand AS name, 'n' || p_size AS a, 'p' || p_partkey AS b, p_size % 2 = 0 AS human FROM part), v AS (SELECT k, name, human, unnest([a, b, name]) AS raw FROM h)
SELECT 'work' AS field, raw, arg_min(name, (CASE WHEN human THEN 0 ELSE 1 END, k)) AS canonical FROM v GROUP BY raw""")
def assigned_names(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries of parts, one kept by hand and one automatic, that share spellings."""
    p = read(spark, d, "part").select(F.lit("work").alias("field"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("canonical"), F.array(F.concat(F.lit("n"), "p_size"), F.concat(F.lit("p"), "p_partkey")).alias("variants"), "p_size")
    return resolve.assigned_names(p.where("p_size % 2 = 0"), p.where("p_size % 2 <> 0"))
