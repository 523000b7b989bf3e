from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from setloom.operators import query
from setloom.plans import catalogue
from setloom.streaming import log

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    ran = sql.execute(catalogue.SQL[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"components_capped", "cluster_hints"}))
def test_other_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0 and set(driver.oracle_sql()) <= set(driver.queries())


def test_tiers_are_disjoint_and_short_words_are_left_alone(spark):
    rows = [(i, k, b) for i, (k, b) in enumerate([("恋のうた", "恋のうた"), ("ラララ", "ラララ"), ("硝子ド-ル", "硝子ド-ル"), ("硝子ド-ルremix", "硝子ド-ル"), ("", ""), ("x", "x")])]
    plays = spark.createDataFrame(rows, "i int, key string, base string")
    asked = spark.createDataFrame([(q,) for q in ("恋", "ラ", "硝子ドール", "x y", "ほか")], "query string")
    tiers = query.played_tiers(plays, asked)
    got = {(r.query, r.i): r.tier for r in tiers.collect()}
    assert got == {("恋", 0): 3, ("硝子ドール", 2): 1, ("硝子ドール", 3): 2, ("x y", 5): 3}
    assert {r["query"] for r in query.verdicts(tiers, asked).where("is_new").collect()} == {"ラ", "ほか"}


def test_decisions_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i, line in enumerate(['{"action":"accept","variants":["a","b"]}', '{"action":"defer","variants":["c"]}']):
        (src / f"{i}.json").write_text(line)
        log.append_to(log.decided_stream(log.decision_stream(spark, str(src))), str(out), str(tmp_path / "cp")).awaitTermination()
    assert {r.raw for r in spark.read.parquet(str(out)).collect()} == {"a", "b"}


def test_names_are_joined_without_moving_the_plays(spark):
    """Dealt by a column of few different values, most plays met in a few tasks."""
    for df in (catalogue.canonical(spark, D), catalogue.named(spark, D)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["merge_master_coalesce", "source_selection", "master_orphans"])
def test_files_master_and_folders_are_one_pass_over_the_log(spark, monkeypatch, name):
    """Each pass shuffles all line items anew."""
    made, plays = [], catalogue.playlog.plays
    monkeypatch.setattr(catalogue.playlog, "plays", lambda *a: made.append(a) or plays(*a))
    assert catalogue.QUERIES[name](spark, D).count() > 0
    assert len(made) == 1


def test_keys_are_made_once_a_title_not_once_a_part(spark, monkeypatch):
    """A filter on a key that Spark moves below the distinct makes keys of all parts."""
    seen, tiers = [], query.played_tiers
    monkeypatch.setattr(catalogue.query, "played_tiers", lambda plays, *a, **k: seen.append(plays) or tiers(plays, *a, **k))
    assert catalogue.played_partial_han(spark, D).count() > 0
    plan = seen[0].where("key is not null").select("key")._jdf.queryExecution().optimizedPlan().toString()
    assert "nfkc" not in plan


def test_texts_are_made_before_their_lines_are_read(spark):
    """Both forms of text made the texts anew, in the tasks that sort their lines."""
    df = catalogue.text_set_lists(spark, D)
    assert df.count() > 0
    assert "l_linenumber" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["top_titles", "top_works_kind_filtered", "top_artists", "top_titles_of_event"])
def test_rankings_do_not_sort_the_plays_of_a_task(spark, monkeypatch, name):
    """The least of a struct, taken over the log, held all plays of a task in a sort."""
    plans, stage = {}, query.staged
    monkeypatch.setattr(query, "staged", lambda df, label: plans.update({label: df._jdf.queryExecution().sparkPlan().toString()}) or stage(df, label))
    assert catalogue.QUERIES[name](spark, D).count() > 0
    whole = [p for label, p in plans.items() if "l_orderkey" in p or label in ("rank-counts", "rank-djs")]
    assert len(whole) >= 3 and not [p for p in whole if "SortAggregate" in p]
    assert "lead" in plans["rank-first"].split("SortAggregate")[-1]  # what is sorted has been joined to its least lead


@pytest.mark.parametrize("limit", [None, 2])
@pytest.mark.parametrize("fields", [("event_no", "play_order", "dj", "track_no"), ("event_no", "track_no", "dj"), ("dj", "event_no", "play_order", "track_no"), ("event_no", "track_no", "play_order", "raw", "dj")])
def test_rank_equals_plain_version(spark, fields, limit):
    """Missing numbers, DJs and spellings, equal leads, orders that begin otherwise."""
    ends = (None, -(2**31), 2**31 - 1, 0, 1)
    names = ["event_no", "play_order", "dj", "track_no", "k", "l", "raw"]
    rows = [(ends[i % 5], ends[i * i % 5], ("b", "a", None, "c")[i * 7 % 11 % 4], i % 3, ("x", "y", "z", "", None)[i % 7 % 5], "lmn"[i % 4 % 3], ("r", None, "s", "xl", "")[i * 3 % 13 % 5]) for i in range(200)]
    rows = [dict(zip(names, (*r[:5], f"{r[4]}{r[5]}", r[6]), strict=True)) for r in rows]

    def order(r):
        return [(r[f] is not None, r[f] if r[f] is not None else 0) for f in (*fields, "l", "raw")]

    groups = {}
    for r in sorted(rows, key=order):
        if r["k"]:
            groups.setdefault(r["k"], []).append(r)
    want = []
    for of in groups.values():
        label = of[0]["l"]
        djs, raws = (list(dict.fromkeys(r[c] for r in of if r[c] is not None)) for c in ("dj", "raw"))
        raws = [x for x in raws if x not in ("", label)]
        want.append((label, len(of), (f"{label} ← {'、'.join(raws)} / " if raws else "") + "・".join(djs)))
    want.sort(key=lambda w: (-w[1], w[0]))
    plays = spark.createDataFrame([tuple(r.values()) for r in rows], "event_no int, play_order int, dj string, track_no int, k string, l string, raw string")
    got = query.rank(plays, F.col("k"), F.col("l"), F.struct(*fields, "l", *[c for c in ("raw",) if c not in fields]), limit, F.col("raw"))
    assert [tuple(r) for r in got.collect()] == want[:limit]
