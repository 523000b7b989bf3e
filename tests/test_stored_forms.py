"""Files read as one set, answers kept by request, the index of grams, and the layout for lookups."""

from __future__ import annotations

import hashlib
import json
import os
import random
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from setloom.operators import graph, lookup, query, requests
from setloom.plans.folders import workbook
from setloom.sources import answers, routing, setlists
from setloom.sources.answers import AnswerStore

NAMES = "event_no int, dj string, pos long, id string, name string, content binary"


# routing ---------------------------------------------------------------------------------------------------------------------


def test_folders_are_read_as_one_set(spark, tmp_path):
    folder = tmp_path / "第7回_20240203" / "01_ミク"
    folder.mkdir(parents=True)
    full = [["曲順", "曲名", "作品", "歌手"], ["1", "Ａ", "W", "X"], ["2", "B", "W", "Y"], ["3", "C", "", "Z"]]
    (folder / "b set.XLSX").write_bytes(workbook([("memo", [["曲名"], ["only"]]), ("本番", full)]))
    (folder / "a list.txt").write_bytes("﻿【set】\nA\nB\nC\nD\n".encode())
    (folder / "c broken.xlsx").write_bytes(b"nothing")
    (folder / "d.pdf").write_bytes(b"%PDF")
    (folder / "e.docx").write_bytes(b"doc")
    for name in ("mix.wmv", "clip.m4v", "slides.pptx", "talk.key", "readme.txt", "Flyer1.txt", "ポスター.xlsx", "x.numbers"):
        (folder / name).write_bytes(b"?")
    (tmp_path / "第7回_20240203" / "素材" / "x").mkdir(parents=True)
    files = routing.candidates(routing.files_with_content(spark, str(tmp_path)))
    assert sorted(r.name for r in files.select("name").collect()) == ["a list.txt", "b set.XLSX", "c broken.xlsx", "d.pdf", "e.docx"]
    none = spark.createDataFrame([], "file_id string, reason string")
    ids = {r.name: r.id for r in files.select("name", "id").collect()}
    manual = spark.createDataFrame([(ids["d.pdf"], "曲名,作品\nP,\n".encode())], "id string, content binary")
    drops = spark.createDataFrame([(ids["b set.XLSX"], "A")], "file_id string, title string")
    records, audit = routing.read_set_lists(files, manual, none, drops)
    got = {r.name: (r.outcome, r.source_kind, r.detail, r.rows, r.reason) for r in audit.collect()}
    assert got == {
        "a list.txt": ("tried", "txt", "bare-title-list", 4, None),
        "b set.XLSX": ("chosen", "xlsx", "sheet=本番", 2, None),
        "c broken.xlsx": ("skipped", "xlsx", None, None, "unreadable: BadZipFile"),
        "d.pdf": ("tried", "manual", "d.pdf", 1, None),
        "e.docx": ("skipped", None, None, None, "unsupported: docx"),
    }
    rows = sorted((r.event_no, r.dj, r.track_no, r.title, r.source_work, r.artist, r.source_file_name, r.source_kind) for r in records.collect())
    assert rows == [(7, "ミク", 2, "B", "W", "Y", "b set.XLSX", "xlsx"), (7, "ミク", 3, "C", None, "Z", "b set.XLSX", "xlsx")]


def test_ties_skips_and_empty_files(spark):
    one = "曲名\nA\n".encode()
    files = spark.createDataFrame(
        [(1, "x", 2, "f2", "2.txt", b"A\nB"), (1, "x", 1, "f1", "1.txt", b"C\nD"), (1, "y", 1, "f3", "3.txt", b""), (2, "x", 1, "f4", "4.txt", b"E"), (2, "z", 1, "f5", None, None), (3, "z", 1, "f6", "6.pdf", one)], NAMES
    )
    skips = spark.createDataFrame([("f4", "old"), ("f4", "older")], "file_id string, reason string")
    empty = spark.createDataFrame([], "file_id string, title string")
    manual = spark.createDataFrame([("f6", one), ("f9", one), ("f6", one)], "id string, content binary")
    records, audit = routing.read_set_lists(files, manual, skips, empty)
    got = {r.id: (r.outcome, r.rows, r.reason) for r in audit.collect()}
    assert got == {"f1": ("chosen", 2, None), "f2": ("tried", 2, None), "f3": ("tried", 0, None), "f4": ("skipped", None, "old"), "f5": ("skipped", None, "unsupported: "), "f6": ("chosen", 1, None)}
    assert sorted(r.title for r in records.collect()) == ["A", "C", "D"]


# answers -----------------------------------------------------------------------------------------------------------------------


def test_keys_are_of_all_fields_in_any_order(spark):
    a = spark.sql("SELECT 1 AS b, struct(2 AS y, array(struct(1 AS q, null AS p)) AS x) AS a, map('k', 1, 'c', 2) AS m, cast(null AS string) AS n")
    b = a.select("n", "m", F.struct(F.col("a.x"), F.col("a.y")).alias("a"), "b")
    row, other = answers.keyed(a).first(), answers.keyed(b).first()
    want = {"a": {"x": [{"p": None, "q": 1}], "y": 2}, "b": 1, "m": {"c": 2, "k": 1}, "n": None}
    text = json.dumps(want, separators=(",", ":"))
    assert row.request == other.request == text
    assert row.key == hashlib.sha256(text.encode()).hexdigest()
    assert answers.keyed(a.drop("n")).first().key != row.key


def test_a_second_run_asks_nothing(spark, tmp_path):
    store, seen = AnswerStore(spark, str(tmp_path / "s")), []

    def answer(requests):
        seen.append(sorted(r.request for r in requests.collect()))
        return requests.select("key", F.when(~F.col("request").contains("mute"), F.upper("request")).alias("response"))

    first = spark.createDataFrame([("a",), ("b",), ("a",), ("mute",)], "q string")
    got = store.ask(first, answer)
    assert got.asked == 3 and len(seen[0]) == 3
    assert sorted((r.q, r.response, r.hit) for r in got.answers.collect() if r.q != "mute") == [("a", '{"Q":"A"}', False), ("a", '{"Q":"A"}', False), ("b", '{"Q":"B"}', False)]
    got = store.ask(first.where("q <> 'mute'"), answer)
    assert got.asked == 0 and len(seen) == 1
    assert {(r.q, r.hit) for r in got.answers.collect()} == {("a", True), ("b", True)}
    assert store.ask(first, answer).asked == 1  # a null is no answer
    assert store.ask(first.limit(0), answer).asked == 0
    assert store.read().count() == 2 == store.compact().count()


def test_writers_at_once_store_a_key_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [spark.createDataFrame([(f"k{i}", "r", f"w{n}") for i in range(n, n + 6)], answers.SCHEMA) for n in range(4)]
    errors = []

    def write(n: int) -> None:
        try:
            AnswerStore(spark, path).store(rows[n])
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = AnswerStore(spark, path)
    assert not errors
    assert sorted(r.key for r in store.read().collect()) == [f"k{i}" for i in range(9)]
    assert store.generations() == [f"gen-{i:06d}" for i in range(len(store.generations()))]
    assert not [n for n in os.listdir(path) if n.startswith("_draft")]


def test_a_taken_number_and_an_unfinished_draft_do_no_harm(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = AnswerStore(spark, path)
    assert store.store(spark.createDataFrame([("a", "r", "1"), ("a", "r", "0"), ("b", "r", None)], answers.SCHEMA)) == 1
    os.makedirs(f"{path}/_draft-left")
    stale = iter([[], store.generations()])
    monkeypatch.setattr(store, "generations", lambda: next(stale))  # the first look is from before the other writer
    assert store.store(spark.createDataFrame([("a", "r", "9"), ("c", "r", "2")], answers.SCHEMA)) == 1
    assert {(r.key, r.response) for r in AnswerStore(spark, path).read().collect()} == {("a", "0"), ("c", "2")}


def test_a_number_taken_after_the_look_loses_no_answer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store, real = AnswerStore(spark, path), spark._jvm.org.apache.hadoop.fs
    one, two = (spark.createDataFrame([("a", "r", w), (k, "r", w)], answers.SCHEMA) for k, w in (("b", "1"), ("c", "2")))

    def rename(source, target, none):  # as FileContext does on local disks, with the other writer after its look
        assert not store._files.exists(target)
        assert AnswerStore(spark, path).store(two) == 2
        monkeypatch.undo()
        store._files.rename(source, target)

    context = SimpleNamespace(getFileContext=lambda *_: SimpleNamespace(rename=rename))
    fs = SimpleNamespace(Path=real.Path, Options=real.Options, FileContext=context)
    monkeypatch.setattr(store, "_jvm", SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=fs)))))
    assert store.store(one) == 1
    assert {(r.key, r.response) for r in store.read().collect()} == {("a", "2"), ("b", "1"), ("c", "2")}
    assert store.generations() == ["gen-000000", "gen-000001"]
    assert not [f for _, folders, _ in os.walk(path) for f in folders if f.startswith("_draft")]


# the index of grams --------------------------------------------------------------------------------------------------------------


def _plays(spark, rows: int = 3000):
    rng = random.Random(6)
    words = ["red", "ring", "blue", "steel", "日本", "の", "夢", "x", "ab", "abc", "zebra", "lake"]
    data = [(i, rng.randrange(5), "".join(rng.choices(words, k=rng.randrange(0, 6)))) for i in range(rows)]
    return spark.createDataFrame([*data, (rows, 1, None), (rows + 1, 1, "")], "n int, event_no int, haystack string")


def test_the_index_finds_what_the_scan_finds(spark, tmp_path):
    plays, path = _plays(spark), str(tmp_path / "i")
    lookup.write_index(plays, path, files=4)
    for asked in ("", " 　", "ring", "RING steel", "日本の", "夢", "x", "ab x", "zebra lake", "zebralake x", "redringblue", "nothing", "ring nothing", "zz"):
        got = sorted(r.n for r in lookup.search_index(spark, path, asked).collect())
        want = sorted(r.n for r in query.search(plays, asked).collect())
        assert got == want, asked
    assert lookup.search_index(spark, path, "・").count() == plays.count()  # a word of marks alone is none


def test_many_candidates_are_joined_and_an_empty_log_is_fine(spark, tmp_path, monkeypatch):
    plays, path = _plays(spark, 400), str(tmp_path / "i")
    lookup.write_index(plays, path, files=3)
    monkeypatch.setattr(lookup, "PLACES", 2)
    assert sorted(r.n for r in lookup.search_index(spark, path, "ring").collect()) == sorted(r.n for r in query.search(plays, "ring").collect())
    lookup.write_index(plays.limit(0), path, files=3)
    assert lookup.search_index(spark, path, "ring").count() == lookup.search_index(spark, path, "r").count() == 0


def _scanned(df) -> dict[str, list[int]]:
    """Rows that each file scan of an executed plan put out, by the folder it reads."""
    df.collect()
    out: dict[str, list[int]] = {}

    def walk(node) -> None:  # noqa: ANN001
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            where = node.relation().location().rootPaths().mkString().split("/")[-1]
            m = node.metrics()
            out.setdefault(where, []).append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


def test_the_index_reads_few_rows(spark, tmp_path):
    rows = 20_000
    plays = spark.range(rows).select(F.col("id").alias("n"), F.concat(F.lit("title"), F.hex(F.xxhash64("id")).substr(1, 8), F.when(F.col("id") == 777, "needle").otherwise("")).alias("haystack"))
    path = str(tmp_path / "i")
    lookup.write_index(plays, path, files=8, rows_a_group=200)
    hits = lookup.search_index(spark, path, "needle title")
    assert [r.n for r in hits.collect()] == [777]
    scan = _scanned(hits)
    assert sum(r for r, _ in scan["plays"]) <= rows // 8  # a file's share at most, where a search reads all


# the layout for lookups ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    none = F.lit(None).cast("string")
    plays = spark.range(6000).select(
        (F.col("id") % 12).cast("int").alias("event_no"), F.concat(F.lit("dj"), (F.col("id") % 60).cast("string")).alias("dj"), F.concat(F.lit("t"), (F.col("id") % 3001).cast("string")).alias("title"), F.col("id").cast("int").alias("track_no"),
        *[none.alias(c) for c in ("event_date", "play_order", "dj_folder", "source_work", "artist", "is_remix", "url", "bpm", "year", "note", "source_file_id", "source_file_name", "source_kind", "confidence")],
    )
    path = str(tmp_path_factory.mktemp("layout") / "log")
    lookup.write_log(plays, path, files=24, buckets=16)
    return plays, path


@pytest.mark.parametrize("asked", [{"dj": "dj7"}, {"title": "t5"}, {"event_no": 3}, {"dj": "dj7", "title": "t7"}, {"event_no": 3, "dj": "dj3"}, {"event_no": 99}, {"dj": "nobody"}, {}])
def test_lookups_find_what_a_filter_finds(spark, laid_out, asked):
    plays, path = laid_out
    got = sorted(int(r.track_no) for r in lookup.lookup(spark, path, buckets=16, **asked).collect())
    want = plays
    for c, v in asked.items():
        want = want.where(F.col(c) == v)
    assert got == sorted(r.track_no for r in want.collect())


def test_lookups_read_few_files(spark, laid_out):
    _, path = laid_out
    whole = sum(len([f for f in files if f.endswith(".parquet")]) for _, _, files in os.walk(f"{path}/plays"))
    for asked in ({"dj": "dj7"}, {"title": "t5"}):
        scan = _scanned(lookup.lookup(spark, path, buckets=16, **asked))
        index = next(v for k, v in scan.items() if k.startswith("by_"))
        assert sum(f for _, f in index) == 1  # one bucket of the index
        assert sum(f for _, f in scan["plays"]) <= whole / 4  # the events that it names
    text = lookup.lookup(spark, path, buckets=16, dj="dj7")._jdf.queryExecution().toString()
    assert "dynamicpruning" in text.lower() and "bucket" in text


def test_large_events_lie_over_many_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(1).alias("event_no"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("dj"), F.lit("t").alias("title"))
    more = [c for c in lookup.PLAY_COLUMNS if c not in rows.columns]
    lookup.write_log(rows.withColumns({c: F.lit(None).cast("string") for c in more}), str(tmp_path / "l"), files=8)
    assert len([f for f in os.listdir(tmp_path / "l" / "plays" / "event_no=1") if f.endswith(".parquet")]) >= 6


# requests and runs ---------------------------------------------------------------------------------------------------------------------


def test_requests_are_capped(spark):
    hit = "struct<source:string,title:string,kind:string,note:string>"
    clusters = spark.createDataFrame([("c", ["h"], ["agg"], [("a", "b", ["agg", "x"])]), ("d", [], ["agg", "edit"], [(f"v{i}", f"v{i + 1}", ["agg"]) for i in range(13)]), ("e", None, None, None)], "id string, hints array<string>, edge_kinds array<string>, pairs array<struct<a:string,b:string,kinds:array<string>>>")
    values = spark.createDataFrame(
        [("c", 1, "b", 2, ["x", "y", "z", "w"], [], None, ["k"], False), ("c", 0, "a", 1, [], ["t"], ["u"], [], True), ("d", 0, "v", 1, [], [], [], [], False)],
        "id string, pos int, raw string, rows long, djs array<string>, co_titles array<string>, co_artists array<string>, co_works array<string>, cross_field boolean",
    )
    long = "é" * 150
    hits = [("w", "T", "search", requests.SEARCH_PREFIX + long), ("w", "T", "search", "again"), ("w", "U", "redirect", "n"), ("w", None, None, None), ("w", "", "search", "n"), ("w", "V", "search", "late")]
    evidence = spark.createDataFrame([("a", []), ("b", hits), ("z", hits), ("v", None)], f"raw string, hits array<{hit}>")
    got = {r.id: json.loads(r.request) for r in requests.packed_clusters(clusters, values, evidence).collect()}
    assert got["c"] == {
        "cluster_id": "c", "hints": ["h"], "edges": [["a", "b", "agg,x"]],
        "candidates": [{"raw": "a", "rows": 1, "coTitles": ["t"], "coArtists": ["u"], "alsoAnArtistName": True}, {"raw": "b", "rows": 2, "djs": ["x", "y", "z"], "coWorks": ["k"]}],
        "api_results": {"a": [], "b": [{"source": "w", "title": "T", "kind": "search", "note": "é" * 100}, {"source": "w", "title": "U", "kind": "redirect"}, {"source": "w", "title": "", "kind": ""}]},
    }
    assert got["d"] == {"cluster_id": "d", "hints": [], "candidates": [{"raw": "v", "rows": 1}], "edgeKinds": ["agg", "edit"]}
    assert got["e"] == {"cluster_id": "e", "hints": [], "candidates": [], "edges": []}


def test_runs_stop_after_failures_in_a_row(spark):
    rng = random.Random(3)
    rows = [(run, i, f"{run}{i}", rng.randrange(2), rng.random() < p) for run, n, p in (("a", 120, 0.7), ("b", 3, 1.0), ("c", 60, 0.2), ("d", 9, 1.0), ("e", 41, 0.9)) for i in range(n)]
    log = spark.createDataFrame(rng.sample(rows, len(rows)), "run string, ord int, raw string, hits int, failed boolean")
    for most, chunk in ((4, 5), (4, 1), (1, 7), (5, 4096)):
        want = {}
        for run in "abcde":
            bad, over = 0, False
            for _, i, raw, hits, failed in (r for r in rows if r[0] == run):
                want[raw] = "left" if over else "failed" if failed else "hit" if hits else "miss"
                bad = bad + 1 if failed else 0
                over |= bad >= most
        got, totals = requests.asking_run(log, most=most, chunk=chunk)
        assert {r.raw: r.outcome for r in got.collect()} == want
        assert sum(r.fetched + r.left for r in totals.collect()) == len(rows)
    assert requests.asking_run(log.limit(0))[1].count() == 0


def test_profiles_count_without_sets(spark):
    rows = [(e, f"d{i % 7}", f"t{i % 11}", w, f"a{i % 5}" if i % 3 else None) for i, (e, w) in enumerate([(1, " W "), (2, "W"), (None, "W"), (2, "V"), (3, ""), (3, None)] * 9)]
    plays = spark.createDataFrame(rows, "event_no int, dj string, title string, source_work string, artist string")
    got = {r.raw: r.asDict() for r in graph.value_profiles(plays, "source_work").collect()}
    assert set(got) == {"W", "V"}
    for raw, r in got.items():
        own = [x for x in rows if (x[3] or "").strip() == raw]
        events, djs, titles, others = ({x[k] for x in own if x[k] is not None} for k in (0, 1, 2, 4))
        assert (r["rows"], r["events"], r["djs"], r["titles"], r["others"]) == (len(own), len(events), len(djs), len(titles), len(others))
        assert (r["first_event"], r["last_event"]) == (min(events), max(events))
        assert (r["dj_sample"], r["title_sample"], r["other_sample"]) == tuple(sorted(x)[:4] for x in (djs, titles, others))
