from __future__ import annotations

import json
import random
import tomllib

from pyspark.sql import functions as F

from setloom.operators import resolve, review
from setloom.plans import entrypoints
from setloom.sources import documents

ENTRY = "field string, ord long, id string, canonical string, series string, kind string, variants array<string>, approved boolean, confidence string, source string, decided_at string, reason string"


def entry(spark, *rows):
    return spark.createDataFrame([(f, i, f"e{i}", c, s, k, v, True, "high", "human", "t", "r") for i, (f, c, s, k, v) in enumerate(rows)], ENTRY)


def read_parts(spark, path):
    return "".join(r.value + "\n" for r in spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect())


def test_export_is_one_document_and_the_same_on_rerun(spark, tmp_path):
    works = entry(spark, ("work", "Stars!", "S", "work", ["stars", 'st"ars', "夜"]), ("work", "Nights", None, None, ["夜", "nights"]))
    artists = entry(spark, ("artist", "Ann", None, None, ["ANN"]))
    out = []
    for i, parts in enumerate((1, 5)):
        counts, warnings = entrypoints.export_aliases(works.repartition(parts), artists, "2024-01-01", f"{tmp_path}/{i}")
        out.append(read_parts(spark, f"{tmp_path}/{i}"))
        assert {(r.section, r.classes, r.spellings) for r in counts.collect()} == {("works", 2, 6), ("artists", 1, 2)}
        assert [tuple(r) for r in warnings.collect()] == [("works", "夜", "Stars!", "Nights")]
    assert out[0] == out[1]
    got = json.loads(out[0])
    assert got["generatedAt"] == "2024-01-01" and set(got["works"]) == {"stars", 'st"ars', "夜", "Stars!", "nights", "Nights"} and got["artists"]["ANN"]["c"] == "Ann"
    empty = documents.aliases_document(works.limit(0), artists.limit(0), "d")[0]
    documents.write_pieces(empty, f"{tmp_path}/e")
    assert json.loads(read_parts(spark, f"{tmp_path}/e")) == {"generatedAt": "d", "works": {}, "artists": {}}


def test_published_log_is_one_document(spark, tmp_path):
    rows = [(2, "2024-02-01", 1, "b", 1, "t", "w", "a", True, None, "xlsx"), (1, "2024-01-01", 0, "z", 2, "u", None, None, None, "https://x", "txt"), (1, "2024-01-01", 3, "a", None, "v", "", "", False, None, "txt"), (1, "2024-01-01", 3, "a", None, "v", "", "", False, None, "txt")]
    plays = spark.createDataFrame(rows, "event_no int, event_date string, play_order int, dj string, track_no int, title string, source_work string, artist string, is_remix boolean, url string, source_kind string")
    documents.write_pieces(documents.plays_document(plays.withColumn("event_date", F.to_date("event_date")), "now"), f"{tmp_path}/p")
    got = json.loads(read_parts(spark, f"{tmp_path}/p"))
    assert [e["no"] for e in got["events"]] == [1, 2] and got["events"][0]["djs"] == ["a", "z"]
    assert [(p["e"], p["dj"], p["t"]) for p in got["plays"]] == [(1, "a", "v"), (1, "a", "v"), (1, "z", "u"), (2, "b", "t")] and got["plays"][2]["r"] is None


def test_toml_strings_read_back(spark):
    texts = ["", "plain", 'say "hi"', "back\\slash", "tab\tand\x01\x7f", "two\nlines", '\nquotes "" at """ the end"', "a\r\nb", "日本"]
    rows = [("work", f"n{i}", t, None, [t, "x"]) for i, t in enumerate(texts)]
    text = "\n".join(r.text for r in documents.toml_blocks(entry(spark, *rows)).orderBy("ord").collect())
    got = tomllib.loads(text)["entry"]
    assert [e["series"] for e in got] == texts and [e["variants"][0] for e in got] == texts and all(e["approved"] is True and "kind" not in e for e in got)


def test_block_decide_approve_and_undo(spark):
    plays = spark.createDataFrame([(1, f"d{i % 2}", f"song{i % 3}", w, "a") for i, w in enumerate(["Moon Saga", "MOON SAGA", "moonsaga", "Moon Saga", "Other Thing"])], "event_no int, dj string, title string, source_work string, artist string")
    none = spark.createDataFrame([], "a string, b string")
    log = spark.createDataFrame([], "id string, field string, action string, variants array<string>")
    found = entrypoints.block(plays, "work", decisions=log, apart=none)
    rows = found.clusters.collect()
    assert len(rows) == 1 and rows[0].members == ["MOON SAGA", "Moon Saga", "moonsaga"] and rows[0].rows == 4
    assert found.totals.first().asDict() == {"total_values": 4, "clustered": 3, "singletons": 1}
    payload = spark.createDataFrame([(rows[0].id, "work", "accept", "Moon Saga", "work", "high", ["MOON SAGA", "Moon Saga"], "same"), ("x", "work", "accept", "", "work", "high", ["q"], "r")], "id string, field string, action string, canonical string, kind string, confidence string, variants array<string>, reason string")
    done = entrypoints.decide(payload, log, entry(spark).limit(0), none, "t1")
    assert {r.id: r.code for r in done.checked.collect()} == {rows[0].id: None, "x": "invalid"} and done.entries.count() == done.log.count() == 1
    proposals = spark.createDataFrame([(0, rows[0].id, "Moon Saga", None, "work", rows[0].members, "high", "why")], "ord long, cluster_id string, canonical string, series string, kind string, variants array<string>, confidence string, reason string")
    run = entrypoints.approve(found.clusters, proposals, log, entry(spark).limit(0), none, "work", "t2")
    assert [(r.canonical, r.decided_at) for r in run.entries.collect()] == [("Moon Saga", "t2")] and run.audit.count() == 1
    left, audit = entrypoints.undo(run.entries, "t3", run="t2")
    assert left.count() == 0 and [(r.action, r.at) for r in audit.collect()] == [("auto-undo", "t3")] and entrypoints.undo(run.entries, "t3", run="t1")[0].count() == 1
    left, audit = entrypoints.undo(run.entries, "t3")
    assert left.count() == 0 and [r.at for r in audit.collect()] == ["t3"]
    assert entrypoints.undo(run.entries, "t3", field="artist")[0].count() == 1 and entrypoints.undo(run.entries, "t3", field="work")[0].count() == 0
    again = entrypoints.block(plays, "work", decisions=log, auto=run.entries, apart=none)
    assert again.clusters.count() == 0


def test_decisions_are_by_field(spark):
    kinds = "id string, field string, action string, canonical string, kind string, confidence string, variants array<string>, reason string"
    log = spark.createDataFrame([("0", "work", "accept", ["Seen"]), ("1", "artist", "reject", ["Gone"]), ("2", "work", "defer", ["Later"])], "id string, field string, action string, variants array<string>")
    entries = entry(spark, ("work", "Name", None, "work", ["Foo"]), ("artist", "", None, None, ["Bar"]))
    auto = entry(spark, ("artist", "Auto", None, None, ["Made"]))
    none = spark.createDataFrame([], "a string, b string")
    rows = [
        ("a", "artist", "accept", "Foo", None, None, ["Foo"], "r", None),  # the work of that spelling is another matter
        ("b", "work", "accept", "Foo", "work", None, ["Foo"], "r", "conflict"),
        ("c", "artist", "reject", None, None, None, ["Seen"], "r", None),
        ("d", "work", "reject", None, None, None, ["Seen"], "r", "already-decided"),
        ("e", "artist", "accept", "Gone", None, None, ["Gone"], "r", "already-decided"),
        ("f", "work", "accept", "Gone", "work", None, ["Gone"], "r", None),
        ("g", "work", "accept", "Later", "work", "low", ["Later"], "r", None),
        ("h", "work", "accept", "X", None, None, ["X"], "r", "invalid"),  # a work needs a kind
        ("i", "artist", "accept", "X", "odd", None, ["X"], "r", "invalid"),
        ("j", "artist", "defer", None, None, None, None, " ", "invalid"),  # everything needs a reason
        ("k", "artist", "reject", None, None, None, None, "r", None),
        ("l", "artist", "accept", "Auto", None, None, ["Made", "Other"], "r", None),  # an automatic entry decides nothing
        ("m", "artist", "accept", "Made", None, None, ["Made"], "r", "conflict"),
        ("n", "artist", "accept", "Name", None, None, ["X"], "r", "invalid"),  # a work's name grounds no artist
        ("n", "work", "accept", "Name", "work", None, ["Y"], "r", None),  # the same id twice
        ("o", "work", "accept", "Seen", None, None, ["Seen"], "r", "already-decided"),
        ("p", "artist", "accept", "Bar", None, None, ["Bar"], "r", None),
        (None, "work", "defer", None, None, None, None, "r", "invalid"),
    ]
    payload = spark.createDataFrame([r[:8] for r in rows], kinds)
    done = entrypoints.decide(payload, log, entries, none, "t", auto=auto)
    order = lambda xs: sorted(xs, key=str)
    assert order((r.id, r.field, r.code) for r in done.checked.collect()) == order((r[0], r[1], r[8]) for r in rows)
    plays = spark.createDataFrame([(1, "d", "s", w, w) for w in ("Gone", "GONE", "Seen", "seen", "new", "NEW")], "event_no int, dj string, title string, source_work string, artist string")
    both = spark.createDataFrame([("1", "artist", "reject", ["Gone", "GONE"])], "id string, field string, action string, variants array<string>")
    assert {tuple(r.members) for r in entrypoints.block(plays, "work", decisions=both).clusters.collect()} == {("Seen", "seen"), ("NEW", "new")}


def test_build_gives_the_log_and_its_faults(spark):
    djs = spark.createDataFrame([(1, "a", "01_a", 1), (1, "b", "02_b", 2), (1, "c", "03_c", 3)], "event_no int, dj string, dj_folder string, play_order int").withColumn("event_date", F.lit("2024-01-01").cast("date"))
    track = "title string, source_work string, artist string, is_remix boolean, url string, bpm double, year int, note string"
    files = spark.createDataFrame([(1, "a", i, i, f"t{i}", None, None, None, None, None, None, None) for i in (1, 2)], f"event_no int, dj string, pos int, track_no int, {track}").withColumns({"play_order": F.lit(None).cast("int"), "source_file_id": F.lit("f"), "source_file_name": F.lit("n"), "source_kind": F.lit("xlsx"), "file_id": F.lit("f")})
    master = spark.createDataFrame([(1, d, 1, n, 1, f"m{d}{n}", "w", "x", None, None, None, None, None) for d, n in (("a", 1), ("b", 1), ("z", 1))], f"event_no int, dj string, play_order int, track_no int, ord int, {track}")
    drops = spark.createDataFrame([("f", "t2")], "file_id string, title string")
    got = entrypoints.build_plays(djs, files, master, drops=drops)
    assert {(r.dj, r.title, r.source_work) for r in got.plays.collect()} == {("a", "t1", "w"), ("b", "mb1", "w")}
    assert [r.dj for r in got.missing.collect()] == ["c"] and [r.dj for r in got.orphans.collect()] == ["z"] and got.mismatch.count() == 0


def test_review_choices(spark):
    values = spark.createDataFrame([("c", 0, "A (OP)", 5, "A", None), ("c", 1, "a", 9, None, None), ("c", 2, "B", 1, None, "Bee"), ("d", 0, "x", 1, None, None)], "id string, pos int, raw string, rows long, base string, decided_as string")
    proposals = spark.createDataFrame([(0, "c", "A!", ["a", "B"]), (1, "c", "no", ["A (OP)"]), (0, "d", "D", ["gone"])], "ord long, cluster_id string, canonical string, variants array<string>")
    checked = review.initial_checked(values, proposals)
    assert {(r.id, r.raw): r.checked for r in checked.collect()} == {("c", "A (OP)"): False, ("c", "a"): True, ("c", "B"): False, ("d", "x"): True}
    options = review.canonical_options(checked, proposals).orderBy("id", "place").collect()
    assert [(r.id, r.value, r.registered) for r in options] == [("c", "a", False), ("c", "A!", False), ("c", "Bee", True), ("d", "x", False), ("d", "D", False)]
    clusters = spark.createDataFrame([("c", ["series-risk"], ["agg", "odd"])], "id string, hints array<string>, edge_kinds array<string>")
    assert review.draft_reasons(clusters, values).first().reason == "「a」9 / 「A (OP)」5 / 「B」1。\nequal without marks\n※ joined by a part of the name only"
    pairs = spark.createDataFrame([("LISA", "Elisa"), ("x", ""), ("p", "q")], "a string, b string")
    lines = review.keep_apart_lines(pairs, spark.createDataFrame([(0, "lisa 主題歌"), (1, "none")], "batch int, raw string"))
    assert [(r.batch, r.line) for r in lines.collect()] == [(0, "- 「LISA」 ≠ 「Elisa」")]
    cards = spark.createDataFrame([("c", "work", " A ", None, "work", "high", "r", ["a", "b"], []), ("d", "work", "B", None, "odd", "high", "r", ["a", "b"], []), ("e", "artist", "", None, None, "low", "r", ["a"], ["h"])], "id string, field string, canonical string, series string, kind string, confidence string, reason string, checked array<string>, hints array<string>")
    assert {r.id: (r.eligible, r.preset) for r in review.bulk_rows(cards, ["work"]).collect()} == {"c": (True, True), "d": (False, False), "e": (False, False)}
    assert [(r.id, r.canonical) for r in review.payloads(cards, "accept").orderBy("id").collect()] == [("c", "A"), ("d", "B")]
    assert [r.id for r in review.payloads(cards, "keep-apart").orderBy("id").collect()] == ["c", "d"] and review.payloads(cards, "defer").count() == 3


def test_drafted_reasons_name_what_is_shared(spark):
    clusters = spark.createDataFrame([("c", [], ["agg"]), ("d", [], [])], "id string, hints array<string>, edge_kinds array<string>")
    rows = [("c", 0, "A", 5, ["x", "y", "z", "w", "v"], ["t"], []), ("c", 1, "a", 9, ["w", "v", "z", "y", "q"], ["u"], []), ("d", 0, "B", 1, ["x"], ["t"], ["k"])]
    values = spark.createDataFrame(rows, "id string, pos int, raw string, rows long, djs array<string>, co_titles array<string>, co_artists array<string>")
    got = {r.id: r.reason for r in review.draft_reasons(clusters, values).collect()}
    assert got == {"c": "「a」9 / 「A」5。\nequal without marks\nthe same DJs use all of them: v、w、y", "d": "「B」1。"}


def test_batches_are_those_of_one_pass(spark):
    rnd = random.Random(5)
    rows = [(f, i, f"{f}{i:03}", rnd.choice([1, 5, 20, 45, 90])) for f, n in (("a", 130), ("b", 7), ("c", 16)) for i in range(n)]
    items = spark.createDataFrame(rnd.sample(rows, len(rows)), "field string, ord long, id string, tokens long")
    for chunk in (1, 9, 50, 4096):
        got = resolve.pack_batches(items, 10, most_tokens=80, most_items=4, chunk=chunk).collect()
        want = set()
        for f in "abc":
            batch, used, n = 0, 10, 0
            for _, _, i, t in (r for r in rows if r[0] == f):
                if n and (used + t > 80 or n >= 4):
                    batch, used, n = batch + 1, 10, 0
                used, n = used + t, n + 1
                want.add((f, batch, i, t))
        assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert resolve.pack_batches(items.limit(0), 10).count() == 0
