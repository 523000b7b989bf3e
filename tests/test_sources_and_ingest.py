from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from setloom.operators import ingest
from setloom.sources import dictionaries, setlists, sinks, xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(rows: str, strings: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx_cells(spark, tmp_path):
    shared = "<si><t>No</t></si><si><r><t>half </t></r><r><t>and half</t></r><phoneticPr/></si><si><t>曲</t><rPh><t>きょく</t></rPh></si>"
    cells = ['<c r="B2" t="s"><v>1</v></c>', '<c r="C2" t="s"><v>2</v></c>', '<c r="E2"><v>7</v></c>', '<c r="F2"><v>0.5</v></c>', '<c r="G2" t="b"><v>0</v></c>', '<c r="H2" t="e"><v>#N/A</v></c>', '<c r="AA2" t="inlineStr"><is><t>far out</t></is></c>']
    (tmp_path / "list.xlsx").write_bytes(workbook(f"<row r='2'>{''.join(cells)}</row>", shared))
    got = xlsx.read_xlsx(spark, str(tmp_path)).first().cells
    assert {i: c for i, c in enumerate(got) if c} == {1: "half and half", 2: "曲", 4: "7", 5: "0.5", 6: "FALSE", 26: "far out"}
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    assert xlsx.sheets_of(binary).first().cells == got


def sheet(spark, rows, path="p"):
    return spark.createDataFrame([(path, "s", 0, i, r) for i, r in enumerate(rows)], xlsx.SCHEMA)


def test_headers_anywhere_and_trimmed_records(spark):
    rows = [["my set"], ["列1", "曲名（既出は太字）", "アニメ/元ネタ", "REMIX", "URL"], ["1", "A", "w", "○", ""], ["", "B", "https://x/1", "×", "again"], ["3.0", "C", "-", "", "http://c"], ["", "", "w"], ["", "spare"]]
    got = ingest.sheet_records(sheet(spark, rows)).orderBy("pos").collect()
    assert [(r.track_no, r.title, r.source_work, r.is_remix, r.url) for r in got] == [(1, "A", "w", True, None), (2, "B", None, False, "https://x/1"), (3, "C", None, None, "http://c")]


def test_number_column_without_header(spark):
    rows = [["", "タイトル"], *[[str(i), f"t{i}"] for i in range(1, 7)]]
    got = ingest.sheet_records(sheet(spark, rows)).orderBy("pos").collect()
    assert [r.track_no for r in got] == [1, 2, 3, 4, 5, 6]
    assert ingest.sequence_quality(ingest.sheet_records(sheet(spark, rows)), ["path"]).first().quality == 1.0


def test_texts_in_both_forms(spark):
    blocks = "1.曲A\nTVアニメ『作品』 OP\nURL：https://a/1\n\n2．曲B\nhttps://b\n"
    bare = "【見出し】\n一曲目\n\n――\n二曲目\n"
    rows = spark.createDataFrame([("a", blocks), ("b", bare)], "path string, text string")
    got = setlists.text_tracks(rows).orderBy("path", "pos").collect()
    assert [(r.path, r.track_no, r.title, r.source_work, r.url) for r in got] == [("a", 1, "曲A", "作品", "https://a/1"), ("a", 2, "曲B", None, "https://b"), ("b", 1, "一曲目", None, None), ("b", 2, "二曲目", None, None)]


def test_folders_become_a_manifest(spark, tmp_path):
    for p in ("第3回_20240102/01_alice/set.txt", "第3回_20240102/01_alice/01-song.mp3", "第3回_20240102/xx_bob/flyer.txt", "other/01_x/a.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    djs = setlists.crawl(setlists.files_below(spark, str(tmp_path))).orderBy("dj").collect()
    assert [(d.event_no, str(d.event_date), d.dj, d.play_order, [s.name for s in d.setlists], d.media_files) for d in djs] == [(3, "2024-01-02", "alice", 1, ["set.txt"], ["01-song.mp3"]), (3, "2024-01-02", "bob", None, [], ["flyer.txt"])]


def test_addresses(spark):
    ok = "https://drive.google.com/drive/folders/abc_-1"
    rows = [ok, "http://drive.google.com/drive/folders/a", "https://evil.com/drive/folders/a", "https://u@drive.google.com/drive/folders/a", "https://drive.google.com:1/drive/folders/a"]
    got = [r.i for r in spark.createDataFrame([(r,) for r in rows], "u string").select(setlists.folder_id(F.col("u")).alias("i")).collect()]
    assert got == ["abc_-1", None, None, None, None]


def test_dispatch(spark):
    files = spark.createDataFrame([("1", "a.pdf"), ("2", "b.pdf"), ("3", "c.XLSX"), ("4", "d.doc")], "id string, name string")
    got = {r.id: (r.reader, r.skipped_reason is None) for r in setlists.dispatch(files, spark.createDataFrame([("1",)], "id string")).collect()}
    assert got == {"1": ("manual", True), "2": (None, False), "3": ("xlsx", True), "4": (None, False)}


def test_names_as_tracks(spark):
    djs = spark.createDataFrame([(1, "a", ["02-b_c.mp3", "1. a.wav", "10_z.mp3", "cover.jpg"]), (1, "b", ["1-x.mp3"])], "event_no int, dj string, media_files array<string>")
    assert [(r.dj, r.track_no, r.title) for r in ingest.names_as_tracks(djs).orderBy("track_no").collect()] == [("a", 1, "a"), ("a", 2, "b c"), ("a", 3, "z")]


FILES = "event_no int, dj string, pos int, track_no int, title string, source_work string, artist string, is_remix boolean, url string, play_order int, source_kind string"
MASTER = "event_no int, dj string, ord int, track_no int, title string, source_work string, artist string, is_remix boolean, url string, play_order int"


def test_merge_prefers_files_and_fills_gaps(spark):
    djs = spark.createDataFrame([(1, "a", None, 0), (1, "b", None, 4), (1, "c", None, None)], "event_no int, dj string, event_date date, play_order int").withColumn("dj_folder", F.col("dj"))
    files = spark.createDataFrame([(1, "a", 1, 0, "x", None, "art", None, None, None, "xlsx"), (1, "a", 2, 2, "y", "w", None, False, None, None, "xlsx")], FILES)
    master = spark.createDataFrame([(1, "a", 1, 1, "x", "old", "m", True, "u", 7), (1, "a", 2, 1, "x", "new", "m", True, "u", 7), (1, "b", 3, 5, "z", None, None, None, None, 9), (2, "d", 4, 1, "q", None, None, None, None, None)], MASTER)
    inferred = spark.createDataFrame([(1, "c", 1, "n"), (1, "b", 1, "n")], "event_no int, dj string, track_no int, title string")
    got = {(r.dj, r.track_no): (r.title, r.source_work, r.artist, r.is_remix, r.play_order, r.source_kind, r.confidence) for r in ingest.merge(djs, files, master, inferred).collect()}
    assert got == {("a", 1): ("x", "new", "art", True, 7, "xlsx", "high"), ("a", 2): ("y", "w", None, False, None, "xlsx", "high"), ("b", 5): ("z", None, None, None, 4, "master-db", "medium"), ("c", 1): ("n", None, None, None, None, "filename", "low")}
    assert [(r.dj, r.rows) for r in ingest.master_orphans(master, djs).collect()] == [("d", 1)]


def test_master_fixes(spark):
    rows = spark.createDataFrame([(0, ["回"]), (1, ["1", "2", "dj", "3", "T", "W", "A", "○", "no link"]), (2, ["", "", "dj", "", "T"])], "row_idx int, cells array<string>")
    fixes = spark.createDataFrame([("move_event", 1, 4, "dj")], "kind string, from_event int, to_event int, dj string")
    (r,) = ingest.master_rows(rows, fixes).collect()
    assert (r.event_no, r.play_order, r.track_no, r.is_remix, r.url) == (4, 2, 3, True, None)


def test_dictionary_files(spark, tmp_path):
    p = tmp_path / "d.toml"
    p.write_text('[[entry]]\nid="1"\ncanonical="A"\nvariants=["a","A"]\napproved=true\nconfidence="high"\n[[pair]]\na="x"\nb="y"\n', encoding="utf-8")
    assert dictionaries.entries(spark, "work", str(p)).first().variants == ["a", "A"]
    assert dictionaries.keep_apart(spark, str(p)).count() == 1 and dictionaries.keep_apart(spark, str(tmp_path / "none.toml")).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"action":"accept","variants":["a"]}\nnot json\n', encoding="utf-8")
    assert dictionaries.decisions(spark, str(log)).count() == 1
    reply = spark.createDataFrame([(0, 'Sure: {"groups":[{"cluster_id":"c","canonical":"A","variants":["a"]}]} done'), (1, "no")], "ord long, reply string")
    assert [r.cluster_id for r in dictionaries.proposals_from_text(reply).collect()] == ["c"]
    assert [r.reason for r in dictionaries.no_groups_reason(reply).orderBy("ord").collect()] == [None, "no-json"]


def test_sinks(spark, tmp_path):
    from setloom.plans import playlog

    plays = playlog.plays(spark, "/root/testdata/sf0.001").limit(50)
    for c in ("dj_folder", "url", "note", "source_file_id", "source_file_name", "source_kind", "confidence"):
        plays = plays.withColumn(c, F.lit("x"))
    plays = plays.withColumns({"bpm": F.lit(1.0), "year": F.lit(1)})
    sinks.plays_csv(plays, str(tmp_path / "c"))
    sinks.paste_tsv(plays, str(tmp_path / "t"))
    sinks.plays_table(plays, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 50 == spark.read.parquet(str(tmp_path / "p")).count()
    none = spark.createDataFrame([], "event_no int, dj string, file_rows long, master_rows long, rows long")
    assert "## Events" in sinks.report(plays, none, none, none)


def test_cells_lose_white_space_at_their_ends_alone(spark):
    from setloom.functions import values

    spaces = [chr(c) for c in range(0x3001) if chr(c) in values.WHITE]
    rows = [(f"{a}x{b}y{a}{b}",) for a in spaces for b in spaces[:4]] + [("",), (None,), (" ",), ("\u200bx",)]
    df = spark.createDataFrame(rows, "t string").select(values.clean_ends(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b"))
    assert len(spaces) == 25 and df.where("not (a <=> b)").count() == 0


def test_joins_by_file_are_never_broadcast(spark):
    """Stored tables show their compressed size only, so Spark took a row a file for small and gathered them on the driver."""
    from setloom.plans import stored

    routed = stored._routed(spark, "/root/testdata/sf0.001")
    for df in routed:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_a_header_is_named_by_one_key_a_cell(spark):
    rows = [("p", "s", 0, 0, ["ｎｏ．", "曲　名", "", None, "-", "ＲＥＭＩＸ？"]), ("p", "s", 0, 1, ["1", " ｘ　", "", None, "-", "○"])]
    sheets = spark.createDataFrame(rows, "path string, sheet string, sheet_no int, row_idx int, cells array<string>")
    got = ingest.sheet_records(sheets).select("track_no", "title", "is_remix", "source_work").collect()
    assert [tuple(r) for r in got] == [(1, "x", True, None)]
    plan = ingest.header_rows(sheets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 5  # it was made for each name that it is compared with
