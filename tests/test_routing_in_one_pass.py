"""Set lists read, made and judged without dealing their rows out again and again."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from setloom.operators import ingest
from setloom.plans.folders import workbook
from setloom.sources import routing, xlsx


def test_sheets_are_dealt_once_and_meet_no_join(spark):
    rows = spark.createDataFrame([("p", "s", 0, 0, ["曲名"]), ("p", "s", 0, 1, ["x"])], xlsx.SCHEMA)
    plan = ingest.best_sheet(ingest.sheet_records(rows))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
    executed = ingest.best_sheet(ingest.sheet_records(rows))._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1


def test_number_columns_and_best_sheets_of_odd_workbooks(spark):
    """Second columns of a field and unnamed ones may count, first columns of any field may not; the first of equal sheets wins."""
    count = [str(i) for i in range(1, 6)]
    sheets = {
        ("a", 0): [["曲名", "曲名", "dj"], *[[f"t{i}", i, i] for i in count]],  # the second title column counts
        ("a", 1): [["曲名", "dj"], *[[f"u{i}", i] for i in count]],  # a DJ's column is named
        ("b", 0): [["曲名", "", "no"], *[[f"v{i}", i, "x"] for i in count]],  # there is a number header
        ("b", 1): [["曲名", ""], *[[f"w{i}", i if i != "3" else "4"] for i in count]],
        ("c", 0): [["曲名", ""], ["x", "１."], ["-", "2"], ["y", "-"], ["z", "３"], ["", "4"], ["q", "5回"], ["r", ""]],
        ("d", 0): [["x"], *[["y"]] * 12, ["曲名"], ["too late"]],
        ("e", 0): [["曲名"], ["one"]], ("e", 1): [["曲名"], ["two"]],
        ("f", 0): [["曲名", "歌手"], ["曲名", "年", "歌手"], ["s", "2001年", "x"], None],
    }
    rows = spark.createDataFrame([(p, f"s{n}", n, i, r) for (p, n), table in sheets.items() for i, r in enumerate(table)], xlsx.SCHEMA)
    records = ingest.sheet_records(rows)
    got = {k: [(r.track_no, r.title) for r in records.where(f"path = '{k[0]}' and sheet_no = {k[1]}").orderBy("pos").collect()] for k in sheets}
    assert got[("a", 0)] == [(int(i), f"t{i}") for i in count]
    assert got[("a", 1)] == [(None, f"u{i}") for i in count]
    assert got[("b", 0)] == [(None, f"v{i}") for i in count]
    assert got[("b", 1)] == [(None, f"w{i}") for i in count]
    assert got[("c", 0)] == [(1, "x"), (2, "y"), (3, "z"), (4, "q")]
    assert got[("d", 0)] == []
    assert [tuple(r) for r in records.where("path = 'f'").select("title", "year", "artist").collect()] == [("s", 2001, "x")]
    best = ingest.best_sheet(records).select("path", "sheet_no").distinct().collect()
    assert sorted(map(tuple, best)) == [("a", 0), ("b", 0), ("c", 0), ("e", 0), ("f", 0)]


def _archive(members: dict[str, bytes], **how) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **how) as book:
        for name, content in members.items():
            book.writestr(name, content)
    return out.getvalue()


def test_cells_are_normalised_where_files_are_opened(spark):
    table = [["曲　名"], ["Ａ＆Ｂ<x>"], []]
    files = [("x", "xlsx", workbook([("ｓ", table)])), ("m", "manual", "曲名,ｎｏ\n".encode()), ("t", "txt", "Ａ".encode()), ("b", "xlsx", b"?"), ("n", "txt", None)]
    df = spark.createDataFrame(files, "id string, reader string, content binary")
    got = sorted((r.id, r.sheet, r.row_idx, r.cells, r.problem) for r in routing.opened(df).collect() if r.id != "b")
    assert got == [("m", "", 0, ["曲名", "no"], None), ("n", "", 0, [""], None), ("t", "", 0, ["Ａ"], None), ("x", "ｓ", 0, ["曲 名"], None), ("x", "ｓ", 1, ["A&B<x>"], None), ("x", "ｓ", 2, [], None)]
    broken = routing.opened(df).where("id = 'b'").first()
    assert broken.cells is None and broken.problem == "unreadable: BadZipFile"
    assert routing.opened(df, unicode=False).where("id = 'x' and row_idx = 1").first().cells == ["Ａ＆Ｂ<x>"]


def test_members_are_read_and_refused_as_by_zipfile():
    plain = workbook([("s", [["a"], ["b"]])])
    with zipfile.ZipFile(io.BytesIO(plain)) as book:
        members = {n: book.read(n) for n in book.namelist()}
    want = list(xlsx.sheet_rows(plain))
    assert want == [("s", 0, 0, ["a"]), ("s", 0, 1, ["b"])]
    assert list(xlsx.sheet_rows(_archive(members, compression=zipfile.ZIP_DEFLATED))) == want
    assert list(xlsx.sheet_rows(_archive(members, compression=zipfile.ZIP_BZIP2))) == want
    assert list(xlsx.sheet_rows(b"something before" + plain)) == want
    for wrong in (plain.replace(b"<t>b<", b"<t>c<"), plain.replace(b"xl/workbook.xml", b"xl/workbooc.xml", 1)):  # a checksum, a name
        with pytest.raises(zipfile.BadZipFile):
            list(xlsx.sheet_rows(wrong))


def test_files_are_made_of_plain_columns(spark):
    """As before: nulls are empty files, marks and headings stay."""
    from setloom.plans import folders

    rows = [(0, [(1, "a<", "w", "r", "R"), (2, "b", "w", "r", "N")]), (2, [(1, "a", "w", "r", "A")]), (3, None), (5, None), (2, [])]
    lines = spark.createDataFrame(rows, f"kind int, lines {folders.LINE}").coalesce(1)
    made = [r[0] for r in lines.select(folders._contents("kind", "lines")).collect()]
    assert list(xlsx.sheet_rows(made[0])) == [("draft", 0, 0, ["タイトル"]), ("draft", 0, 1, ["a<"]), ("draft", 0, 2, ["b"]), ("set", 1, 0, folders.HEADER), ("set", 1, 1, ["1", "a<", "w", "r", "○"]), ("set", 1, 2, ["2", "b", "w", "r", "－"])]
    assert [bytes(x).decode() for x in made[1:]] == ["【set】\na", ",".join(folders.HEADER), "PK not a workbook", "【set】"]
    assert lines.where(F.col("lines").isNull()).count() == 2


def test_tracks_are_judged_where_they_are_put_together(spark, monkeypatch):
    """Scores are made before the tracks are stored, in the order they have then: a row a file is all that the audit reads again."""
    rows = [(1, "x", 1, "f1", "1.txt", b"A\nB\nC"), (1, "x", 2, "f2", "2.txt", b"A\nB"), (2, "x", 3, "f3", "3.txt", b"A\nA\nD")]
    files = spark.createDataFrame(rows, "event_no int, dj string, pos long, id string, name string, content binary")
    drops = spark.createDataFrame([("f1", "A"), ("f1", "B"), ("f3", "A"), ("f3", None), ("f9", "B")], "file_id string, title string")
    none = spark.createDataFrame([], "file_id string, reason string")
    stored = {}
    monkeypatch.setattr(routing, "staged", lambda df, label, real=routing.staged: stored.setdefault(label, real(df, label)))
    records, audit = routing.read_set_lists(files, spark.createDataFrame([], "id string, content binary"), none, drops)
    assert {(r.file_id, r.place, r.title, r.score.rows) for r in stored["routed-tracks"].collect()} == {("f1", 1, "C", 1), ("f2", 1, "A", 2), ("f2", 2, "B", 2), ("f3", 1, "D", 1)}
    assert {r.id: (r.outcome, r.rows, r.detail) for r in audit.collect()} == {"f1": ("tried", 1, "bare-title-list"), "f2": ("chosen", 2, "bare-title-list"), "f3": ("chosen", 1, "bare-title-list")}
    assert sorted((r.source_file_id, r.track_no, r.title) for r in records.collect()) == [("f2", 1, "A"), ("f2", 2, "B"), ("f3", 3, "D")]
    assert not {"place", "score", "detail"} & set(records.columns)
    assert "Window" not in audit._jdf.queryExecution().optimizedPlan().toString()
