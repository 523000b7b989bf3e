"""The driver's orders as folders of set-list files in several formats, for the readers."""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.plans.playlog import read

HEADER = ["曲順", "タイトル", "アニメ/元ネタ", "アーティスト", "REMIX"]
KINDS = ["xlsx", "xlsx", "txt", "pdf", "docx", "xlsx"]  # by order key, the last one broken
MARKS = {"R": "○", "A": "×"}
LINE = "array<struct<pos:int,title:string,work:string,artist:string,flag:string>>"


def _sheet(rows: list[list[str]]) -> str:
    text = "".join(c for row in rows for c in row)
    if any(mark in text for mark in "&<>"):
        rows = [[escape(c) for c in row] for row in rows]
    first, between, last = '<c t="inlineStr"><is><t>', '</t></is></c><c t="inlineStr"><is><t>', "</t></is></c>"
    return "".join([f"<row>{first}{between.join(row)}{last}</row>" if row else "<row></row>" for row in rows])


def _archive(members: list[tuple[bytes, bytes]]) -> bytes:
    """A ZIP file of small stored members (name, content). zipfile takes ten times as long, most of what a small workbook takes."""
    parts, directory, at = [], [], 0
    for name, content in members:
        common = struct.pack("<5H3I2H", 20, 0, 0, 0, 0x21, zlib.crc32(content), len(content), len(content), len(name), 0)
        parts += [b"PK\3\4", common, name, content]
        directory += [b"PK\1\2\x14\0", common, struct.pack("<3H2I", 0, 0, 0, 0, at), name]
        at += 30 + len(name) + len(content)
    listed = b"".join(directory)
    return b"".join([*parts, listed, struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(members), len(members), len(listed), at, 0)])


def workbook(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of inline strings."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    names = "".join(f'<sheet name="{escape(name)}" sheetId="{i}"/>' for i, (name, _) in enumerate(sheets, 1))
    members = [("xl/workbook.xml", f'<workbook xmlns="{main}"><sheets>{names}</sheets></workbook>')]
    members += [(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{_sheet(rows)}</sheetData></worksheet>') for i, (_, rows) in enumerate(sheets, 1)]
    return _archive([(name.encode(), text.encode()) for name, text in members])


def _content(kind: int, lines: list[tuple]) -> bytes:
    if kind == 5:
        return b"PK not a workbook"
    if KINDS[kind] == "txt":
        return "\n".join(["【set】", *[title for _, title, *_ in lines]]).encode()
    table = [HEADER, *[[str(pos), title, work, artist, MARKS.get(flag, "－")] for pos, title, work, artist, flag in lines]]
    if KINDS[kind] == "xlsx":
        return workbook([("draft", [["タイトル"], *[[title] for _, title, *_ in lines]]), ("set", table)])
    return "\n".join(",".join(row) for row in table).encode()  # a transcription, where there is one


@F.arrow_udf(T.BinaryType())
def _contents(kinds: pa.Array, lines: pa.Array) -> pa.Array:
    """A column, so that files are not made where only their names are read. Lines cross as plain columns, not as objects."""
    each = list(zip(*[x.to_pylist() for x in lines.values.flatten()], strict=True))
    ends = lines.offsets.to_pylist()
    spans = zip(kinds.to_pylist(), lines.is_valid().to_pylist(), ends, ends[1:])
    return pa.array([_content(kind, each[a:b] if some else []) for kind, some, a, b in spans], pa.binary())


def set_list_files(spark: SparkSession, sf_dir: str, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, manual, skips, drops) as `routing.read_set_lists` takes them: a file for each order in the folder of its year and customer.

    lines (path, pos, title, work, artist, flag): the orders' lines. Some PDFs have a transcription, some files are to be left
    out, and of some the first title is to be dropped.
    """

    each = lines.groupBy(F.col("path").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "title", "work", "artist", "flag"))).cast(LINE).alias("lines"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("key"), F.year("o_orderdate").alias("event_no"), F.col("o_custkey").cast("string").alias("dj"), (F.col("o_orderkey") % 6).cast("int").alias("kind"))
    whole = orders.join(each.hint("merge"), "key", "left").withColumn("content", _contents("kind", "lines"))
    key = F.col("key").cast("string")
    suffix = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    files = whole.select("event_no", "dj", F.col("key").alias("pos"), key.alias("id"), F.concat(key, F.lit("."), suffix).alias("name"), "content")
    manual = whole.where("kind = 3 and key % 4 = 3").select(key.alias("id"), "content")
    skips = orders.where("key % 10 = 1").select(key.alias("file_id"), F.lit("a draft").alias("reason"))
    drops = lines.where("pos = 1 and path % 7 = 0").select(F.col("path").cast("string").alias("file_id"), "title")
    return files, manual, skips, drops
