"""Spreadsheets as a Spark data source: spark.read.format("xlsx").load(path).

One row a sheet row: path, sheet, sheet_no, row_idx, cells. One partition a file. Strings come without phonetic readings,
rich text as one string, booleans as TRUE and FALSE, errors as empty, whole numbers without a fraction; gaps are empty cells.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet string, sheet_no int, row_idx int, cells array<string>"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, CELL, VALUE, INLINE, RUN, TEXT = (NS + tag for tag in ("row", "c", "v", "is", "r", "t"))

SEALED = 0x61  # flags of members that are encrypted, or patches of others


def column_number(reference: str) -> int:
    """A1 -> 0, B7 -> 1, AA3 -> 26."""
    n = 0
    for letter in re.match(r"[A-Z]*", reference.upper()).group():
        n = 26 * n + ord(letter) - 64
    return n - 1


def shown_number(text: str) -> str:
    try:
        value = float(text)
    except ValueError:
        return text
    return f"{value:.0f}" if value.is_integer() else text


def plain_text(node: ElementTree.Element) -> str:
    """Own text and rich-text runs of a string item; phonetic runs are other children."""
    runs = [node, *node.findall(RUN)]
    return "".join(t.text or "" for run in runs for t in run.findall(TEXT))


def cell_text(cell: ElementTree.Element, strings: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        if len(cell) == 1 and (inline := cell[0]).tag == INLINE and len(inline) == 1 and (text := inline[0]).tag == TEXT:
            return text.text or ""  # one string without runs
        inline = cell.find(INLINE)
        return "" if inline is None else plain_text(inline)
    value = cell.findtext(VALUE)
    if value is None or kind == "e":
        return ""
    if kind == "s":
        return strings[int(value)] if int(value) < len(strings) else ""
    if kind == "b":
        return "TRUE" if value.strip() == "1" else "FALSE"
    return shown_number(value)


def _member(book: zipfile.ZipFile, content: bytes, info: zipfile.ZipInfo, end: int) -> bytes:
    """A member of the archive `content`, which ends before `end`: cut out and checked here, as a file object for each takes longer
    than its few bytes. Whatever is special or wrong about it is zipfile's to read or to refuse."""
    at = info.header_offset
    if 0 <= at <= len(content) - 30 and content[at : at + 4] == b"PK\3\4" and not info.flag_bits & SEALED and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        name, extra = struct.unpack_from("<HH", content, at + 26)
        start = at + 30 + name + extra
        stop = start + info.compress_size
        if stop <= end and content[at + 30 : at + 30 + name] == info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437"):
            with suppress(zlib.error):
                plain = content[start:stop] if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(content[start:stop], -zlib.MAX_WBITS)
                if len(plain) == info.file_size and zlib.crc32(plain) == info.CRC:
                    return plain
    return book.read(info)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, its number, row index, cells) of a workbook, sheets by the number in their file names."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        infos = {x.filename: x for x in book.infolist()}
        starts = [*sorted(x.header_offset for x in book.infolist()), book.start_dir]

        def parsed(name: str) -> ElementTree.Element:
            info = infos[name]
            return ElementTree.fromstring(_member(book, content, info, starts[bisect_right(starts, info.header_offset, hi=len(starts) - 1)]))

        strings = [plain_text(x) for x in parsed("xl/sharedStrings.xml").findall(f"{NS}si")] if "xl/sharedStrings.xml" in infos else []
        titles = [x.get("name") or "" for x in parsed("xl/workbook.xml").iter(f"{NS}sheet")]
        files = sorted((int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for number, (_, file) in enumerate(files):
            title = titles[number] if number < len(titles) else f"sheet{number + 1}"
            for at, row in enumerate(parsed(file).iter(ROW)):
                cells: list[str] = []
                for cell in row:
                    if cell.tag != CELL:
                        continue
                    if reference := cell.get("r"):
                        cells += [""] * (column_number(reference) - len(cells))
                    cells.append(cell_text(cell, strings))
                yield title, number, at, cells


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return XlsxReader(self.options)


class XlsxReader(DataSourceReader):
    """Reads the file or all .xlsx files of the folder in option `path`, by any file system that pyarrow reaches."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [InputPartition(path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [InputPartition(f.path) for f in found if f.path.lower().endswith(".xlsx")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with system.open_input_file(partition.value) as file:
            for row in sheet_rows(file.read()):
                yield (partition.value, *row)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").load(path)


def sheets_of(files: DataFrame) -> DataFrame:
    """Sheet rows of workbooks already read as binaryFile rows (path, content), for stores that only Spark reaches."""

    def rows(parts):  # noqa: ANN001, ANN202
        import pandas as pd

        for part in parts:
            out = [(p, *row) for p, content in zip(part["path"], part["content"], strict=True) for row in sheet_rows(content)]
            yield pd.DataFrame(out, columns=["path", "sheet", "sheet_no", "row_idx", "cells"])

    return files.select("path", "content").mapInPandas(rows, SCHEMA)
