"""Folders of mixed files read as one set: each file goes to the reader of its format, and the best file of each DJ counts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from typing import NamedTuple
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.operators import ingest
from setloom.operators.staging import staged
from setloom.sources import setlists
from setloom.sources.xlsx import sheet_rows

READABLE = ["xlsx", "txt"]
OPENED = "id string, reader string, sheet string, sheet_no int, row_idx int, cells array<string>, problem string"
AUDIT = ["event_no", "dj", "pos", "id", "name", "source_kind", "detail", "rows", "outcome", "reason"]


class Routed(NamedTuple):
    """records: as `ingest.merge` takes them, of chosen files; audit: a row for each file, see AUDIT."""

    records: DataFrame
    audit: DataFrame


def files_with_content(spark: SparkSession, root: str) -> DataFrame:
    """`setlists.files_below`, with the content of files that have a reader; others are listed without being opened. Files
    of no bytes are not listed by Spark."""
    names = setlists.files_below(spark, root)
    readable = setlists.suffix_of(F.col("name")).isin(*READABLE)
    glob = "*.{[xX][lL][sS][xX],[tT][xX][tT]}"
    bodies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    opened = setlists.named_files(bodies.select("path", "content"))
    return opened.where(readable).unionByName(names.where(~readable).withColumn("content", F.lit(None).cast("binary")))


def candidates(files: DataFrame, known: tuple[str, ...] = setlists.KNOWN_NAMES, not_djs: tuple[str, ...] = ()) -> DataFrame:
    """(event_no, dj, pos, id, name, content) of the files that may be set lists; pos: their order by name in the DJ's folder."""
    own = files.where(F.col("event_folder").rlike(setlists.EVENT_FOLDER) & setlists.is_candidate(F.col("name"), F.col("mime"), known))
    if not_djs:
        own = own.where(~F.col("dj_folder").isin(*not_djs))
    event = F.regexp_extract("event_folder", setlists.EVENT_FOLDER, 1).cast("int")
    return own.select(event.alias("event_no"), setlists.normalize_dj(F.col("dj_folder")).alias("dj"), F.struct("name", "id").alias("pos"), "id", "name", "content")


def _read(reader: str, content: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    if reader == "xlsx":
        yield from sheet_rows(content)
    elif reader == "manual":
        for at, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8").removeprefix("﻿")))):
            yield "", 0, at, row
    else:
        yield "", 0, 0, [content.decode("utf-8-sig", errors="replace")]


def opened(files: DataFrame, unicode: bool = True, at_once: int = 50_000) -> DataFrame:
    """Rows of files (id, reader, content), each file read once: sheet rows, or a text as one cell. A file that can't be read
    gives one row with the problem. unicode: cells of sheets are normalised on the way, texts stay as they are."""

    names = [c.split()[0] for c in OPENED.split(", ")]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(zip(names, [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()], strict=True))

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        held: list[tuple] = []
        for part in parts:
            for name, reader, content in zip(*[c.to_pylist() for c in part.columns], strict=True):
                try:
                    got = list(_read(reader, content or b""))
                except Exception as error:  # whatever a broken file raises, the others go on
                    held.append((name, reader, None, None, None, None, f"unreadable: {type(error).__name__}"))
                    continue
                for sheet, sheet_no, at, cells in got:
                    if unicode and reader != "txt":
                        cells = [x if x.isascii() else normalize("NFKC", x) for x in cells]
                    held.append((name, reader, sheet, sheet_no, at, cells, None))
                if len(held) >= at_once:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return files.select("id", "reader", "content").mapInArrow(rows, OPENED)


def _is_blocks(text: Column) -> Column:
    return text.contains("『") | text.contains("URL：") | text.contains("http")


def read_set_lists(files: DataFrame, manual: DataFrame, skips: DataFrame, drops: DataFrame, unicode: bool = True) -> Routed:
    """Read all files and choose one for each (event_no, dj).

    files (event_no, dj, pos, id, name, content); manual (id, content): transcriptions as CSV, which count instead of the file;
    skips (file_id, reason): files that are left out; drops (file_id, title): rows that are. Of a workbook the best sheet counts,
    of a DJ's files the best one, by `list_scores`, the first by pos among equals; lists without a row are never chosen. A file is
    opened once, whatever reads it. All tables here have a row a file, or one for a share of the files, and Spark knows only the
    compressed size of stored ones: they are merged by key and never broadcast, so the driver holds none of them.
    """
    merged = lambda df: df.hint("merge")
    skip = skips.groupBy(F.col("file_id").alias("id")).agg(F.min("reason").alias("skip_reason"), F.lit(True).alias("skip"))
    hand = manual.groupBy("id").agg(F.first("content").alias("content"))
    suffix = setlists.suffix_of(F.col("name"))
    own = files.where(suffix.isin(*READABLE)).join(merged(skip), "id", "left_anti").join(merged(hand.select("id")), "id", "left_anti")
    transcribed = hand.join(merged(files.select("id")), "id", "left_semi").join(merged(skip), "id", "left_anti")
    rows = staged(opened(own.select("id", suffix.alias("reader"), "content").unionByName(transcribed.select("id", F.lit("manual").alias("reader"), "content")), unicode), "routed-rows")
    fine = rows.where("problem is null")
    sheets = fine.where("reader <> 'txt'").select(F.col("id").alias("path"), "sheet", "sheet_no", "row_idx", "cells")
    from_sheets = ingest.best_sheet(ingest.sheet_records(sheets, unicode=False)).withColumn("detail", F.when(F.col("sheet") != "", F.concat(F.lit("sheet="), "sheet")))
    texts = fine.where("reader = 'txt'").select(F.col("id").alias("path"), F.element_at("cells", 1).alias("text"))
    shape = texts.select("path", F.when(_is_blocks(F.col("text")), "numbered-blocks").otherwise("bare-title-list").alias("detail"))
    from_texts = setlists.text_tracks(texts, unicode).where("title is not null").join(merged(shape), "path")
    tracks = from_sheets.drop("sheet", "sheet_no").unionByName(from_texts, allowMissingColumns=True).withColumnRenamed("path", "file_id")
    tracks = staged(ingest.with_scores(ingest.without_dropped(tracks, drops), ["file_id"]), "routed-tracks")
    names = setlists.dispatch(files.drop("content"), manual).join(merged(skip), "id", "left").join(merged(rows.where("problem is not null").select("id", "problem")), "id", "left")
    scores = tracks.where("place = 1").select(F.col("file_id").alias("id"), "score", "detail")
    judged = staged(names.join(merged(scores), "id", "left"), "routed-files")
    best = ingest.best_list(judged.where("score is not null").select("event_no", "dj", "pos", "id", "score"), ["event_no", "dj"], "pos").select("id", F.lit(True).alias("best"))
    reason = F.when(F.col("skip"), F.coalesce("skip_reason", F.lit("left out"))).otherwise(F.coalesce("skipped_reason", "problem"))
    seen = judged.join(merged(best), "id", "left")
    tried = ~F.coalesce("skip", F.lit(False)) & F.col("skipped_reason").isNull() & F.col("problem").isNull()
    outcome = F.when(~tried, "skipped").when(F.col("best"), "chosen").otherwise("tried")
    count = F.when(tried, F.coalesce("score.rows", F.lit(0).cast("long")))
    audit = seen.select("event_no", "dj", "pos", "id", "name", F.col("reader").alias("source_kind"), F.coalesce("detail", F.when(tried & (F.col("reader") == "manual"), F.col("name"))).alias("detail"), count.alias("rows"), outcome.alias("outcome"), F.when(~tried, reason).alias("reason"))
    chosen = audit.where("outcome = 'chosen'").select("event_no", "dj", F.col("id").alias("file_id"), F.col("name").alias("source_file_name"), "source_kind")
    records = tracks.drop("detail", "place", "score").join(merged(chosen), "file_id").withColumnRenamed("file_id", "source_file_id")
    return Routed(records, audit.select(*AUDIT))
