"""Folders and files of set lists: listing, crawling, text and CSV readers, dispatch by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.values import clean

# What is not a set list, and how folders are named.
EVENT_FOLDER = r"^第(\d+)回_(\d{8})$"
DJ_PREFIX = r"^(\d+|[xX]{2})_"
SOUNDS = ["mp3", "m4a", "wav", "flac", "aac", "aif", "aiff", "ogg"]
VIDEOS = ["mp4", "mov", "avi", "mkv", "webm", "wmv", "m4v"]
PICTURES = ["jpg", "jpeg", "png", "gif", "webp", "heic"]
MEDIA = [*SOUNDS, *VIDEOS, *PICTURES, "zip", "pptx", "key"]
SKIPPED = [*MEDIA, "numbers"]
FLYER = r"(?i)flyer|ポスター"
KNOWN_NAMES = ("readme.txt",)


def normalize_dj(folder: Column, nicknames: dict[str, str] | None = None) -> Column:
    """A DJ's name from the folder's; nicknames (configuration): other names that the same DJ goes by."""
    name = F.trim(F.regexp_replace(folder, DJ_PREFIX, ""))
    pairs = [F.lit(x) for p in (nicknames or {}).items() for x in p]
    return F.coalesce(F.create_map(*pairs)[name], name) if pairs else name


def play_order_of(folder: Column) -> Column:
    return F.regexp_extract(folder, r"^(\d+)_", 1).try_cast("int")


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def is_candidate(name: Column, mime: Column, known: tuple[str, ...] = KNOWN_NAMES) -> Column:
    """A file that may be a set list: no flyer, sound, video, picture or slides; known (configuration): names of other texts."""
    return ~name.isin(*known) & ~name.rlike(FLYER) & ~mime.rlike("^(audio|video|image)/") & ~suffix_of(name).isin(*SKIPPED)


def mime_of(name: Column) -> Column:
    s = suffix_of(name)
    return F.when(s == "xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet").when(s == "txt", "text/plain").when(s == "csv", "text/csv").when(s == "pdf", "application/pdf").when(s.isin(*SOUNDS), F.concat(F.lit("audio/"), s)).when(s.isin(*VIDEOS), F.concat(F.lit("video/"), s)).when(s.isin(*PICTURES), F.concat(F.lit("image/"), s)).otherwise("application/octet-stream")


def local_suffix(mime: Column, name: Column) -> Column:
    """The suffix under which a fetched file is kept: shared documents are exported."""
    return F.when(mime == "application/vnd.google-apps.spreadsheet", "xlsx").when(mime == "application/vnd.google-apps.document", "txt").otherwise(suffix_of(name))


def folder_id(url: Column, host: str = "drive.google.com") -> Column:
    """The id in a shared folder's or file's address; null for anything but a plain https address of that host."""
    ok = url.rlike(rf"^https://{host.replace('.', chr(92) + '.')}/(?:drive/(?:u/\d+/)?folders|file/d|spreadsheets/d|document/d)/[A-Za-z0-9_-]+(?:[/?#].*)?$")
    return F.when(ok, F.regexp_extract(url, r"/(?:folders|d)/([A-Za-z0-9_-]+)", 1))


def listing(raw: DataFrame) -> DataFrame:
    """(parent, id, name, mime) from pages of folder listings (parent, page): the JSON array that the page embeds with \\xNN escapes.

    The escapes are bytes of UTF-8: they are put together before they are decoded.
    """
    body = F.regexp_extract("page", r"_DRIVE_ivd'\]\s*=\s*'([^']*)'", 1)
    hexed = F.regexp_replace(F.hex(F.encode(body, "UTF-8")), "(?i)5C78(3[0-9]|4[1-6]|6[1-6])(3[0-9]|4[1-6]|6[1-6])", "<$1$2>")
    # each escape is now the hex of its two digits
    parts = F.transform(F.split(hexed, "[<>]"), lambda x: F.when(F.length(x) == 4, F.decode(F.unhex(x), "UTF-8")).otherwise(x))
    text = F.decode(F.unhex(F.array_join(parts, "")), "UTF-8")
    items = F.from_json(F.get_json_object(text, "$[0]"), "array<string>")
    each = raw.select("parent", F.explode(items).alias("item"))
    at = lambda i: F.get_json_object("item", f"$[{i}]")
    return each.select("parent", at(0).alias("id"), at(2).alias("name"), at(3).alias("mime"))


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(event_folder, dj_folder, id, name, mime) of root/<event>/<dj>/<file>, from Spark's own file listing."""
    return named_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))


def named_files(found: DataFrame) -> DataFrame:
    """Files (path and more) with what their paths say."""
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    n = F.size(parts)
    out = found.select(F.sha2("path", 256).alias("id"), *found.columns, F.get(parts, n - 3).alias("event_folder"), F.get(parts, n - 2).alias("dj_folder"), F.get(parts, n - 1).alias("name"))
    return out.withColumn("mime", mime_of(F.col("name")))


def crawl(files: DataFrame, not_djs: tuple[str, ...] = (), known: tuple[str, ...] = KNOWN_NAMES) -> DataFrame:
    """The manifest's DJs: one row for each DJ folder of an event folder, with candidates and media files in name order."""
    own = files.where(F.col("event_folder").rlike(EVENT_FOLDER) & ~F.col("dj_folder").isin(*not_djs)) if not_djs else files.where(F.col("event_folder").rlike(EVENT_FOLDER))
    own = own.withColumn("candidate", is_candidate(F.col("name"), F.col("mime"), known))
    item = F.struct("name", "id", "mime")
    out = own.groupBy("event_folder", "dj_folder").agg(F.array_sort(F.collect_list(F.when(F.col("candidate"), item))).alias("setlists"), F.array_sort(F.collect_list(F.when(~F.col("candidate"), F.col("name")))).alias("media_files"))
    return out.select(
        F.regexp_extract("event_folder", EVENT_FOLDER, 1).cast("int").alias("event_no"),
        F.to_date(F.regexp_extract("event_folder", EVENT_FOLDER, 2), "yyyyMMdd").alias("event_date"),
        "event_folder", normalize_dj(F.col("dj_folder")).alias("dj"), "dj_folder", play_order_of(F.col("dj_folder")).alias("play_order"), "setlists", "media_files",
    )


def manifest_djs(manifest: DataFrame) -> DataFrame:
    """A nested manifest (events) as one row a DJ."""
    e = manifest.select(F.explode("events").alias("e")).select("e.*")
    return e.select(F.col("no").alias("event_no"), F.col("date").alias("event_date"), F.col("folder").alias("event_folder"), F.explode("djs").alias("d")).select("event_no", "event_date", "event_folder", F.col("d.dj").alias("dj"), F.col("d.folder").alias("dj_folder"), F.col("d.play_order").alias("play_order"), F.col("d.setlists").alias("setlists"), F.col("d.media_files").alias("media_files"))


def crawl_totals(djs: DataFrame) -> DataFrame:
    return djs.agg(F.count("*").alias("djs"), F.sum(F.size("setlists")).alias("setlists"), F.count_if(F.size("setlists") == 0).alias("without"))


def read_csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as sheet rows (path, sheet, sheet_no, row_idx, cells); rows are numbered within their file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.mapInPandas(_csv_rows, "path string, sheet string, sheet_no int, row_idx int, cells array<string>")


def _csv_rows(parts):  # noqa: ANN001, ANN202
    import csv
    import io

    import pandas as pd

    for part in parts:
        rows = [(p, "", 0, i, row) for p, text in zip(part["path"], part["value"], strict=True) for i, row in enumerate(csv.reader(io.StringIO(text.removeprefix("﻿"))))]
        yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_no", "row_idx", "cells"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_tracks(texts: DataFrame, unicode: bool = True) -> DataFrame:
    """(path, pos, track_no, title, source_work, url, note) of set lists as text (path, text), in either of two forms.

    Without a work in quotes or a link, each line is a title, but for headings. Otherwise a numbered line opens a track, and
    the lines below it give its link and its work; the last of each counts.
    """
    text = F.regexp_replace("text", "^﻿", "")
    blocks = text.contains("『") | text.contains("URL：") | text.contains("http")
    lines = texts.select("path", blocks.alias("blocks"), F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    by_file = Window.partitionBy("path").orderBy("pos")
    bare = lines.where("not blocks and not startswith(line, '【') and not startswith(line, '―')")
    bare = bare.select("path", "pos", F.row_number().over(by_file).alias("track_no"), clean(F.col("line"), unicode).alias("title"))
    opening = r"(?U)^(\d{1,3})\s*[.．、]\s*(\S.*)$"
    b = lines.where("blocks").withColumn("opens", F.col("line").rlike(opening)).withColumn("block", F.sum(F.col("opens").cast("int")).over(by_file)).where("block > 0")
    link, work = F.regexp_extract("line", r"(https?://\S+)", 1), F.regexp_extract("line", r"[『「]([^』」]+)[』」]", 1)
    rest = ~F.col("opens")
    last = lambda value, test: F.max_by(F.when(test, value), F.when(test, F.col("pos")))
    is_link, is_work = rest & (link != ""), rest & (link == "") & (work != "")
    full = b.groupBy("path", "block").agg(
        F.min("pos").alias("pos"), F.min_by("line", "pos").alias("head"), last(clean(work, unicode), is_work).alias("source_work"), last(link, is_link).alias("url"), last(clean(F.col("line"), unicode), is_work).alias("note")
    )
    full = full.select("path", "pos", F.regexp_extract("head", opening, 1).cast("int").alias("track_no"), clean(F.regexp_extract("head", opening, 2), unicode).alias("title"), "source_work", "url", "note")
    return full.unionByName(bare, allowMissingColumns=True)


def dispatch(files: DataFrame, manual: DataFrame) -> DataFrame:
    """files (id, name) with `reader` and `skipped_reason`: a hand-made transcription beats the file's own format."""
    s = suffix_of(F.col("name"))
    out = files.join(manual.select("id", F.lit(True).alias("manual")).distinct().hint("merge"), "id", "left")
    reader = F.when(F.col("manual"), "manual").when(s.isin("xlsx", "txt"), s)
    reason = F.when(reader.isNotNull(), None).when(s == "pdf", "no text in PDF; give a transcription").otherwise(F.concat(F.lit("unsupported: "), F.coalesce(s, F.lit(""))))
    return out.select(*[files[c] for c in files.columns], reader.alias("reader"), reason.alias("skipped_reason"))
