"""Where results go: tables, paste sheets, published JSON, logs, caches, and the import report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.operators.ingest import fill_rate, report_by_event, report_by_kind
from setloom.operators.query import play_order
from setloom.schema import PLAY_COLUMNS

PASTE = {"event_no": "回", "play_order": "play順", "dj": "DJ", "track_no": "曲順", "title": "タイトル", "source_work": "アニメ/元ネタ", "artist": "アーティスト", "is_remix": "REMIX", "url": "URL"}


def plays_csv(plays: DataFrame, path: str) -> None:
    """All columns, in the log's order, spread over files by range so that any number of rows can be written."""
    plays.select(*PLAY_COLUMNS).orderBy(*play_order()).write.mode("overwrite").csv(path, header=True)


def paste_rows(plays: DataFrame) -> DataFrame:
    """The columns of the shared sheet; missing values and zeros are blank, remixes a circle or a cross."""
    blank = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("0")) if c in ("play_order", "track_no") else F.col(c).cast("string"), F.lit(""))
    mark = F.when(F.col("is_remix"), "○").when(~F.col("is_remix"), "×").otherwise("")
    return plays.select(*[(mark if c == "is_remix" else blank(c)).alias(name) for c, name in PASTE.items()])


def paste_tsv(plays: DataFrame, path: str) -> None:
    paste_rows(plays.orderBy(*play_order())).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="")


def plays_table(plays: DataFrame, path: str) -> None:
    """The log as Parquet by event, all values as text but the event: queries by event read their part alone."""
    plays.select(*[F.col(c).cast("string").alias(c) if c != "event_no" else F.col(c) for c in PLAY_COLUMNS]).repartition("event_no").sortWithinPartitions("dj", "title").write.mode("overwrite").partitionBy("event_no").parquet(path)


def published(plays: DataFrame) -> DataFrame:
    """(kind, event_no, json): a row for each event and each play in compact form; nulls are written out."""
    first = plays.groupBy("event_no", "dj").agg(F.min(F.struct(F.coalesce(F.nullif("play_order", F.lit(0)), F.lit(99)), "dj")).alias("at"), F.min("event_date").alias("d"))
    events = first.groupBy("event_no").agg(F.min("d").alias("date"), F.transform(F.array_sort(F.collect_list(F.struct("at", "dj"))), lambda x: x["dj"]).alias("djs"))
    keep = {"ignoreNullFields": "false"}
    e = events.select(F.lit("event").alias("kind"), "event_no", F.to_json(F.struct(F.col("event_no").alias("no"), F.col("date").cast("string").alias("date"), "djs"), keep).alias("json"))
    names = {"event_no": "e", "play_order": "p", "dj": "dj", "track_no": "n", "title": "t", "source_work": "w", "artist": "a", "is_remix": "r", "url": "u", "source_kind": "k"}
    p = plays.select(F.lit("play").alias("kind"), "event_no", F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]), keep).alias("json"))
    return e.unionByName(p)


def append(rows: DataFrame, path: str) -> None:
    """Decisions and human dictionary entries are added, never changed."""
    rows.write.mode("append").json(path)


def replace(rows: DataFrame, path: str) -> None:
    """The automatic dictionary is written anew; an empty one undoes it."""
    rows.write.mode("overwrite").parquet(path)


def write_proposals(rows: DataFrame, path: str) -> None:
    """Proposals never carry an approval."""
    if "approved" in rows.columns:
        raise ValueError("a proposal must not be approved")
    rows.write.mode("overwrite").json(path)


def cache_key(*parts: str):  # noqa: ANN201
    """SHA-256 of the parts' canonical JSON."""
    return F.sha2(F.to_json(F.struct(*[F.col(p) for p in sorted(parts)])), 256)


def report(plays: DataFrame, missing: DataFrame, mismatch: DataFrame, orphans: DataFrame) -> str:
    """The import report as Markdown; every table of it is an aggregate by event, kind, field or DJ."""
    lines = ["# Import report", "", "| source | rows |", "|---|---:|"]
    lines += [f"| {r.source_kind} | {r.rows} |" for r in report_by_kind(plays).collect()]
    lines += ["", "## Events", "", "| event | date | DJs | tracks |", "|---:|---|---:|---:|"]
    lines += [f"| {r.event_no} | {r.event_date} | {r.djs} | {r.tracks} |" for r in report_by_event(plays).orderBy("event_no").collect()]
    for title, df, text in (("Without a set list", missing, "{event_no} {dj}"), ("Row counts differ from the master table", mismatch, "{event_no} {dj}: {file_rows} and {master_rows}"), ("Master rows without a folder", orphans, "{event_no} {dj}: {rows}")):
        rows = [text.format(**r.asDict()) for r in df.orderBy("event_no", "dj").collect()]
        lines += ["", f"## {title}", "", *[f"- {x}" for x in rows]] if rows else []
    lines += ["", "## Filled fields", "", "| field | rows | share |", "|---|---:|---:|"]
    return "\n".join(lines + [f"| {r.field} | {r.filled} | {r.percent}% |" for r in fill_rate(plays).collect()]) + "\n"
