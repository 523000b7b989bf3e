"""From sheet rows to the play log: headers, typed records, choice of file, merge with the master table, report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from setloom.functions.keys import nfkc_each, normalised
from setloom.functions.values import but_nullish, clean, clean_ends, confidence, is_url, repaired, to_float, to_int, to_remix

# Headers of set lists and the columns of the master table.
HEADERS = {
    "track_no": ["曲順", "no", "no.", "列1", "#", "番号"],
    "title": ["タイトル", "曲名", "曲", "トラックタイトル", "曲名(原曲)", "title", "song"],
    "source_work": ["アニメ/元ネタ", "アニメ", "元ネタ", "原作", "作品"],
    "artist": ["アーティスト", "アーティスト(音源)", "artist", "artists", "歌手"],
    "is_remix": ["remix"],
    "url": ["url", "動画", "リンク", "link"],
    "play_order": ["play順", "順番"],
    "event_no": ["開催", "回"],
    "bpm": ["bpm"],
    "year": ["年", "年代"],
    "note": ["メモ", "備考", "特記事項", "オタクコメ"],
    "dj": ["dj"],
}
PARTIAL_HEADERS = [("タイトル", "title"), ("曲名", "title"), ("アニメ", "source_work"), ("元ネタ", "source_work"), ("アーティスト", "artist"), ("remix", "is_remix"), ("url", "url")]
FIELDS = ["track_no", "title", "source_work", "artist", "is_remix", "url", "bpm", "year", "note", "play_order"]
MASTER = ["event_no", "play_order", "dj", "track_no", "title", "source_work", "artist", "is_remix", "url"]
SCAN, NUMBER_COLUMNS, NUMBERS_LEAST = 12, 6, 5
ENRICHED = ["source_work", "artist", "url", "is_remix", "play_order"]
FILLED = ["source_work", "artist", "is_remix", "url", "play_order", "year"]


def header_key(cell: Column) -> Column:
    """What a normalised header cell is looked up by."""
    return F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), r"(?U)\s+", "")


def field_of(key: Column) -> Column:
    """The field that a header's key names, or null."""
    names = {name: field for field, names in HEADERS.items() for name in names}
    found = F.when(key.isin(*names), F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key])
    partly = reduce(lambda rest, p: F.when(key.contains(p[0]), p[1]).otherwise(rest), reversed(PARTIAL_HEADERS), F.lit(None).cast("string"))
    return F.when(key != "", F.coalesce(found, F.when(key.rlike(r"^第\d+回$"), "track_no"), partly))


def header_field(cell: Column, unicode: bool = True) -> Column:
    """The field a header cell names, or null."""
    return field_of(header_key(normalised(cell, unicode)))


def table_cells(rows: DataFrame) -> DataFrame:
    """rows (path, sheet, sheet_no, row_idx, cells) as one row a cell (…, col, cell)."""
    return rows.select("path", "sheet", "sheet_no", "row_idx", F.posexplode("cells").alias("col", "cell"))


def with_heads(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """rows (…, row_idx, cells) with `head` where one of a sheet's first rows names a title: (minus the number of fields that it names,
    row_idx, `at`: the first column of each field, `taken`: these columns). The least head of a sheet is its header."""
    cells = nfkc_each("cells") if unicode else F.col("cells")
    keys = F.when(F.col("row_idx") < SCAN, F.transform(cells, header_key))  # a key once a cell, not once a name
    titles = [*HEADERS["title"], *[part for part, field in PARTIAL_HEADERS if field == "title"]]
    maybe = F.exists("_keys", lambda key: reduce(lambda a, b: a | b, [key.contains(t) for t in titles]))
    rows = rows.withColumn("_keys", keys).withColumn("_named", F.when(maybe, F.transform("_keys", field_of))).drop("_keys")
    fields = F.array_distinct(F.array_compact("_named"))
    at = F.struct(*[(F.nullif(F.array_position("_named", F.lit(f)), F.lit(0)) - 1).cast("int").alias(f) for f in HEADERS])
    taken = F.transform(fields, lambda f: (F.array_position("_named", f) - 1).cast("int"))
    head = F.struct((-F.size(fields)).alias("n"), "row_idx", at.alias("at"), taken.alias("taken"))
    return rows.withColumn("head", F.when(F.array_contains("_named", "title"), head)).drop("_named")


def header_rows(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """(path, sheet_no, header_idx, columns): of the first rows of a sheet, that which names most fields, title among them.

    columns: map of column to field; a field goes to the first column that names it, ties to the first row.
    """
    found = with_heads(rows, unicode).where("head is not null").groupBy("path", "sheet_no").agg(F.min("head").alias("h"))
    named = F.filter(F.array(*[F.struct(F.col(f"h.at.{f}").alias("col"), F.lit(f).alias("field")) for f in HEADERS]), lambda e: e["col"].isNotNull())
    return found.select("path", "sheet_no", F.col("h.row_idx").alias("header_idx"), F.map_from_entries(named).alias("columns"))


def _number_column(body: DataFrame, ordered: WindowSpec, whole: WindowSpec) -> DataFrame:
    """body with `number_col`: for sheets without a number header, the first column that counts 1, 2, 3 and so on."""
    places = range(NUMBER_COLUMNS)
    body = body.withColumns({f"_c{i}": F.when(F.col("head.at.track_no").isNull() & ~F.array_contains("head.taken", i), F.get("cells", F.lit(i))) for i in places})
    body = body.withColumns({f"_n{i}": F.count(f"_c{i}").over(ordered) for i in places})
    body = body.withColumns({f"_c{i}": F.when(F.col(f"_c{i}").isNotNull(), to_int(F.col(f"_c{i}"), None).eqNullSafe(F.col(f"_n{i}"))) for i in places})
    body = body.withColumns({f"_hit{i}": F.bool_and(f"_c{i}").over(whole) for i in places} | {f"_n{i}": F.max(f"_n{i}").over(whole) for i in places})
    first = F.coalesce(*[F.when((F.col(f"_n{i}") >= NUMBERS_LEAST) & F.col(f"_hit{i}"), i) for i in places])
    return body.withColumn("number_col", first).drop(*[f"{c}{i}" for c in ("_c", "_n", "_hit") for i in places])


def sheet_records(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """(path, sheet, sheet_no, pos, then the fields of a track) of all sheets with a header, trimmed and renumbered.

    Cells are normalised and cleaned once, before anything looks at them. Rows are dealt by file and sorted once: header, number
    column, and the ends of a list are windows over that order, so no row meets its header by a join.
    """
    trimmed = F.transform(nfkc_each("cells") if unicode else F.col("cells"), clean_ends)
    rows = rows.select("path", "sheet", "sheet_no", "row_idx", F.transform(trimmed, but_nullish).alias("cells")).repartition("path")
    ordered = Window.partitionBy("path", "sheet_no").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    body = with_heads(rows, unicode=False).withColumn("head", F.min("head").over(whole)).where("row_idx > head.row_idx")
    at = {f: F.col(f"head.at.{f}") for f in FIELDS}
    body = _number_column(body, ordered, whole)
    at["track_no"] = F.coalesce(at["track_no"], "number_col")
    raw = body.select("path", "sheet", "sheet_no", F.col("row_idx").alias("pos"), *[F.get("cells", i).alias(f) for f, i in at.items()]).where("title is not null")
    fixed = repaired(*[F.col(c) for c in ("url", "is_remix", "note", "artist", "source_work")], None)
    return trim_and_renumber(typed(raw.select("path", "sheet", "sheet_no", "pos", *[fixed.get(f, F.col(f)).alias(f) for f in FIELDS]), None), ["path", "sheet_no"])


def typed(raw: DataFrame, unicode: bool | None = True) -> DataFrame:
    kinds = {"track_no": to_int, "play_order": to_int, "year": to_int, "bpm": to_float, "is_remix": to_remix}
    return raw.withColumns({f: fn(F.col(f), unicode) for f, fn in kinds.items()})


def trim_and_renumber(records: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Cut a list after its last numbered row, and number all its rows anew unless they count 1 to n already.

    A list without a number stays as it is.
    """
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(pos)
    out = records.withColumn("_at", F.row_number().over(ordered))
    out = out.withColumn("_last", F.max(F.when(F.col("track_no").isNotNull(), F.col("_at"))).over(whole))
    out = out.where("_last is null or _at <= _last").withColumn("_fine", F.bool_and(F.col("track_no").eqNullSafe(F.col("_at"))).over(whole))
    return out.withColumn("track_no", F.when(F.col("_last").isNull() | F.col("_fine"), F.col("track_no")).otherwise(F.col("_at"))).drop("_at", "_last", "_fine")


def _score(over: Callable[[Column], Column] = lambda total: total) -> Column:
    """The score of a list's records, whose `_hit` is 1 where a row is numbered by its place; `over` makes window functions of the totals."""
    used = [over(F.max(F.col(f).isNotNull().cast("int"))) for f in ("track_no", "source_work", "artist", "url", "is_remix", "bpm")]
    filled = [over(F.count(F.when(F.col(f).cast("string") != "", 1))) for f in ("source_work", "artist", "url", "is_remix")]
    n = over(F.count("*"))
    tenths = F.when(n < 3, 0).otherwise(F.bround(10 * over(F.sum("_hit")) / n, 0).cast("int"))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    return F.struct(add(used).alias("fields"), tenths.alias("tenths"), add(filled).alias("filled"), n.alias("rows"))


def _with_hits(records: DataFrame, keys: list[str], pos: str) -> DataFrame:
    placed = records.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))
    return placed.withColumn("_hit", F.coalesce((F.col("track_no") == F.col("place")).cast("int"), F.lit(0)))


def list_scores(records: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys with `score`: (fields in use, tenths of rows numbered by their place, filled cells, rows), compared in that order."""
    return _with_hits(records, keys, pos).groupBy(*keys).agg(_score().alias("score"))


def with_scores(records: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """records with their `place` in their list and the list's `score`, as `list_scores` has it, by windows over one order."""
    whole = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return _with_hits(records, keys, pos).withColumn("score", _score(lambda total: total.over(whole))).drop("_hit")


def sequence_quality(records: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys with `quality`: the share of rows numbered by their place; under three rows 0."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    hit = records.withColumn("_hit", F.coalesce((F.col("track_no") == at).cast("int"), F.lit(0)))
    return hit.groupBy(*keys).agg(F.when(F.count("*") < 3, 0.0).otherwise(F.avg("_hit")).alias("quality"))


def _some() -> Column:
    return (F.col("score.fields") > 0) | (F.col("score.tenths") > 0) | (F.col("score.filled") > 0) | (F.col("score.rows") > 0)


def _backwards(order: str) -> Column:
    """The best score is the least of these."""
    return F.struct(*[(-F.col(f"score.{f}")).alias(f) for f in ("fields", "tenths", "filled", "rows")], F.col(order).alias("o"))


def best_list(scores: DataFrame, group: list[str], order: str) -> DataFrame:
    """The row with the best score of each group, the first in `order` among equals; a score of nothing never wins."""
    rest = [c for c in scores.columns if c not in group]
    out = scores.where(_some()).groupBy(*group).agg(F.min_by(F.struct(*rest), _backwards(order)).alias("_r"))
    return out.select(*group, "_r.*")


def best_sheet(records: DataFrame) -> DataFrame:
    """The records of each file's best sheet. Scores are windows in the order that `sheet_records` leaves: nothing is dealt anew."""
    best = F.min(F.when(_some(), _backwards("sheet_no"))).over(Window.partitionBy("path"))
    return with_scores(records, ["path", "sheet_no"]).withColumn("_best", best).where("_best.o = sheet_no").drop("place", "score", "_best")


def master_rows(rows: DataFrame, fixes: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """The master table from its sheet's rows (row_idx, cells), by position; fixes move DJs to another event."""
    cell = {f: clean(F.get("cells", F.lit(i)), unicode) for i, f in enumerate(MASTER)}
    out = rows.where("row_idx > 0").select(F.col("row_idx").alias("ord"), *[c.alias(f) for f, c in cell.items()]).where("title is not null and dj is not null and event_no is not null")
    out = out.withColumns({f: to_int(F.col(f), unicode) for f in ("event_no", "play_order", "track_no")}).withColumns({"is_remix": to_remix(F.col("is_remix"), unicode), "url": F.when(is_url(F.col("url"), unicode), F.col("url"))})
    return move_events(out, fixes) if fixes is not None else out


def move_events(master: DataFrame, fixes: DataFrame) -> DataFrame:
    f = fixes.where("kind = 'move_event'").select(F.col("from_event").alias("event_no"), "dj", "to_event").dropDuplicates(["event_no", "dj"])
    return master.join(f, ["event_no", "dj"], "left").withColumn("event_no", F.coalesce("to_event", "event_no")).drop("to_event")


def without_skipped(files: DataFrame, skips: DataFrame) -> DataFrame:
    return files.join(skips.select(F.col("file_id").alias("id")), "id", "left_anti")


def without_dropped(records: DataFrame, drops: DataFrame) -> DataFrame:
    """Records (file_id, title, …) but those that a correction drops by exact title. They are dealt by file, as their lists are."""
    dropped = drops.groupBy("file_id").agg(F.collect_set("title").alias("_dropped")).hint("merge")
    return records.join(dropped, "file_id", "left").where(~F.coalesce(F.array_contains("_dropped", F.col("title")), F.lit(False))).drop("_dropped")


def names_as_tracks(djs: DataFrame, least: int = 3) -> DataFrame:
    """(event_no, dj, track_no, title) read off names of sound files such as 01-title.mp3, where a folder has `least` of them."""
    names = djs.select("event_no", "dj", F.explode("media_files").alias("name"))
    pattern = r"^(\d{1,2})[-_.]\s*(.+?)\.[A-Za-z0-9]+$"
    hits = names.where(F.col("name").rlike(pattern)).select("event_no", "dj", F.regexp_extract("name", pattern, 1).cast("int").alias("no"), F.trim(F.translate(F.regexp_extract("name", pattern, 2), "_", " ")).alias("title"))
    pair = Window.partitionBy("event_no", "dj")
    hits = hits.withColumn("n", F.count("*").over(pair)).where(F.col("n") >= least)
    return hits.select("event_no", "dj", F.row_number().over(pair.orderBy("no", "title")).alias("track_no"), "title")


def merge(djs: DataFrame, files: DataFrame, master: DataFrame, inferred: DataFrame | None = None) -> DataFrame:
    """The play log of all DJs (djs: event_no, event_date, dj, dj_folder, play_order).

    files: event_no, dj, pos, the fields of a track, source_file_id, source_file_name, source_kind. A DJ's rows are those of
    the file, where the master table fills gaps by track number (its last row of a number counts); else, if the master table has
    none either, rows inferred from file names; else the master table's own.
    """
    pair = ["event_no", "dj"]
    from_file, from_master = files.select(*pair).distinct(), master.select(*pair).distinct()
    rows = files
    if inferred is not None:
        more = inferred.join(from_file, pair, "left_anti").join(from_master, pair, "left_anti")
        rows = files.unionByName(more.withColumns({"pos": F.col("track_no"), "source_kind": F.lit("filename")}), allowMissingColumns=True)
    at = F.row_number().over(Window.partitionBy(*pair).orderBy("pos"))
    rows = rows.withColumn("track_no", F.coalesce(F.nullif("track_no", F.lit(0)), at))
    known = master.where("track_no <> 0").groupBy(*pair, "track_no").agg(F.max_by(F.struct(*ENRICHED), "ord").alias("m"))
    rows = rows.join(known, [*pair, "track_no"], "left").withColumns({f: F.coalesce(F.col(f), F.col(f"m.{f}")) for f in ENRICHED}).drop("m")
    alone = master.join(rows.select(*pair).distinct(), pair, "left_anti").withColumns({"source_kind": F.lit("master-db"), "source_file_name": F.lit("master table")})
    plays = rows.unionByName(alone, allowMissingColumns=True).drop("pos", "ord")
    d = djs.select(*pair, "event_date", "dj_folder", F.col("play_order").alias("_order"))
    out = plays.join(d, pair).withColumn("play_order", F.coalesce(F.nullif("_order", F.lit(0)), "play_order"))
    return out.withColumn("source_kind", F.coalesce("source_kind", F.lit("unknown"))).withColumn("confidence", confidence(F.col("source_kind"))).drop("_order")


def missing_sets(djs: DataFrame, plays: DataFrame) -> DataFrame:
    return djs.join(plays.select("event_no", "dj"), ["event_no", "dj"], "left_anti")


def master_orphans(master: DataFrame, djs: DataFrame) -> DataFrame:
    """(event_no, dj, rows) of the master table without a folder."""
    return master.join(djs.select("event_no", "dj"), ["event_no", "dj"], "left_anti").groupBy("event_no", "dj").agg(F.count("*").alias("rows"))


def count_mismatch(files: DataFrame, master: DataFrame) -> DataFrame:
    """(event_no, dj, file_rows, master_rows) where both have rows and not as many."""
    a = files.groupBy("event_no", "dj").agg(F.count("*").alias("file_rows"))
    b = master.groupBy("event_no", "dj").agg(F.count("*").alias("master_rows"))
    return a.join(b, ["event_no", "dj"]).where("file_rows <> master_rows")


def report_by_kind(plays: DataFrame) -> DataFrame:
    return plays.groupBy("source_kind").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "source_kind")


def report_by_event(plays: DataFrame) -> DataFrame:
    return plays.groupBy("event_no").agg(F.min("event_date").alias("event_date"), F.countDistinct("dj").alias("djs"), F.count("*").alias("tracks"))


def fill_rate(plays: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, filled, percent) of each column, in one pass."""
    columns = columns or FILLED
    one = plays.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return rows.select("x.field", "x.filled", F.bround(100 * F.col("x.filled") / F.greatest("n", F.lit(1)), 0).cast("int").alias("percent"))
