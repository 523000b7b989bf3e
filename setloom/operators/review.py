"""What a person sees and sends in review: preset choices, names to choose from, reasons, lines to keep apart, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.functions.keys import agg_key, strip_notes
from setloom.operators.enrich import first_by
from setloom.operators.graph import trimmed
from setloom.operators.resolve import shared_cooccurrence

#: Own wording for codes; an installation may pass its own.
EDGE_LABELS = {"caseonly": "case or blanks only", "redirect": "an outside source's redirect", "agg": "equal without marks", "cooccur": "same song and work", "edit": "similar spelling", "bigram": "shared letter pairs", "substr": "one within the other"}
HINT_LABELS = {"series-risk": "joined by a part of the name only", "series-mark-mismatch": "sequel marks differ", "artist-as-work": "holds an artist's name", "split-from-large": "a piece of a large group"}
CONFIDENCE_LABELS = {"high": "high", "medium": "medium, check it", "low": "low, doubt it"}


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, null for an unknown one."""
    return F.create_map(*[F.lit(x) for p in labels.items() for x in p])[code]


def initial_checked(values: DataFrame, proposals: DataFrame) -> DataFrame:
    """values (id, raw, decided_as, ...) with `checked`: undecided ones that the proposal names, or all undecided if it names none."""
    p = first_by(proposals.select(F.col("cluster_id").alias("id"), "ord", "variants"), ["id"], "ord")
    alive = F.col("decided_as").isNull() | (F.col("decided_as") == "")
    named = alive & F.coalesce(F.array_contains("variants", F.col("raw")), F.lit(False))
    v = values.join(p.select("id", "variants"), "id", "left").withColumn("_named", named)
    some = v.groupBy("id").agg(F.bool_or("_named").alias("_some"))
    return v.join(some, "id").withColumn("checked", F.when(F.col("_some"), F.col("_named")).otherwise(alive)).drop("variants", "_named", "_some")


def canonical_options(values: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, place, value, derived, registered): names to choose from, once each: checked spellings, the proposal's name, checked
    spellings without their notes, names that decided members have. values: id, pos, raw, base, decided_as, checked."""
    p = first_by(proposals.select(F.col("cluster_id").alias("id"), "ord", F.col("canonical").alias("value")), ["id"], "ord").select("id", "value")
    on = values.where("checked")
    row = lambda df, step, pos, value, derived=False, registered=False: df.select("id", F.struct(F.lit(step).alias("step"), pos.cast("long").alias("pos")).alias("at"), value.alias("value"), F.lit(derived).alias("derived"), F.lit(registered).alias("registered"))
    parts = [row(on, 0, F.col("pos"), F.col("raw")), row(p.join(values.select("id").distinct(), "id", "left_semi"), 1, F.lit(0), F.col("value")), row(on, 2, F.col("pos"), F.coalesce("base", "raw"), True), row(values.where("decided_as is not null"), 3, F.col("pos"), F.col("decided_as"), False, True)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("value is not null and value <> ''")
    first = rows.groupBy("id", "value").agg(F.min(F.struct("at", "derived", "registered")).alias("f"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f.at", "value", "f.derived", "f.registered"))).alias("o"))
    return lists.select("id", F.posexplode("o").alias("place", "x")).select("id", "place", "x.value", "x.derived", "x.registered")


#: What is said of things that all spellings of a cluster have.
SHARED = {"djs": "the same DJs use all of them: %s", "co_titles": "the same titles: %s", "co_artists": "the same artists: %s"}


def draft_reasons(clusters: DataFrame, values: DataFrame, edge_labels: dict[str, str] | None = None, hint_labels: dict[str, str] | None = None) -> DataFrame:
    """(id, reason) from facts: rows of each spelling, kinds of evidence, what all spellings share, hints.

    clusters: id, hints, edge_kinds; values: id, pos, raw, rows, and any of the arrays in `SHARED`, of which up to three things that all
    of a cluster's spellings have are named. Clusters are capped, so their lists are short.
    """
    v = values.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("less"), "pos", "raw", "rows"))).alias("vs"))
    counts = F.concat(F.array_join(F.transform("vs", lambda x: F.concat(F.lit("「"), x["raw"], F.lit("」"), x["rows"].cast("string"))), " / "), F.lit("。"))
    named = lambda codes, table: F.array_compact(F.transform(codes, lambda c: label(c, table)))
    kinds, hints = named(F.col("edge_kinds"), edge_labels or EDGE_LABELS), named(F.col("hints"), hint_labels or HINT_LABELS)
    why = F.when(F.size(kinds) > 0, F.array_join(kinds, "、"))
    notes = F.when(F.size(hints) > 0, F.concat(F.lit("※ "), F.array_join(hints, "\n※ ")))
    out, shared = clusters.join(v, "id"), []
    for column, text in SHARED.items():
        if column in values.columns:
            common = shared_cooccurrence(values, column).select("id", F.col("shared").alias(f"shared_{column}"))
            out = out.join(common, "id", "left")
            shared.append(F.when((F.size("vs") > 1) & (F.size(f"shared_{column}") > 0), F.format_string(text, F.array_join(f"shared_{column}", "、"))))
    return out.select("id", F.concat_ws("\n", counts, why, *shared, notes).alias("reason"))


def keep_apart_lines(pairs: DataFrame, members: DataFrame, unicode: bool = True) -> DataFrame:
    """(batch, a, b, line): the declared pairs (a, b) that touch a value of a batch (batch, raw), by key with or without notes."""

    def keyed(df: DataFrame, column: str) -> DataFrame:
        name = F.col(column)
        return df.withColumn("k", F.explode(F.array_distinct(F.array(agg_key(strip_notes(name), unicode), agg_key(name, unicode))))).where("k <> ''")

    clean = pairs.select(trimmed(F.coalesce("a", F.lit(""))).alias("a"), trimmed(F.coalesce("b", F.lit(""))).alias("b")).where("a <> '' and b <> ''").distinct()
    ends = keyed(clean, "a").unionByName(keyed(clean, "b"))
    met = ends.join(keyed(members.select("batch", "raw"), "raw").select("batch", "k").distinct(), "k").select("batch", "a", "b").distinct()
    return met.withColumn("line", F.concat(F.lit("- 「"), "a", F.lit("」 ≠ 「"), "b", F.lit("」")))


def payloads(cards: DataFrame, action: str) -> DataFrame:
    """What a card sends for an action: accept with name and details, reject and defer without, keep-apart for exactly two spellings.

    cards: id, field, canonical, series, kind, confidence, reason, checked (spellings). An action that a card can't take gives no row.
    """
    name = trimmed(F.coalesce("canonical", F.lit("")))
    fits = {"accept": (F.size("checked") > 0) & (name != ""), "reject": F.size("checked") > 0, "defer": F.lit(True), "keep-apart": F.size("checked") == 2}[action]
    detail = lambda c: F.col(c) if action == "accept" else F.lit(None).cast("string")
    own = name if action == "accept" else F.lit(None).cast("string")
    return cards.where(fits).select("id", "field", F.lit(action).alias("action"), own.alias("canonical"), detail("series").alias("series"), detail("kind").alias("kind"), detail("confidence").alias("confidence"), F.col("checked").alias("variants"), "reason")


def bulk_rows(cards: DataFrame, kinds: list[str]) -> DataFrame:
    """cards with `eligible` and `preset`: a whole list may be approved at once of cards with a name, two spellings or more and, for
    works, a known kind; those of high confidence without a hint are preset."""
    known = (F.col("field") != "work") | F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    eligible = (trimmed(F.coalesce("canonical", F.lit(""))) != "") & (F.size("checked") > 1) & known
    preset = eligible & F.coalesce(F.col("confidence") == "high", F.lit(False)) & (F.size("hints") == 0)
    return cards.withColumns({"eligible": eligible, "preset": preset})
