"""Decisions about names: evidence, proposals, approval rules, reviews, and the dictionary that is published."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.functions.keys import agg_key, strip_notes
from setloom.operators.enrich import first_by
from setloom.operators.graph import pairs_of, trimmed
from setloom.operators.staging import spread, staged

# Codes and limits.
KNOWN_KINDS = ["caseonly", "agg", "bigram", "redirect", "edit", "substr"]
RISKY_HINTS = ["split-from-large", "artist-as-work"]
EXPORTED = ["high", "medium"]
ACTIONS = ["accept", "reject", "defer", "keep-apart"]
CONFIDENCES = ["high", "medium", "low"]
WORK_KINDS = ["work", "vocaloid", "vtuber", "artist-as-work", "unknown"]
SKIP_CODES = ["no-proposal", "many-proposals", "partial", "confidence", "canonical", "hint", "edge-kind", "keep-apart", "conflict", "already-decided", "auto-done"]
MAX_TOKENS, MAX_CLUSTERS = 3600, 15


def names_of(variants: Column) -> Column:
    """Trimmed, without blanks, in order, once each."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(variants, F.array().cast("array<string>")), trimmed), lambda v: v != ""))


def class_values(entries: DataFrame) -> Column:
    """All spellings of an entry: its variants and its canonical name."""
    name = trimmed(F.coalesce(entries.canonical, F.lit("")))
    return F.filter(names_of(F.concat(F.coalesce(entries.variants, F.array().cast("array<string>")), F.array(name))), lambda v: v != "")


# evidence ------------------------------------------------------------------------------------------------------------


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """(raw, hits): new answers replace old ones; an empty answer is an answer."""
    n = new.select("raw", F.col("hits").alias("new_hits"))
    return old.join(n, "raw", "full").select("raw", F.coalesce("new_hits", "hits").alias("hits")).orderBy("raw")


def targets(profiles: DataFrame, known: DataFrame | None = None, least_rows: int = 2, limit: int | None = None) -> DataFrame:
    """Values worth asking about: at least `least_rows` rows, those with most first; with `known`, only new ones."""
    out = profiles.where(F.col("rows") >= least_rows)
    if known is not None:
        out = out.join(known.select("raw").distinct(), "raw", "left_anti")
    out = out.select("raw", "rows").orderBy(F.desc("rows"), "raw")
    return out.limit(limit) if limit is not None else out


def first_source(*answers: DataFrame) -> DataFrame:
    """(raw, hits) of the first source with hits; answers: raw, hits, in order of preference."""
    out = answers[0].select("raw", F.col("hits").alias("h0"))
    for i, more in enumerate(answers[1:], 1):
        out = out.join(more.select("raw", F.col("hits").alias(f"h{i}")), "raw", "full")
    some = [F.when(F.size(f"h{i}") > 0, F.col(f"h{i}")) for i in range(len(answers))]
    return out.select("raw", F.coalesce(*some).alias("hits"))


# decisions -----------------------------------------------------------------------------------------------------------


def decided_values(decisions: DataFrame, auto_entries: DataFrame | None = None, field: str | None = None) -> DataFrame:
    """(raw): spellings that a person accepted or rejected, and those of the automatic dictionary."""
    rows = decisions.where(F.col("action").isin("accept", "reject"))
    if field is not None:
        rows = rows.where(F.col("field") == field)
    out = rows.select(F.explode("variants").alias("raw"))
    if auto_entries is not None:
        out = out.unionByName(auto_entries.select(F.explode(class_values(auto_entries)).alias("raw")))
    return out.distinct()


def decided_by_field(decisions: DataFrame) -> DataFrame:
    """(field, raw): spellings that a person accepted or rejected, in the field where that was."""
    return decisions.where(F.col("action").isin("accept", "reject")).select("field", F.explode("variants").alias("raw")).distinct()


def variant_index(entries: DataFrame) -> DataFrame:
    """(field, raw, canonical): the first entry of a field that has the spelling counts; entries without a name don't."""
    rows = entries.select("field", "ord", trimmed(F.col("canonical")).alias("canonical"), F.explode(class_values(entries)).alias("raw")).where("canonical <> ''")
    return rows.groupBy("field", "raw").agg(F.min_by("canonical", "ord").alias("canonical"))


def validate(payload: DataFrame, decided: DataFrame, apart: DataFrame, index: DataFrame, allowed: DataFrame, unicode: bool = True, own_kinds: tuple[str, ...] = ()) -> DataFrame:
    """payload with `code`: null if it may be written, else invalid, already-decided, keep-apart or conflict.

    payload: id, field, action, canonical, kind, confidence, variants, reason. decided (field, raw) and index (field, raw, canonical):
    a spelling that is settled as a work is open as an artist. allowed: field, canonical (names that exist already). own_kinds
    (configuration): further kinds of works that an installation has. The first fault counts: form (a reason is always
    needed), what is decided already, what an acceptance needs (spellings, a name, a work's kind), an invented name, pairs
    that are kept apart, another name for the spelling.
    """
    p = payload.withColumn("names", names_of(F.col("variants"))).withColumn("name", trimmed(F.coalesce("canonical", F.lit(""))))
    p = p.withColumn("_row", F.monotonically_increasing_id())
    blank = lambda c: trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    writes, accept = F.col("action").isin("accept", "reject"), F.col("action") == "accept"
    form = blank("id") | ~F.coalesce(F.col("field").isin("work", "artist"), F.lit(False)) | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | blank("reason")
    need = F.when(F.col("action") == "keep-apart", F.size("names") == 2).when(accept, (F.size("names") > 0) & (F.col("name") != "")).otherwise(True)
    kind = F.when(blank("kind"), F.col("field") != "work").otherwise(trimmed(F.col("kind")).isin(*WORK_KINDS, *own_kinds))
    sure = F.when(blank("confidence"), True).otherwise(trimmed(F.col("confidence")).isin(*CONFIDENCES))
    body = ~need | (accept & ~(kind & sure))
    p = staged(p, "validate")  # the rows' numbers must not change
    each = p.where(writes).select("_row", "field", "action", "name", F.explode(F.array_distinct(F.concat("names", F.when(accept & (F.col("name") != ""), F.array("name")).otherwise(F.array().cast("array<string>"))))).alias("raw"), "names")
    done = each.where(F.array_contains("names", F.col("raw"))).join(decided, ["field", "raw"], "left_semi").select("_row").distinct().withColumn("done", F.lit(True))
    clash = each.where("action = 'accept'").join(index.withColumnRenamed("canonical", "now"), ["field", "raw"]).where("now <> name").select("_row").distinct().withColumn("clash", F.lit(True))
    parted = within_apart(each.where("action = 'accept'").select(F.col("_row").alias("id"), "raw"), apart, unicode).select(F.col("id").alias("_row"), F.lit(True).alias("parted"))
    stripped = F.transform("names", strip_notes)
    known = allowed.select(F.col("field").alias("f"), F.col("canonical").alias("n")).distinct().withColumn("known", F.lit(True))
    out = p.join(done, "_row", "left").join(clash, "_row", "left").join(parted, "_row", "left").join(known, (F.col("field") == F.col("f")) & (F.col("name") == F.col("n")), "left")
    grounded = F.array_contains("names", F.col("name")) | F.coalesce("known", F.lit(False)) | ((F.col("field") == "work") & F.array_contains(stripped, F.col("name")))
    code = F.when(form, "invalid").when(F.coalesce("done", F.lit(False)), "already-decided").when(body | (accept & ~grounded), "invalid").when(F.coalesce("parted", F.lit(False)), "keep-apart").when(F.coalesce("clash", F.lit(False)), "conflict")
    return out.select(*payload.columns, code.alias("code"))


def within_apart(members: DataFrame, apart: DataFrame, unicode: bool = True) -> DataFrame:
    """(id) of the groups (id, raw) that hold a pair that is kept apart, by spelling or by key without notes.

    Groups meet the declared pairs on both ends by equi-joins; no pairs within a group are made.
    """
    keyed = members.select("id", F.col("raw").alias("v")).unionByName(members.select("id", agg_key(strip_notes(F.col("raw")), unicode).alias("v"))).where("v <> ''").distinct()
    one = keyed.join(apart, keyed.v == apart.a).select("id", "a", "b")
    both = one.join(keyed.withColumnRenamed("v", "w"), "id").where(F.col("w") == F.col("b"))
    return both.select("id").distinct()


def decision_entries(valid: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary entries, log records) for valid payloads."""
    ok = valid.where("code is null")
    entry = ok.where("action = 'accept'").select("field", "id", "canonical", "kind", names_of(F.col("variants")).alias("variants"), F.lit(True).alias("approved"), F.coalesce("confidence", F.lit("high")).alias("confidence"), F.lit("human").alias("source"), F.lit(at).alias("decided_at"), "reason")
    pair = F.when(F.col("action") == "keep-apart", F.array(F.struct(F.element_at("variants", 1).alias("a"), F.element_at("variants", 2).alias("b"))))
    log = ok.select("id", "field", "action", F.when(F.col("action").isin("accept", "reject"), names_of(F.col("variants"))).alias("variants"), "canonical", pair.alias("pairs"), "reason", F.lit(at).alias("at"))
    return entry, log


# publishing ----------------------------------------------------------------------------------------------------------


def exportable(entries: DataFrame) -> DataFrame:
    return entries.where("approved <=> true").where(F.col("confidence").isin(*EXPORTED))


def class_map(entries: DataFrame) -> DataFrame:
    """(raw, canonical, series, kind, variants): entries of one canonical name form a class; a spelling goes to the first class.

    Spellings keep the order in which they first appear, series and kind are the first that is given.
    """
    use = exportable(entries).withColumn("name", trimmed(F.col("canonical"))).where("name <> ''")
    rows = use.select("name", "ord", F.posexplode(class_values(use)).alias("pos", "raw"))
    spelling = rows.groupBy("name", "raw").agg(F.min(F.struct("ord", "pos")).alias("at"))
    lists = spelling.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]).alias("variants"))
    given = use.groupBy("name").agg(F.min("ord").alias("first"), F.min_by(F.nullif("series", F.lit("")), F.when(F.coalesce("series", F.lit("")) != "", F.col("ord"))).alias("series"), F.min_by(F.nullif("kind", F.lit("")), F.when(F.coalesce("kind", F.lit("")) != "", F.col("ord"))).alias("kind"))
    owner = spelling.join(given.select("name", "first"), "name").groupBy("raw").agg(F.min_by("name", F.struct("first", "name")).alias("name"))
    return owner.join(given, "name").join(lists, "name").select("raw", F.col("name").alias("canonical"), "series", "kind", "variants")


def variant_conflicts(entries: DataFrame) -> DataFrame:
    """(raw, kept, dropped): spellings claimed by several canonical names; the first one keeps it."""
    use = exportable(entries).withColumn("name", trimmed(F.col("canonical"))).where("name <> ''")
    first = use.groupBy("name").agg(F.min("ord").alias("first"))
    claims = use.select("name", F.explode(class_values(use)).alias("raw")).distinct().join(first, "name")
    kept = claims.groupBy("raw").agg(F.min_by("name", F.struct("first", "name")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    return claims.join(kept, "raw").where("name <> kept").select("raw", "kept", F.col("name").alias("dropped"))


def published_json(classes: DataFrame) -> DataFrame:
    """(raw, json): the published entry of each spelling, by raw spelling; the same input gives the same bytes."""
    return classes.orderBy("raw").select("raw", F.to_json(F.struct(F.col("canonical").alias("c"), F.col("series").alias("s"), F.col("kind").alias("k"), F.col("variants").alias("v"))).alias("json"))


# proposals and automatic approval -------------------------------------------------------------------------------------


def check_proposals(proposals: DataFrame, clusters: DataFrame, titles: DataFrame, apart: DataFrame, field: str = "work", unicode: bool = True) -> DataFrame:
    """(ord, cluster_id, problem): why a proposal is dropped, the first reason that holds; null if it stands.

    clusters: id, members; titles: id, title (names that outside sources gave for the cluster).
    """
    none = F.array().cast("array<string>")
    outside = titles.groupBy("id").agg(F.collect_set("title").alias("titles"))
    p = proposals.join(clusters.select(F.col("id").alias("cluster_id"), "members"), "cluster_id", "left").join(outside.withColumnRenamed("id", "cluster_id"), "cluster_id", "left")
    p = p.withColumn("names", F.filter(F.coalesce("variants", none), lambda v: v.isNotNull() & (v != ""))).withColumn("name", trimmed(F.coalesce("canonical", F.lit(""))))
    allowed = F.concat("members", F.coalesce("titles", none), F.transform("members", strip_notes) if field == "work" else none)
    values = F.array_distinct(F.concat("names", F.when(F.array_contains("members", F.col("name")), F.array("name")).otherwise(none)))
    parted = within_apart(p.select(F.col("ord").alias("id"), F.explode(values).alias("raw")), apart, unicode).select(F.col("id").alias("ord"), F.lit(True).alias("parted"))
    p = p.join(parted, "ord", "left")
    problem = (
        F.when(F.col("members").isNull(), "unknown-cluster")
        .when(F.size("names") == 0, "no-variants")
        .when(F.size(F.array_except("names", "members")) > 0, "foreign-variants")
        .when(F.col("name") == "", "no-canonical")
        .when(~F.array_contains(allowed, F.col("name")), "invented-canonical")
        .when(F.size(F.array_distinct(F.concat("names", F.array("name")))) < 2, "nothing-to-merge")
        .when(F.coalesce("parted", F.lit(False)), "keep-apart")
        .when(trimmed(F.coalesce("reason", F.lit(""))) == "", "no-reason")
    )
    return p.select("ord", "cluster_id", problem.alias("problem"))


def auto_plan(clusters: DataFrame, proposals: DataFrame, decided: DataFrame, auto_values: DataFrame, index: DataFrame, apart: DataFrame, field: str = "work", unicode: bool = True) -> DataFrame:
    """(id, rows, code, canonical, variants): what the approval rules say of each cluster; code null: accepted.

    clusters: id, rows, hints, edge_kinds, members. decided: raw; auto_values: raw; index: raw, canonical; apart: a, b.
    Clusters are taken by rows, most first. The rules on a cluster alone are one expression; an accepted cluster then claims
    its spellings, and a later one that meets such a claim falls. Claims are settled in rounds over the few clusters that share
    a spelling, all together.
    """
    none = F.array().cast("array<string>")
    # few clusters may hold very many spellings: they are dealt out by row and stored, so that all tasks trim and clean
    c = staged(spread(clusters.select("id", "rows", "hints", "edge_kinds", "members")).select("id", "rows", "hints", "edge_kinds", names_of(F.col("members")).alias("raws")), "auto-clusters")
    given = proposals.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n"), F.min_by(F.struct("canonical", "variants", "confidence"), "ord").alias("p"))
    flags = c.select("id", F.explode("raws").alias("raw")).join(decided.select("raw", F.lit(True).alias("d")).distinct(), "raw", "left").join(auto_values.select("raw", F.lit(True).alias("u")).distinct(), "raw", "left")
    flags = flags.groupBy("id").agg(F.coalesce(F.bool_or("d"), F.lit(False)).alias("d"), F.coalesce(F.bool_or("u"), F.lit(False)).alias("u"))
    j = spread(c.join(given, "id", "left").join(flags, "id", "left"))
    j = j.withColumn("variants", names_of(F.col("p.variants"))).withColumn("canonical", trimmed(F.coalesce("p.canonical", F.lit(""))))
    values = F.array_distinct(F.concat("variants", F.when(F.col("canonical") != "", F.array("canonical")).otherwise(none)))
    grounded = F.array_contains("variants", F.col("canonical"))
    if field == "work":
        grounded = grounded | F.array_contains(F.transform("variants", strip_notes), F.col("canonical"))
    equal = (F.size(F.array_except("variants", "raws")) == 0) & (F.size(F.array_except("raws", "variants")) == 0)
    code = (
        F.when(F.col("u"), "auto-done").when(F.col("d"), "already-decided").when(F.col("n").isNull(), "no-proposal").when(F.col("n") > 1, "many-proposals")
        .when(~equal, "partial").when(~F.coalesce(F.col("p.confidence") == "high", F.lit(False)), "confidence").when((F.col("canonical") == "") | ~grounded, "canonical")
        .when(F.arrays_overlap("hints", F.array(*map(F.lit, RISKY_HINTS))), "hint").when(F.size(F.array_except("edge_kinds", F.array(*map(F.lit, KNOWN_KINDS)))) > 0, "edge-kind")
    )
    j = staged(j.select("id", "rows", code.alias("code"), "canonical", "variants", "raws", values.alias("vals")), "auto-given")
    # the last two rules look beyond the cluster: only those that no rule stopped so far are asked
    each = j.where("code is null").select("id", "canonical", F.explode("vals").alias("raw"))
    parted = within_apart(each.select("id", "raw"), apart, unicode).withColumn("parted", F.lit(True))
    clash = each.join(index.withColumnRenamed("canonical", "now"), "raw").where("now <> canonical").select("id").distinct().withColumn("clash", F.lit(True))
    j = j.join(parted, "id", "left").join(clash, "id", "left")
    code = F.coalesce("code", F.when(F.coalesce("parted", F.lit(False)), "keep-apart").when(F.coalesce("clash", F.lit(False)), "conflict"))
    plan = staged(j.select("id", "rows", code.alias("code"), "canonical", "variants", "raws", "vals"), "auto-plan")
    return _claims(plan).select("id", "rows", "code", "canonical", "variants")


def _claims(plan: DataFrame) -> DataFrame:
    """Later clusters that meet a spelling claimed by an earlier accepted one are skipped."""
    open_ = plan.where("code is null")
    claim = open_.select(F.col("id").alias("first"), F.col("rows").alias("r1"), F.col("canonical").alias("c1"), F.explode("vals").alias("raw"))
    meet = open_.select("id", "rows", "canonical", "raws", F.explode("vals").alias("raw")).join(claim, "raw").where("first <> id and (r1 > rows or (r1 = rows and first < id))")
    code = F.when(F.array_contains("raws", F.col("raw")), "auto-done").when(F.col("c1") != F.col("canonical"), "conflict")
    meet = meet.withColumn("why", code).where("why is not null").groupBy("id", "first").agg(F.min("why").alias("why"))
    meet = staged(meet, "auto-meet")
    fate = staged(meet.select("id").union(meet.select("first")).distinct().select("id", F.lit(None).cast("string").alias("fate"), F.lit(None).cast("string").alias("why")), "auto-fate")
    while fate.where("fate is null").limit(1).count():
        state = fate.select(F.col("id").alias("first"), F.col("fate").alias("ahead"))
        look = meet.join(state, "first").groupBy("id").agg(F.min(F.when(F.col("ahead") == "in", F.col("why"))).alias("hit"), F.bool_or(F.col("ahead").isNull()).alias("waits"))
        nxt = fate.select("id", "fate", F.col("why").alias("was")).join(look, "id", "left")
        new = F.coalesce("fate", F.when(F.col("hit").isNotNull(), "out").when(~F.coalesce("waits", F.lit(False)), "in"))
        fate = staged(nxt.select("id", new.alias("fate"), F.coalesce("was", "hit").alias("why")), "auto-fate")
    return plan.join(fate.where("fate = 'out'").select("id", "why"), "id", "left").withColumn("code", F.coalesce("code", "why"))


def auto_entries(plan: DataFrame, proposals: DataFrame, field: str, at: str) -> DataFrame:
    """Dictionary entries of the accepted clusters."""
    p = first_by(proposals.select(F.col("cluster_id").alias("id"), "ord", "series", "kind", "reason"), ["id"], "ord")
    out = plan.where("code is null").join(p, "id", "left")
    return out.select(F.lit(field).alias("field"), "id", "canonical", "series", "kind", "variants", F.lit(True).alias("approved"), F.lit("high").alias("confidence"), F.lit("auto:v1").alias("source"), F.lit(at).alias("decided_at"), "reason")


def skip_counts(plan: DataFrame) -> DataFrame:
    """(code, n, example) of the skipped clusters, in the order of the codes."""
    order = F.array_position(F.array(*map(F.lit, SKIP_CODES)), F.col("code"))
    return plan.where("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("example")).orderBy(order)


# review --------------------------------------------------------------------------------------------------------------


def review_queue(clusters: DataFrame, decided: DataFrame, assigned: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, rows, raw, is_open, decided_as, proposed, canonical): the members of each cluster with an undecided one.

    assigned: raw, canonical; proposals: ord, cluster_id, canonical, variants, the first of a cluster counts.
    """
    m = clusters.select("id", "rows", F.explode("members").alias("raw"))
    m = m.join(decided.select("raw", F.lit(True).alias("d")).distinct(), "raw", "left").join(assigned.select("raw", F.col("canonical").alias("as")), "raw", "left")
    m = m.withColumn("is_open", F.col("d").isNull())
    fresh = m.where("is_open").select("id").distinct()
    p = first_by(proposals.select(F.col("cluster_id").alias("id"), "ord", F.col("canonical").alias("name"), "variants"), ["id"], "ord")
    alive = m.where("is_open").join(p, "id").where(F.array_contains("variants", F.col("raw"))).select("id", "raw", "name")
    heads = alive.groupBy("id").agg(F.first("name").alias("canonical"))
    out = m.join(fresh, "id", "left_semi").join(alive.select("id", "raw", F.lit(True).alias("proposed")), ["id", "raw"], "left").join(heads, "id", "left")
    return out.select("id", "rows", "raw", "is_open", F.when(~F.col("is_open"), F.coalesce("as", F.lit("判断済み"))).alias("decided_as"), F.coalesce("proposed", F.lit(False)).alias("proposed"), "canonical")


def assigned_names(human: DataFrame, auto: DataFrame) -> DataFrame:
    """(field, raw, canonical): the name that each spelling goes to; what a person wrote beats the automatic dictionary, and of
    entries of one kind the first counts."""
    both = human.select("field", F.lit(0).alias("kind"), "ord", "canonical", "variants").unionByName(auto.select("field", F.lit(1).alias("kind"), "ord", "canonical", "variants"))
    rows = both.withColumn("name", trimmed(F.col("canonical"))).where("name <> ''").select("field", "kind", "ord", "name", F.explode(class_values(both)).alias("raw"))
    return rows.groupBy("field", "raw").agg(F.min_by("name", F.struct("kind", "ord")).alias("canonical"))


def queue_counters(clusters: DataFrame, decided: DataFrame, auto: DataFrame) -> DataFrame:
    """(field, total, decided, auto_approved, open_values): a field's clusters, those without an undecided member, the clusters whose
    entries the automatic dictionary has (among the decided ones), and the members that still wait.

    clusters (id, field, members); decided (field, raw); auto (field, id): the automatic dictionary.
    """
    member = clusters.select("field", "id", F.explode("members").alias("raw")).join(decided.select("field", "raw", F.lit(1).alias("d")).distinct(), ["field", "raw"], "left")
    each = member.groupBy("field", "id").agg(F.count_if(F.col("d").isNull()).alias("open"))
    by_rule = auto.groupBy("field").agg(F.countDistinct("id").alias("auto_approved"))
    out = each.groupBy("field").agg(F.count("*").alias("total"), F.count_if(F.col("open") == 0).alias("decided"), F.sum("open").alias("open_values"))
    return out.join(by_rule, "field", "left").select("field", "total", "decided", F.coalesce("auto_approved", F.lit(0)).alias("auto_approved"), "open_values")


def guess_canonical(values: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, canonical): the most plausible name of each cluster from its checked values.

    values: id, raw, pos, rows, base (null: the spelling has no notes), decided_as, checked. In order: the proposal's name; the one
    name that decided siblings have; the unannotated spelling with most rows, cut back to a stem that other values share; the
    base that most values share, the shorter first, then by rows.
    """
    v = values.withColumn("stem", F.coalesce("base", "raw"))
    p = first_by(proposals.select(F.col("cluster_id").alias("id"), "ord", F.col("canonical").alias("proposed")), ["id"], "ord")
    sibling = v.where("decided_as is not null and decided_as <> ''").groupBy("id").agg(F.countDistinct("decided_as").alias("names"), F.min("decided_as").alias("registered")).where("names = 1").select("id", "registered")
    on = v.where("checked")
    plain = on.where("stem = raw").groupBy("id").agg(F.min_by("raw", F.struct((-F.col("rows")).alias("r"), "pos")).alias("plain"))
    stems = on.where("stem <> raw").join(plain, "id").where(F.startswith(F.col("plain"), F.col("stem")) & (F.length("stem") < F.length("plain")))
    cut = stems.groupBy("id").agg(F.min_by("stem", F.struct(F.length("stem").alias("l"), "stem")).alias("cut"))
    shared = on.groupBy("id", "stem").agg(F.count("*").alias("n"), F.sum("rows").alias("r"), F.min("pos").alias("pos"))
    shared = shared.groupBy("id").agg(F.min_by("stem", F.struct((-F.col("n")).alias("n"), F.length("stem").alias("l"), (-F.col("r")).alias("r"), "pos")).alias("shared"))
    out = v.select("id").distinct()
    for part in (p, sibling, plain, cut, shared):
        out = out.join(part, "id", "left")
    return out.select("id", F.coalesce(F.nullif("proposed", F.lit("")), "registered", "cut", "plain", "shared").alias("canonical"))


def shared_cooccurrence(values: DataFrame, column: str, most: int = 3) -> DataFrame:
    """(id, shared): what all values of a cluster have in common in an array column, the first `most`."""
    each = values.select("id", "raw", F.explode(F.array_distinct(column)).alias("x")).groupBy("id", "x").agg(F.countDistinct("raw").alias("n"))
    size = values.groupBy("id").agg(F.countDistinct("raw").alias("size"))
    both = each.join(size, "id").where("n = size").groupBy("id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("shared"))
    return size.select("id").join(both, "id", "left").select("id", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def new_keep_apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that are not known yet."""
    return pairs_of(pairs).join(pairs_of(known), ["a", "b"], "left_anti")


# requests ------------------------------------------------------------------------------------------------------------


def _filled(tokens: list[int], used: int, n: int, system: int, most_tokens: int, most_items: int) -> tuple[list[int], int]:
    """The batch of each item, from 0 for the one that is open at first (with n items and `used` tokens); items in the last one."""
    batch, out = 0, []
    for t in tokens:
        if n and (used + t > most_tokens or n >= most_items):
            batch, used, n = batch + 1, system, 0
        used, n = used + t, n + 1
        out.append(batch)
    return out, n


def pack_batches(items: DataFrame, system_tokens: int, most_tokens: int = MAX_TOKENS, most_items: int = MAX_CLUSTERS, chunk: int = 4096) -> DataFrame:
    """(field, batch, id, tokens) for items (field, ord, id, tokens): filled in order up to the limits, an oversized item alone.

    A field is cut into chunks of `chunk` items. What a chunk needs of those before it is how many items the open batch has,
    `most_items` at most, for their tokens are those of the last items before the chunk. So each chunk is filled once for
    every such number, in its own task; the outcomes, a row of at most `most_items` + 1 pairs a chunk, are followed from chunk to chunk on the
    driver; and each chunk is filled again from where it really starts.
    """
    spark = items.sparkSession
    in_order = items.select("field", "ord", "id", "tokens").repartitionByRange("field", "ord", "id").sortWithinPartitions("field", "ord", "id")
    rows = staged(in_order.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "pack-items")
    parts = rows.groupBy("field", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each partition of a field
    before = F.coalesce(F.sum("n").over(Window.partitionBy("field").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(parts.select("field", "part", "first", before.alias("before")), ["field", "part"])
    rows = rows.select("field", "id", "tokens", (F.col("before") + F.col("at") - F.col("first")).alias("n"))
    size = max(chunk, most_items)
    rows = rows.withColumn("c", F.floor(F.col("n") / size))
    behind = F.when(F.col("n") % size >= size - most_items, F.array(F.col("c"), F.col("c") + 1)).otherwise(F.array("c"))
    rows = staged(rows.withColumn("to", F.explode(behind)), "pack-chunks")

    def starts(own: pd.DataFrame) -> tuple[list[int], list[int], pd.DataFrame]:
        own = own.sort_values("n")
        ahead = own[own["c"] < own["to"]]["tokens"].tolist()
        return ahead, [system_tokens + sum(ahead[len(ahead) - j :]) for j in range(len(ahead) + 1)], own[own["c"] == own["to"]]

    def outcomes(own: pd.DataFrame) -> pd.DataFrame:
        _, used, mine = starts(own)
        tokens = mine["tokens"].tolist()
        ends = [_filled(tokens, u, j, system_tokens, most_tokens, most_items) for j, u in enumerate(used)] if tokens else []
        return pd.DataFrame({"field": own["field"].iloc[:1], "c": own["to"].iloc[:1], "left": [[n for _, n in ends]], "made": [[out[-1] for out, _ in ends]]})

    found = staged(rows.groupBy("field", "to").applyInPandas(outcomes, "field string, c long, left array<int>, made array<int>"), "pack-outcomes")
    entries, field, open_items, batch = [], None, 0, 0
    for r in found.where(F.size("left") > 0).orderBy("field", "c").toLocalIterator():
        if not entries or r.field != field:
            field, open_items, batch = r.field, 0, 0
        entries.append((field, r.c, open_items, batch))
        batch, open_items = batch + r.made[open_items], r.left[open_items]
    known = spark.createDataFrame(entries, "field string, to long, open_items int, first_batch int")

    def fill(own: pd.DataFrame) -> pd.DataFrame:
        _, used, mine = starts(own)
        j = int(own["open_items"].iloc[0])
        out, _ = _filled(mine["tokens"].tolist(), used[j], j, system_tokens, most_tokens, most_items)
        return pd.DataFrame({"field": mine["field"], "batch": [b + int(own["first_batch"].iloc[0]) for b in out], "id": mine["id"], "tokens": mine["tokens"]})

    same = F.col("field").eqNullSafe(F.col("f"))
    joined = rows.join(known.select(F.col("field").alias("f"), F.col("to").alias("t"), "open_items", "first_batch"), same & (F.col("to") == F.col("t"))).drop("f", "t")
    return joined.groupBy("field", "to").applyInPandas(fill, "field string, batch int, id string, tokens long")


def chunks(items: DataFrame, size: int) -> DataFrame:
    """Items numbered from 0 by `ord` in chunks of `size`."""
    return items.withColumn("chunk", F.floor(F.col("ord") / size))
