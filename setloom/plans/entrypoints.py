"""The engine's commands as one call each: build the log, block a field into clusters, decide, approve and undo, export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.operators import graph, ingest, resolve
from setloom.operators.staging import staged
from setloom.sources import documents


class Built(NamedTuple):
    plays: DataFrame
    missing: DataFrame
    mismatch: DataFrame
    orphans: DataFrame


class Blocked(NamedTuple):
    clusters: DataFrame
    values: DataFrame
    edges: DataFrame
    totals: DataFrame


class Decided(NamedTuple):
    checked: DataFrame
    entries: DataFrame
    log: DataFrame


class Approved(NamedTuple):
    entries: DataFrame
    plan: DataFrame
    audit: DataFrame


def build_plays(djs: DataFrame, files: DataFrame, master: DataFrame, inferred: DataFrame | None = None, drops: DataFrame | None = None, fixes: DataFrame | None = None) -> Built:
    """The play log and what is wrong with it: DJs without a set, differing counts, master rows without a folder.

    files: one row a track of each DJ's chosen file, with file_id where drops are given; see `ingest.merge` for the columns.
    """
    if drops is not None:
        files = ingest.without_dropped(files, drops)
    if fixes is not None:
        master = ingest.move_events(master, fixes)
    plays = staged(ingest.merge(djs, files, master, inferred), "built-plays")
    return Built(plays, ingest.missing_sets(djs, plays), ingest.count_mismatch(files, master), ingest.master_orphans(master, djs))


def block(plays: DataFrame, field: str, decisions: DataFrame | None = None, auto: DataFrame | None = None, apart: DataFrame | None = None, evidence: DataFrame | None = None, unicode: bool = True) -> Blocked:
    """Clusters of spellings of `field` ("work" or "artist") that wait for a decision.

    decisions: the log; auto: the automatic dictionary; apart: declared pairs (a, b); evidence: raw, pos, kind, title.
    """
    column = {"work": "source_work", "artist": "artist"}[field]
    profiles = staged(graph.value_profiles(plays, column), "block-profiles")
    pairs = graph.keep_apart_pairs(apart, unicode) if apart is not None else None
    edges = staged(graph.build_edges(plays, profiles, column, pairs, evidence, unicode), "block-edges")
    # a spelling that was decided in either field is no candidate in the other
    done = resolve.decided_values(decisions, auto) if decisions is not None else None
    found = staged(graph.clusters(field, profiles, edges, graph.capped_components(edges), done), "block-clusters")
    return Blocked(found, graph.cluster_values(found, profiles, field, graph.value_events(plays, column)), edges, graph.cluster_totals(profiles, found))


def decide(payload: DataFrame, decisions: DataFrame, entries: DataFrame, apart: DataFrame, at: str, auto: DataFrame | None = None, unicode: bool = True) -> Decided:
    """Payloads with their codes, and the dictionary entries and log records that the valid ones write.

    Spellings are decided, and go to names, by field. The automatic dictionary (auto) names what exists, but decides nothing: a
    person may still accept its spellings under the same name.
    """
    known = entries.unionByName(auto, allowMissingColumns=True) if auto is not None else entries
    index = resolve.variant_index(known)
    allowed = known.select("field", F.trim("canonical").alias("canonical")).distinct()
    pairs = graph.keep_apart_pairs(apart, unicode)
    checked = staged(resolve.validate(payload, resolve.decided_by_field(decisions), pairs, index, allowed, unicode), "decide-checked")
    return Decided(checked, *resolve.decision_entries(checked, at))


def approve(clusters: DataFrame, proposals: DataFrame, decisions: DataFrame, entries: DataFrame, apart: DataFrame, field: str, at: str, auto: DataFrame | None = None, unicode: bool = True) -> Approved:
    """The automatic dictionary after a run of the approval rules, the plan, and audit records (id, field, action, variants, canonical, reason, at).

    Undoing a run means writing the dictionary without its entries: `undo`.
    """
    known = (entries.unionByName(auto, allowMissingColumns=True) if auto is not None else entries).where(F.col("field") == field)
    auto_here = auto.where(F.col("field") == field) if auto is not None else None
    before = auto_here.select(F.explode(resolve.class_values(auto_here)).alias("raw")).distinct() if auto is not None else clusters.sparkSession.createDataFrame([], "raw string")
    plan = resolve.auto_plan(clusters, proposals, resolve.decided_values(decisions, field=field), before, resolve.variant_index(known).drop("field"), graph.keep_apart_pairs(apart, unicode), field, unicode)
    plan = staged(plan, "approve-plan")
    new = resolve.auto_entries(plan, proposals, field, at)
    audit = new.select("id", "field", F.lit("auto-accept").alias("action"), "variants", "canonical", "reason", F.lit(at).alias("at"))
    return Approved(auto.unionByName(new, allowMissingColumns=True) if auto is not None else new, plan, audit)


def undo(auto: DataFrame, at: str, field: str | None = None, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the automatic dictionary without the entries taken back, audit records of the time `at`): all entries, or those of a field, or
    of the run that was made at the time `run`."""
    gone = F.lit(True) if field is None else F.col("field") == field
    if run is not None:
        gone = gone & (F.col("decided_at") == run)
    gone = F.coalesce(gone, F.lit(False))
    out = auto.where(gone).select("id", "field", F.lit("auto-undo").alias("action"), "variants", "canonical", "reason", F.lit(at).alias("at"))
    return auto.where(~gone), out


def export_aliases(works: DataFrame, artists: DataFrame, generated_at: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts: section, classes, spellings; warnings: section, raw, kept, dropped); with a path, the document is written there."""
    pieces, counts, warnings = documents.aliases_document(works, artists, generated_at)
    if path:
        documents.write_pieces(pieces, path)
    return counts, warnings
