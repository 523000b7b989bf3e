"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. A source's target is its share of the budget by weight, held to `most` times its size, with what is over
shared out again. A source is taken whole as often as its target holds it; what remains of the target is met by choosing
documents: counted by exact size, first the proportional number of each size, then a bounded-knapsack dynamic program over
the counts left for what is still missing. Which documents of a size are taken follows a seeded hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import discard, numbered, row_key, rows_of, staged

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted from each source; sources by code point, null last, take the weights in turn."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size = dict(order)
    target = dict.fromkeys(size, 0.0)
    left, free = budget * sum(size.values()), list(size)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > most * size[s]]
        if not over:
            for s in free:
                target[s] = weight[s] * share
            break
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
        free = [s for s in free if s not in set(over)]
    return target


def fit_counts(sizes: list[int], counts: list[int], goal: int, window: int = 1 << 16) -> list[int]:
    """How many documents of each size to take so that the sum comes as near to `goal` as can be found, never above it.

    Takes the proportional number of each size, fills up from the largest size down until less than `window` is missing,
    and solves the rest exactly: a bitset holds which sums the documents left can reach, and the largest one is traced back.
    """
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if goal >= total:
        return list(counts)
    take = [min(n, int(n * goal // total)) for n in counts]
    left = goal - sum(s * k for s, k in zip(sizes, take, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, left - window) // sizes[i])
        take[i] += more
        left -= more * sizes[i]
    left = min(left, window + max(sizes))
    # keep many sizes in play: give documents back as far as the window allows, first one of each size, then more
    for most in (1, total):
        for i in order:
            back = max(0, min(take[i], most, (window - left) // sizes[i]))
            take[i] -= back
            left += back * sizes[i]
    full = (1 << (left + 1)) - 1
    reach, steps, used = 1, [], []
    for i in sorted(order, key=lambda i: sizes[i]):
        room = min(counts[i] - take[i], left // sizes[i])
        part = 1
        while room > 0:  # a bounded number of equal items as powers of two
            k = min(part, room)
            steps.append(reach)
            used.append((i, k))
            reach |= (reach << (k * sizes[i])) & full
            room -= k
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, (i, k) in zip(reversed(steps), reversed(used), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= k * sizes[i]
    return take


def _fit_source(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["size"] > 0].sort_values("size")
        if not len(rows):
            return pd.DataFrame({"source_key": [], "size": [], "whole": [], "extra": []})
        size, n = rows["size"].tolist(), rows["n"].tolist()
        total = sum(a * b for a, b in zip(size, n, strict=True))
        goal = rows["target"].iloc[0]
        whole = math.floor(goal / total)
        extra = fit_counts(size, n, round(goal - whole * total), window)
        return pd.DataFrame({"source_key": rows["source_key"], "size": size, "whole": whole, "extra": extra})

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, seed: int = 11, window: int = 1 << 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, then `carry`) for each row of docs (doc_id, text, source).

    taken: words that the mix takes from the row, repeats counted: a multiple of its size, at most `most` times. Null or
    empty texts have size 0 and nothing taken; a null source is a source of its own, after all others; rows with equal doc_id
    stand for themselves; very long texts are one row of their size; of rows with equal sizes the seeded hash of the id decides;
    an empty table gives an empty result; columns not in `carry` are left out. The per-source totals, one row a source, pass through the
    driver; sizes within a source are counted before they meet, so a task gets one row for each different size.
    """
    spark = docs.sparkSession
    kept = list(dict.fromkeys(["doc_id", "source", "text", *carry]))
    key = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    # only row keys and sizes go through the mix; what is carried joins at the end
    rk = [row_key(kept).alias("rk")] if carry else []
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("source_key"), words(F.col("text")).alias("size"), *rk), "mix-sized")
    totals = {r.source_key: (r.source, r.total, r.n) for r in sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("total"), F.count("*").alias("n")).collect()}
    targets = source_targets([(s, t) for s, t, _ in totals.values()], weights, budget, most)
    table = spark.createDataFrame([(k, int(t), float(targets[s])) for k, (s, t, _) in totals.items()], "source_key string, source_size long, target double")
    hist = sized.groupBy("source_key", "size").agg(F.count("*").alias("n")).join(table, "source_key")
    plan = hist.groupBy("source_key").applyInPandas(_fit_source(window), "source_key string, size long, whole long, extra long")
    plan = staged(plan, "mix-plan")
    rows = sum(n for *_, n in totals.values())
    point = F.xxhash64(F.lit(seed), "doc_id")
    ranked = numbered(sized.withColumn("point", point), ["source_key", "size"], ["point", "doc_id"], "rank", rows)
    out = ranked.join(plan, ["source_key", "size"], "left").join(table, "source_key")
    taken = F.col("size") * F.coalesce(F.col("whole") + (F.col("rank") < F.col("extra")).cast("long"), F.lit(0))
    out = out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[c for c in out.columns if c == "rk"])
    if not carry:
        return out
    # equal rows differ at most in what is taken of them
    each = staged(out.groupBy("rk", "size", "source_size", "target", "taken").agg(F.count("*").alias("n")), "mix-taken")
    discard(sized, plan)
    full = rows_of(docs, each, kept).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return full.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", "taken", *carry)
