"""Quality classification by naive Bayes support vectors.

A text is cut into blocks of `block` bytes. A block's features are indicators: n-grams of 1 to 4 bytes over character
classes (capital, small, digit; marks as they are), words, and 1- to 4-grams of whether a word repeats the one before. Each indicator
is scaled by the log ratio of its smoothed frequencies in the two classes, and a linear model with hinge loss is fitted by
dual coordinate descent. Margins become scores by a logistic curve fitted on rows kept out of the descent.

Fitting takes a bounded sample of labelled rows (`per_label` of each label) and of each at most `blocks_each` blocks, drawn by
hash from the whole text; scoring takes every block of every text and weighs blocks by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean, runs_of_rows, utf8
from setloom.llm.sampling import fold, stratified

SHAPES, WORDS, REPEATS = 1 << 14, 1 << 16, 32
DIMS = SHAPES + WORDS + REPEATS
NGRAMS = (1, 2, 3, 4)

CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91] = 65
CLASS[97:123] = 97
CLASS[48:58] = 48
CLASS[128:] = 97
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    block: int


def features(body: np.ndarray, offsets: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each block, bytes of each block, block of each present feature, feature) for the texts in body."""
    size = np.diff(offsets)
    blocks = np.maximum(-(-size // block), 1)
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(size)), blocks)
    length = np.full(len(owner), block)
    length[first + blocks - 1] = size - (blocks - 1) * block
    n = len(body)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(n) - offsets[:-1][row]
    where = first[row] + at // block
    left = size[row] - at
    shape = CLASS[body].astype(np.uint32)
    grid = np.zeros(len(owner) * SHAPES, bool)
    h = np.zeros(n, np.uint32)
    for k in NGRAMS:
        if n < k:
            break
        h = h[: n - k + 1] * np.uint32(0x01000193) + shape[k - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(k)
        mixed = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)
        ok = left[: len(h)] >= k
        grid[where[: len(h)][ok] * SHAPES + mixed[ok]] = True
    present = np.flatnonzero(grid)
    keys = [(present // SHAPES) * DIMS + present % SHAPES]
    # words: runs without white space inside one text
    solid = ~SPACE[body]
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = SPACE[body[:-1]] | (at[1:] == 0)
    start = np.flatnonzero(solid & new)
    if len(start):
        stop_here = np.ones(n, bool)
        stop_here[:-1] = SPACE[body[1:]] | (at[1:] == 0)
        end = np.flatnonzero(solid & stop_here) + 1
        low = np.where((body >= 65) & (body <= 90), body + 32, body).astype(np.uint64)
        stirred = (low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        stirred ^= stirred >> np.uint64(29)
        # a word's hash: sum of stirred bytes times odd powers of their place in it
        place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], n) - np.repeat(start, np.diff(np.append(start, n)))])
        power = np.multiply.accumulate(np.full(1024, 0xD6E8FEB86659FD93, np.uint64))[place & 1023]
        word = np.add.reduceat(np.where(solid, stirred * power, np.uint64(0)), start)
        word ^= word >> np.uint64(32)
        word *= np.uint64(0xD6E8FEB86659FD93)
        bucket = (word >> np.uint64(48)).astype(np.int64)
        home = where[start]
        keys.append(home * DIMS + SHAPES + bucket)
        same = np.zeros(len(start), np.int64)
        same[1:] = (word[1:] == word[:-1]) & (row[start[1:]] == row[start[:-1]]) & (end[1:] - start[1:] == end[:-1] - start[:-1])
        for k in NGRAMS:
            if len(start) >= k:
                code = sum(same[j : len(same) - k + 1 + j] << j for j in range(k))
                ok = row[start[: len(code)]] == row[start[k - 1 :]]
                keys.append((home[: len(code)] * DIMS + SHAPES + WORDS + (1 << k) + code)[ok])
    key = np.unique(np.concatenate(keys))
    return owner, length, key // DIMS, key % DIMS


def in_parts(body: np.ndarray, off: np.ndarray, block: int, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first block, bytes, offsets) of parts of at most about `limit` bytes; a long text is cut between blocks."""
    limit = max(limit // block, 1) * block
    for a, b in runs_of_rows(off, limit):
        if b == a + 1 and off[b] - off[a] > limit:
            for x in range(int(off[a]), int(off[b]), limit):
                y = min(x + limit, int(off[b]))
                yield a, (x - int(off[a])) // block, body[x:y], np.array([0, y - x])
        else:
            yield a, 0, body[off[a] : off[b]], off[a : b + 1] - off[a]


def chosen_blocks(size: int, block: int, most: int) -> list[int]:
    """At most `most` of the blocks of a text of `size` bytes, drawn by hash over its whole length."""
    n = max(-(-size // block), 1)
    h = (np.arange(n, dtype=np.uint64) + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return np.sort(np.argsort(h, kind="stable")[:most]).tolist()


def _feature_batches(block: int, blocks_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(2))
            for a, first, part, rel in in_parts(body, off, block):
                owner, _, where, feature = features(part, rel, block)
                edge = np.searchsorted(where, np.arange(len(owner) + 1))
                for k in range(len(rel) - 1):
                    r, own = a + k, int(np.searchsorted(owner, k))
                    blocks = int(np.searchsorted(owner, k, side="right")) - own
                    for c in chosen_blocks(int(off[r + 1] - off[r]), block, blocks_each):
                        if first <= c < first + blocks:
                            i = own + c - first
                            yield pa.RecordBatch.from_arrays([batch.column(0)[r : r + 1], batch.column(1)[r : r + 1], pa.array([c], pa.int32()), pa.array([feature[edge[i] : edge[i + 1]].astype("<i4").tobytes()], pa.binary())], names=["doc_id", "y", "part", "features"])

    return run


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [smooth + np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == c] or [np.zeros(0, int)]), minlength=DIMS) for c in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over indicator rows scaled by `scale`; cost: C of each row."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + bias) - 1
            to = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # rows and bias have squared length 1 + 1
            step = (to - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = to
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    t = t * (1 - 2e-3) + 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = p * (1 - p)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        hess = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, block: int, rounds: int = 20, c: float = 1.0, seed: int = 3) -> QualityModel:
    y = np.where(y > 0, 1, -1)
    if not len(rows) or len(set(y.tolist())) < 2:  # nothing to tell apart
        return QualityModel(np.zeros(DIMS), 0.0, 0.0, 3.0 * (int(y[0]) if len(rows) else 0), block)
    kept = np.arange(len(rows)) % 5 == 0
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(rows), bool)
    use = np.flatnonzero(~kept).tolist()
    train, ty = [rows[i] for i in use], y[use]
    scale = log_count_ratio(train, ty)
    share = {v: (ty == v).sum() for v in (1, -1)}
    cost = np.array([c * len(ty) / 2 / share[v] for v in ty.tolist()])
    w, bias = dual_descent(train, ty, scale, cost, rounds, seed)
    check = np.flatnonzero(kept).tolist() or use
    margin = np.array([w[rows[i]] @ scale[rows[i]] / max(np.sqrt((scale[rows[i]] ** 2).sum()), 1e-9) + bias for i in check])
    slope, shift = _logistic(margin, y[check])
    return QualityModel(np.stack([w * scale, scale**2]), bias, slope, shift, block)


def margins(model: QualityModel, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean margin of each text over its blocks by their bytes. n-grams and repeats over the end of a long text's part don't count."""
    total, weight = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    if model.weights.ndim == 1:
        return total
    for a, _, part, rel in in_parts(body, offsets, model.block):
        owner, length, where, feature = features(part, rel, model.block)
        dot = np.bincount(where, model.weights[0][feature], len(owner))
        norm = np.sqrt(np.bincount(where, model.weights[1][feature], len(owner)))
        value = dot / np.maximum(norm, 1e-9) + model.bias
        share = np.maximum(length, 1).astype(float)
        total[a : a + len(rel) - 1] += np.bincount(owner, value * share, len(rel) - 1)
        weight[a : a + len(rel) - 1] += np.bincount(owner, share, len(rel) - 1)
    return total / weight


def _score_batches(shared, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            off, body = utf8(batch.column(0))
            out = margins(model, body, off)
            p = 1 / (1 + np.exp(-np.clip(model.slope * out + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=[*(f"c{i}" for i in range(carry)), "score"])

    return run


def fit_quality_model(docs: DataFrame, labels: DataFrame, per_label: int = 2000, blocks_each: int = 2, block: int = 4096) -> QualityModel:
    """Fit on at most about `per_label` documents of each label outside fold 0; a document with several labels counts for each."""
    marked = labels.where("quality is not null").select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("y"))
    marked = marked.where(fold(F.col("labelled")) != 0).withColumn("doc_id", F.col("labelled"))
    some = stratified(marked, "y", per_label).select("labelled", "y")  # about per_label rows of a label, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    got = rows.mapInArrow(lean(_feature_batches(block, blocks_each)), "doc_id long, y int, part int, features binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.part, r.y, r.features))
    return fit([np.frombuffer(r.features, "<i4") for r in got], np.array([r.y for r in got]), block)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: tuple[str, ...] = (), **options: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, then `carry`) for each row of docs (doc_id, text).

    Learns from labels (doc_id, quality) of rows outside fold 0 alone; a score sees the text alone. A null text counts as
    empty and gets the score of a text without features; very long texts are scored part by part, whole; a null doc_id counts as
    held out; repeated rows get equal scores; without labels of both kinds all scores are equal; an empty table gives an empty
    result. Columns not in `carry` are left out, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality_model(docs, labels, **options))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    src = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("c0"), held.alias("c1"), *[F.col(c).alias(f"c{i + 2}") for i, c in enumerate(carry)])
    kinds = dict(src.dtypes)
    n = len(carry) + 2
    out = src.mapInArrow(lean(_score_batches(model, n)), ", ".join(f"c{i} {kinds[f'c{i}']}" for i in range(n)) + ", score double")
    return out.select(F.col("c0").alias("doc_id"), F.col("c1").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"c{i + 2}").alias(c) for i, c in enumerate(carry)])
