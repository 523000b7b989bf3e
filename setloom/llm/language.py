"""Language identification with string kernels.

A text is cut into blocks of `block` characters. A block is the set of the 1- to 3-grams it holds (a blended spectrum of
presences, hashed to `dims` buckets), and the kernel of two blocks is the cosine of their sets. Nyström landmarks turn the
kernel into a feature map, and kernel ridge regression against each language gives its score. Fitting takes a bounded
sample of labelled documents (`per_language`) and of each at most `blocks_each` blocks, drawn by hash from the whole text;
scoring takes every block of every text, as products of the block matrix with the landmarks and of that with the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean
from setloom.llm.sampling import drawn_parts, fold, stratified

LETTER = regex.compile(r"\p{L}")
NGRAMS = (1, 2, 3)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # dims x landmarks, each column of unit length
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    dims: int
    block: int


def presence(texts: list[str], dims: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block matrix of 0 and 1, text of each block, characters of each block). A text has at least one block."""
    shift = np.uint32(32 - (dims.bit_length() - 1))
    chars = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(c) for c in chars])
    blocks = -(-size // block)
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(texts)), blocks)
    length = np.full(len(owner), block)
    length[first + blocks - 1] = size - (blocks - 1) * block
    grid = np.zeros(len(owner) * dims, np.uint8)
    flat = np.concatenate(chars)
    start = np.cumsum(size) - size
    at = np.arange(len(flat)) - np.repeat(start, size)
    cell = (np.repeat(first, size) + at // block) * dims
    left = np.repeat(size, size) - at  # characters from here to the end of the text
    h = np.zeros(len(flat), np.uint32)
    for n in NGRAMS:
        h = h[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        ok = left[: len(h)] >= n
        grid[cell[: len(h)][ok] + (mixed >> shift)[ok]] = 1
    return grid.reshape(-1, dims), owner, length


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(x.sum(axis=1, keepdims=True) + np.float32(1e-9))


def fit(texts: list[str], labels: list[str], dims: int, block: int, landmarks: int, ridge: float, seed: int = 5) -> LanguageModel:
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    grid, owner, _ = presence(texts, dims, block)
    x = _unit(grid)
    y = np.array([languages.index(v) for v in labels])[owner]
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: max(1, landmarks // len(languages))] for c in range(len(languages))])
    marks = x[chosen]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    phi = (x @ marks.T).astype(np.float64) @ to_features
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # every language counts the same, however many blocks it has
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weight *= len(y) / weight.sum()
    mean_x, mean_y = np.average(phi, 0, weight), np.average(target, 0, weight)
    px, py = phi - mean_x, target - mean_y
    coef = np.linalg.solve((px * weight[:, None]).T @ px + ridge * np.eye(px.shape[1]), (px * weight[:, None]).T @ py)
    return LanguageModel(languages, np.ascontiguousarray(marks.T), (to_features @ coef).astype(np.float32), mean_y - mean_x @ coef, dims, block)


def score(model: LanguageModel, texts: list[str], at_once: int = 128) -> np.ndarray:
    """Mean decision values of each text for each language, over all its blocks by their characters."""
    total, chars = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    # a part of a long text is scored on its own; its blocks end where they would end anyway
    step = model.block * at_once
    pieces = [(i, t[a : a + step - 2]) for i, t in enumerate(texts) for a in range(0, max(len(t), 1), step - 2)]
    at = 0
    while at < len(pieces):
        to, blocks = at, 0
        while to < len(pieces) and (to == at or blocks < at_once):
            blocks += len(pieces[to][1]) // model.block + 1
            to += 1
        grid, owner, length = presence([t for _, t in pieces[at:to]], model.dims, model.block)
        value = (_unit(grid) @ model.landmarks) @ model.weights + model.bias
        who = np.array([i for i, _ in pieces[at:to]])[owner]
        np.add.at(total, who, value * length[:, None])
        np.add.at(chars, who, length)
        at = to
    return total / np.maximum(chars, 1)[:, None]


def _score_batches(shared, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            known = [i for i, t in enumerate(texts) if t and model.languages and LETTER.search(t)]
            lang, best = ["und"] * len(texts), np.zeros(len(texts))
            for a in range(0, len(known), 128):
                part = known[a : a + 128]
                value = score(model, [texts[i] for i in part])
                top = value.argmax(axis=1)
                for i, k, v in zip(part, top.tolist(), value.max(axis=1).tolist(), strict=True):
                    lang[i], best[i] = model.languages[k], min(max((1 + v) / 2, 0.0), 1.0)
            names = [f"c{i}" for i in range(carry)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(best)], names=[*names, "lang_pred", "score"])

    return run


def fit_language_model(docs: DataFrame, per_language: int = 250, blocks_each: int = 2, dims: int = 8192, block: int = 4096, landmarks: int = 128, ridge: float = 1.0) -> LanguageModel:
    """Fit on the documents outside fold 0 with text, a letter and a language, `per_language` of each at most.

    Of a text of over `blocks_each` blocks as many are drawn by hash over its whole length.
    """
    usable = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    some = stratified(usable, "lang", per_language)
    # a block is read with a blank on either side
    rows = some.select("doc_id", "lang", F.explode(drawn_parts(F.col("text"), block - 2, blocks_each)).alias("text"))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.lang, r.text) for r in rows.collect()))
    if not rows:
        return LanguageModel([], np.zeros((dims, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), dims, block)
    return fit([r[3] for r in rows], [r[2] for r in rows], dims, block, landmarks, ridge)


def identify_language(docs: DataFrame, carry: tuple[str, ...] = (), **options: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, then `carry`) for each row of docs (doc_id, text, lang).

    Learns from text and lang of rows outside fold 0 alone; a prediction sees the text alone. `und` with score 0: the text is
    null, empty or has no letter, or there was nothing to learn from. score: (1 + decision) / 2, held within 0 to 1. Languages
    that tie give the first by name. Very long texts are scored part by part, whole. Repeated rows get equal predictions; a null
    doc_id counts as held out; an empty table gives an empty result. Columns not in `carry` are left out, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_language_model(docs, **options))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    src = docs.select("text", F.col("doc_id").cast("long").alias("c0"), held.alias("c1"), *[F.col(c).alias(f"c{i + 2}") for i, c in enumerate(carry)])
    kinds = dict(src.dtypes)
    n = len(carry) + 2
    out = src.mapInArrow(lean(_score_batches(model, n)), ", ".join(f"c{i} {kinds[f'c{i}']}" for i in range(n)) + ", lang_pred string, score double")
    return out.select(F.col("c0").alias("doc_id"), F.col("c1").alias("held_out"), "lang_pred", "score", *[F.col(f"c{i + 2}").alias(c) for i, c in enumerate(carry)])
