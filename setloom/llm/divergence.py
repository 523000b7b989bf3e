"""Source divergence audit: how far apart the sources of a language are in their use of terms, and by which terms.

Terms are counted by language and source where the texts are; of each language the terms in enough documents are kept. Kept
terms are dealt by hash into blocks, a block of a language being a dense int64 tile of all its sources by the block's terms, at
most about `TILE` cells. In a task, tiles come one after another: all pairs of rows of a tile are held against each other by
broadcasting, their sums are added to the language's partial matrix, and each source keeps a heap of its most telling terms.
Spark sums the partial matrices and merges the heaps.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.llm.common import discard, groups, lean, runs_of_rows, staged, starts_of, strings, utf8

#: Bytes of terms: ASCII letters, the large ones made small, and all of other characters; the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
TILE = 1 << 19  # cells of a tile
MATRIX = 1 << 22  # cells of a partial matrix that a task holds
SCALE = 1_000_000_000


def _count_batches(most: int = 250_000, limit: int = 2 << 20):
    """Counts by (lang, source, term), added up over many texts; a row with an empty term says that the group occurs."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            terms = [b"", *count]
            where = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*where, strings(terms), pa.array([0, *count.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, count)], pa.int64())], names=["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            offsets, body = utf8(batch.column(2))
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs_of_rows(offsets, limit):
                for i in range(a, b):
                    words = body[offsets[i] : offsets[i + 1]].tobytes().translate(FOLD).split()
                    group = langs[i], sources[i]
                    if group not in held:
                        held[group] = Counter(), Counter()
                    count, docs = held[group]
                    count.update(words)
                    docs.update(set(words))
                if sum(len(c) for c, _ in held.values()) + len(held) > most:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) over docs (text, lang, source), nulls as empty; each group has an empty term with count 0."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = src.mapInArrow(lean(_count_batches()), "lang string, source string, term string, count long, docs long")
    # dealt so that a term's sources meet as well, which the kept terms need
    return partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exactly, for 0 <= count <= total < 9e15: three digits at a time."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def pair_sums(p: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sums) for runs of rows: the sum over the columns of (p - q) ** 2 // q, p of a row, q of each row."""
    n, width = p.shape
    step = max(1, cells // max(1, n * width))
    for a in range(0, n, step):
        apart = p[a : a + step, None, :] - p[None, :, :]
        yield a, (apart * apart // p[None, :, :]).sum(axis=2)


def _tile_batches(top: int):
    names = ["lang", "source", "part", "item", "value"]

    def pairs(lang: str, sources: list[str], first: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, values in enumerate(sums, first):
            n = len(sources) - 1
            others = [s for j, s in enumerate(sources) if j != k]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([sources[k]] * n, pa.string()), pa.array(["pair"] * n, pa.string()), pa.array(others, pa.string()), pa.array(np.delete(values, k), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, sources, matrix, heaps = None, [], None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if matrix is not None:
                yield from pairs(lang, sources, 0, matrix)
            for source, heap in zip(sources, heaps, strict=True):
                n = len(heap)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(["term"] * n, pa.string()), strings([t for _, t in heap]), pa.array([-v for v, _ in heap], pa.int64())], names=names)

        for table in groups(batches, ["lang", "block"]):
            langs, blocks = table.column("lang").combine_chunks().dictionary_encode(), table.column("block").to_numpy()
            ends = starts_of(langs.indices.to_numpy(), blocks)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                heads, cells = part.filter(pa.compute.is_null(part.column("term"))), part.filter(pa.compute.is_valid(part.column("term")))
                if langs[a].as_py() != lang:
                    yield from finish()
                    lang, sources = langs[a].as_py(), heads.column("source").to_pylist()
                    heaps = [[] for _ in sources]
                    matrix = np.zeros((len(sources), len(sources)), np.int64) if len(sources) ** 2 <= MATRIX else None
                sizes, kept = heads.column("count").to_numpy(), heads.column("kept").to_numpy()
                coded = cells.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
                words = [t.as_py() for t in coded.dictionary]
                order = sorted(range(len(words)), key=words.__getitem__)
                terms = [words[i] for i in order]
                column = np.argsort(np.array(order, np.int64), kind="stable")[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
                row = {s: i for i, s in enumerate(sources)}
                count = np.zeros((len(sources), len(terms)), np.int64)
                count[[row[s] for s in cells.column("source").to_pylist()], column] = cells.column("count").to_numpy()
                p = shares(count + 1, (sizes + kept)[:, None]) if terms else count
                for first, sums in pair_sums(p):
                    if matrix is None:
                        yield from pairs(lang, sources, first, sums)
                    else:
                        matrix[first : first + len(sums)] += sums
                if not terms:
                    continue
                q = shares(count.sum(axis=0) + 1, np.full(len(terms), sizes.sum() + kept[0]))
                telling = (p - q) ** 2 // q
                for k in range(len(sources)):
                    own = np.flatnonzero((count[k] > 0) & (p[k] > q))
                    own = own[np.argsort(-telling[k, own], kind="stable")[:top]]
                    heaps[k] = list(heapq.merge(heaps[k], [(-int(telling[k, t]), terms[t]) for t in own]))[:top]
        yield from finish()

    return run


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): sources of a language held against each other, and against the language.

    Terms are runs of ASCII letters and non-ASCII characters, A to Z made small. A language keeps the V terms in at least
    `least_docs` of its documents; a group (lang, source), and a language as a whole, gives each of them the share
    p = 1 + floor(10**9 * (count + 1) / (N + V)), N being the count of its kept terms. With f = floor((p - q)**2 / q): part `pair` has
    for each group each other source of its language and the sum of f over the kept terms (0 if there are none), part `term` the
    `top` terms of the group by f against the language, of those that occur in it with p over q. rank: from 1 in each group and
    part, by falling value, of equal ones by item in UTF-8 order. All in integers.

    A null text, lang or source is an empty one; repeated rows count as often as they stand; texts are read whole; groups without
    terms take part; an empty table gives an empty result; other columns don't matter, whatever their names. Groups are never
    brought into one task: what meets is a block of terms, by source.
    """
    counted = term_counts(docs)
    by_term = Window.partitionBy("lang", "term")
    whole = counted.withColumn("all_docs", F.sum("docs").over(by_term)).withColumn("is_first", F.row_number().over(by_term.orderBy("source")) == 1)
    kept = staged(whole.where((F.col("term") == "") | (F.col("all_docs") >= least_docs)).select("lang", "source", "term", "count", (F.col("is_first") & (F.col("term") != "")).cast("long").alias("firsts")), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("count"), F.sum("firsts").alias("firsts"))
    per_lang = Window.partitionBy("lang")
    terms = F.sum("firsts").over(per_lang)
    sources = F.count("*").over(per_lang)
    heads = staged(sizes.select("lang", "source", "count", terms.alias("kept"), F.greatest(F.lit(1), F.ceil(terms * sources / F.lit(tile))).alias("blocks")), "sources")
    # the number of a language's blocks, copied so that a language's terms can be split over tasks
    salts = 32
    langs = heads.groupBy("lang").agg(F.first("blocks").alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cells = kept.where("term <> ''").withColumn("h", F.xxhash64("term")).withColumn("salt", F.pmod(F.col("h"), F.lit(salts)).cast("int"))
    cells = cells.join(langs, ["lang", "salt"]).select("lang", F.pmod(F.shiftrightunsigned("h", 5), "blocks").alias("block"), "source", "term", "count", F.lit(None).cast("long").alias("kept"))
    rows = heads.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "count", "kept").unionByName(cells)
    dealt = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "source", "term")
    found = dealt.mapInArrow(lean(_tile_batches(top)), "lang string, source string, part string, item string, value long")
    found = staged(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergence")
    discard(kept, heads)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
