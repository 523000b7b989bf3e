"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Which documents share a sequence depends on their lengths alone, and there are at most `size` different lengths. So the
plan is made from counts by length (a bounded table), as patterns with a number of sequences each, and the documents are
dealt to the plan's places by their number among the documents of their length.

Reduction: for a piece x, longest first, with r tokens free beside it, and all other pieces that aren't fixed yet, {x} is
final if none of them fits; {x, k} with the longest fitting k is final if no set of them that fits in r is longer than k;
{x, k, b} is final if no three of them fit and b is the best partner that any two could have. Such a set dominates every
other way to fill x's sequence, so fixing it loses nothing. Passes go on until none fixes a set; what is left goes to
best-fit decreasing.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import lean, numbered, parts_of, runs_of_rows, staged, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A run of letters, then marks that the pre-tokeniser keeps together: one pre-token each.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:*$%&#|]*)$"


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start[i]:start[i] + size[i]] for each i of `which` in a row, and their n + 1 boundaries."""
    many = size[which]
    edge = np.zeros(len(which) + 1, np.int64)
    np.cumsum(many, out=edge[1:])
    at = np.repeat(start[which] - edge[:-1], many)
    at += np.arange(edge[-1])
    return flat[at], edge


class WordIds:
    """Token ids of white-space-separated words: each different word of a call is encoded once.

    The tokeniser drops white space and never looks across it, so a text's ids are its words' ids in a row. Nothing is kept
    from one call to the next, so memory is bounded by the words of one call.
    """

    def __init__(self, path: str, joined: int = 200) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.joined = Tokenizer.from_file(path), joined
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 boundaries) of words of letters alone: many are encoded as one text and told apart by their last tokens."""
        parts = [words[a : a + self.joined] for a in range(0, len(words), self.joined)]
        ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, got in zip(parts, self.encode([" ".join(p) for p in parts]), strict=True):
            own = np.array(got, np.uint32)
            stop = np.flatnonzero(self.ends[own]) + 1
            if len(stop) != len(part):
                alone = self.encode(part)
                own, stop = np.array([i for x in alone for i in x], np.uint32), np.cumsum([len(x) for x in alone])
            ids.append(own)
            size.append(np.diff(stop, prepend=0))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(size))])

    def of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 boundaries) of different words of any kind."""
        split = pc.extract_regex(words, PLAIN)
        plain = np.asarray(split.is_valid())
        core = pc.utf8_lower(split.field("core")).filter(pa.array(plain)).dictionary_encode()
        marks = split.field("marks").filter(pa.array(plain)).dictionary_encode()
        odd = self.encode([*marks.dictionary.to_pylist(), *words.filter(pa.array(~plain)).to_pylist()])
        letters, edge = self.of_letters(core.dictionary.to_pylist())
        size = np.concatenate([np.diff(edge), np.array([len(x) for x in odd], np.int64)])
        flat = np.concatenate([letters, np.array([i for x in odd for i in x], np.uint32)])
        # two parts for a plain word, one and an empty one for another
        first, second = np.empty(len(words), np.int64), np.full(len(words), len(size))
        first[plain], second[plain] = np.asarray(core.indices), len(core.dictionary) + np.asarray(marks.indices)
        first[~plain] = len(core.dictionary) + len(marks.dictionary) + np.arange((~plain).sum())
        size = np.append(size, 0)
        ids, edge = gathered(flat, np.cumsum(size) - size, size, np.stack([first, second], axis=1).ravel())
        return ids, edge[::2]

    def of_texts(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 boundaries) of whole texts, each followed by `end` if given."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        ids, edge = self.of_words(coded.dictionary)
        code, last = np.asarray(coded.indices).astype(np.int64), np.asarray(words.offsets).astype(np.int64)
        last = last - last[0]
        size = np.diff(edge)
        if end is not None:
            code = np.insert(code, last[1:], len(size))
            last = last + np.arange(len(last))
            ids, edge, size = np.append(ids, np.uint32(end)), edge, np.append(size, 1)
        out, at = gathered(ids, np.cumsum(size) - size, size, code)
        return out, at[last]


def _piece_batches(path: str, size: int, end_id: int, with_ids: bool, limit: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            off, body = utf8(batch.column(1))
            for a, b in runs_of_rows(off, limit):
                if off[b] - off[a] > limit:  # one long text
                    own = body[off[a] : off[b]]
                    found = [words.of_texts(pa.array([own[x:y].tobytes().decode()], pa.string()), None)[0] for x, y in parts_of(own, limit)]
                    ids = np.append(np.concatenate(found), np.uint32(end_id))
                    edge = np.array([0, len(ids)])
                else:
                    ids, edge = words.of_texts(batch.column(1).slice(a, b - a), end_id)
                ids = np.ascontiguousarray(ids, "<u4")
                n = -(-np.diff(edge) // size)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = edge[:-1][row] + piece * size
                stop = np.minimum(start + size, edge[1:][row])
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                cols = [batch.column(0).take(pa.array(row + a)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(stop - start), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(start, edge[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["token_ids"] * with_ids)

    return run


def _largest_sum(counts: Counter, room: int) -> int:
    """The largest sum up to `room` of pieces left."""
    full, reach = (1 << (room + 1)) - 1, 1
    for length in sorted(counts):
        if length > room:
            break
        n, k = min(counts[length], room // length), 1
        while n > 0:
            k = min(k, n)
            reach |= (reach << (k * length)) & full
            n -= k
            k *= 2
        if reach >> room & 1:
            return room
    return reach.bit_length() - 1


def dominating_set(x: int, others: Counter, size: int) -> tuple[int, ...] | None:
    """The set with x that dominates every other way to fill x's sequence from `others`, if one of up to three pieces does."""
    room = size - x
    lengths = sorted(v for v, n in others.items() if v <= room and n > 0)
    if not lengths:
        return (x,)
    k = lengths[-1]
    if k == room or _largest_sum(Counter({v: others[v] for v in lengths}), room) == k:
        return (x, k)
    three = sorted(v for v in lengths for _ in range(min(others[v], 3)))[:3]
    if len(three) == 3 and sum(three) <= room:
        return None
    fits = [v for v in lengths if v <= room - k and others[v] > (v == k)]
    second = max((v for v in lengths if 2 * v <= room), default=0)
    return (x, k, fits[-1]) if fits and fits[-1] >= second else None


def reduce_by_dominance(counts: Counter, size: int) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """(patterns that are final with their numbers, counts left)."""
    left, fixed = Counter({k: n for k, n in counts.items() if n > 0}), []
    again = True
    while again:
        again = False
        for x in sorted(left, reverse=True):
            while left[x] > 0:
                # all that isn't fixed counts, the longer pieces that couldn't be fixed as well
                pattern = dominating_set(x, left - Counter({x: 1}), size)
                if pattern is None:
                    break
                need = Counter(pattern)
                # fewer pieces reach fewer sums, so the reason stands for as many sequences as the counts hold
                times = min(left[v] // n for v, n in need.items())
                fixed.append((pattern, times))
                left -= Counter({v: n * times for v, n in need.items()})
                again = True
    return fixed, left


def best_fit(counts: Counter, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal sequences are kept as one pattern with a number."""
    open_: dict[int, list[list]] = {}  # free tokens -> [[pattern, number]]
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n > 0:
            free = min((r for r in open_ if r >= x), default=size)
            pattern, many = open_[free].pop() if free in open_ else [(), n]
            if free in open_ and not open_[free]:
                del open_[free]
            each = free // x
            full, odd = min(many, n // each), 0
            if full < many and n - full * each:
                odd = n - full * each
            for number, k in ((full, each), (1 if odd else 0, odd), (many - full - (1 if odd else 0), 0)):
                if number and (pattern or k):
                    open_.setdefault(free - k * x, []).append([pattern + (x,) * k, number])
            n -= full * each + odd
    return [(tuple(p), n) for entries in open_.values() for p, n in entries]


def pack_plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (the lengths in a sequence) with their numbers of sequences.

    Reduced exactly, then best fit; where best fit happens to fare worse on the remainder than on the whole, its whole plan.
    """
    fixed, rest = reduce_by_dominance(Counter(counts), size)
    plans = [fixed + best_fit(rest, size)]
    if rest:
        plans.append(best_fit(Counter(counts), size))
    plan: Counter = Counter()
    for pattern, n in min(plans, key=lambda p: sum(n for _, n in p)):
        plan[pattern] += n
    return sorted(plan.items(), reverse=True)


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(lean(_piece_batches(tokenizer, size, end_id, with_ids)), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", token_ids array<int>" * with_ids)


def pack_sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text).

    A document is its token ids and `end_id`; only a longer one than `size` is cut. With `with_ids`, token_ids follow. A null
    or empty text is one piece of length 1; a very long text is encoded in parts cut at white space; repeated rows are packed
    as often as they occur; an empty table gives an empty result; further columns of docs, whatever their names, are left out. The plan that is broadcast has at most `size` lengths and a few patterns for each, whatever the corpus.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, tokenizer, size, end_id, with_ids), "pack-pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, at, sequence = [], Counter(), 0
    for pattern, many in pack_plan(counts, size):
        offset = 0
        for length, k in sorted(Counter(pattern).items(), reverse=True):
            places.append((length, at[length], at[length] + k * many, k, sequence, offset))
            at[length] += k * many
            offset += k * length
        sequence += many
    plan = spark.createDataFrame(places, "length long, lo long, hi long, each int, first_sequence long, first_offset long")
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values()))
    placed = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(plan.length)
    within = F.col("rank") - F.col("lo")
    sequence_id = F.col("first_sequence") + F.floor(within / F.col("each"))
    offset = F.col("first_offset") + (within % F.col("each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *["token_ids"] * with_ids)
