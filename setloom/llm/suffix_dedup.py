"""Removal of repeated byte strings by sparse suffix sorting (deep-shallow).

Wanted: every byte that lies in a string of `length` bytes which also starts somewhere else, in any document.

1. Anchors. Each window of `length` bytes names one position in it: the first least hash among its `gram`-byte grams. Equal
   windows name the same gram at the same distance, so only windows of equal anchors need comparing; an anchor's windows
   form one slice of text. Anchors are found in one scan and carry hashes only.
2. Anchors whose gram occurs at one place only are dropped. Slices that occur at two places are repeated as a whole.
3. The other slices of a contested gram are fetched once each and sorted as suffixes that start at the anchor (onwards and
   backwards) by deep-shallow sorting: multikey quicksort to a shallow depth, then a blind trie for each group that still
   agrees. Ranks and common prefixes say exactly which windows are equal.
4. The slices of a frequent gram (over `group_cap` different ones) are dealt out by content first: the windows of a slice are
   taken in ranges, and all windows of a range hold the same stretch, so only slices that agree on it meet. They are sorted
   as in 3. Where over `group_cap` slices agree even on that stretch, their windows are hashed (128 bits) and counted by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import discard, groups, is_blank, lean, runs_of_rows, staged, starts_of, utf8

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STIR = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base squared ... modulo 2^64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams of `gram` bytes."""
    n = len(body)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = (total[gram:] - total[:-gram]) * powers(INVERSE, n - gram + 1)
    h ^= h >> np.uint64(32)
    h *= STIR
    h ^= h >> np.uint64(29)
    h *= STIR
    h ^= h >> np.uint64(32)
    return h


def first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its first least value (by the upper 52 bits)."""
    n = len(h)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:n] = h
    low = np.uint64(4095)
    full = ((full & ~low) | np.tile(np.arange(width, dtype=np.uint64), blocks)).reshape(blocks, width)
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    upto = np.minimum.accumulate(full, axis=1).ravel()
    start = np.arange(n - width + 1)
    a, b = after[: n - width + 1], upto[width - 1 : n]
    first = (a >> np.uint64(12)) <= (b >> np.uint64(12))
    block = np.where(first, start, start + width - 1) // width
    return block * width + (np.where(first, a, b) & low).astype(np.int64)


def anchors(body: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, gram hash) over the texts body[offsets[i]:offsets[i + 1]], as positions in body."""
    nothing = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(body) < length:
        return nothing
    h = gram_hashes(body, gram)
    chosen = first_minima(h, length - gram + 1)
    row = np.searchsorted(offsets, np.arange(len(chosen)), side="right") - 1
    row = np.minimum(row, len(offsets) - 2)
    ok = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[1:][row])
    if not len(ok):
        return nothing
    at, who = chosen[ok], row[ok]
    edge = starts_of(at, who)
    s, e = edge[:-1], edge[1:] - 1
    return who[s], at[s], ok[s], ok[e], h[at[s]]


ANCHOR = "khash long, shash long, tkey binary, doc_id long, pos int, lo int, hi int"


def _anchor_batches(length: int, gram: int, limit: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            off, body = utf8(batch.column(2))
            for a, b in runs_of_rows(off, limit):
                # windows are told apart by what they hold, so a long text is read in parts that overlap by a window less one byte
                for x in range(int(off[a]), max(int(off[b]) - length + 1, int(off[a]) + 1), limit):
                    y = min(x + limit + length - 1, int(off[b]))
                    part = body[x:y]
                    rel = np.array([0, y - x]) if b == a + 1 else off[a : b + 1] - x
                    row, at, first, last, h = anchors(part, rel, length, gram)
                    if not len(row):
                        continue
                    view = memoryview(part)
                    sh = np.fromiter((digest(view[s : e + length]) for s, e in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(row))
                    take = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), batch.column(1).take(take), batch.column(0).take(take)]
                        + [pa.array(v.astype(np.int32)) for v in (at + x - off[row + a], at - last, at - first)],
                        names=["khash", "shash", "tkey", "doc_id", "pos", "lo", "hi"],
                    )

    return run


def common_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, given that the first `at` bytes agree."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def blind_trie_order(strings: list[bytes], ids: list[int], depth: int) -> list[tuple[int, int]]:
    """Sort the strings `ids`, which agree on `depth` bytes: (id, common length with the one before).

    A blind trie keeps at each node only the depth and the branching bytes. A new string first runs down blindly, comparing
    branch bytes alone, to some leaf; one comparison with that leaf gives the common length, at which it then branches off.
    """
    root: list = [None, ids[0]]  # leaf: [None, id, equals...]; inner: [depth, {byte: node}]
    for i in ids[1:]:
        s, node = strings[i], root
        while node[0] is not None:
            d = node[0]
            nxt = node[1].get(s[d] if d < len(s) else -1)
            node = nxt if nxt is not None else next(iter(node[1].values()))
        other = strings[node[1]]
        common = common_length(s, other, depth)
        if common == len(s) == len(other):
            node.append(i)
            continue
        mine, theirs = (s[common] if common < len(s) else -1), (other[common] if common < len(other) else -1)
        node = root
        while node[0] is not None and node[0] < common:
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        if node[0] == common:
            node[1][mine] = [None, i]
        else:
            below = list(node)
            node[:] = [common, {theirs: below, mine: [None, i]}]
    out: list[tuple[int, int]] = []
    stack = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node[0] is None:
            out.append((node[1], shared))
            out += [(i, len(strings[i])) for i in node[2:]]
        else:
            kids = sorted(node[1].items(), reverse=True)
            stack += [(kid, node[0]) for _, kid in kids[:-1]] + [(kids[-1][1], shared)]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int, known: int = 0) -> tuple[list[int], list[int]]:
    """Order of `strings`, and each one's common length with the one before (0 for the first).

    Three-way radix quicksort on one byte at a time while the depth is below `shallow`; groups that still agree there go to
    a blind trie. `known`: bytes on which all are known to agree.
    """
    order: list[int] = []
    common: list[int] = []
    stack = [(list(range(len(strings))), known, known)]
    while stack:
        ids, depth, before = stack.pop()
        if len(ids) == 1:
            order.append(ids[0])
            common.append(before)
        elif depth >= shallow:
            got = blind_trie_order(strings, ids, depth)
            order += [i for i, _ in got]
            common += [before, *(c for _, c in got[1:])]
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in ids]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [i for i, x in zip(ids, byte, strict=True) if x < pivot]
            same = [i for i, x in zip(ids, byte, strict=True) if x == pivot]
            more = [i for i, x in zip(ids, byte, strict=True) if x > pivot]
            first = less or same
            if more:
                stack.append((more, depth, depth))
            if less:
                stack += [(same, depth + 1 if pivot >= 0 else shallow, depth), (less, depth, before)]
            elif pivot >= 0:
                stack.append((first, depth + 1, before))
            else:
                stack.append((first, shallow, before))
    if common:
        common[0] = 0
    return order, common


def repeated_windows(slices: list[bytes], lo: list[int], hi: list[int], length: int, gram: int, shallow: int = 256) -> list[list[tuple[int, int]]]:
    """For different slices around one gram, the distances d (window start before the anchor) whose windows are equal.

    slices[i] holds the windows that start lo[i]..hi[i] bytes before the anchor, which lies at slices[i][hi[i]]. Returns
    ranges (from, to) of d for each slice. Windows d of i and j are equal just when the two agree on d bytes backwards and
    length - d bytes onwards.
    """
    n = len(slices)
    on = [s[h:] for s, h in zip(slices, hi, strict=True)]
    back = [s[:h][::-1] for s, h in zip(slices, hi, strict=True)]
    if n == 2:
        f, r = common_length(on[0], on[1], gram), common_length(back[0], back[1], 0)
        a, b = max(length - f, *lo), min(r, *hi)
        return [[(a, b)] if a <= b else []] * 2
    places = []
    for strings, known in ((on, gram), (back, 0)):
        order, common = deep_shallow_order(strings, shallow, known)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        places.append((rank, np.array(common)))
    (rf, cf), (rb, cb) = places
    low, high = np.array(lo), np.array(hi)
    cuts = np.unique(np.concatenate([low, high + 1, length - cf, cb + 1]))
    cuts = cuts[(cuts >= low.min()) & (cuts <= high.max())]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, d in enumerate(cuts.tolist()):
        to = int(cuts[k + 1]) - 1 if k + 1 < len(cuts) else int(high.max())
        has = np.flatnonzero((low <= d) & (d <= high))
        if len(has) < 2:
            continue
        onward = np.cumsum(cf < length - d)[rf[has]]
        pair = onward * (n + 1) + np.cumsum(cb < d)[rb[has]]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        for i in has[count[inverse] > 1].tolist():
            if out[i] and out[i][-1][1] == d - 1:
                out[i][-1] = (out[i][-1][0], to)
            else:
                out[i].append((d, to))
    return out


def _slice_batches(length: int):
    """From documents with their wanted slices: one row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1)
            first = np.asarray(wanted.offsets)
            flat = wanted.flatten()
            f = {x.name: flat.field(i) for i, x in enumerate(flat.type)}
            off, body = utf8(batch.column(0))
            base = np.repeat(off[:-1], np.diff(first))
            pos, lo, hi = (np.asarray(f[x]).astype(np.int64) for x in ("pos", "lo", "hi"))
            view = memoryview(body)
            begin, end = (base + pos - hi).tolist(), (base + pos - lo + length).tolist()
            for a in range(0, len(pos), 20_000):
                text = [bytes(view[x:y]) for x, y in zip(begin[a : a + 20_000], end[a : a + 20_000], strict=True)]
                rows = [f[x].slice(a, len(text)) for x in ("khash", "shash", "whole", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(text, pa.binary())], names=["khash", "shash", "whole", "lo", "hi", "slice"])

    return run


def _verdict_batches(length: int, gram: int, shallow: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["khash"]):
            k, s = np.asarray(table.column("khash")), np.asarray(table.column("shash"))
            whole, lo, hi = (table.column(c).to_pylist() for c in ("whole", "lo", "hi"))
            text = table.column("slice").to_pylist()
            edge = starts_of(k)
            rows: list[tuple[int, int, int, int]] = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                once: dict[bytes, dict[int, int]] = {}  # by gram, in case two grams share a hash
                for i in range(a, b):  # repeated rows of a document bring a slice twice
                    once.setdefault(text[i][hi[i] : hi[i] + gram], {})[int(s[i])] = i
                for own in (sorted(x.values()) for x in once.values() if len(x) > 1):
                    found = repeated_windows([text[i] for i in own], [lo[i] for i in own], [hi[i] for i in own], length, gram, shallow)
                    rows += [(int(k[i]), int(s[i]), x, y) for i, ranges in zip(own, found, strict=True) if not whole[i] for x, y in ranges]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["khash", "shash", "from_d", "to_d"])

    return run


def _range_batches(length: int, gram: int, ranges: int):
    """Slices cut into ranges of windows; the new khash stands for the stretch that all windows of a range hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, width = xxhash.xxh3_64_intdigest, -(-(length - gram + 1) // ranges)
        for batch in batches:
            k, s, lo, hi, text = (batch.column(i).to_pylist() for i in range(5))
            rows: list[tuple] = []
            for i, body in enumerate(text):
                for r in range(lo[i] // width, hi[i] // width + 1):
                    a, b = max(lo[i], r * width), min(hi[i], (r + 1) * width - 1)
                    shared = body[hi[i] - r * width : hi[i] + length - (r + 1) * width + 1]
                    own = body[hi[i] - b : hi[i] - a + length]
                    rows.append((k[i], s[i], digest(shared, (k[i] + r) % (1 << 64)), digest(own, (a << 32) + b), a, b, own))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[2:4]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *hashes, pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.binary())], names=["khash0", "shash0", "khash", "shash", "lo", "hi", "slice"])

    return run


def _window_batches(length: int):
    """All windows of the slices of very frequent stretches, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, s, w, lo, hi, text = (batch.column(i).to_pylist() for i in range(6))
            for i, body in enumerate(text):
                view, ds = memoryview(body), range(lo[i], hi[i] + 1)
                hashes = [xxhash.xxh3_128_digest(view[hi[i] - d : hi[i] - d + length]) for d in ds]
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(ds), t) for x, t in ((k[i], pa.int64()), (s[i], pa.int64()), (w[i], pa.bool_()))] + [pa.array(ds, pa.int32()), pa.array(hashes, pa.binary())], names=["khash", "shash", "whole", "d", "whash"])

    return run


def _word_window_batches(words: int, length: int, limit: int = 1 << 18):
    """Windows of `words` words that are shorter than `length` bytes, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(1))
            for i in range(batch.num_rows):
                # a window is shorter than `length` bytes, so parts of a long text overlap by so many
                for x in range(int(off[i]), int(off[i + 1]), limit):
                    own = body[max(x - 1, int(off[i])) : min(x + limit + length, int(off[i + 1]))]
                    skip = int(x > off[i])  # the byte before the part
                    blank = np.concatenate([[True], is_blank(own), [True]])
                    start, end = np.flatnonzero(blank[:-2] & ~blank[1:-1]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1
                    if len(start) < words:
                        continue
                    a, b = start[: len(start) - words + 1], end[words - 1 :]
                    short = np.flatnonzero((b - a < length) & (a >= skip) & (a < limit + skip))
                    if len(short):
                        raw, a, b = own.tobytes(), a[short], b[short]
                        hashes = [xxhash.xxh3_128_digest(raw[p:q]) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
                        shift = x - skip - int(off[i])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(a), i))), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32)), pa.array(hashes, pa.binary())], names=["tkey", "start", "end", "whash"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("tkey"), text.alias("text"))


VERDICT = "khash long, shash long, from_d int, to_d int"


def contested(slices: DataFrame) -> DataFrame:
    """(khash, n) for the grams whose n slices need comparing: there are several, and one of them isn't repeated as a whole."""
    return slices.groupBy("khash").agg(F.count("*").alias("n"), F.min("whole").alias("done")).where("n > 1 and not done").select("khash", "n")


def sorted_verdicts(slices: DataFrame, length: int, gram: int, shallow: int) -> DataFrame:
    """Repeated windows of slices (khash, shash, whole, lo, hi, slice), by deep-shallow sorting of those of a gram."""
    near = slices.repartition("khash").sortWithinPartitions("khash")
    return near.mapInArrow(lean(_verdict_batches(length, gram, shallow)), VERDICT)


def frequent_verdicts(once: DataFrame, length: int, gram: int, group_cap: int, shallow: int, ranges: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for frequent grams, whose different slices (khash, shash, whole, lo, hi, slice) are dealt out by content; and tables to discard."""
    ddl = "khash0 long, shash0 long, khash long, shash long, lo int, hi int, slice binary"
    cut = staged(once.select("khash", "shash", "lo", "hi", "slice").mapInArrow(lean(_range_batches(length, gram, ranges)), ddl), "suffix-ranges")
    own = cut.groupBy("khash", "shash").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "slice")])
    own = staged(own.select("khash", "shash", (F.col("n") > 1).alias("whole"), "lo", "hi", "slice"), "suffix-stretches")
    open_ = staged(contested(own), "suffix-open")
    found = sorted_verdicts(own.join(open_.where(F.col("n") <= group_cap).select("khash"), "khash", "left_semi"), length, gram, shallow)
    many = own.join(open_.where(F.col("n") > group_cap).select("khash"), "khash", "left_semi")
    windows = staged(many.select("khash", "shash", "whole", "lo", "hi", "slice").mapInArrow(lean(_window_batches(length)), "khash long, shash long, whole boolean, d int, whash binary"), "suffix-windows")
    twice = windows.groupBy("khash", "d", "whash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.where("not whole").join(twice, ["khash", "d", "whash"], "left_semi").select("khash", "shash", F.col("d").alias("from_d"), F.col("d").alias("to_d"))
    all_of = own.where("whole").select("khash", "shash", F.col("lo").alias("from_d"), F.col("hi").alias("to_d"))
    verdicts = staged(found.unionByName(again).unionByName(all_of), "suffix-part-verdicts")
    whole = once.where("whole").select(F.col("khash").alias("khash0"), F.col("shash").alias("shash0"))
    parts = cut.select("khash0", "shash0", "khash", "shash").join(verdicts, ["khash", "shash"]).join(whole, ["khash0", "shash0"], "left_anti")
    return parts.select(F.col("khash0").alias("khash"), F.col("shash0").alias("shash"), "from_d", "to_d"), [cut, own, open_, windows, verdicts]


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 128, group_cap: int = 256, shallow: int = 256, ranges: int = 8, words: int = 0) -> DataFrame:
    """(tkey, spans): for each different text (tkey: its MD5) the byte ranges [start, end) that are repeated, unmerged.

    With `words`, strings of so many words that are shorter than `length` bytes and stand elsewhere are repeated as well.
    """
    texts = _texts(docs)
    long = texts.where(F.octet_length("text") >= length)
    every = staged(long.select("doc_id", "tkey", "text").mapInArrow(lean(_anchor_batches(length, gram)), ANCHOR), "suffix-anchors")
    place = F.xxhash64("tkey", "pos")
    shared = staged(every.select("khash", place.alias("p")).groupBy("khash").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("khash"), "suffix-grams")
    near = staged(every.join(shared, "khash", "left_semi"), "suffix-near")
    discard(every, shared)
    slices = near.groupBy("khash", "shash").agg(F.min(F.struct("tkey", "doc_id", "pos", "lo", "hi")).alias("at"), F.min(place).alias("a"), F.max(place).alias("b"))
    slices = staged(slices.select("khash", "shash", (F.col("a") != F.col("b")).alias("whole"), "at"), "suffix-slices")
    open_ = staged(contested(slices), "suffix-open")
    want = slices.join(open_, "khash").groupBy("at.tkey", F.col("at.doc_id").alias("d")).agg(F.collect_list(F.struct("khash", "shash", "whole", F.col("at.pos").alias("pos"), F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))).alias("want"))
    want = staged(want.withColumnRenamed("tkey", "wkey"), "suffix-want")
    fetched = long.join(want, (F.col("tkey") == F.col("wkey")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "want")
    cut = staged(fetched.mapInArrow(lean(_slice_batches(length)), "khash long, shash long, whole boolean, lo int, hi int, slice binary"), "suffix-texts")
    discard(want)
    few, many = open_.where(F.col("n") <= group_cap), open_.where(F.col("n") > group_cap)
    found, spent = sorted_verdicts(cut.join(few.select("khash"), "khash", "left_semi"), length, gram, shallow), []
    if many.limit(1).count():
        once = cut.join(many.select("khash"), "khash", "left_semi").groupBy("khash", "shash").agg(*[F.first(c).alias(c) for c in ("whole", "lo", "hi", "slice")])
        once = staged(once, "suffix-frequent")
        more, spent = frequent_verdicts(once, length, gram, group_cap, shallow, ranges)
        spent, found = [*spent, once], found.unionByName(more)
    whole = slices.where("whole").select("khash", "shash", F.col("at.lo").alias("from_d"), F.col("at.hi").alias("to_d"))
    verdicts = staged(found.unionByName(whole), "suffix-verdicts")
    discard(cut, open_, slices, *spent)
    marks = near.join(verdicts, ["khash", "shash"]).select("tkey", F.struct((F.col("pos") - F.col("to_d")).alias("start"), (F.col("pos") - F.col("from_d") + length).alias("end")).alias("span")).distinct()
    short = []
    if words:
        windows = staged(texts.select("tkey", "text").mapInArrow(lean(_word_window_batches(words, length)), "tkey binary, start int, end int, whash binary"), "suffix-words")
        # staged, so that the join's sides are plain shuffles, which can be split where a window is frequent
        again = staged(windows.groupBy("whash").agg(F.count("*").alias("n")).where("n > 1").select("whash"), "suffix-again")
        short += [windows, again]
        marks = marks.unionByName(windows.join(again, "whash", "left_semi").select("tkey", F.struct("start", "end").alias("span")).distinct())
    spans = marks.groupBy("tkey").agg(F.collect_list("span").alias("spans"))
    # of a text that several rows hold, every byte is repeated
    copies = long.groupBy("tkey").agg(F.count("*").alias("n"), F.first(F.octet_length("text")).alias("size")).where("n > 1")
    copies = copies.select("tkey", F.array(F.struct(F.lit(0).alias("start"), F.col("size").cast("int").alias("end"))).alias("all"))
    out = staged(spans.join(copies, "tkey", "full").select("tkey", F.coalesce("all", "spans").alias("spans")), "suffix-spans")
    discard(near, verdicts, *short)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removal_batches(carry: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(1))
            spans = batch.column(2)
            size, removed, count, sha, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = body[off[i] : off[i + 1]].tobytes()
                got = spans[i].as_py()
                cuts = merged([(x["start"], x["end"]) for x in got]) if got else []
                rest = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)], strict=True))
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                count.append(len(cuts))
                sha.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest.decode("utf-8", "ignore"))  # a cut inside a character drops the rest of it
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())]
            cols += [pa.array(kept, pa.string())] * keep_text + [batch.column(3 + i) for i in range(carry)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text + [f"c{i}" for i in range(carry)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = (), keep_text: bool = False, **options: int) -> DataFrame:
    """Remove from each text the bytes of all strings of `length` bytes that also start elsewhere.

    docs: doc_id, text and any other columns, of which those named in `carry` are handed on. Returns a row for each row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, then kept_text (if asked for) and `carry`. A
    null text counts as empty; texts shorter than `length` stay as they are; very long texts are read in overlapping parts; of
    repeated rows all bytes go, if long enough; an empty table gives an empty result. doc_id may be null or repeated: texts are
    told apart by content. Columns not named in `carry` are left out, whatever their names.
    """
    spans = repeated_spans(docs, length, **options)
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("tkey"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    joined = own.join(spans, "tkey", "left").select("doc_id", "text", "spans", *[f"c{i}" for i in range(len(carry))])
    kinds = dict(own.dtypes)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text + "".join(f", c{i} {kinds[f'c{i}']}" for i in range(len(carry)))
    out = joined.mapInArrow(lean(_removal_batches(len(carry), keep_text)), ddl)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
