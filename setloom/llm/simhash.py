"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Fingerprints are made from word shingles, equal ones fall together first, and distinct ones are linked at a few differing
bits. To spread the search, the 64 bits are cut into `m` blocks: two fingerprints that differ in at most t bits agree on at
least m - t whole blocks, so every choice of m - t blocks gives a bucket key, and m grows with the count of distinct
fingerprints to keep buckets small. Each bucket is sorted by Gray rank; runs of neighbours form index nodes whose shared
bits are factored out and handed up level by level, and pairs of nodes are dropped as soon as the differences gathered on
the way down exceed t. Only the links that keep a bucket connected leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from setloom.llm.common import connected_components, discard, groups, lean, local_forest, parts_of, row_key, rows_of, staged, starts_of, utf8

LANES = np.uint64(0x0101010101010101)


def simhash_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Majority fingerprints of consecutive non-empty runs of 64-bit hashes; starts: n + 1 boundaries."""
    n = np.diff(starts)
    pieces = -(-n // 255)  # a lane of 8 bits counts 255 hashes at most
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    inner = (np.arange(pieces.sum()) - first) * 255 + np.repeat(starts[:-1], pieces)
    counts = np.zeros((len(n), 64), np.int64)
    doc_first = np.cumsum(pieces) - pieces
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, inner)
        counts[:, bit::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), doc_first, axis=0)
    packed = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").ravel()


def shingle_hashes(body: np.ndarray, width: int, seed: int, limit: int = 1 << 20) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; fewer words are one shingle, no words none. Long texts are read in parts."""
    digest, out, words = xxhash.xxh64_intdigest, [], []
    for a, b in parts_of(body, limit):
        words += body[a:b].tobytes().lower().split()  # bytes: ASCII letters and white space only
        n = len(words) - width + 1
        if n > 0:
            text = b" ".join(words)
            edge = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=edge[1:])
            ends = (edge[width:] - 1).tolist()
            out.append(np.fromiter((digest(text[x:y], seed) for x, y in zip(edge[:-width].tolist(), ends, strict=True)), np.uint64, n))
            words = words[n:]
    if not out and words:
        out.append(np.array([digest(b" ".join(words), seed)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Prints:
    """Fingerprints of many sets of hashes, made for some 200,000 hashes at a time; no hashes: 0."""

    def __init__(self, rows: int) -> None:
        self.out, self.held, self.owner, self.size = np.zeros(rows, np.uint64), [], [], 0

    def add(self, row: int, hashes: np.ndarray) -> None:
        if len(hashes):
            self.held.append(hashes)
            self.owner.append(row)
            self.size += len(hashes)
            if self.size > 200_000:
                self.flush()

    def flush(self) -> np.ndarray:
        if self.held:
            starts = np.concatenate([[0], np.cumsum([len(h) for h in self.held])])
            self.out[self.owner] = simhash_bits(np.concatenate(self.held), starts)
            self.held, self.owner, self.size = [], [], 0
        return self.out.view(np.int64)


def _fingerprint_batches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(1))
            prints = Prints(batch.num_rows)
            for i in range(batch.num_rows):
                prints.add(i, shingle_hashes(body[off[i] : off[i + 1]], width, seed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.flush())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row: the majority bits of the XXH64 of all its word shingles; no words: 0."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(lean(_fingerprint_batches(width, seed)), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Position of a code in the binary-reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def index_links(codes: np.ndarray, most: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j of Gray-sorted `codes` (uint64) that differ in at most `most` bits, by the hierarchical index.

    A node keeps the bits on which all its members agree (ones, zeros). Two nodes differ for certain on the bits that both
    fix with other values; a level down only the bits that the parents had not fixed are added to the sum so far.
    """
    ones, zeros = [codes], [~codes]
    while len(ones[-1]) > fan:
        at = np.arange(0, len(ones[-1]), fan)
        ones.append(np.bitwise_and.reduceat(ones[-1], at))
        zeros.append(np.bitwise_and.reduceat(zeros[-1], at))
    top = len(ones[-1])
    left, right = np.triu_indices(top)
    fixed = np.zeros(len(left), np.uint64)
    gone = np.zeros(len(left), np.int64)
    for level in range(len(ones) - 1, -1, -1):
        one, zero = ones[level], zeros[level]
        both = (one[left] | zero[left]) & (one[right] | zero[right])
        gone = gone + np.bitwise_count((one[left] ^ one[right]) & both & ~fixed).astype(np.int64)
        keep = gone <= most
        left, right, gone, fixed = left[keep], right[keep], gone[keep], both[keep]
        if level:
            size = len(ones[level - 1])
            i = (left[:, None] * fan + np.arange(fan))[:, :, None]
            j = (right[:, None] * fan + np.arange(fan))[:, None, :]
            ok = (i < size) & (j < size) & (i <= j)
            k = np.nonzero(ok)
            left, right = np.broadcast_to(i, ok.shape)[k], np.broadcast_to(j, ok.shape)[k]
            gone, fixed = gone[k[0]], fixed[k[0]]
    keep = left < right
    return left[keep], right[keep]


def _bucket_links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["part", "key", "p", "q"]):
            cols = [np.asarray(table.column(c)) for c in ("part", "key", "p", "q")]
            fp = np.asarray(table.column("fp"))
            edge = starts_of(*cols)
            a, b = [], []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s > 1:
                    code = fp[s:e]
                    left, right = index_links(code.view(np.uint64), most)
                    if len(left):
                        root = code[local_forest(len(code), left, right)]
                        other = root != code
                        a.append(code[other])
                        b.append(root[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def blocks_for(distinct: int, most: int, wanted: int = 64) -> int:
    """The number of blocks that leaves about `wanted` evenly spread codes, or fewer, in a bucket."""
    m = most + 1
    while m < 2 * most + 4 and distinct / 2 ** (64 * (m - most) / m) > wanted:
        m += 1
    return m


def hamming_links(codes: DataFrame, distinct: int, most: int = 4, chunk: int = 1024) -> DataFrame:
    """Edges (a, b) that connect the distinct codes `codes.fp` exactly as all pairs at <= `most` differing bits do.

    A bucket with over `chunk` codes is dealt into chunks by hash, and each pair of chunks is a group of its own, so no
    group holds more than about twice `chunk` codes however alike the fingerprints are.
    """
    m = blocks_for(distinct, most)
    cuts = [round(64 * i / m) for i in range(m + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in keep) for keep in combinations(range(m), m - most)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    keyed = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x).cast("long")) for x in signed])).alias("part", "key"))
    keyed = staged(keyed, "simhash-keys")
    counts = staged(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
    dealt = keyed.join(counts, ["part", "key"]).withColumn("c", F.ceil(F.col("n") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda o: (o != F.col("own")) | (F.col("c") == 1))
    dealt = dealt.withColumn("own", own).select("part", "key", "fp", "own", F.explode(others).alias("o"))
    dealt = dealt.select("part", "key", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "fp")
    order = ["part", "key", "p", "q"]
    links = dealt.repartition(*order).sortWithinPartitions(*order, gray_rank(F.col("fp"))).mapInArrow(lean(_bucket_links(most)), "a long, b long")
    out = staged(links.distinct(), "simhash-links")
    discard(keyed, counts)
    return out


def simhash_groups(docs: DataFrame, width: int = 4, most: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id: the smallest doc_id reachable over links at <= `most` bits; null only where every doc_id reached is null.
    Nulls and texts without words get fingerprint 0; very long texts are read in parts, whole; repeated rows come out as often
    as they went in; an empty table gives an empty result. Further columns of docs, whatever their names, are left out.
    """
    prints = staged(fingerprints(docs, width, seed), "simhash-prints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    links = hamming_links(classes, classes.count(), most)
    linked = staged(connected_components(links), "simhash-linked")
    roots = linked.join(classes, linked.node == classes.fp).groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(roots, "root").select(F.col("node").alias("fp"), "least")
    known = staged(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-known")
    discard(links, linked, classes)
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _sig_batches(width: int, seed: int):
    """The first column is the text, the others are handed on without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(0))
            sig, prints = [], Prints(batch.num_rows)
            for i in range(batch.num_rows):
                own = np.unique(shingle_hashes(body[off[i] : off[i + 1]], width, seed))
                sig.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.add(i, own)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(prints.flush()), *batch.columns[1:]], names=["sig", "fp", *batch.schema.names[1:]])

    return run


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def prefix_sizes(n: int, similarity: float, extra: float = 0.05) -> tuple[int, int]:
    """(p, m) of a set of n: it and any set at `similarity` or more share at least m of their first p entries in one order of all.

    They share o >= similarity * n entries. At least o - l of those follow the l-th, so it stands among the first
    n - o + l of both; l is `extra` of the smaller of the two sets, and that has at least `similarity` * n entries.
    """
    o = _ceil(similarity * n)
    return n - o + min(_ceil(extra * n), o), _ceil(extra * similarity * n)


def _entry_batches(width: int, seed: int, similarity: float, at_once: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (off, body) = np.asarray(batch.column(0)), utf8(batch.column(1))
            held: list[np.ndarray] = []
            need: list[int] = []
            first = total = 0
            for i in range(batch.num_rows):
                own = np.unique(shingle_hashes(body[off[i] : off[i + 1]], width, seed))
                p, m = prefix_sizes(len(own), similarity)
                held.append(own[:p])
                need.append(m)
                total += p
                if total >= at_once or i == batch.num_rows - 1:
                    size = np.array([len(x) for x in held])
                    cols = [np.repeat(ids[first : i + 1], size), np.repeat(np.array(need, np.int32), size), np.concatenate(held).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["id", "need", "h"])
                    held, need, first, total = [], [], i + 1, 0

    return run


def _set_batches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, body = utf8(batch.column(2))
            out = [np.unique(shingle_hashes(body[off[i] : off[i + 1]], width, seed)).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["grp", "doc_id", "shingles"])

    return run


def alike_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Least index that each set is connected with by pairs of at least `similarity` of their union in common.

    side: True for the sets that are compared with the others; where all are True, all pairs are compared. Sets that are
    connected by now needn't be compared again, so a group of copies takes one pass.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    label = np.arange(n)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(label, size), often[ids] > 1
    other = np.ones(n, bool) if side.all() else ~side
    edge = np.searchsorted(owner[shared], np.arange(n + 1))
    own = ids[shared]
    use = other[owner[shared]]
    theirs, whose = own[use], owner[shared][use]
    mark = np.zeros(len(often), bool)
    for i in np.flatnonzero(side).tolist():
        if (label[other] == label[i]).all():
            continue
        mine = own[edge[i] : edge[i + 1]]
        mark[mine] = True
        both = np.bincount(whose[mark[theirs]], minlength=n)
        mark[mine] = False
        near = np.flatnonzero((both > 0) & (both >= similarity * (size + size[i] - both)))
        if len(near):
            merged = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, merged)] = merged[0]
    return label


def _alike_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["grp", "p", "q"]):
            cols = [np.asarray(table.column(c)) for c in ("grp", "p", "q")]
            doc, own = np.asarray(table.column("doc_id")), np.asarray(table.column("own"))
            column = table.column("shingles").combine_chunks()
            off, flat = np.asarray(column.offsets), np.asarray(column.values)
            edge = starts_of(*cols)
            a, b = [], []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s > 1:
                    side = own[s:e] == cols[1][s]
                    root = doc[s:e][alike_links([flat[off[i] : off[i + 1]] for i in range(s, e)], side, similarity)]
                    other = root != doc[s:e]
                    a.append(doc[s:e][other])
                    b.append(root[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def signed_rows(docs: DataFrame, columns: list[str], width: int = 5, seed: int = 42) -> DataFrame:
    """(sig, fp, doc_id, rk, rid) of each row of docs, staged: signature and fingerprint of its set of word shingles, its row_key
    over `columns` and a number of its own. No text is kept."""
    src = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), row_key(columns).alias("rk"))
    return staged(src.mapInArrow(lean(_sig_batches(width, seed)), "sig binary, fp long, doc_id long, rk binary").withColumn("rid", F.monotonically_increasing_id()), "near-signed")


def candidate_keys(entries: DataFrame) -> DataFrame:
    """(id, h, least, many): entries such that all sets that share `need` entries share one of these, from the sets' entries (id, need, h).

    least and many: the first of the sets that hold h here, and how many do; those that one set alone holds are left out. `need` of
    such a set's entries stand in other sets too. In any order of the entries, two such sets of p entries share one of their first
    p - need + 1. Ordered by how many sets hold them, rarest first, few sets share any of these.
    """
    # staged, so that the join's sides are plain shuffles, which can be split where an entry is frequent
    shared = staged(entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-shared")
    found = staged(entries.join(shared, "h"), "near-found")
    alive = found.groupBy("id").agg(F.count("*").alias("c"), F.first("need").alias("least")).where("c >= least").select("id", (F.col("c") - F.col("least") + 1).alias("upto"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    keys = staged(found.join(alive, "id").withColumn("r", rank).where("r <= upto").select("id", "h"), "near-keys")
    least = staged(keys.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1"), "near-least")
    out = staged(keys.join(least, "h").select("id", "h", "least", "many"), "near-held")
    discard(shared, found, keys, least)
    return out


def pairs_within(held: DataFrame, known: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare among the sets of a key (held: id, h, least, many) by what is connected by now (known: node, root).

    (pairs: a, b; groups: node, root). Keys with one connected part alone are done. Of a key of at most `few` sets come the pairs of
    different parts, each once, but for those with the first set, which have been compared. The sets of larger keys, which are
    mostly those of large groups of copies with many keys in common, are put together to groups to be compared as a whole.
    """
    parts = held.join(known.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "least", "many", F.coalesce("root", "id").alias("part"))
    open_keys = parts.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h")
    parts = staged(parts.join(open_keys, "h", "left_semi"), "near-open")
    small = parts.where((F.col("many") <= few) & (F.col("id") != F.col("least")))
    other = small.select("h", F.col("id").alias("b"), F.col("part").alias("part_b"))
    pairs = staged(small.select("h", F.col("id").alias("a"), "part").join(other, "h").where("a < b and part <> part_b").select("a", "b").distinct(), "near-pairs")
    large = parts.where((F.col("many") > few) & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    groups_ = staged(connected_components(large), "near-large")
    discard(parts)
    return pairs, groups_


def alike_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (id, shingles) have at least `similarity` of their union in common."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("n", F.size(F.array_intersect("set_a", "set_b")))
    return both.where((F.col("n") > 0) & (F.col("n") >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - F.col("n")))).select("a", "b")


def fingerprint_links(reps: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect the ids of reps (id, fp) whose fingerprints differ in at most `most` bits, by the Gray-ordered index."""
    classes = staged(reps.groupBy("fp").agg(F.min("id").alias("least")), "near-codes")
    links = hamming_links(classes.select("fp"), classes.count(), most)
    same = reps.join(classes, "fp").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    at = lambda c: classes.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    near = links.join(at("a"), "a").join(at("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    out = staged(same.unionByName(near), "near-prints")
    discard(classes, links)
    return out


def near_groups(signed: DataFrame, docs: DataFrame, columns: list[str], width: int = 5, similarity: float = 0.8, seed: int = 42, chunk: int = 512, most: int = 4, few: int = 64) -> DataFrame:
    """(sig, grp) for each different sig of `signed_rows(docs, columns)`: grp is the same for all that pairs of alike sets connect.

    Candidates are the pairs that SimHash links at `most` bits, and all that it may miss: an exact prefix filter
    (`prefix_sizes`, `candidate_keys`) makes them complete. Sets of shingles are compared in full, and pairs with at least `similarity` of
    their union in common are links: first the linked fingerprints and each set with the first one of its keys, then what shares
    a key and isn't connected yet (`pairs_within`). Of that, groups by keys of over `few` sets are dealt into chunks of `chunk` sets,
    and each pair of chunks is a task's work of its own. Texts without words are alike.
    """
    least = F.min(F.struct("rid", "rk", "fp")).alias("k")
    reps = staged(signed.groupBy("sig").agg(least).select("sig", F.col("k.rid").alias("id"), F.col("k.rk").alias("rk"), F.col("k.fp").alias("fp")), "near-reps")

    def texts_of(ids: DataFrame) -> DataFrame:
        return rows_of(docs, ids, columns).select("id", F.coalesce("text", F.lit("")).alias("text"), *[c for c in ids.columns if c not in ("id", "rk")])

    entries = texts_of(reps.select("id", "rk")).mapInArrow(lean(_entry_batches(width, seed, similarity)), "id long, need int, h long")
    entries = staged(entries, "near-entries")
    held, prints = candidate_keys(entries), fingerprint_links(reps.select("id", "fp"), most)
    discard(entries)
    first = held.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(prints)
    first = staged(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-first")
    ids = held.select("id").unionByName(prints.select(F.col("a").alias("id"))).unionByName(prints.select(F.col("b").alias("id"))).distinct()
    own = texts_of(reps.select("id", "rk").join(ids, "id", "left_semi")).select(F.lit(0).cast("long").alias("grp"), F.col("id").alias("doc_id"), "text")
    sets = staged(own.mapInArrow(lean(_set_batches(width, seed)), "grp long, doc_id long, shingles array<long>").select(F.col("doc_id").alias("id"), "shingles"), "near-shingles")
    links = staged(alike_pairs(first, sets, similarity), "near-links")
    known = staged(connected_components(links), "near-known")
    rest, large = pairs_within(held, known, few)
    pairs = rest.join(first, ["a", "b"], "left_anti")
    parts = large.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("c"))
    dealt = large.join(parts, "root").select(F.col("root").alias("grp"), F.col("node").alias("id"), "c").join(sets, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.select("grp", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), "own", F.col("id").alias("doc_id"), "shingles")
    order = ["grp", "p", "q"]
    within = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(_alike_batches(similarity)), "a long, b long")
    links = staged(links.unionByName(alike_pairs(pairs, sets, similarity)).unionByName(within).distinct(), "near-all-links")
    roots = staged(connected_components(links).select(F.col("node").alias("id"), "root"), "near-roots")
    out = staged(reps.join(roots, "id", "left").select("sig", F.coalesce("root", "id").alias("grp")), "near-groups")
    discard(reps, held, prints, first, sets, known, rest, large, links, roots)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, **options: int) -> DataFrame:
    """(doc_id, kept_id) for each different doc_id: the document that stands for its group, itself included.

    Groups are those of `near_groups`; kept_id is the smallest doc_id of the group. Rows with a null doc_id are left out; of
    rows that share a doc_id the least text counts. Null texts count as empty, an empty table gives an empty result.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = staged(own.groupBy("doc_id").agg(F.min("text").alias("text")), "near-docs")
    columns = ["doc_id", "text"]
    signed = signed_rows(own, columns, width, options.get("seed", 42))
    known = staged(signed.select("doc_id", "sig").join(near_groups(signed, own, columns, width, similarity, **options), "sig").select("doc_id", "grp"), "near-known")
    discard(signed, own)
    return known.join(known.groupBy("grp").agg(F.min("doc_id").alias("kept_id")), "grp").select("doc_id", "kept_id")


def one_of_each_group(docs: DataFrame, columns: list[str], width: int = 5, similarity: float = 0.8, **options: int) -> DataFrame:
    """The rows of docs (`columns`, doc_id and text among them) that stand for their groups of near duplicates, one of each.

    Groups are those of `near_groups`. The row with the least doc_id is kept, a null one last; then the least row_key. Null
    texts count as empty, texts without words are alike, very long texts are compared whole, ids may be null or repeated, an
    empty table gives an empty result, and columns not named are left out.
    """
    own = docs.select(*columns)
    signed = signed_rows(own, columns, width, options.get("seed", 42))
    groups_ = near_groups(signed, own, columns, width, similarity, **options)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    first = signed.groupBy("sig").agg(F.min(order).alias("k"))
    kept = staged(first.join(groups_, "sig").groupBy("grp").agg(F.min("k").alias("k")).select("k.rk"), "near-kept")
    discard(signed, groups_)
    return rows_of(own, kept, columns).select(*columns)
