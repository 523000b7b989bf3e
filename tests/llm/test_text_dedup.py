from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from setloom.llm import suffix_dedup
from setloom.llm.simhash import alike_links, blocks_for, hamming_links, index_links, near_duplicates, pairs_within, prefix_sizes, simhash_groups
from setloom.llm.suffix_dedup import blind_trie_order, common_length, deep_shallow_order, remove_repeats, repeated_windows


def plain_removal(texts: list[str | None], length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed: int, n: int) -> list[str | None]:
    rnd = random.Random(seed)
    some = lambda k: "".join(rnd.choice("abé \n") for _ in range(k))
    shared = [some(rnd.randint(20, 90)) for _ in range(6)]
    texts: list[str | None] = ["".join(rnd.choice(shared) if rnd.random() < 0.5 else some(rnd.randint(1, 30)) for _ in range(rnd.randint(0, 8))) for _ in range(n)]
    return [*texts, texts[3], texts[3], "a" * 300, "xa" * 150, "", None, shared[0] * 5]


@pytest.mark.parametrize("cap", [20_000, 3, 1])
def test_removal_is_brute_force(spark, cap, monkeypatch):
    if cap == 1:  # every text in many parts
        monkeypatch.setattr(suffix_dedup._anchor_batches, "__defaults__", (50,))
    texts = passages(3, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=40, gram=12, group_cap=cap, shallow=20).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)


def test_frequent_passages_are_brute_force(spark):
    rnd = random.Random(9)
    some = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    common, longer = some(35), some(60)
    texts = [some(30) + (common if i % 3 else longer) + some(30) for i in range(60)] + [longer[:45] + some(9), some(9) + longer[12:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for options in ({"group_cap": 4}, {"group_cap": 4, "ranges": 2}, {"group_cap": 1000}):
        got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=40, gram=12, shallow=20, **options).collect()}
        assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)


def test_passages_of_words_in_parts(spark, monkeypatch):
    rnd = random.Random(2)
    words = [rnd.choice(["a", "of", "to", "it", "is", "we", "by"]) for _ in range(400)]
    texts = ["  ".join(words[:200]) + " end", "begin " + " ".join(words[150:350]), " ".join(words[300:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def kept() -> list[str]:
        return [r.kept_text for r in remove_repeats(docs, length=120, gram=40, keep_text=True, words=12).orderBy("doc_id").collect()]

    gone = [set() for _ in texts]
    found: dict[str, list[tuple[int, int, int]]] = {}
    for i, t in enumerate(texts):
        at = [m.span() for m in re.finditer(r"\S+", t)]
        for (x, _), (_, y) in zip(at, at[11:], strict=False):
            found.setdefault(t[x:y], []).append((i, x, y))
        for x in range(len(t) - 119):
            found.setdefault(t[x : x + 120], []).append((i, x, x + 120))
    for places in found.values():
        for i, x, y in places if len(places) > 1 else []:
            gone[i].update(range(x, y))
    want = ["".join(c for k, c in enumerate(t) if k not in g) for t, g in zip(texts, gone, strict=True)]
    assert want != texts and kept() == want
    monkeypatch.setattr(suffix_dedup._word_window_batches, "__defaults__", (70,))
    assert kept() == want


def test_removal_of_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(1, "abcdefghij" * 3, "x"), (1, "abcdefghij" * 3, "x"), (None, "0123456789" * 3, "y"), (2, "qwertyuiopasdfghjklzxcvbnm", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tkey string")
    got = remove_repeats(docs, length=25, gram=8, carry=("tkey",), keep_text=True).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.tkey or "", r.kept_text) for r in got) == sorted([("1", 30, "x", ""), ("1", 30, "x", ""), ("None", 0, "y", "0123456789" * 3), ("2", 0, "", "qwertyuiopasdfghjklzxcvbnm")])
    assert remove_repeats(docs.limit(0), length=25, gram=8).count() == 0


def test_deep_shallow_order_sorts():
    rnd = random.Random(1)
    for _ in range(100):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 20))]
        for shallow in (0, 3, 50):
            order, common = deep_shallow_order(strings, shallow)
            assert [strings[i] for i in order] == sorted(strings)
            assert common[1:] == [common_length(strings[a], strings[b], 0) for a, b in zip(order, order[1:], strict=False)]
    assert [i for i, _ in blind_trie_order([b"b", b"a", b"ab"], [0, 1, 2], 0)] == [1, 2, 0]


def test_repeated_windows_by_hand():
    a, b = b"xxHELLOWORLDyy", b"zzHELLOWORLDqq"
    assert repeated_windows([a, b], [0, 0], [4, 4], 8, 3) == [[(0, 2)], [(0, 2)]]


def plain_groups(texts: dict[int, str], width: int, most: int) -> tuple[dict[int, int], dict[int, int]]:
    prints = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + width]) for j in range(max(1, len(w) - width + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return prints, {i: find(i) for i in ids}


def test_simhash_is_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts: dict[int, str | None] = {}
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 300))]
        texts[3 * i] = " ".join(base)
        base[rnd.randrange(len(base))] = "changed"
        texts[3 * i + 1] = "\n".join(base).upper()
        texts[3 * i + 2] = " ".join(base)
    texts |= {900: "", 901: None, 902: " \t\n", 903: "one two", 904: "ONE  two"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints, roots = plain_groups(texts, 4, 4)
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == roots
    assert simhash_groups(docs.limit(0)).count() == 0


def test_index_links_finds_every_pair():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = codes[:30] ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64))
    codes = np.unique(np.concatenate([codes, near]))
    a, b = index_links(codes, 4)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert {*zip(a.tolist(), b.tolist(), strict=True)} == want


def test_hot_buckets_are_dealt_into_chunks(spark):
    codes = spark.createDataFrame([(1 << i,) for i in range(60)], "fp long")
    few = {r.b for r in hamming_links(codes, 60, 4, chunk=8).collect()}
    assert few and blocks_for(10, 4) == 5 and blocks_for(10**7, 4) > 5


def test_near_duplicates_keep_what_only_looks_alike(spark):
    rnd = random.Random(9)
    a = [rnd.choice("abcdefgh") + str(rnd.randrange(99)) for _ in range(200)]
    b = [*a]
    b[100] = "other"
    c = [rnd.choice("abcdefgh") + str(rnd.randrange(99)) for _ in range(200)]
    docs = spark.createDataFrame([(5, " ".join(a)), (7, " ".join(b)), (8, " ".join(c)), (9, " ".join(a)), (9, " ".join(a)), (None, "x"), (10, None), (11, "")], "doc_id long, text string")
    assert {r.doc_id: r.kept_id for r in near_duplicates(docs).collect()} == {5: 5, 7: 5, 8: 8, 9: 5, 10: 10, 11: 10}


def test_near_duplicates_are_groups_of_alike_sets(spark):
    rnd = random.Random(12)
    texts: dict[int, str] = {}
    for g in range(12):
        base = [f"v{rnd.randrange(500)}" for _ in range(rnd.randint(150, 400))]
        for k in range(rnd.randint(1, 7)):
            now = [*base]
            for _ in range(k % 3):
                now[rnd.randrange(len(now))] = f"z{rnd.randrange(10**6)}"
            texts[100 * g + k] = " ".join(now)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    root = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for chunk, few in ((512, 64), (2, 2), (512, 3)):
        assert {r.doc_id: r.kept_id for r in near_duplicates(docs, chunk=chunk, few=few).collect()} == root


def test_only_candidates_are_compared_in_a_chain_of_texts(spark):
    """Neighbours in a long chain share keys, so that all of it is connected, but no text is compared with one far away."""
    n = 40
    held = spark.createDataFrame([(i, h, h, 2) for h in range(n - 1) for i in (h, h + 1)], "id long, h long, least long, many long")
    nothing = spark.createDataFrame([], "node long, root long")
    pairs, groups = pairs_within(held, nothing, few=64)
    assert pairs.count() == 0 and groups.count() == 0  # neighbours have met as the first of a key
    more = spark.createDataFrame([(i, 100, 0, 4) for i in (0, 7, 8, 9)] + [(i, 101, 0, 3) for i in (0, 8, 9)] + [(i, 102, 1, 5) for i in (1, 2, 3, 4, 5)], "id long, h long, least long, many long")
    known = spark.createDataFrame([(7, 7), (8, 7), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1)], "node long, root long")
    pairs, groups = pairs_within(more, known, few=64)
    assert sorted(map(tuple, pairs.collect())) == [(7, 9), (8, 9)]
    pairs, groups = pairs_within(more, known, few=3)
    assert sorted(map(tuple, pairs.collect())) == [(8, 9)]
    assert {r.node for r in groups.collect()} == {0, 7, 8, 9}


def test_near_duplicates_just_over_the_threshold_are_all_found(spark):
    rnd = random.Random(31)
    texts: dict[int, str] = {}
    for g in range(60):
        base = [f"v{rnd.randrange(10**6)}" for _ in range(104)]
        now = [*base]
        for at in (20, 60):  # each changes five shingles of 100: 90 of 110 in common
            now[at] = f"z{rnd.randrange(10**6)}"
        # a line that all hold, often: repeats don't count in a set
        line = " all of them hold this line" * 40
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(now)
        if g % 3 == 0:
            texts[2 * g + 1] += " " + now[0] + line
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = {(2 * g, 2 * g + 1) for g in range(60) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])}
    assert len(alike) >= 40
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.kept_id for r in near_duplicates(docs).collect()}
    assert {(k, i) for i, k in got.items() if i != k} == alike


def test_prefixes_of_alike_sets_share_what_they_must():
    rnd = random.Random(6)
    for _ in range(2000):
        a = set(rnd.sample(range(10**6), rnd.randint(1, 60)))
        b = set(rnd.sample(sorted(a), max(1, len(a) - rnd.randint(0, 6)))) | {rnd.randrange(10**6) for _ in range(rnd.randint(0, 6))}
        if len(a & b) >= 0.8 * len(a | b):
            (p, m), (q, k) = prefix_sizes(len(a), 0.8), prefix_sizes(len(b), 0.8)
            assert len({*sorted(a)[:p]} & {*sorted(b)[:q]}) >= max(m, k) >= 1


def test_alike_links_by_hand():
    sets = [np.arange(10), np.arange(9), np.arange(50, 60), np.arange(1, 10), np.zeros(0, np.int64)]
    assert alike_links(sets, np.ones(5, bool), 0.8).tolist() == [0, 0, 2, 0, 4]
    assert alike_links(sets, np.array([True, False, False, False, False]), 0.95).tolist() == [0, 1, 2, 3, 4]
