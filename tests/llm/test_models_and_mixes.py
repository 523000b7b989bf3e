from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setloom.llm import packing
from setloom.llm.language import identify_language
from setloom.llm.mixing import fit_counts, mix_sources, source_targets
from setloom.llm.quality import score_quality
from setloom.llm.sampling import fold

tokenizers_at = pytest.importorskip("public_tokenizers")
PATH = tokenizers_at.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify_language(docs).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in held)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    extra = spark.createDataFrame([(-1, None, None, "s"), (-2, "", "en", "s"), (-3, "12 34 !?", "en", "s"), (None, "the and of", None, "s")], "doc_id long, text string, lang string, score string")
    more = identify_language(docs.select("doc_id", "text", "lang").unionByName(extra, allowMissingColumns=True), carry=()).where("doc_id < 0 or doc_id is null").collect()
    assert Counter(r.lang_pred == "und" for r in more) == {True: 3, False: 1}
    assert identify_language(docs.limit(0)).count() == 0


def test_quality_held_out_accuracy_and_edges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    rows = score_quality(docs.select("doc_id", "text").unionByName(odd), labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows) and len(rows) == docs.count() + 2
    assert len({r.score for r in score_quality(docs, labels.limit(0)).collect()}) == 1


def test_targets_share_out_what_is_over():
    got = source_targets([("a", 10), ("b", 100), (None, 1000)])
    assert got["a"] == 20 and abs(sum(got.values()) - 1665) < 1e-9 and all(got[s] <= 2 * n + 1e-9 for s, n in (("a", 10), ("b", 100), (None, 1000)))
    assert source_targets([]) == {}


def test_fit_counts_is_as_near_as_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        sizes = sorted(rnd.sample(range(1, 40), rnd.randint(1, 5)))
        counts = [rnd.randint(1, 3) for _ in sizes]
        goal = rnd.randint(0, sum(s * n for s, n in zip(sizes, counts, strict=True)))
        sums = {0}
        for s, n in zip(sizes, counts, strict=True):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        take = fit_counts(sizes, counts, goal, window=1 << 12)
        assert all(0 <= k <= n for k, n in zip(take, counts, strict=True))
        assert sum(s * k for s, k in zip(sizes, take, strict=True)) == max(x for x in sums if x <= goal)


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "c", None])) for i in range(400)] + [(7, None, "a"), (7, "one two", "a"), (7, "one two", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(mix_sources(docs.repartition(7)).collect())
    assert mix_sources(docs.limit(0)).count() == 0


TEXTS = ["Hello, WORLD!! it's naïve", "<|endoftext|> x<|startoftext|>y", "Éçà ü ß İstanbul 3.14 don't", "a b\tc\nd e　f", "日本語 テスト 😀 ''s", "thnd*** of%%% x| |", "é ﬁ ⅷ", ""]


def test_word_ids_are_the_tokenizers(spark):
    ids = packing.WordIds(PATH, joined=3)
    got, edge = ids.of_texts(pa.array(TEXTS), None)
    for i, t in enumerate(TEXTS):
        assert got[edge[i] : edge[i + 1]].tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_texts_encoded_in_parts_are_the_tokenizers(limit):
    texts = [" ".join(f"word{chr(97 + (i * 7 + k) % 26)}" for k in range(9)) for i in range(600)] + TEXTS + ["no-blank" * 200, "mixed Words, " * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    plain = packing.WordIds(PATH)
    want = [np.array([*plain.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    rows = [r for b in packing._piece_batches(PATH, 2048, 0, False, limit)([batch]) for r in b.to_pylist()]
    cut = [(i, p, len(x[p * 2048 : (p + 1) * 2048]), zlib.crc32(x[p * 2048 : (p + 1) * 2048].tobytes())) for i, x in enumerate(want) for p in range(-(-len(x) // 2048))]
    assert [(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows] == cut


def fewest(items: list[int], size: int) -> int:
    """The least number of sequences, by trying all."""
    best = [len(items)]

    def place(i: int, used: list[int]) -> None:
        if len(used) >= best[0]:
            return
        if i == len(items):
            best[0] = len(used)
            return
        for j in {u: j for j, u in enumerate(used)}.values():
            if used[j] + items[i] <= size:
                used[j] += items[i]
                place(i + 1, used)
                used[j] -= items[i]
        place(i + 1, [*used, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_plans_beat_best_fit():
    rnd = random.Random(11)
    for _ in range(1000):
        size = rnd.choice([10, 20, 50, 100])
        items = sorted((rnd.randint(1, size) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = Counter(items)
        fixed, rest = packing.reduce_by_dominance(counts, size)
        optimum = fewest(items, size)
        assert sum(n for _, n in fixed) + fewest(sorted(rest.elements(), reverse=True), size) == optimum
        used = Counter(v for p, n in fixed for v in p for _ in range(n))
        assert used + rest == counts and all(sum(p) <= size for p, _ in fixed)
        plan = sum(n for _, n in packing.pack_plan(dict(counts), size))
        assert optimum <= plan <= sum(n for _, n in packing.best_fit(counts, size))


def test_deferred_pieces_count_in_dominance():
    assert sum(n for _, n in packing.pack_plan({6: 1, 2: 1, 1: 2}, 10)) == 1
    assert sum(n for _, n in packing.pack_plan({40: 1, 20: 1, 10: 3}, 100)) == 1


def test_plan_holds_every_piece_and_no_more():
    rnd = random.Random(6)
    for size in (10, 64):
        counts = {k: rnd.randint(1, 30) for k in rnd.sample(range(1, size + 1), size // 2)}
        plan = packing.pack_plan(counts, size)
        used = Counter()
        for pattern, n in plan:
            assert sum(pattern) <= size
            for x in pattern:
                used[x] += n
        assert used == Counter(counts)
        total = sum(n for _, n in plan)
        assert -(-sum(k * n for k, n in counts.items()) // size) <= total <= sum(n for _, n in packing.best_fit(Counter(counts), size))


def test_dominance_fixes_perfect_pairs():
    fixed, rest = packing.reduce_by_dominance(Counter({7: 3, 3: 3, 10: 2}), 10)
    assert Counter(dict(fixed)) == Counter({(10,): 2, (7, 3): 3}) and not rest


def test_packing_is_gapless_and_exact(spark):
    rows = [(1, "the cat sat"), (2, None), (3, "word " * 50), (3, "word " * 50), (4, ""), (5, "x " * 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_sequences(docs, PATH, size=16, with_ids=True).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append((r.piece, r.start, r.length, tuple(r.token_ids)))
        assert len(r.token_ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 16
    assert [p[2] for p in sorted(texts[3])] == [16, 16, 16, 16, 16, 16, 3, 3] or sum(p[2] for p in texts[3]) == 102
    assert sorted(texts[2]) == [(0, 0, 1, (0,))] and len(bins) == -(-sum(r.length for r in got) // 16)
    assert packing.pack_sequences(docs.limit(0), PATH).count() == 0


def test_packing_encodes_few_bytes_at_once(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from setloom.llm import packing

    seen, whole = [], packing.WordIds.of_texts
    monkeypatch.setattr(packing.WordIds, "of_texts", lambda self, texts, end: seen.append(texts.nbytes) or whole(self, texts, end))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(["word " * 20_000] * 60)], names=["doc_id", "text"])
    out = list(packing._piece_batches(public_tokenizers.path("word_bpe_49k.json"), 2048, 0, False)(iter([batch])))
    assert sum(sum(x.column(3).to_pylist()) for x in out) > 60 * 20_000 and max(seen) < 5 << 20
