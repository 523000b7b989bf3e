from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DDL)


def test_passages_of_51_short_words_go(spark):
    rnd = random.Random(2)
    some = lambda n, k: " ".join("".join(rnd.choice("abcdefghij") for _ in range(k)) for _ in range(n))
    shared, fifty, wide = some(51, 2), some(50, 2), some(60, 7)
    assert len(shared) < 256 < len(wide)
    own = [f"{c}{some(20, 6)}{c}" for c in "KLMNOPQR"]
    rows = [(1, f"{own[0]} {shared} {own[1]}"), (2, f"{own[2]} {shared}"), (None, f"{own[3]} {fifty}"), (4, f"{fifty} {own[4]}"), (5, f"{own[5]} {wide} {own[6]}"), (6, f"{wide} {own[7]}"), (7, shared)]
    got = {r.doc_id: r.text.split() for r in pipeline.repeated_passages(spark, documents(spark, rows), "").collect()}
    want = {1: own[0] + " " + own[1], 2: own[2], None: own[3] + " " + fifty, 4: fifty + " " + own[4], 5: own[5] + " " + own[6], 6: own[7]}
    assert got == {i: t.split() for i, t in want.items()}


def plain_near_copies(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, min(len(w), 1)))})
    root = [*range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((root[a], root[b]))
                root = [x if v == y else v for v in root]
    least = {}
    for (i, t), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return Counter((None if none else i) for none, i in least.values()), len(least)


def test_near_copies_keep_a_row_of_each_group_whatever_the_ids(spark):
    rnd = random.Random(3)
    some = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = some(90), some(90), some(90), some(90)
    near = [*a[:40], "other", *a[41:]]
    rows = [(1, " ".join(a)), (2, " ".join(near)), (None, " ".join(near)), (None, " ".join(b)), (None, " ".join(b)), (None, " ".join(c)), (7, " ".join(d)), (7, "quite another text"), (7, " ".join(d)), (8, "x y"), (8, "x y"), (9, None), (10, "")]
    got = pipeline.near_copies(spark, documents(spark, rows), "").collect()
    want, n = plain_near_copies(rows)
    assert Counter(r.doc_id for r in got) == want == Counter({1: 1, None: 2, 7: 2, 8: 1, 9: 1}) and len(got) == n
    assert {r.text for r in got} == {" ".join(a), " ".join(b), " ".join(c), " ".join(d), "quite another text", "x y", None}


def test_language_mixture_and_packing_are_plain(spark):
    rows = [(1, "the old house by the river"), (2, "12 34 !?"), (None, "and the way to it"), (4, ""), (5, None), (1, "a second text of one")]
    docs = documents(spark, rows)
    told = pipeline.language(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in told.collect()) == Counter((i, t) for i, t in rows if t and any(x.isalpha() for x in t))
    nameless = pipeline.language(spark, docs.withColumn("lang", F.when(F.col("doc_id") != 4, F.col("lang"))), "")
    assert {r.lang for r in nameless.where("doc_id is null").collect()} == {"en"}  # a missing language is told by the classifier
    mixed = Counter((r.doc_id, r.text) for r in pipeline.mixture(spark, told, "").collect())
    assert mixed and all(n <= 2 and k in rows for k, n in mixed.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = pipeline.packing(spark, told, "").collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in told.collect())
    assert {r.sequence_id for r in packed} == {0}


def test_run_keeps_unlike_documents_with_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.choice('abcdefgh')}{rnd.randrange(10**5)}" for _ in range(60))) for i in (1, 2, None, None, 5, 5)]
    documents(spark, [*rows, (6, rows[0][1]), (7, "12")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) == {1, 2, None, 5} and got[None] >= 2 and got[5] >= 2
