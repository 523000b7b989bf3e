"""Every operator and stage: nulls, empties, repeated rows, ties, a long text, empty tables, extra columns with clashing names."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from setloom.llm import language, quality
from setloom.llm.extract import extract_text
from setloom.llm.language import identify_language
from setloom.llm.mixing import mix_sources
from setloom.llm.packing import pack_sequences
from setloom.llm.quality import score_quality
from setloom.llm.simhash import simhash_groups
from setloom.llm.suffix_dedup import remove_repeats
from setloom.llm.vectors import near_vectors, top_k
from setloom.llm.warc import read_archives, resolve_revisits, write_archives

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ["rid", "sig", "fp", "rk", "c0", "c1", "tkey", "khash", "length", "rank", "size", "taken", "path", "host", "salt", "score", "lab", "cid", "v", "grp", "spans", "payload", "n", "Text2"]
RND = random.Random(12)
LONG = " ".join(f"w{RND.randrange(10**5)}" for _ in range(90_000))  # about 600 KB, over every part limit of half a megabyte
ROWS = [(1, "the house by the river and the sea", "en", "a"), (1, "the house by the river and the sea", "en", "a"), (None, None, None, None), (2, "", "en", "b"), (3, " \t\n", "de", "b"), (4, LONG, "en", "a"), (5, "das Haus und der Fluss", "de", None), (6, "x", "en", "a"), (7, "x", "en", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return frame.withColumns({c: F.lit("clash") for c in CLASHES}).cache()


@pytest.mark.parametrize("run", [
    lambda d: remove_repeats(d, length=400, keep_text=True, carry=("lang",)),
    lambda d: identify_language(d, carry=("source",)),
    lambda d: mix_sources(d),
    lambda d: mix_sources(d, carry=("text", "lang")),
    lambda d: score_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
    lambda d: simhash_groups(d),
])
def test_one_row_a_document(docs, run):
    got = run(docs)
    assert not set(got.columns) & (set(CLASHES) - {"score", "size", "taken", "fp"})
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter(r[0] for r in ROWS)
    assert run(docs.where("false")).count() == 0


def test_packing_and_stages(docs):
    got = pack_sequences(docs, PATH, size=512).collect()
    assert Counter((r.doc_id) for r in got if r.piece == 0) == Counter(r[0] for r in ROWS)
    assert sum(r.length for r in got if r.doc_id == 4) > 90_000 and pack_sequences(docs.where("false"), PATH).count() == 0
    spark = docs.sparkSession
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, docs.where("false"), "")
        assert none.count() == 0
        if name != "packing":
            assert out.columns == pipeline.COLUMNS
            texts = {r.text for r in out.collect()}
            assert LONG in texts and "das Haus und der Fluss" in texts, name


def test_pages_archives_and_vectors(spark):
    pages = [(1, "http://a/", "<p>one, two</p>"), (1, "http://a/", "<p>one, two</p>"), (2, None, None), (3, "x", ""), (None, "http://a/", "<p>" + "long text, " * 60_000 + "</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES})
    got = extract_text(frame).collect()
    assert Counter(r.page_id for r in got) == Counter(p[0] for p in pages) and max(r.n_chars for r in got) == 60_000 * 11 - 1
    back = resolve_revisits(read_archives(write_archives(frame, least_bytes=0))).collect()
    assert Counter(r.page_id for r in back) == Counter(p[0] for p in pages) and Counter(r.record_type for r in back)["revisit"] >= 1
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [0.5, 0.5], None), (None, None, 1), (5, [], 1)], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in CLASHES})
    assert near_vectors(vectors).count() == 5 and top_k(vectors, k=2).select("query_id").distinct().count() == 2
    for run in (extract_text, near_vectors, top_k, lambda d: resolve_revisits(read_archives(write_archives(d, least_bytes=0)))):
        empty = frame.where("false") if run not in (near_vectors, top_k) else vectors.where("false")
        assert run(empty).count() == 0


def test_kernel_ridge_is_the_plain_solution():
    texts = ["the cat and the dog " * 3, "a man of the sea and land", "der Hund und die Katze " * 3, "ein Mann der See und", "le chat et le chien " * 2, "un homme de la mer"]
    labels = ["en", "en", "de", "de", "fr", "fr"]
    model = language.fit(texts, labels, 1 << 16, 4096, landmarks=6, ridge=0.5)
    grams = [{t[i : i + n] for t in [f" {x.lower()} "] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for x in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    # with all blocks as landmarks the Nyström kernel is the kernel itself; centred kernel ridge, each language weighing the same
    centre = np.eye(6) - 1 / 6
    y = np.where(np.array(labels)[:, None] == np.array(model.languages), 1.0, -1.0)
    alpha = np.linalg.solve(centre @ kernel @ centre + 0.5 * np.eye(6), y - y.mean(axis=0))
    want = y.mean(axis=0) + centre @ kernel @ centre @ alpha
    assert np.abs(language.score(model, texts) - want).max() < 0.03  # bucket collisions and single precision


def test_dual_descent_meets_the_optimum_of_the_hinge_loss():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(40)]
    y = np.where(np.array([(r < 6).mean() for r in rows]) + rng.normal(0, 0.15, 40) > 0.5, 1, -1)
    scale, cost = rng.normal(0, 1, quality.DIMS), np.full(40, 0.7)
    w, bias = quality.dual_descent(rows, y, scale, cost, rounds=3000, seed=1)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 12] = 1.0  # the bias is a feature of its own
    loss = lambda v: 0.5 * v @ v + 0.7 * np.maximum(1 - y * (x @ v), 0).sum()
    found, best = np.append(w[:12], bias), np.zeros(13)
    least = loss(best)
    for k in range(40_000):  # plain subgradient steps
        g = best - 0.7 * ((y * (x @ best) < 1) * y) @ x
        best = best - g / (k + 10)
        least = min(least, loss(best))
    assert loss(found) <= least * 1.01


def test_long_texts_score_like_their_parts():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 110, 3 << 19).astype(np.uint8)
    body[::7] = 32
    model = quality.QualityModel(np.stack([rng.normal(0, 1, quality.DIMS), np.ones(quality.DIMS)]), 0.1, 1.0, 0.0, 4096)
    at_once = quality.margins(model, body, np.array([0, len(body)]))
    parts = quality.margins(model, body, np.array([0, 1 << 19, 2 << 19, 3 << 19]))
    assert abs(at_once[0] - parts.mean()) < 1e-9
    assert quality.chosen_blocks(10 * 4096, 4096, 2) != [0, 1] and quality.chosen_blocks(5, 4096, 2) == [0]
    rows = list(quality._feature_batches(4096, 2)([pa.record_batch([pa.array([1]), pa.array([1]), pa.array([body.tobytes().decode()])], names=["doc_id", "y", "text"])]))
    assert [r.column("part")[0].as_py() for r in rows] == quality.chosen_blocks(len(body), 4096, 2)
