from __future__ import annotations

import base64
import hashlib
import io
import struct
import zipfile

import duckdb
import numpy as np
import pytest

from setloom.llm import queries as registered
from setloom.llm import vectors
from setloom.llm.extract import extract_text, main_text
from setloom.llm.warc import ZipDirectory, page_of, parse_record, read_archives, record, record_id, resolve_revisits, write_archives


def test_record_round_trip():
    for page_id in (0, 7, -3, None, 1 << 62):
        assert page_of(record_id(page_id)) == page_id
    fields, payload = parse_record(record(5, "http://x/ü\n", "<p>é\r\n\r\n</p>".encode(), None, False))
    assert fields["warc-type"] == "response" and payload == "<p>é\r\n\r\n</p>".encode()
    assert page_of(parse_record(record(5, None, b"a", 9, True))[0]["warc-refers-to"]) == 9


def test_zip64_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"stored")
        z.writestr(zipfile.ZipInfo("b"), b"more")
        z.writestr("c", b"packed" * 50, compress_type=zipfile.ZIP_DEFLATED)
    raw = out.getvalue()
    end = raw.rfind(b"PK\x05\x06")
    n, size, start = struct.unpack("<HII", raw[end + 10 : end + 20])
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start)
    far = raw[:end] + wide + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1) + raw[end : end + 8] + struct.pack("<HHIIH", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for data in (raw, far):
        z = ZipDirectory(io.BytesIO(data), len(data))
        assert set(z.members) == {"a", "b"}
        assert [z.range(*z.place(m)) for m in ("a", "b")] == [b"stored", b"more"]


def test_pages_go_through_archives(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 1000), (6, "http://a/\n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = write_archives(pages, most_bytes=200)
    got = {r.page_id: r for r in resolve_revisits(read_archives(archives)).collect()}
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "")]
        r = got[page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == max(same) else ("revisit", max(same)))
    assert len(got) == 6 and archives.count() > 1
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def odd_vectors(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[n // 2 :] = x[rng.integers(0, 6, n - n // 2)] + rng.normal(size=(n - n // 2, 8)) * rng.choice([0, 0.05, 0.12, 0.3], (n - n // 2, 1))
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2)) for i in range(n)]
    return [*rows, (n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] + [1.0] * 7, 0), (n + 3, [None] + [1.0] * 7, 1), (n + 4, rows[0][1], None), (n + 5, rows[1][1], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [float("inf")] * 8, 1), (n + 8, [], 1)]


@pytest.mark.parametrize("node", [1024, 8])
def test_near_vectors_are_brute_force(spark, node):
    rows = odd_vectors(1, 120)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links: dict[int, set[int]] = {i: set() for i, *_ in rows}
    for a, (i, u, k) in enumerate(fine):
        for j, v, m in fine[a + 1 :]:
            if k == m and len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    got = {r.vec_id: r for r in vectors.near_vectors(frame, 0.98, node=node).collect()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), i == min(seen)), i
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_dual_traversal_finds_all_pairs_with_few_distances():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 6))
    x = np.repeat(middle, 40, axis=0) + rng.normal(size=(1200, 6)) * 0.02
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    every = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    for reach in (0.02, 0.2):
        for a, b, want in ((x, x, np.triu(every <= reach, 1)), (x[:500], x[500:], every[:500, 500:] <= reach)):
            made = vectors.Distances()
            i, j = vectors.dual_pairs(a, b if a is not b else a, reach, made, at_once=700)
            assert len({*zip(i.tolist(), j.tolist(), strict=True)}) == len(i) and want.sum() <= len(i)
            got = np.zeros(want.shape, bool)
            got[i, j] = True
            assert not (want & ~got).any()
            assert made.made < len(a) * len(b) / 8, made.made
    flat = rng.normal(size=(300, 32))
    flat /= np.linalg.norm(flat, axis=1, keepdims=True)
    far = np.sqrt(np.maximum(2 - 2 * flat @ flat.T, 0))
    i, j = vectors.dual_pairs(flat, flat, 0.9, vectors.Distances(), many=50)
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*zip(*(v.tolist() for v in np.nonzero(np.triu(far <= 0.9 + 1e-6, 1))), strict=True)}
    assert not len(vectors.dual_pairs(np.eye(3)[:2], np.eye(3)[2:], 0.2, vectors.Distances())[0])
    for n in (1, 2, 5):
        i, j = vectors.dual_pairs(x[:n], x[:n].copy(), 0.5, vectors.Distances())
        assert {*zip(i.tolist(), j.tolist(), strict=True)} >= {(a, b) for a in range(n) for b in range(n) if every[a, b] <= 0.5}


def test_near_vectors_with_null_shared_and_repeated_ids(spark):
    u, v, w = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, u, 1), (None, v, 1), (5, w, 1), (7, w, 1), (7, w, 1), (None, [0.0, 1.0, 0.0], 1), (None, [0.0, 1.01, 0.0], 1), (3, u, None), (3, u, 2)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, cid string, n int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_vectors(frame, 0.98).collect())
    want = [("5", 1, "5", True), ("None", 1, "5", False), ("5", 2, "5", True), ("7", 2, "5", False), ("7", 2, "5", False), ("None", 1, "None", True), ("None", 1, "None", True), ("3", 0, "3", True), ("3", 0, "3", True)]
    assert got == sorted(want)


def test_top_k_of_large_components_and_empty_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [200000.0, 0.0]), (2, [0.5, 0.0]), (3, [-3.0e9, 1.0]), (100, [4.0e6, 4.0e6]), (200, []), (7, [])], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.top_k(frame, every=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    own = {0: [1024, 0], 1: [204800000, 0], 2: [512, 0], 3: [-3072000000000, 1024], 100: [4096000000, 4096000000]}
    for q in (0, 100):
        best = sorted((-sum(a * b for a, b in zip(own[q], v, strict=True)), i) for i, v in own.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, max(-s, -(1 << 63))) for n, (s, i) in enumerate(best)]
    assert got[200] == [(1, 7, 0)]


def test_top_k_is_brute_force(spark):
    rows = odd_vectors(2, 300) + [(4, [1.0] * 8, 0), (100, [2.0] * 8, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in vectors.top_k(frame, every=50, candidate_block=40, query_block=3, step=2).collect() if r.query_id != 100)
    use = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, q in use:
        if i % 50 == 0 and i != 100:
            best = sorted((-int(q @ v), j) for j, v in use if j != i and len(v) == len(q))[:10]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert vectors.top_k(frame.limit(0)).count() == 0


def test_top_k_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.execute(registered.ORACLES["op8_top_k"]).fetchall())
    assert sorted(tuple(r) for r in registered.op8_top_k(spark, d).collect()) == want


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>bad</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<div class="post-%d content"><h1>Title &amp; more</h1><p><b>First   para,<br>with a break, and commas, to count.<p>Second &eacute; <a href="x">link</a> para, which is longer than the others, by far.</p>
<form><input><p>Sign up</p></form><ul><li>one<li>two</ul><!-- <p>gone</p> --><aside>Related</aside></div>
<section id="comments"><p>Nice post, I like it, very much, indeed, and so on and so on.</p></section><footer>&copy; x</footer>"""
TEXT = "Title & more\nFirst para, with a break, and commas, to count.\nSecond é link para, which is longer than the others, by far.\none\ntwo"


def test_pages_give_their_article(spark):
    rows = [(i, f"https://h.example/{i}", PAGE % i) for i in range(6)] + [(10, None, None), (11, "not a url", ""), (12, "http://o/", "<p>Only this &am"), (13, "http://h.example", "<nav>menu</nav>")]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == TEXT and got[i].n_chars == len(TEXT) for i in range(6))
    assert got[10].text == got[11].text == got[13].text == "" and got[12].text == "Only this &am"
    assert extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_broken_markup_is_read_to_its_end():
    assert main_text('<article><p title="a>b">x <b>y</p><p>z', None) == "x y\nz"
    assert main_text("a < b & c <p", None) == "a < b & c"
    assert main_text("<div>" * 300 + "deep" + "</div>" * 300, None) == "deep"


def test_rows_that_share_an_id_find_each_other(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_k(frame, every=100).collect())
    a, b, c = 1024 * 512, 1024 * 1024, 512 * 1024
    assert got == sorted([(0, 1, 3, b), (0, 2, 0, a), (0, 1, 0, c), (0, 2, 3, c)])


def test_very_large_and_very_small_vectors_link(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 0.0]), (4, [2e-200, 3e-250]), (5, [0.0, 1e308]), (6, [5e-324, 5e-324]), (7, [3.0, 3.0]), (8, [-1e-310, -1e-310])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}
