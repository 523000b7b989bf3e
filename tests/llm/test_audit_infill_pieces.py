"""Divergence audit, fill-in-middle and pieces against plain versions and the library."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from setloom.llm import divergence as audit
from setloom.llm import infill, pieces

SCHEMA = "doc_id long, text string, lang string, source string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
EDGES = [None, "", " ", "\n\t ", "a", " a", "a ", "  a  b\n", "<P>", "x<S>y", "<<M>", "<M", "M>", "<P <S", "ÄÖ ß　 x", "日本語 テスト", "😀 😀", "a\x00b", "word " * 700, "é" * 900, "x" * 239 + " yy", "x" * 238 + "<P>", "x" * 240 + " " * 240 + "z"]


# divergence ----------------------------------------------------------------------------------------------------------


def plain_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    seen = defaultdict(Counter)
    for lang, _, words in docs:
        seen[lang].update(set(words))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        count = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                count[s].update(w for w in words if w in set(kept))
        whole = sum(count.values(), Counter())

        def share(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)

        for s, c in count.items():
            pairs = [(-sum((share(c, t) - share(o, t)) ** 2 // share(o, t) for t in kept), other) for other, o in count.items() if other != s]
            terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize(("tile", "matrix", "top"), [(1 << 19, 1 << 22, 200), (40, 1 << 22, 7), (12, 4, 3)])
def test_divergence_equals_a_plain_version_in_whole_and_small_tiles(spark, monkeypatch, tile, matrix, top):
    monkeypatch.setattr(audit, "MATRIX", matrix)
    rng = random.Random(tile)
    words = ["the", "The", "of", "Ärger", "ärger", "naïve", "x1y", "日本", "don't", "a_b", "zz", "q q", "ﬁ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))) or None, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ä", "Z", None, ""])) for i in range(120)]
    rows += [(1, "rare words only", "xx", "a"), (2, "", "xx", "b"), (3, None, "yy", None)] + [(7, "the same row", "en", "a")] * 5
    got = {tuple(r) for r in audit.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), top=top, tile=tile).collect()}
    assert got == plain_divergence(rows, top=top)


def test_divergence_of_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.divergence(empty).count() == 0
    rows = [(1, "A b " * 50_000, "en", "s"), (2, "a B", "en", "t"), (3, "a b c", "en", "t")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS count", "3 AS value", "4 AS rank", "5 AS block", "6 AS docs")
    assert {tuple(r) for r in audit.divergence(docs).collect()} == plain_divergence(rows)


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(3)
    total = rng.integers(1, 9 * 10**15, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    want = [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
    assert audit.shares(count, total).tolist() == want
    assert audit.shares(total, total).tolist() == [10**9 + 1] * 2000


# fill in middle ------------------------------------------------------------------------------------------------------


def plain_infill(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_equals_a_plain_version_and_comes_back(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "日", "😀", " ", "\n", "\t", "\x0b", " ", "<", "P", "S", "M", ">", "<P", "word", "  ", "\x1f"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([3, 20, 100, 700])))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "a null id with text"), (-5, "a b c d"), (-5, "a b c d")]
    rows.append((7777, "lang " * 300_000 + "ende"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS form", "2 AS output", "3 AS h1")
    for rate in (50, 100):
        made = infill.fill_in_middle(docs, rate=rate)
        got = made.withColumn("back", infill.restored(made.output, made.form)).collect()
        want = Counter(plain_infill(i, t, rate=rate) for i, t in rows)
        assert Counter(tuple(r)[:6] for r in got) == want
        whole = Counter((i, t or "") for i, t in rows)
        assert Counter((r.doc_id, r.back) for r in got) == whole
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def test_infill_with_sentinels_of_other_kinds(spark):
    sentinels = ("<|pre fix|>", "<|suf|>", "aab")
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(["a", "b", "aab", " ", "<|suf|", "<|suf|>", "<|pre fix|>", "é", "\n"], [9, 6, 1, 5, 3, 1, 1, 4, 2], k=rng.randrange(0, 60)))) for i in range(300)]
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, sentinels=sentinels)
    got = {r.doc_id: (r.form, r.back) for r in made.withColumn("back", infill.restored(made.output, made.form, sentinels)).collect()}
    for i, t in rows:
        assert got[i][1] == t
        assert (got[i][0] == "plain") == (not t or any(s in t for s in sentinels))
    with pytest.raises(ValueError):
        infill.fill_in_middle(made, sentinels=("a", "a", "b"))


def test_the_automaton_knows_how_far_back_it_looks():
    scan = infill.scanner(infill.SENTINELS)
    rng = np.random.default_rng(1)
    text = rng.choice(np.frombuffer("<PSM> aé".encode(), np.uint8), 5000).astype(np.uint8)
    lanes = infill.first_pass(scan, text, np.array([0, len(text)]))
    state, states = 0, []
    for i, byte in enumerate(text.tolist()):
        if i % infill.LANE == 0:
            states.append(state)
        state = int(scan.table[state << 8 | byte]) >> 24
    assert lanes.state.tolist() == states


# pieces --------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    alphabet = ["a", "e", " ", "  ", "▁", "the", "ing", "\n", "日", "😀", "\x00", "<0x0A>", "<s>", "é", "　", "ра", "aaaa", "    ", "͸", "\r", "==", "ﬁ", "2024", "한", "�", "​"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(1, 60)))) for i in range(600)] + [(1000 + i, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (4, "twice"), (4, "twice")]
    rows += [(5000, "x" * 20_000), (5001, "abcdefgh" * 4000), (5002, "word and word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    got = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL).collect()
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "")
        want[i, tuple(ids), lib.decode(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert pieces.decode_pieces(pieces.encode_pieces(docs.limit(0), MODEL), MODEL).count() == 0


def test_any_ids_decode_as_the_library_decodes_them():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.piece_model(MODEL)
    rng = random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 29871, lib.piece_to_id("▁▁")]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_pieces_are_found_again_after_what_was_remembered_is_gone(monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 3)
    monkeypatch.setattr(pieces, "PARTS", 4)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(MODEL)
    for text in ("one two three four five six seven", "two three nine ten eleven twelve", "one thirteen two"):
        assert own.encode(text) == lib.encode(text)
    assert len(own.parts) <= 2
    own.rule = None  # texts that aren't cut
    assert own.encode("one two  three   four ▁ five\n six") == lib.encode("one two  three   four ▁ five\n six")


def test_texts_are_cut_where_no_piece_is():
    own = pieces.piece_model(MODEL)
    letters, blanks = pieces.first_bytes(True), pieces.first_bytes(False)
    assert (own.rule == letters).all()
    assert (pieces.safe_rule({"▁a", "ab", "é1"}) == blanks).all()
    assert pieces.safe_rule({"▁a", "a▁"}) is None
    flat = np.frombuffer("  ab,é  日x".encode(), np.uint8)
    assert own._cuts(flat, np.array([0, 4])).tolist() == [0, 4, 5, 7, 12]


def test_backtracking_takes_pieces_back():
    own = pieces.piece_model(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(9)
    greedy = 0
    for _ in range(3000):
        text = "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 14)))
        ids, rest, longest = np.frombuffer(own.cut_up(text), np.int32).tolist(), text, []
        assert [own.pieces[i] for i in ids] == own.merged(text)
        while rest:
            size, found = max((end + 1, found) for end, (last, found) in own.automaton.iter(rest) if end == last)
            longest.append(found[0][1])
            rest = rest[size:]
        greedy += longest != ids
    assert greedy > 100  # the longest pieces alone would be wrong that often
    assert lib.encode("a" * 37) == own.encode("a" * 37)
