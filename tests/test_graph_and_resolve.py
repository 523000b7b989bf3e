from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations

from setloom.operators import graph, resolve


def edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, kind string")


def split(spark, rows, limit):
    out: dict[str, list] = {}
    for r in graph.capped_components(edges(spark, rows), limit).collect():
        out.setdefault(r.comp, []).append((r.node, r.was_split))
    return sorted((sorted(n for n, _ in v), v[0][1]) for v in out.values())


CHAIN = [(f"v{i}", f"v{i + 1}", "substr") for i in range(6)] + [("V0 ", "v0", "caseonly")]


def test_capped_components(spark):
    assert split(spark, CHAIN, 12) == [(sorted(["V0 ", *[f"v{i}" for i in range(7)]]), False)]
    assert split(spark, CHAIN, 3) == [(["V0 ", "v0"], True)]
    assert split(spark, [("c0", f"c{i}", "caseonly") for i in range(1, 6)], 3) == [([f"c{i}" for i in range(6)], False)]


def test_components_of_chains_and_stars(spark):
    rows = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("z", f"y{i}") for i in range(5)] + [("s", "s")]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {got[f"n{i:02}"] for i in range(21)} == {"n00"} and got["z"] == "y0" and "s" not in got


def plain_kind(a: str, b: str) -> str | None:
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)} or {s}
    lo, hi = sorted((len(a), len(b)))
    if lo >= 3 and a != b and (a in b or b in a):
        return "substr"
    if hi > 2 * lo:
        return None
    if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.65:
        return "bigram"
    if lo >= 4 and SequenceMatcher(None, a, b).ratio() >= 0.85:
        return "edit"
    return None


def test_prefiltered_edges_are_those_of_all_pairs(spark):
    words = ["aiobahn", "aiobarn", "lia", "lisa", "guiltycrown", "guiltrycrown", "lovelive", "loveliver", "lovelivesunshine", "bt", "bts", "theidlomster", "theidolmster", "abcdabcd", "abcabcd", "kiss", "kisss", "a", "ab"]
    values = graph.keyed_values(spark.createDataFrame([(w,) for w in words], "raw string"))
    got = {(min(r.a, r.b), max(r.a, r.b)): r.kind for r in graph.similarity_edges(values).collect()}
    want = {(a, b): k for a, b in combinations(sorted(words), 2) if (k := plain_kind(a, b))}
    assert got == want


def test_keep_apart_blocks_the_detour_too(spark):
    names = ["アイカツ!", "アイカツ! 楽曲", "アイカツスターズ", "x\nアイカツ!"]
    plays = spark.createDataFrame([(1, "d", "t", n, None) for n in names], "event_no int, dj string, title string, source_work string, artist string")
    apart = graph.keep_apart_pairs(spark.createDataFrame([("アイカツ!", "アイカツスターズ")], "a string, b string"))
    profiles = graph.value_profiles(plays, "source_work")
    got = {(r.a, r.b) for r in graph.build_edges(plays, profiles, "source_work", apart).collect()}
    assert got == {("アイカツ!", "アイカツ! 楽曲")}


def test_redirects_and_cooccurrence(spark):
    values = spark.createDataFrame([("ナナシス",), ("Tokyo 7th シスターズ",), ("z",)], "raw string")
    hits = spark.createDataFrame([("ナナシス", 0, "search", "z"), ("ナナシス", 1, "redirect", " Tokyo 7th シスターズ "), ("z", 0, "alias", "unknown")], "raw string, pos int, kind string, title string")
    assert [(r.a, r.b) for r in graph.first_redirects(graph.redirect_edges(values, hits), None).collect()] == [("Tokyo 7th シスターズ", "ナナシス")]
    plays = spark.createDataFrame([("Song", "W", "AKINO"), ("song!", "w", "AKINO from bless4"), ("other", "W", "x")], "title string, source_work string, artist string")
    assert [(r.a, r.b) for r in graph.cooccurrence_edges(plays, None).collect()] == [("AKINO", "AKINO from bless4")]


def test_clusters_end_to_end(spark):
    rows = [(1, "d1", "t1", "アイカツ! 楽曲", "Ado"), (2, "d2", "t2", "アイカツ!", "x"), (3, "d1", "t3", "Ado", "y"), (3, "d1", "t3", "ado", "y")]
    plays = spark.createDataFrame(rows, "event_no int, dj string, title string, source_work string, artist string")
    profiles = graph.value_profiles(plays, "source_work")
    e = graph.build_edges(plays, profiles, "source_work")
    comps = graph.capped_components(e)
    got = {tuple(r.members): (r.rows, r.hints, r.edge_kinds) for r in graph.clusters("work", profiles, e, comps).collect()}
    assert got == {("Ado", "ado"): (2, ["artist-as-work"], ["agg", "bigram", "caseonly"]), ("アイカツ!", "アイカツ! 楽曲"): (2, [], ["agg", "bigram"])}
    done = spark.createDataFrame([("Ado",), ("ado",)], "raw string")
    left = graph.clusters("work", profiles, e, comps, done)
    assert left.count() == 1 and tuple(graph.cluster_totals(profiles, left).first()) == (4, 2, 2)
    assert {r.raw: r.base for r in graph.cluster_values(left, profiles, "work").collect()} == {"アイカツ!": None, "アイカツ! 楽曲": "アイカツ!"}


ENTRY = "ord long, canonical string, series string, kind string, variants array<string>, approved boolean, confidence string"


def test_class_map(spark):
    rows = [(0, "L!", None, "work", ["L"], True, "high"), (1, "M", None, None, ["L", "m"], True, "medium"), (2, "L!", "S", "other", ["l!"], True, "high"), (3, "N", None, None, ["n"], False, "high"), (4, "O", None, None, ["o"], True, "low")]
    e = spark.createDataFrame(rows, ENTRY)
    got = {r.raw: (r.canonical, r.series, r.kind, r.variants) for r in resolve.class_map(e).collect()}
    whole = ("L!", "S", "work", ["L", "L!", "l!"])
    assert got == {"L": whole, "L!": whole, "l!": whole, "m": ("M", None, None, ["L", "m", "M"]), "M": ("M", None, None, ["L", "m", "M"])}
    assert [tuple(r) for r in resolve.variant_conflicts(e).collect()] == [("L", "L!", "M")]
    assert [r.json for r in resolve.published_json(resolve.class_map(e)).collect()] == [r.json for r in resolve.published_json(resolve.class_map(e.repartition(3))).collect()]


CLUSTER = "id string, rows long, hints array<string>, edge_kinds array<string>, members array<string>"
PROPOSAL = "ord long, cluster_id string, canonical string, series string, kind string, variants array<string>, confidence string, reason string"


def test_auto_rules_and_claims(spark):
    c = spark.createDataFrame([("a", 9, [], ["agg"], ["x", "X"]), ("b", 8, [], ["agg"], ["y 2期", "y OP"]), ("c", 7, [], ["agg"], ["z", "Z"]), ("d", 6, ["artist-as-work"], ["agg"], ["q", "Q"]), ("e", 5, [], ["cooccur"], ["r", "R"]), ("f", 4, [], ["agg"], ["y", "Y"]), ("g", 3, [], ["agg"], ["k", "K"])], CLUSTER)
    p = spark.createDataFrame([(1, "a", "X", "", "", ["x", "X"], "high", "r"), (2, "b", "y", "", "", ["y 2期", "y OP"], "high", "r"), (3, "c", "new", "", "", ["z", "Z"], "high", "r"), (4, "d", "q", "", "", ["q", "Q"], "high", "r"), (5, "e", "r", "", "", ["r", "R"], "high", "r"), (6, "f", "Y", "", "", ["y", "Y"], "high", "r")], PROPOSAL)
    none, index = spark.createDataFrame([], "raw string"), spark.createDataFrame([("x", "other")], "raw string, canonical string")
    got = {r.id: r.code for r in resolve.auto_plan(c, p, none, none, index, spark.createDataFrame([], "a string, b string")).collect()}
    # b's canonical name would have under two characters without its notes, so its notes stay and the name is invented
    assert got == {"a": "conflict", "b": "canonical", "c": "canonical", "d": "hint", "e": "edge-kind", "f": None, "g": "no-proposal"}
    c2 = spark.createDataFrame([("a", 9, [], ["agg"], ["yy 2期", "yy OP"]), ("b", 8, [], ["agg"], ["yy", "YY"]), ("c", 7, [], ["agg"], ["s", "S"])], CLUSTER)
    p2 = spark.createDataFrame([(1, "a", "yy", "", "", ["yy 2期", "yy OP"], "high", "r"), (2, "b", "YY", "", "", ["yy", "YY"], "high", "r"), (3, "c", "s", "", "", ["s", "S"], "high", "r")], PROPOSAL)
    plan = resolve.auto_plan(c2, p2, none, none, spark.createDataFrame([], "raw string, canonical string"), spark.createDataFrame([], "a string, b string"))
    assert {r.id: r.code for r in plan.collect()} == {"a": None, "b": "auto-done", "c": None}
    assert resolve.auto_entries(plan, p2, "work", "now").count() == 2 and [tuple(r) for r in resolve.skip_counts(plan).collect()] == [("auto-done", 1, "b")]


def test_proposal_checks_and_queue(spark):
    c = spark.createDataFrame([("a", 2, [], [], ["x", "X", "w"])], CLUSTER)
    p = spark.createDataFrame([(1, "a", "x", "", "", ["x", "X"], "high", "r"), (2, "b", "x", "", "", ["x"], "high", "r"), (3, "a", "x", "", "", [], "high", "r"), (4, "a", "x", "", "", ["?"], "high", "r"), (5, "a", "", "", "", ["x"], "high", "r"), (6, "a", "new", "", "", ["x"], "high", "r"), (7, "a", "x", "", "", ["x"], "high", "r"), (8, "a", "x", "", "", ["x", "w"], "high", "r"), (9, "a", "Official", "", "", ["x"], "high", " ")], PROPOSAL)
    apart = graph.keep_apart_pairs(spark.createDataFrame([("w", "x")], "a string, b string"))
    titles = spark.createDataFrame([("a", "Official")], "id string, title string")
    got = {r.ord: r.problem for r in resolve.check_proposals(p, c, titles, apart).collect()}
    assert got == {1: None, 2: "unknown-cluster", 3: "no-variants", 4: "foreign-variants", 5: "no-canonical", 6: "invented-canonical", 7: "nothing-to-merge", 8: "keep-apart", 9: "no-reason"}
    queue = resolve.review_queue(c, spark.createDataFrame([("X",)], "raw string"), spark.createDataFrame([("X", "XX")], "raw string, canonical string"), p)
    assert {r.raw: (r.is_open, r.decided_as, r.proposed, r.canonical) for r in queue.collect()} == {"x": (True, None, True, "x"), "X": (False, "XX", False, "x"), "w": (True, None, False, "x")}


def test_validation_codes(spark):
    rows = [("1", "work", "accept", "A", "work", "high", ["A", "a"], "r"), ("2", "work", "accept", "B", "work", "high", ["b"], "r"), ("3", "work", "reject", None, None, None, ["done"], "r"), ("4", "work", "accept", "p", "work", "high", ["p", "q"], "r"), ("5", "work", "accept", "k", "work", "high", ["k", "kk"], "r"), ("6", "work", "keep-apart", None, None, None, ["x"], "r"), ("7", "x", "accept", "A", None, None, ["A"], "r")]
    payload = spark.createDataFrame(rows, "id string, field string, action string, canonical string, kind string, confidence string, variants array<string>, reason string")
    decided, apart = spark.createDataFrame([("work", "done")], "field string, raw string"), graph.keep_apart_pairs(spark.createDataFrame([("p", "q")], "a string, b string"))
    index = spark.createDataFrame([("work", "kk", "other")], "field string, raw string, canonical string")
    got = {r.id: r.code for r in resolve.validate(payload, decided, apart, index, spark.createDataFrame([], "field string, canonical string")).collect()}
    assert got == {"1": None, "2": "invalid", "3": "already-decided", "4": "keep-apart", "5": "conflict", "6": "invalid", "7": "invalid"}


def test_canonical_guess(spark):
    rows = [("a", "ゆるゆり 1期OP", 0, 5, "ゆるゆり", None, True), ("a", "ゆるゆり♪♪", 1, 9, None, None, True), ("b", "x 2期", 0, 1, "x 軽", None, True), ("b", "x OP", 1, 1, "x 軽", None, True), ("b", "y ED", 2, 9, "y", None, True), ("c", "m", 0, 1, None, "M!", False), ("c", "n", 1, 5, None, None, True)]
    v = spark.createDataFrame(rows, "id string, raw string, pos int, rows long, base string, decided_as string, checked boolean")
    got = {r.id: r.canonical for r in resolve.guess_canonical(v, spark.createDataFrame([], "ord long, cluster_id string, canonical string")).collect()}
    assert got == {"a": "ゆるゆり", "b": "x 軽", "c": "M!"}


def test_batches(spark):
    rows = [("work", i, str(i), t) for i, t in enumerate([10, 10, 50, 10, 10])]
    got = [r.batch for r in resolve.pack_batches(spark.createDataFrame(rows, "field string, ord long, id string, tokens long"), 20, 60, 2).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 2]


def test_profiles_and_rows_of_values_read_the_log_once(spark):
    """Values that stand in both fields are found among the stored cells, those beside a blank value too."""
    rows = [(1, "d1", "t1", " A ", "x"), (2, "d2", "t2", "A", None), (3, "d1", "t3", " ", "A "), (3, "d1", "t3", "x", ""), (4, "d3", "t4", None, "y"), (4, "d3", "t5", "z", "z")]
    met = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            met.add(len(part))
            yield part

    schema = "event_no int, dj string, title string, source_work string, artist string"
    plays = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    full = {r.raw: (r.rows, r.cross_field) for r in graph.value_profiles(plays, "source_work").collect()}
    assert met.value == len(rows)
    lean = {r.raw: (r.rows, r.cross_field) for r in graph.value_rows(plays, "source_work").collect()}
    assert full == lean == {"A": (2, True), "x": (1, True), "z": (1, True)}
    assert met.value == 2 * len(rows)


def test_large_clusters_are_dealt_out_and_settled_ones_are_not_cleaned(spark, monkeypatch):
    """Clusters that no rule stopped, alone, meet the pairs kept apart; their rows come from as many tasks as shuffles have."""
    clusters = spark.createDataFrame([(f"c{i}", 9 - i, [], ["agg"], [f"{x}{i}" for x in "abc"]) for i in range(8)], "id string, rows long, hints array<string>, edge_kinds array<string>, members array<string>")
    proposals = spark.createDataFrame([(i, f"c{i}", f"a{i}", [f"{x}{i}" for x in "abc"], "high" if i < 4 else "low") for i in range(8)], "ord long, cluster_id string, canonical string, variants array<string>, confidence string")
    met, inner = [], resolve.within_apart
    monkeypatch.setattr(resolve, "within_apart", lambda members, *a, **k: met.append(members) or inner(members, *a, **k))
    none = spark.createDataFrame([], "raw string")
    apart = spark.createDataFrame([("a2", "b2"), ("a5", "b5")], "a string, b string")
    plan = resolve.auto_plan(clusters, proposals, none, none, spark.createDataFrame([("b1", "other")], "raw string, canonical string"), apart)
    want = {"c0": None, "c1": "conflict", "c2": "keep-apart", "c3": None} | {f"c{i}": "confidence" for i in range(4, 8)}
    assert {r.id: r.code for r in plan.collect()} == want
    assert {r.id for r in met[0].select("id").distinct().collect()} == {f"c{i}" for i in range(4)}
