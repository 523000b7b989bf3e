"""The review queue: names by precedence, counters, and the counters kept up from the log."""

from __future__ import annotations

import json
import random

from setloom.operators import resolve
from setloom.streaming import log

CLUSTERS = [("work", "w1", ["a", "b"]), ("work", "w2", ["c"]), ("work", "w3", ["a", "d", "e"]), ("artist", "a1", ["a", "x"])]


def test_names_of_people_come_before_automatic_ones(spark):
    ddl = "field string, ord long, canonical string, variants array<string>"
    human = spark.createDataFrame([("work", 5, "Five", ["s", "t"]), ("work", 2, " Two ", ["s"]), ("artist", 1, "Art", ["s"]), ("work", 0, " ", ["z"])], ddl)
    auto = spark.createDataFrame([("work", 0, "Machine", ["s", "u", "Five"]), ("work", 1, "Late", ["u"]), ("work", 9, None, ["q"])], ddl)
    got = {(r.field, r.raw): r.canonical for r in resolve.assigned_names(human, auto).collect()}
    assert got == {("work", "s"): "Two", ("work", "t"): "Five", ("work", "Five"): "Five", ("work", "Two"): "Two", ("artist", "s"): "Art", ("artist", "Art"): "Art", ("work", "u"): "Machine", ("work", "Machine"): "Machine", ("work", "Late"): "Late"}


def test_the_state_equals_the_batch_result_after_each_micro_batch(spark, tmp_path):
    clusters = spark.createDataFrame(CLUSTERS, "field string, id string, members array<string>")
    nothing = spark.createDataFrame([], "field string, id string")
    rng, written = random.Random(1), []
    (tmp_path / "log").mkdir()
    state = log.QueueState(spark, str(tmp_path / "state"), clusters)

    def whole():
        decided = resolve.decided_by_field(spark.createDataFrame([(r["field"], r["action"], r["variants"]) for r in written], "field string, action string, variants array<string>"))
        return {(r.field, r.total, r.decided, r.open_values) for r in resolve.queue_counters(clusters, decided, nothing).collect()}

    assert {tuple(r) for r in state.counters().collect()} == whole()
    for n in range(5):
        rows = [{"id": "x", "field": rng.choice(["work", "work", "artist"]), "action": rng.choice(["accept", "reject", "defer", "keep-apart"]), "variants": rng.choices("abcdex", k=2)} for _ in range(2)]
        written += rows
        (tmp_path / "log" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
        log.follow_queue(log.decision_stream(spark, str(tmp_path / "log")), state, str(tmp_path / "checkpoint")).awaitTermination()
        assert {tuple(r) for r in state.counters().collect()} == whole(), n
    # a batch that is run again counts once
    again = spark.read.schema("field string, action string, variants array<string>").json(str(tmp_path / "log" / "4.json"))
    state.apply(again, 4)
    assert {tuple(r) for r in state.counters().collect()} == whole()


def test_new_titles_over_all_time_after_late_events(spark, tmp_path):
    rng, seen = random.Random(2), []
    (tmp_path / "plays").mkdir()
    stream = spark.readStream.schema("base string, event_no int, event_date date, dj string").json(str(tmp_path / "plays"))
    for n, events in enumerate(([5, 6], [6, 7], [1, 2, 7], [3, 5], [0])):  # some come late
        rows = [{"base": rng.choice(["a", "b", "c", "d", "e", "", None]), "event_no": rng.choice([*events, None]), "dj": "x"} for _ in range(8)]
        seen += rows
        (tmp_path / "plays" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        log.keep_changes(log.new_title_changes(stream), str(tmp_path / "changes"), str(tmp_path / "titles")).awaitTermination()
        first = {}
        for r in seen:
            if r["base"] and r["event_no"] is not None:
                first[r["base"]] = min(first.get(r["base"], 99), r["event_no"])
        want = {e: list(first.values()).count(e) for e in first.values()}
        assert {r.event_no: r.new_titles for r in log.new_titles(spark, str(tmp_path / "changes")).collect()} == want


def test_counters(spark):
    clusters = spark.createDataFrame(CLUSTERS, "field string, id string, members array<string>")
    decided = spark.createDataFrame([("work", "a"), ("work", "b"), ("work", "a"), ("artist", "c")], "field string, raw string")
    auto = spark.createDataFrame([("work", "w1"), ("work", "w1")], "field string, id string")
    got = {tuple(r) for r in resolve.queue_counters(clusters, decided, auto).collect()}
    assert got == {("work", 3, 1, 1, 3), ("artist", 1, 0, 0, 2)}
