"""Transcripts, sinks and detector runs over literal files and rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snagline.operators import detectors as D
from snagline.operators import review as V
from snagline.sources import sinks, transcripts
from tests.test_detectors import SPAN, missing, obs


def call(i, name="Bash", **given):
    return {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": i, "name": name, "input": given}]}}


def result(i, text, error=False):
    return {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": i, "content": text, "is_error": error}]}}


def says(text, role="user"):
    return {"type": role, "message": {"role": role, "content": text}}


#: What happens in a session, and the kinds of its events.
CASES = {
    "run-failed": ([call("1", command="make"), result("1", "Exit code 2\nboom", True)], ["run_failed"]),
    "run without exit code": ([call("1", command="ls"), result("1", "a b")], ["run"]),
    "unresolved run": ([call("1", command="ls")], ["run"]),
    "tool-error-edit": ([call("1", "Edit", file_path="/a"), result("1", "String not found", True)], ["tool_error"]),
    "tool-rejected": ([call("1", command="rm"), result("1", transcripts.REJECTIONS[1], True), says("do not delete")], ["tool_rejected", "user_turn_after_correction"]),
    "interrupt-then-correction": ([says(transcripts.INTERRUPT), says("use tabs"), says("and more")], ["interrupt", "user_turn_after_correction", "turn"]),
    "interrupt-assistant-resumes": ([says(transcripts.INTERRUPT), call("1", command="ls"), result("1", "x"), says("fine")], ["interrupt", "run", "turn"]),
    "file-read": ([call("1", "Read", file_path="/r"), result("1", "text"), call("2", command="ls"), result("2", "x")], ["file_read", "run"]),
}


def lines(spark, records, path="/s"):
    rows = [(path, i, r if isinstance(r, str) else json.dumps({"sessionId": "s1"} | r)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "path string, line long, text string")


def test_parser_cases(spark):
    parts = [lines(spark, records, f"/{name}").withColumn("text", F.replace("text", F.lit('"s1"'), F.lit(f'"{name}"'))) for name, (records, _) in CASES.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    got = {}
    for r in transcripts.events_of(transcripts.blocks_a(every)).orderBy("line", "place").collect():
        got.setdefault(r["session_id"], []).append(r["kind"])
    assert got == {name: kinds for name, (_, kinds) in CASES.items()}


def test_interactions_drop_streamed_repeats_and_stop_at_the_cap(spark):
    again = {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "hi"}, {"type": "text", "text": "hi"}]}}
    rows = transcripts.interactions_of(transcripts.blocks_a(lines(spark, [says("fix it"), again, says("more"), "no json", says("late")])), 3).orderBy("ordinal").collect()
    assert [(r["origin"], r["turn_id"], r["text"]) for r in rows] == [("human_request", 1, "fix it"), ("assistant_text", 1, "hi"), ("human_request", 2, "more")]


def test_texts_of_unknown_records(spark):
    texts = {'{"message":{"content":[{"text":"a"},{"output":["b",{"stderr":"c"}]}]},"id":"x"}': "a\nb\nc", "{": None, "3": None, '"just text"': "just text"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", transcripts.text_within("t").alias("x")).collect()} == texts


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "lesson_id string, n int")
    path = str(tmp_path / "t")
    sinks.write_partitions(rows, path, "lesson_id")
    sinks.write_partitions(spark.createDataFrame([("b", 5)], rows.schema), path, "lesson_id")
    assert sorted((r["lesson_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 5)]
    sinks.write_whole(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    for _ in range(2):
        sinks.mirror_measurements(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 4
    (tmp_path / "r").mkdir()
    receipt = {"schema": "friction-v1", "session_id": "s", "ended_at": "2026-10-01T00:00:00Z", "reason": "x", "cwd": "/", "rules_consulted": [], "denials": [], "unresolved_errors": [{"kind": "k", "signature": "z"}], "ended_mid_task": False}
    for name, change in (("a", {}), ("b", {"schema": "v0"}), ("c", {"ended_at": "?"}), ("d", {"reason": None})):
        (tmp_path / "r" / f"{name}.json").write_text(json.dumps(receipt | change, indent=1))
    got = sinks.receipts(spark, str(tmp_path / "r")).collect()
    assert [r["session_id"] for r in got] == ["s"] and got[0]["unresolved_errors"][0]["signature"] == "z"
    listed = sinks.manifest(spark, str(tmp_path / "r")).collect()
    assert len(listed) == 4 and all(len(r["sha256"]) == 64 and r["bytes"] > 0 for r in listed)


def test_a_failing_detector_does_not_stop_the_others(spark, tmp_path):
    healthy = D.DETECTORS["D-01"]
    lacking = D.Detector("X-1", 1, "reads a column that is not there", lambda span, observation: observation.select("nothing"))
    twice = D.Detector("X-2", 1, "repeats a key", lambda span, observation: observation.select(F.lit("k").alias("key"), "obs_id", "session_id", "ts_utc"), None, ("key", "obs_id"))
    raising = D.Detector("X-3", 1, "fails when it runs", lambda span, observation: observation.select(F.raise_error(F.lit("no")).cast("string").alias("key"), "session_id", "ts_utc"))
    older = D.Detector("X-4", 1, "is older than what ran", healthy.hits)
    rows = obs(spark, missing("a"), missing("b"))
    path = str(tmp_path / "clusters")
    done = sinks.run_detectors(spark, [lacking, healthy, twice, raising, older], SPAN, lambda d: {"observation": rows}, path, {"X-4": 2})
    assert {r["detector_id"]: (r["status"], r["clusters"]) for r in done.collect()} == {
        "X-1": ("error", None), "D-01": ("ok", 1), "X-2": ("error", None), "X-3": ("error", None), "X-4": ("refused", None),
    }
    assert [r["detector_id"] for r in spark.read.parquet(path).collect()] == ["D-01"]


def test_known_rows_count_what_a_detector_should(spark):
    """The detectors' self-test: seeded rows with their expected clusters."""
    rows = obs(spark, *[missing(s, "zed") for s in "abc"], missing("a", "one"), *[{"kind": "run_failed", "command": "x", "session_id": "q"}] * 3)
    expected = {"D-01": {"command-not-found:zed": (3, 3)}, "D-03": {"x": (1, 3)}, "D-05": {}}
    for name, want in expected.items():
        got = {r["key"]: (r["sessions"], r["events"]) for r in D.DETECTORS[name].run("cluster", SPAN, observation=rows).collect()}
        assert got == want


def test_lanes_of_few_sessions(spark):
    rows = [("D-01", "a", "open", None, False, 1), ("D-12", "b", "open", None, False, 1), ("D-12", "c", "open", None, False, 2), ("D-01", "d", "open", "/r", False, 1), ("D-01", "e", "dismissed", "/r", True, 1), ("D-09", "f", "open", None, False, 3)]
    df = spark.createDataFrame(rows, "detector_id string, key string, state string, covered_by string, rule_stale boolean, sessions long")
    got = {r["key"]: (r["candidate"], r["covered"], r["escalation"], r["degraded"]) for r in V.lanes(df, ("D-09",)).collect()}
    assert got == {"a": (True, False, False, False), "b": (False,) * 4, "c": (True, False, False, False), "d": (False, True, True, False), "e": (False, True, False, True), "f": (False,) * 4}


@pytest.mark.parametrize(("made", "taken", "want"), [("2026-10-01T00:00:00Z", "2026-09-30T23:00:00+00:00", "current"), ("2026-10-01T00:00:00", "2026-10-01T00:00:00Z", "malformed"), (None, "2026-10-01T00:00:00Z", "malformed")])
def test_freshness(spark, made, taken, want):
    df = spark.createDataFrame([(made, taken, datetime(2026, 10, 1, 1))], "a string, b string, now timestamp")
    assert df.select(V.freshness(F.col("a"), F.col("b"), F.col("now")).alias("x")).first()["x"] == want
