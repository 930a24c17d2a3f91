"""Detectors over literal rows with known counts."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snagline.operators import detectors as D

SPAN = D.Span("2026-10-01 00:00:00", "2026-10-31 00:00:00", 30)
SCHEMA = (
    "obs_id long, session_id string, ts_utc timestamp, kind string, program string, command string, signature string,"
    " sig_hash string, tool string, path string, excerpt string, host string"
)


def at(day, minute=0):
    return datetime(2026, 10, 1) + timedelta(days=day, minutes=minute)


def obs(spark, *rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    full = []
    for i, r in enumerate(rows):
        r = {"obs_id": i, "session_id": "s1", "ts_utc": at(1, i)} | r
        full.append(tuple(r.get(n) for n in names))
    return spark.createDataFrame(full, SCHEMA)


def found(df):
    return {r["key"]: (r["sessions"], r["events"]) for r in df.collect()}


def missing(session, program="orion", **more):
    return {"kind": "run_failed", "session_id": session, "program": program, "signature": f"{program}: Command Not Found", "sig_hash": "x"} | more


def test_missing_binary_needs_two_sessions(spark):
    rows = obs(spark, missing("a"), missing("a"), missing("b"), missing("a", "lyra"), missing("c", ts_utc=at(-5)), missing("b", "  "))
    d = D.DETECTORS["D-01"]
    assert found(d.run("cluster", SPAN, observation=rows)) == {"command-not-found:orion": (2, 3)}
    assert sorted(map(tuple, d.run("session", SPAN, observation=rows).collect())) == [("command-not-found:orion", "a"), ("command-not-found:orion", "b")]


def test_weeks_qualify_over_the_whole_window(spark):
    rows = obs(spark, missing("a", ts_utc=at(1)), missing("b", ts_utc=at(15)))
    weekly = D.DETECTORS["D-01"].run("weekly", SPAN, observation=rows).collect()
    assert sorted((r["week"], r["sessions"], r["events"]) for r in weekly) == [("2026-W40", 1, 1), ("2026-W42", 1, 1)]


def test_retry_loop_ends_with_success(spark):
    fail = {"kind": "run_failed", "command": "make test"}
    good = {"kind": "run_succeeded", "command": "make test"}
    open_loop = [fail] * 3
    closed = [fail | {"session_id": "s2"}] * 3 + [good | {"session_id": "s2"}]
    reopened = [fail | {"session_id": "s3"}] * 2 + [good | {"session_id": "s3"}] + [fail | {"session_id": "s3"}] * 2
    got = found(D.DETECTORS["D-03"].run("cluster", SPAN, observation=obs(spark, *open_loop, *closed, *reopened)))
    assert got == {"make test": (1, 3)}


def test_retry_loop_breaks_time_ties_by_id(spark):
    same = {"ts_utc": at(2), "command": "x"}
    rows = obs(spark, *[same | {"kind": "run_failed"}] * 3, same | {"kind": "run_succeeded"})
    assert found(D.DETECTORS["D-03"].run("cluster", SPAN, observation=rows)) == {}
    rows = obs(spark, same | {"kind": "run_succeeded"}, *[same | {"kind": "run_failed"}] * 3)
    assert found(D.DETECTORS["D-03"].run("cluster", SPAN, observation=rows)) == {"x": (1, 3)}


def test_corrections_must_follow_at_once(spark):
    rows = obs(
        spark,
        {"kind": "tool_rejected", "tool": "Edit"},
        {"kind": "user_turn_after_correction", "excerpt": " edit the copy "},
        {"kind": "tool_rejected", "tool": "Edit"},
        {"kind": "file_read"},
        {"kind": "user_turn_after_correction", "excerpt": "late"},
        {"kind": "interrupt"},
        {"kind": "user_turn_after_correction", "excerpt": "dry run first"},
    )
    assert found(D.DETECTORS["D-05"].run("cluster", SPAN, observation=rows)) == {"tool-rejected:Edit:edit the copy": (1, 1)}
    assert found(D.DETECTORS["D-06"].run("cluster", SPAN, observation=rows)) == {"interrupt:dry run first": (1, 1)}


def test_rediscovery_needs_days_for_files_and_no_edit(spark):
    read = lambda s, p, d: {"kind": "file_read", "session_id": s, "path": p, "ts_utc": at(d)}
    rows = obs(
        spark, read("a", "/r/x", 1), read("b", "/r/x", 2), read("a", "/r/y", 1), read("b", "/r/y", 1), read("a", "/r/z", 1), read("b", "/r/z", 2),
        {"kind": "file_edit", "path": "/r/z"}, {"kind": "run", "command": "rg -n x"}, {"kind": "run", "command": "rg -n x", "session_id": "b"},
    )
    got = found(D.DETECTORS["D-07"].run("cluster", SPAN, observation=rows))
    assert got == {"rediscovery:file:/r/x": (2, 2), "rediscovery:command:rg -n x": (2, 2)}


def test_rules_that_name_what_is_gone(spark):
    rows = obs(spark, missing("a"), missing("b"), {"kind": "run", "host": "oldhost", "ts_utc": at(-9)}, {"kind": "run", "host": "new"})
    docs = spark.createDataFrame(
        [("/r/a", "s", "Use Orion, then orionx", 0, at(0)), ("/r/b", "t", "orionx only", 0, at(0)), ("/r/c", "u", "ssh oldhost", 0, at(0)),
         ("/r/d", "v", "orion", 1, at(0))],
        "path string, sha string, text string, stale int, indexed_at timestamp",
    )
    got = found(D.DETECTORS["D-08"].run("cluster", SPAN, observation=rows, rule_doc=docs))
    assert got == {"stale-rule:binary:orion:/r/a": (2, 2), "stale-rule:host:oldhost:/r/c": (0, 0)}


def test_unread_rules_go_by_content(spark):
    docs = spark.createDataFrame(
        [("/r/a", "s1", 0, None), ("/r/copy", "s1", 0, None), ("/r/b", "s2", 0, None), ("/r/c", "s3", 0, at(3)), ("/r/d", "s4", 1, None)],
        "path string, sha string, stale int, last_read timestamp",
    ).selectExpr("*", "timestamp'2026-10-01' as indexed_at")
    rows = obs(spark, {"kind": "file_read", "path": "/r/copy"})
    assert set(found(D.unread_rules(SPAN, rows, docs))) == {"unread-rule-doc:/r/b"}


def test_gate_gap_honours_the_packs_allow_rules(spark):
    catalog = spark.createDataFrame(
        [("never", "git", "force", r"^git\s+push\s+--force\b"), ("always", "git", "ok", "--dry-run"), ("never", "rm", "all", "^rm ")],
        "verdict string, pack string, id string, pattern string",
    )
    run = lambda c, k="run_failed", s="a": {"kind": k, "command": c, "session_id": s}
    rows = obs(
        spark, run("git push --force"), run("git push --force", "run_succeeded", "b"), run("git push --force --dry-run"),
        run("git push --force", "run"), run("git push --forced"), run("ls"),
    )
    assert found(D.DETECTORS["D-10"].run("cluster", SPAN, observation=rows, catalog=catalog)) == {"gate-gap:git:force": (2, 2)}


@pytest.mark.parametrize("n", [1096, 697, 632])
def test_known_counts(spark, n):
    rows = spark.range(n).selectExpr(
        "id as obs_id", "concat('s', id) as session_id", "timestamp'2026-10-02' as ts_utc", "'run_failed' as kind", "'zed' as program",
        "'zed: command not found' as signature", "'h' as sig_hash",
    )
    assert found(D.DETECTORS["D-01"].run("cluster", SPAN, observation=rows)) == {"command-not-found:zed": (n, n)}


def test_adjacency_and_retry_plans_have_no_cartesian(spark):
    rows = obs(spark, {"kind": "run"})
    for name in ("D-03", "D-05"):
        plan = D.DETECTORS[name].run("cluster", SPAN, observation=rows)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Window" in plan


def test_contract_and_registry(spark):
    rows = spark.createDataFrame([("a", 1, 1, "t"), ("a", 1, 1, "t"), ("b", -1, 1, "t"), ("c", 1, 1, "t")], "key string, sessions int, events int, last_seen string")
    assert {r["key"] for r in D.contract_violations(rows).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        D.register(D.DETECTORS["D-01"])
    with pytest.raises(ValueError):
        D.DETECTORS["D-01"].run("daily", SPAN, observation=rows)


def test_one_pass_gives_what_each_detector_gives(spark):
    rows = obs(
        spark, missing("a"), missing("b"), missing("a", "lyra"), *[{"kind": "run_failed", "command": " make", "session_id": "c", "signature": "x", "sig_hash": "y"}] * 3,
        {"kind": "tool_rejected", "tool": "Edit", "session_id": "d"}, {"kind": "user_turn_after_correction", "excerpt": "no", "session_id": "d"},
        {"kind": "file_read", "path": "/r", "ts_utc": at(1)}, {"kind": "file_read", "path": "/r", "ts_utc": at(2), "session_id": "b"},
        {"kind": "file_read", "path": "/w", "ts_utc": at(1)}, {"kind": "file_read", "path": "/w", "ts_utc": at(2), "session_id": "b"}, {"kind": "file_edit", "path": " /w"},
        {"kind": "run", "command": "ls", "ts_utc": at(20)}, {"kind": "run", "command": "ls", "session_id": "e", "ts_utc": at(20)},
    )
    spans = [SPAN, D.Span("2026-10-15 00:00:00", "2026-10-31 00:00:00", 16)]
    both = D.clusters_of(D.daily_cells(D.session_hits(rows, spans)))
    for i, span in enumerate(spans):
        for name in ("D-01", "D-02", "D-03", "D-05", "D-07"):
            want = found(D.DETECTORS[name].run("cluster", span, observation=rows))
            assert found(both.where((F.col("span") == i) & (F.col("detector_id") == name))) == want, (name, i)


def test_phrases_match_by_stems_and_without_marks(spark):
    docs = spark.createDataFrame([("a", "Ask the builders first"), ("b", "un café noir"), ("c", "run the test suites now"), ("d", "suites of the test"), ("e", None)], "path string, text string")
    phrases = spark.createDataFrame([("builder",), ("cafe",), ("test suite",), ("--",), ("the the",)], "phrase string")
    got = {tuple(r) for r in D.phrase_matches(docs, phrases).collect()}
    assert got == {("a", "builder"), ("b", "cafe"), ("c", "test suite")}


def test_weeks_across_hosts_end_before_the_last_day(spark):
    bucket = spark.createDataFrame(
        [("h1", "v1", date(2026, 10, 5), "x", 2), ("h2", "v1", date(2026, 10, 31), "x", 1), ("h3", "v0", date(2026, 10, 5), "x", 9)],
        "host string, scheme string, day date, sig_hash string, events long",
    ).selectExpr("*", "cast(day as timestamp) as first_seen", "cast(day as timestamp) as last_seen")
    report = spark.createDataFrame([("h1", "v1"), ("h2", "v1"), ("h3", "v1")], "host string, scheme string")
    assert found(D.cross_host(SPAN, bucket, report)) == {"cross-host-signature:x": (2, 3)}
    assert D.cross_host(SPAN, bucket, report, True).count() == 0
    later = D.Span("2026-10-01 00:00:00", "2026-10-31 10:00:00", 30)
    assert D.cross_host(later, bucket, report, True).count() == 2


def test_large_catalogues_are_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "CATALOGUE_ROWS", 1)
    catalog = spark.createDataFrame([("never", "p", "a", "x"), ("never", "p", "b", "y")], "verdict string, pack string, id string, pattern string")
    with pytest.raises(ValueError):
        D.gate_gaps(obs(spark, {"kind": "run"}), catalog)
