"""Fences, SQL detectors, publications, as-of lookups, prompts, rule reports, assessments and follow-up over literal rows."""

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snagline.functions import fences
from snagline.operators import detectors as D
from snagline.operators import reports as R
from snagline.operators import review as V
from snagline.operators.asof import as_of
from snagline.operators.sql_detectors import ContractError, SqlDetector, catalogue
from snagline.sources import files
from snagline.sources.publication import Publication
from tests.test_detectors import SPAN, at, missing, obs


def day(n, **more):
    return datetime(2026, 1, 1) + timedelta(days=n, **more)


# --- fences -------------------------------------------------------------------------------------


def by_pattern(text, names):
    found = "|".join(re.escape(n) for n in sorted({n for n in names if n}, key=len, reverse=True))
    return re.sub(found, fences.MARKER, text, flags=re.I) if found else text


def test_fences_like_one_alternation_of_literals():
    rng = random.Random(1)
    letters = "abAB .éÉsſkKıiİß"
    for _ in range(3000):
        names = ["".join(rng.choice(letters) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(6))]
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        automaton = fences.automaton_of(names)
        assert (text if automaton is None else fences.without(text, automaton)) == by_pattern(text, names), (text, names)


def test_thousands_of_fences_in_one_pass(spark):
    names = [f"client-{i}" for i in range(5000)]
    df = spark.createDataFrame([("see CLIENT-4999 and client-49, not client-", None), (None, None), ("", "x")], "t string, fenced string").repartition(2)
    got = {r["t"]: r["x"] for r in df.select("t", fences.fenced(names)(F.col("t")).alias("x")).collect()}
    assert got == {"see CLIENT-4999 and client-49, not client-": f"see {fences.MARKER} and {fences.MARKER}, not client-", None: None, "": ""}
    assert df.select(fences.fenced([])(F.col("t")).alias("x")).count() == 3
    with pytest.raises(ValueError):
        fences.fenced(["x" * (fences.MOST_CHARS + 1)])


# --- SQL detectors ------------------------------------------------------------------------------

GOOD = "SELECT program AS key, count(DISTINCT session_id) AS sessions, count(*) AS events, min(ts_utc) AS first_seen, max(ts_utc) AS last_seen FROM observation WHERE ts_utc >= CAST(:start AS TIMESTAMP) GROUP BY program"


def test_a_statement_runs_like_a_detector(spark):
    rows = obs(spark, missing("a"), missing("b"), missing("c", "{x}", ts_utc=at(-9)), missing("d", "{y}"))
    d = SqlDetector("D-77", 2, "failures", f"  {GOOD};  ", session="with s as (select * from observation) SELECT program AS key, session_id FROM s WHERE program = '{y}'")
    got = {r["key"]: (r["sessions"], r["events"], r["first_seen"]) for r in d.run("cluster", SPAN, observation=rows).collect()}
    assert got == {"orion": (2, 2, "2026-10-02 00:00:00"), "{y}": (1, 1, "2026-10-02 00:03:00")}
    assert [tuple(r) for r in d.run("session", SPAN, observation=rows).collect()] == [("{y}", "d")]
    with pytest.raises(ValueError, match="week-hit"):
        d.run("week", SPAN, observation=rows)
    again = lambda **change: SqlDetector(**({"id": "D-77", "version": 2, "description": "reworded", "cluster": f"  {GOOD};  ".replace(" FROM", "\n  FROM")} | change)).fingerprint()
    assert d.fingerprint() == again() != again(version=3) and again(cluster=GOOD + " LIMIT 1") != again()
    assert d.fingerprint("weekly") is None and d.fingerprint() != d.fingerprint("session")


@pytest.mark.parametrize(("change", "says"), [
    ({"id": "X-1"}, "D-01"), ({"id": "D-1"}, "D-01"), ({"version": 0}, "versions"), ({"description": " "}, "empty"), ({"cluster": " ; "}, "empty"),
    ({"cluster": "DROP TABLE observation"}, "single SELECT"), ({"cluster": "SELECT 1; SELECT 2"}, "one statement"), ({"cluster": "INSERT INTO x SELECT 1"}, "single SELECT"),
    ({"week": "DELETE FROM observation"}, "week-hit"), ({"weekly": ""}, "weekly-hit"), ({"session": "SELECT 1; DROP TABLE x"}, "session-hit"), ({"cluster": "SELECTED"}, "single SELECT"),
])
def test_what_is_no_detector(change, says):
    with pytest.raises(ValueError, match=says):
        SqlDetector(**({"id": "D-77", "version": 1, "description": "x", "cluster": GOOD} | change))


def test_statements_that_write_or_break_the_contract_are_never_run(spark, tmp_path):
    rows = obs(spark, missing("a"))
    spark.sql("CREATE TABLE kept (key string) USING parquet")
    try:
        for sql in ("WITH x AS (SELECT 1) INSERT INTO kept SELECT 'a'", "SELECT 1) x, (SELECT 2", "WITH x AS (SELECT 1 AS key) DELETE FROM kept", "SELECT * FROM nowhere"):
            with pytest.raises(Exception):
                SqlDetector("D-77", 1, "x", sql).run("cluster", SPAN, observation=rows)
        assert spark.table("kept").count() == 0
    finally:
        spark.sql("DROP TABLE kept")
    for sql in ("SELECT 1 AS key", GOOD.replace("program AS key", "1 AS key").replace("GROUP BY program", ""), GOOD.replace("count(*) AS events", "1.5 AS events"), GOOD.replace("AS key", "AS key, 1 AS more")):
        with pytest.raises(ContractError):
            SqlDetector("D-77", 1, "x", sql).planned("cluster", SPAN, observation=rows)


def test_an_id_has_one_version():
    a, b = SqlDetector("D-77", 1, "x", GOOD), SqlDetector("D-78", 1, "x", GOOD)
    assert list(catalogue(b, a)) == ["D-78", "D-77"]
    with pytest.raises(ValueError, match="twice"):
        catalogue(a, b, SqlDetector("D-77", 2, "x", GOOD))


# --- publications -------------------------------------------------------------------------------


def test_tables_are_published_together(spark, tmp_path, monkeypatch):
    p = Publication(spark, f"file://{tmp_path}/out")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    got = lambda name: sorted(r["n"] for r in p.read(name).collect())
    assert p.manifest()["version"] == 0 and p.sweep() == []
    with pytest.raises(KeyError):
        p.read("events")
    p.publish({"events": rows(1, 2), "usage": rows(7)}, {"f": 10})
    held = p.manifest()

    def dies(old):
        raise RuntimeError("killed")

    # a run that dies between two tables leaves the state of before, whole
    with pytest.raises(RuntimeError, match="killed"):
        p.publish({"events": rows(3), "usage": dies}, {"f": 20})
    assert p.manifest() == held and got("events") == [1, 2] and got("usage") == [7]
    # the same while the manifest is written
    with monkeypatch.context() as m:
        m.setattr(Publication, "_swap", lambda *a: dies(None))
        with pytest.raises(RuntimeError, match="killed"):
            p.publish({"events": rows(4), "usage": rows(8)}, {"f": 30})
    assert p.manifest() == held and got("events") == [1, 2]
    made = p.publish({"events": lambda old: old.unionAll(rows(5))}, {"f": 40})
    assert got("events") == [1, 2, 5] and got("usage") == [7] and (made["version"], made["cursor"]) == (2, {"f": 40})
    # who follows an older manifest still reads its tables
    assert sorted(r["n"] for r in p.read("events", held).collect()) == [1, 2]
    assert len(p.sweep()) == 4 and got("events") == [1, 2, 5] and got("usage") == [7]


def test_only_one_run_publishes(spark, tmp_path):
    p = Publication(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "n int")

    def meanwhile(old):
        Publication(spark, str(tmp_path)).publish({"t": one})
        return one

    with pytest.raises(RuntimeError, match="no longer"):
        p.publish({"u": meanwhile})
    assert list(p.manifest()["tables"]) == ["t"] and json.loads((tmp_path / "current.json").read_text())["version"] == 1


# --- as-of and lessons --------------------------------------------------------------------------


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_like_a_search(spark, forward):
    rng = random.Random(3)
    asks = [(rng.choice("abc"), rng.randrange(20) if rng.random() < 0.9 else None, i) for i in range(60)]
    points = [(rng.choice("ab"), rng.randrange(20) if rng.random() < 0.9 else None, i) for i in range(40)]
    a = spark.createDataFrame(asks, "k string, t int, ask int").repartition(3)
    b = spark.createDataFrame(points, "k string, t int, v int").repartition(3)
    got = {r["ask"]: r["p"] and (r["p"]["t"], r["p"]["v"]) for r in as_of(a, b, ["k"], "t", "p", forward).collect()}
    for k, t, ask in asks:
        fit = [(pt, v) for pk, pt, v in points if pk == k and None not in (t, pt) and (pt >= t if forward else pt <= t)]
        time = (min if forward else max)((x for x, _ in fit), default=None)
        assert got[ask] == (max(x for x in fit if x[0] == time) if fit else None)


def test_escalations(spark):
    lessons = [
        ("base", "applied:memory", day(10), 99, 99), ("evidence", "applied:skill", day(0), 4, 9), ("halved", "applied:skill", day(0), 4, 10), ("strongest", "applied:environment", day(0), 4, 4),
        ("draft", "draft", day(0), 4, 4), ("young", "applied:hook", day(40), 4, 4), ("unmeasured", "applied:hook", day(0), 4, 4), ("odd", "applied:nowhere", day(0), 1, 1), ("undated", "applied:hook", None, 1, 1),
    ]
    points = [("base", day(3), 1, 1), ("base", day(10), 6, 6), ("base", day(11), 50, 50), ("base", day(31, hours=1), 3, 4), ("base", day(33), 0, 0)]
    points += [(x, day(21), 2, 5) for x in ("evidence", "halved", "strongest", "draft", "young", "odd")] + [("unmeasured", day(20), 9, 9), ("evidence", day(49), 0, 0)]
    got = R.escalations(
        spark.createDataFrame(lessons, "lesson_id string, state string, applied_at timestamp, sessions long, events long"),
        spark.createDataFrame(points, "lesson_id string, measured_at timestamp, sessions long, events long"), "2026-02-15",
    )
    assert sorted((r["lesson_id"], r["next_layer"], r["base_at"], r["sessions_before"], r["events_before"], r["measured_at"], r["events"]) for r in got.collect()) == [
        ("base", "agents_md", day(10), 6, 6, day(31, hours=1), 4), ("evidence", "wrapper", None, 4, 9, day(21), 5),
    ]


# --- prompts ------------------------------------------------------------------------------------


def fits(rows, cluster_budget, total_budget):
    """Rows by prompt as a person would take them: own texts, then one further row of each cluster in turn."""
    out = []
    for prompt in {r[0] for r in rows}:
        total, used = 0, {}
        mine = sorted((r for r in rows if r[0] == prompt), key=lambda r: (r[2], r[1]))
        for _, c, position, size in mine:
            if (position == 0 or c in used) and used.get(c, 0) + size <= cluster_budget and total + size <= total_budget:
                total += size
                used[c] = used.get(c, 0) + size
                out.append((prompt, c, position, size))
    return sorted(out)


def test_a_large_row_is_left_out_and_the_next_one_tried(spark):
    rows = [(1, "a", 0, 6), (1, "a", 1, 50), (1, "a", 2, 6), (1, "b", 0, 30), (1, "b", 1, 1), (1, "c", 0, 2), (1, "c", 1, 9), (1, "c", 2, 1)]
    df = spark.createDataFrame(rows, "prompt int, cluster string, position int, bytes int")
    got = R.packed(df, "prompt", "cluster", "position", "bytes", 20, 24).orderBy("taken").collect()
    assert [(r["cluster"], r["position"], r["taken"]) for r in got] == [("a", 0, 1), ("c", 0, 2), ("c", 1, 3), ("a", 2, 4), ("c", 2, 5)]


def test_prompts_of_all_kinds(spark):
    rng = random.Random(5)
    rows = [(p, c, k, rng.randrange(1, 30)) for p in range(12) for c in "abcd" for k in range(rng.randrange(7))]
    df = spark.createDataFrame(rows, "p int, c string, k int, b int").repartition(4)
    for own, total in ((25, 60), (60, 60), (10, 1000), (0, 0)):
        got = sorted((r["p"], r["c"], r["k"], r["b"]) for r in R.packed(df, "p", "c", "k", "b", own, total).collect())
        assert got == fits(rows, own, total)


# --- rules --------------------------------------------------------------------------------------


def test_rule_report(spark):
    now = day(200)
    docs = [
        ("/live", "l", "A", 0, day(0), None), ("/copy", "l", "A", 1, day(0), day(195)), ("/never", "l", "B", 0, day(0), None), ("/new", "l", "C", 0, day(150), None), ("/gone", "l", "D", 1, day(0), None),
        ("/quiet", "l", "E", 0, day(0), day(50)), ("/busy", "l", "F", 0, day(0), None), ("/odd", "l", "G", 0, day(0), None), ("/seen", "l", "H", 0, day(0), day(1)),
    ]
    clusters = [("/quiet", str(day(100)), "up"), ("/quiet", str(day(90)), "down"), ("/busy", str(day(199)), "flat"), ("/busy", str(day(1)), "up"), ("/odd", "no time", "up"), (None, str(day(199)), "up"), ("/live", str(day(1)), "up")]
    reads = [("/seen ", day(199)), ("/seen", day(150)), ("/nothing", day(199))]
    got = {r["path"]: r for r in R.rule_report(
        spark.createDataFrame(docs, "path string, layer string, sha string, stale int, indexed_at timestamp, last_read timestamp"),
        spark.createDataFrame(clusters, "covered_by string, last_seen string, direction string"), spark.createDataFrame(reads, "path string, ts_utc timestamp"), str(now),
    ).collect()}
    assert set(got) == {"/live", "/never", "/new", "/quiet", "/busy", "/odd", "/seen"}
    facts = {p: (r["covers"], r["unread"], r["unread_days"], r["deletion_candidate"], r["retire"]) for p, r in got.items()}
    assert facts == {
        "/live": (1, False, 5, False, False),  # read by a stale copy of the same content
        "/never": (0, True, 200, True, True), "/new": (0, True, 50, False, False), "/quiet": (2, True, 150, False, True),  # what it covers was quiet for 100 days
        "/busy": (2, True, 200, False, False), "/odd": (1, True, 200, False, False), "/seen": (0, False, 1, False, False),
    }
    assert got["/quiet"]["last_occurrence"] == day(100) and got["/quiet"]["up"] == 1 and got["/odd"]["last_occurrence"] is None


def test_rules_that_are_enforced(spark, tmp_path):
    on = {"enabled": True, "action": "deny", "check": "command_regex", "match": {"regex": "^rm"}}
    rule = lambda i, **change: {"id": i, "pack": "p"} | on | change
    never = [rule("on"), rule("off", enabled=False), rule("hint", action="additional_context"), rule("content", check="content_regex"), rule("unsaid", enabled=None), rule("other", pack="q"), rule("free", pack="r")]
    always = [{"id": "ok", "pack": "p", "check": "command_regex", "match": {"regex": "^rm -i"}}, {"id": "engine", "pack": "q", "check": "predicate"}]
    (tmp_path / "c.json").write_text(json.dumps({"never": never, "always": always}))
    rules = files.enforced(files.catalogue(spark, str(tmp_path / "c.json")))
    assert sorted((r["verdict"], r["pack"], r["id"]) for r in rules.collect()) == [("always", "p", "ok"), ("never", "p", "on"), ("never", "r", "free")]
    ran = [{"kind": "run_succeeded", "command": c} for c in ("rm x", "rm -i x", "ls")]
    gaps = D.gate_gaps(obs(spark, *ran), rules)
    assert sorted((r["pack"], r["id"], r["obs_id"]) for r in gaps.collect()) == [("p", "on", 0), ("r", "free", 0), ("r", "free", 1)]


# --- autonomy -----------------------------------------------------------------------------------


def assess(spark, family, text, *rows, facts=(), **state):
    """The assessment of a reply at ordinal 5 of an episode that may fix the bug."""
    known = [("pending_action", "fix:the bug", "known", 0, None), *facts]
    e = {"authority": "authorized", "context": "known", "lifecycle": "active", "advice_only": False} | state
    episode = spark.createDataFrame([(1, 0, "fix:the bug", 0, 9, e["lifecycle"], e["authority"], e["context"], e["advice_only"], known)], (
        "session_key long, episode int, action_key string, start_ordinal long, end_ordinal long, lifecycle string, authority string, context string, advice_only boolean,"
        " assertions array<struct<kind:string,value:string,strength:string,ordinal:bigint,related:bigint>>"
    ))
    turns = [(1, 5, "assistant_text", text), *[(1, *r) for r in rows]]
    interaction = spark.createDataFrame(turns, "session_key long, ordinal long, origin string, text string")
    return {r["family"]: r for r in V.assessed(V.shortlist(episode, interaction), episode, interaction).collect()}[family]


BLOCKED_REPLY = "I cannot fix the bug under current access."
CHECK = (3, "tool_result", "Capability check: fix the bug available under current access. exit code: 0")


def test_a_block_needs_a_matching_check(spark):
    assert assess(spark, "D-16", BLOCKED_REPLY, (3, "tool_result", "all checks passed"))["missing"] == ["capability check"]
    found = assess(spark, "D-16", BLOCKED_REPLY, CHECK)
    assert found["disposition"] == "supported" and ("capability_check", 3) in [tuple(r) for r in found["supporting"]]
    for row in ((3, "assistant_text", CHECK[2]), (3, "tool_result", CHECK[2].replace("0", "1")), (3, "tool_result", CHECK[2].replace("the bug", "the build")), (12, *CHECK[1:])):
        assert assess(spark, "D-16", BLOCKED_REPLY, row)["disposition"] == "needs_review", row


@pytest.mark.parametrize("row", [
    (2, "tool_result", "it has finished"), (2, "human_request", "I already fixed it; done and tested, completed"), (7, "assistant_text", "I fixed that"), (2, "harness", "new credentials are set"),
    (2, "tool_result", "needs a payment"), (2, "human_request", "external approval first"),
])
def test_turns_that_speak_against_a_finding(spark, row):
    found = assess(spark, "D-16", BLOCKED_REPLY, CHECK, row)
    assert found["disposition"] == "dismissed" and row[0] in [r["ordinal"] for r in found["disconfirming"]]


def test_turns_that_do_not(spark):
    for row in ((2, "harness", "it has finished"), (2, "assistant_text", "needs a payment"), (20, "tool_result", "it has finished")):
        assert assess(spark, "D-16", BLOCKED_REPLY, CHECK, row)["disposition"] == "supported", row


def test_abandonment_needs_a_repeated_approval(spark):
    asked = [("status_exchange", "status?", "known", 2, None)]
    assert assess(spark, "D-15", "I am abandoning fix the bug.", facts=asked)["missing"] == ["repeated approval"]
    assert assess(spark, "D-15", "I am abandoning fix the bug. Approve it again.", facts=asked)["disposition"] == "supported"
    assert assess(spark, "D-15", "I am abandoning fix the bug. Approve it again.")["missing"] == ["status exchange"]


def test_offers_need_a_completed_reply(spark):
    done = [("terminal_reply", "x", "known", 5, None)]
    text = "I can fix the bug if you approve."
    assert assess(spark, "D-12", text, facts=done)["disposition"] == "supported"
    assert assess(spark, "D-12", text)["missing"] == ["completed reply"]
    assert assess(spark, "D-13", text, facts=done)["missing"] == ["settled approval"]
    assert assess(spark, "D-13", text, facts=[*done, ("explicit_approval", "fix:the bug", "known", 1, None)])["disposition"] == "supported"
    defect = "I found a defect. It blocks fix the bug. I can fix the bug?"
    assert assess(spark, "D-14", defect, facts=done)["disposition"] == "supported"
    assert assess(spark, "D-12", text, facts=done, authority="unknown")["missing"] == ["authority"]
    assert assess(spark, "D-12", text, facts=done, advice_only=True, lifecycle="superseded")["missing"] == ["active objective"]


# --- follow-up ----------------------------------------------------------------------------------


def test_follow_up_counts_without_comparing_all(spark):
    rng = random.Random(6)
    episodes = []
    for _ in range(400):
        begun = day(rng.randrange(12), hours=rng.choice([0, 0, 5, 12, 23]))
        episodes.append((rng.randrange(40), begun if rng.random() < 0.97 else None, rng.choice(["authorized"] * 3 + ["withheld", "unknown"]), rng.choice(["known", "known", "unknown"]), rng.random() < 0.2, rng.choice(["completed", "interrupted", None])))
    folders = [(k, f) for k in range(40) for f in rng.sample(["/w/a", "/w/a/x", "/w/ab", "/w/b/", "/v", ""], rng.randrange(1, 3))]
    covered = [(k,) for k in range(40) if k % 3]
    lessons = [(f"l{i}", day(rng.randrange(12), hours=rng.choice([0, 5, 7])), day(rng.randrange(14), hours=rng.choice([0, 12, 13])), rng.choice([None, None, ["/w/a"], ["/w"], ["/"], ["/w/b", "/v/"], []])) for i in range(40)]
    lessons += [("undated", None, day(5), None)]
    episode = spark.createDataFrame(episodes, "session_key long, started_at timestamp, authority string, context string, advice_only boolean, terminal string")
    folder = spark.createDataFrame(folders, "session_key long, folder string")
    lesson = spark.createDataFrame(lessons, "lesson_id string, applied_at timestamp, until timestamp, folders array<string>")
    df = V.follow_up(lesson, episode, spark.createDataFrame(covered, "session_key long"), folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {r["lesson_id"]: tuple(r)[1:] for r in df.collect()}
    own = {}
    for k, f in folders:
        own.setdefault(k, []).append(f)
    below = lambda f, roots: bool(f) and any(r == "/" or (f.rstrip("/") + "/").startswith(r.rstrip("/") + "/") for r in roots)
    for name, a, b, roots in lessons:
        hit = [e for e in episodes if e[1] and a and a <= e[1] < b and (roots is None or all(below(f, roots) for f in own[e[0]]))]
        counts = [e for e in hit if not e[4] and e[2] != "withheld"]
        plain = [e for e in counts if e[2] == "authorized" and e[3] == "known"]
        done = [sum(e[5] == x and e[0] % 3 > 0 for e in plain) for x in ("completed", "interrupted")]
        assert got[name] == (len({e[0] for e in hit}), len(plain), len(counts) - len(plain), *done, len(plain) - sum(done)), name
