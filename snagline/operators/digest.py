"""The weekly digest: verdicts, waste and trends of the clusters of two windows in one order; and the detectors' self-test."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.operators.detectors import DETECTORS, Span, clusters_of, counted_cells
from snagline.operators.reports import digest, equal_split_waste, trends
from snagline.operators.review import digest_order, numbered

KEYS = ["detector_id", "key"]


def weekly_digest(cells: DataFrame, weekly: DataFrame, usage: DataFrame, dismissed: DataFrame, limit: int, minimum: int = 6) -> DataFrame:
    """The first findings of a digest.

    cells are daily cells (detectors.daily_cells) with the present window as
    span 0 and the one before as span 1; their aggregation is one exchange that
    all parts of the digest share.  weekly has the counts by week that trends are
    taken from, usage the cost of sessions, dismissed the clusters that are not
    to be shown.

    Returns detector_id, key, verdict, trend, sessions, sessions_before, events, events_before, waste_usd, tokens, place.
    """
    found = clusters_of(cells).select("span", *KEYS, "sessions", "events")
    verdicts = digest(found.where("span = 0"), found.where("span = 1"), dismissed)
    hits = counted_cells(cells.where("span = 0")).select(*KEYS, "session_id").distinct()
    waste = equal_split_waste(hits, usage).select(*KEYS, F.col("est_cost").alias("waste_usd"), F.col("est_tokens").alias("tokens"))
    trend = trends(weekly, minimum=minimum).select(*KEYS, F.col("status").alias("trend"))
    rows = verdicts.join(waste, KEYS, "left").join(trend, KEYS, "left")
    columns = "verdict trend sessions sessions_before events events_before waste_usd tokens".split()
    return numbered(rows.select(*KEYS, *columns), digest_order(), limit)


_OBSERVATION = (
    "obs_id long, session_id string, ts_utc timestamp, kind string, program string, command string, signature string, sig_hash string, tool string, path string, excerpt string, host string"
)
_RULES = "path string, layer string, sha string, text string, stale int, indexed_at timestamp, last_read timestamp"
#: Seeded rows: each detector finds the clusters below and no others.
_SEEDS = [
    *[{"kind": "run_failed", "session_id": s, "program": "orion", "command": f"orion {s}", "signature": "orion: command not found", "sig_hash": "h1"} for s in "ab"],
    *[{"kind": "run_failed", "session_id": "c", "command": "make test"} for _ in range(3)],
    {"kind": "tool_rejected", "session_id": "d", "tool": "Bash"}, {"kind": "user_turn_after_correction", "session_id": "d", "excerpt": "ask first"},
    {"kind": "interrupt", "session_id": "e"}, {"kind": "user_turn_after_correction", "session_id": "e", "excerpt": "use tabs"},
    {"kind": "file_read", "session_id": "f", "path": "/notes.md"}, {"kind": "file_read", "session_id": "g", "path": "/notes.md", "day": 2},
    {"kind": "run_succeeded", "session_id": "h", "command": "git push --force"},
]
_EXPECTED = [
    ("D-01", "command-not-found:orion", 2, 2), ("D-02", "orion: command not found", 2, 2), ("D-03", "make test", 1, 3), ("D-04", "hook-denial:no-push", 2, 2), ("D-05", "tool-rejected:Bash:ask first", 1, 1),
    ("D-06", "interrupt:use tabs", 1, 1), ("D-07", "rediscovery:file:/notes.md", 2, 2), ("D-08", "stale-rule:binary:orion:/rules.md", 2, 2), ("D-10", "gate-gap:git:force", 1, 1),
]


def self_test(spark: SparkSession, detectors: dict | None = None) -> DataFrame:
    """Seeded rows through the detectors, in one plan: (detector_id, key, sessions, events, expected_sessions, expected_events, ok).

    A cluster that is missing or not expected is not ok; detectors without seeds are left out.
    """
    detectors = DETECTORS if detectors is None else detectors
    span = Span("2026-10-01 00:00:00", "2026-10-31 00:00:00", 30)
    names = [x.split()[0] for x in _OBSERVATION.split(", ")]
    at = lambda i, r: datetime(2026, 10, 5) + timedelta(days=r.get("day", 0), minutes=i)
    rows = [tuple(({"obs_id": i, "ts_utc": at(i, r)} | r).get(n) for n in names) for i, r in enumerate(_SEEDS)]
    observation = spark.createDataFrame(rows, _OBSERVATION)
    inputs = {
        "observation": observation,
        "rule_doc": spark.createDataFrame([("/rules.md", "l", "s", "Call Orion, then wait.", 0, at(0, {}), None)], _RULES),
        "catalog": spark.createDataFrame([("never", "git", "force", r"^git\s+push\s+--force\b")], "verdict string, pack string, id string, pattern string"),
        "hook_denial": spark.createDataFrame([("no-push", s, at(0, {})) for s in "ab"], "rule_id string, session_id string, ts_utc timestamp"),
    }
    needs = {"D-04": ("hook_denial",), "D-08": ("observation", "rule_doc"), "D-10": ("observation", "catalog")}
    expected = spark.createDataFrame(_EXPECTED, "detector_id string, key string, expected_sessions long, expected_events long")
    found = None
    for id in sorted({e[0] for e in _EXPECTED} & set(detectors)):
        part = detectors[id].run("cluster", span, **{n: inputs[n] for n in needs.get(id, ("observation",))}).select(F.lit(id).alias("detector_id"), "key", "sessions", "events")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no detector with seeds is registered")
    known = expected.where(F.col("detector_id").isin(*detectors))
    both = known.join(found, KEYS, "full")
    ok = (F.col("sessions") == F.col("expected_sessions")) & (F.col("events") == F.col("expected_events"))
    return both.select(*KEYS, "sessions", "events", "expected_sessions", "expected_events", F.coalesce(ok, F.lit(False)).alias("ok"))
