"""The detectors' self-test, and the plan of the digest."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from snagline.operators import detectors as D
from snagline.operators import digest as G


def test_self_test_passes_and_notices_a_change(spark):
    rows = G.self_test(spark).collect()
    assert [r for r in rows if not r["ok"]] == [] and {r["detector_id"] for r in rows} == {f"D-{n:02d}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)}
    d = D.DETECTORS["D-03"]
    late = D.Detector("D-03", 2, "forgets one", lambda span, observation: d.hits(span, observation).limit(2))
    extra = D.Detector("D-05", 2, "finds more", lambda span, observation: observation.select(F.lit("x").alias("key"), "session_id", "ts_utc"))
    bad = {(r["detector_id"], r["key"]) for r in G.self_test(spark, D.DETECTORS | {"D-03": late, "D-05": extra}).collect() if not r["ok"]}
    assert bad == {("D-03", "make test"), ("D-05", "x"), ("D-05", "tool-rejected:Bash:ask first")}
    with pytest.raises(ValueError):
        G.self_test(spark, {})


def test_the_digest_aggregates_observations_once(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no driver tables here")
    from snagline.plans.registry import QUERIES

    df = QUERIES["weekly_digest"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
