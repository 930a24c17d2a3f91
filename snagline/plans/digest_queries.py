"""The weekly digest as one plan over one pass of the observations, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions import exprs as E
from snagline.operators import detectors as D
from snagline.operators import digest as G
from snagline.plans.registry import FIRST_HALF, LATE, ORACLES, SPAN, USAGE, _several, _split, cells, query
from snagline.sources import adapters as A


@query(
    "weekly_digest",
    f"""WITH v AS ({ORACLES['digest_verdicts']}), tr AS ({ORACLES['trend_ewma']}), {USAGE}, cs AS ({_several('session', LATE)}), shares AS (SELECT session_id, count(*) AS hits FROM cs GROUP BY 1),
      w AS (SELECT detector_id, key, {_split('cost_usd')} AS waste_usd, {_split('tokens')} AS tokens FROM cs JOIN shares USING (session_id) LEFT JOIN usage USING (session_id) GROUP BY ALL),
      x AS (SELECT v.*, w.waste_usd, w.tokens, tr.status AS trend FROM v LEFT JOIN w ON w.detector_id = v.detector_id AND w.key = v.key LEFT JOIN tr ON tr.detector_id = v.detector_id AND tr.key = v.key)
      SELECT detector_id, key, verdict, trend, sessions, sessions_before, events, events_before, waste_usd, tokens, row_number() OVER (ORDER BY CASE trend WHEN 'new' THEN 0 WHEN 'accelerating' THEN 1 WHEN 'insufficient_history' THEN 2 ELSE 3 END,
        CASE verdict WHEN 'new' THEN 0 WHEN 'worsening' THEN 1 WHEN 'gone' THEN 2 WHEN 'improving' THEN 3 ELSE 4 END, waste_usd DESC NULLS LAST, tokens DESC NULLS LAST, detector_id, key) AS place FROM x ORDER BY place LIMIT 40""",
)
def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = cells(spark, sf_dir, LATE, FIRST_HALF, SPAN)
    week = E.iso_week(F.col("day").cast("timestamp")).alias("week")
    by = D.counted_cells(every.where("span = 2")).groupBy("detector_id", "key", week)
    weekly = by.agg(F.count_distinct("session_id").alias("sessions"), F.sum("n").alias("events"))
    dismissed = spark.createDataFrame([("D-03", "cmd1")], "detector_id string, key string")
    return G.weekly_digest(every, weekly, A.usage(spark, sf_dir), dismissed, 40, 3)
