"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snagline.functions import exprs as E
from snagline.functions.fences import fenced
from snagline.operators import detectors as D
from snagline.operators import reports as R
from snagline.operators import sessions as S
from snagline.operators.sql_detectors import SqlDetector
from snagline.sources import adapters as A
from snagline.sources.files import enforced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPAN = D.Span()
LATE = D.Span(start="2024-01-15 00:00:00", days=16)
FIRST_HALF = D.Span(end="2024-01-15 00:00:00", days=14)
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- SQL for the views -------------------------------------------------------------------------

_OBS = """obs AS (SELECT event_id AS obs_id, 'u' || user_id AS session_id, ts AS ts_utc,
  CASE event_type WHEN 'error' THEN 'run_failed' WHEN 'purchase' THEN 'run_succeeded' WHEN 'view' THEN 'file_read'
    WHEN 'signup' THEN '{signup}' ELSE 'user_turn_after_correction' END AS kind,
  'bin' || k AS program, 'cmd' || (k % 5) AS command,
  CASE WHEN k % 2 = 0 THEN 'bin' || k || ': command not found' ELSE 'error code ' || (k % 10) END AS signature,
  'tool' || (k % 3) AS tool, '/f/' || k AS path, 'use ' || (k % 7) AS excerpt, 'r' || (k % 8) AS rule_id,
  'host' || (user_id % CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 6 ELSE 4 END) AS host
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
OBS = _OBS.replace("{signup}", "tool_rejected")
OBS_INTERRUPT = _OBS.replace("{signup}", "interrupt")
RULES = """rules AS (SELECT '/f/' || doc_id AS path, coalesce(lang, 'none') AS layer, sha256(text) AS sha,
  'Prefer bin' || (doc_id % 120) || ' on host' || (doc_id % 6) || '. ' || coalesce(text, '') AS text,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS stale,
  make_timestamp((1704067200 + doc_id % 86400) * 1000000) AS indexed_at,
  CASE WHEN doc_id % 7 = 0 THEN make_timestamp((1704067200 + doc_id % 2592000) * 1000000) END AS last_read FROM documents)"""
USAGE = """usage AS (SELECT 'u' || user_id AS session_id, count(*) AS tokens,
  CASE WHEN user_id % 10 <> 0 THEN sum(value) END AS cost_usd FROM events GROUP BY user_id)"""


def _in(span: D.Span, ts: str = "ts_utc") -> str:
    end = f" AND {ts} < TIMESTAMP '{span.end}'" if span.end else ""
    return f"{ts} >= TIMESTAMP '{span.start}'{end}"


def _stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _hits_sql(span: D.Span) -> dict[str, tuple[str, str, str, str]]:
    """Per detector: the view of observations, the SQL of its hits, its groups and its condition."""
    w = _in(span)
    pair = f"""hits AS (SELECT substr('{{prefix}}', 1, 240) AS key, session_id, ts_utc FROM (
        SELECT *, lead(kind) OVER s AS k2, lead(excerpt) OVER s AS correction, lead(ts_utc) OVER s AS t2 FROM obs
        WINDOW s AS (PARTITION BY session_id ORDER BY obs_id))
      WHERE {w} AND kind = '{{kind}}' AND k2 = 'user_turn_after_correction' AND {_in(span, 't2')})"""
    missing = f"""SELECT substr('command-not-found:' || program, 1, 240) AS key, program, session_id, ts_utc FROM obs
      WHERE {w} AND kind = 'run_failed' AND lower(signature) LIKE '%command not found%'"""
    words = lambda c: f"regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+')"
    return {
        "D-01": (OBS, f"hits AS ({missing})", "key", "count(DISTINCT session_id) >= 2"),
        "D-02": (
            OBS,
            f"""hits AS (SELECT substr(signature, 1, 240) AS key, session_id, ts_utc FROM obs
              WHERE {w} AND kind IN ('run_failed', 'tool_error'))""",
            "key",
            "count(DISTINCT session_id) >= 2",
        ),
        "D-03": (
            OBS,
            f"""failed AS (SELECT f.* FROM obs f WHERE {_in(span, 'f.ts_utc')} AND f.kind = 'run_failed' AND NOT EXISTS (
                SELECT 1 FROM obs s WHERE s.session_id = f.session_id AND s.kind = 'run_succeeded' AND s.command = f.command
                AND {_in(span, 's.ts_utc')} AND (s.ts_utc > f.ts_utc OR (s.ts_utc = f.ts_utc AND s.obs_id > f.obs_id)))),
              loops AS (SELECT session_id, command FROM failed GROUP BY 1, 2 HAVING count(*) >= 3),
              hits AS (SELECT command AS key, session_id, ts_utc FROM failed JOIN loops USING (session_id, command))""",
            "key",
            "true",
        ),
        "D-04": (
            OBS,
            f"hits AS (SELECT 'hook-denial:' || rule_id AS key, session_id, ts_utc FROM obs WHERE {w} AND kind = 'run_failed')",
            "key",
            "count(DISTINCT session_id) >= 2",
        ),
        "D-05": (OBS, pair.replace("'{prefix}'", "'tool-rejected:' || tool || ':' || correction").replace("{kind}", "tool_rejected"), "key", "true"),
        "D-06": (OBS_INTERRUPT, pair.replace("'{prefix}'", "'interrupt:' || correction").replace("{kind}", "interrupt"), "key", "true"),
        "D-07": (
            OBS,
            f"""hits AS (SELECT 'rediscovery:file:' || path AS key, 'file' AS family, session_id, ts_utc FROM obs WHERE {w} AND kind = 'file_read'
              UNION ALL SELECT 'rediscovery:command:' || command, 'command', session_id, ts_utc FROM obs
              WHERE {w} AND kind IN ('run', 'run_succeeded', 'run_failed'))""",
            "family, key",
            "count(DISTINCT session_id) >= 2 AND (family = 'command' OR count(DISTINCT CAST(ts_utc AS DATE)) >= 2)",
        ),
        "D-08": (
            f"{OBS}, {RULES}",
            f"""missing AS ({missing}),
              absent AS (SELECT program FROM missing GROUP BY 1 HAVING count(DISTINCT session_id) >= 2),
              named AS (SELECT DISTINCT program, path FROM absent JOIN rules ON stale = 0 AND list_contains({words('text')}, program)),
              hits AS (SELECT 'stale-rule:binary:' || program || ':' || path AS key, session_id, ts_utc
                FROM missing JOIN named USING (program))""",
            "key",
            "true",
        ),
        "D-10": (
            OBS,
            f"""hits AS (SELECT 'gate-gap:' || pack || ':' || id AS key, session_id, ts_utc FROM obs JOIN
              (VALUES ('shell', 'odd', '^cmd[13]$'), ('shell', 'four', 'cmd4'), ('git', 'all', '^cmd')) AS c(pack, id, pattern)
              ON regexp_matches(command, pattern) WHERE {w} AND kind IN ('run_succeeded', 'run_failed')
              AND NOT (pack = 'git' AND regexp_matches(command, '^cmd[0-2]')))""",
            "key",
            "true",
        ),
        "D-12": (
            OBS,
            f"""base AS (SELECT obs_id, session_id, ts_utc, obs_id % 5 AS f, obs_id % 11 AS d, obs_id % 13 AS j FROM obs WHERE kind = 'run_failed'),
              hits AS (SELECT 'D-' || (12 + f) AS family, 'autonomy:' || (obs_id % 17) AS key, session_id, ts_utc FROM base
              WHERE {w} AND obs_id % 19 <> 0 AND CASE WHEN j = 0 THEN obs_id % 2 = 0 AND obs_id % 3 <> 0 ELSE d < 6 END)""",
            "family, key",
            "true",
        ),
    }


def _projection_sql(detector: str, kind: str, span: D.Span) -> str:
    views, hits, groups, having = _hits_sql(span)[detector]
    good = f", good AS (SELECT {groups} FROM hits GROUP BY {groups} HAVING {having})"
    kept = f"FROM hits JOIN good USING ({groups})"
    week = "strftime(ts_utc, '%G-W%V') AS week"
    cluster = f"""SELECT key, count(DISTINCT session_id) AS sessions, count(*) AS events,
        {_stamp('min(ts_utc)')} AS first_seen, {_stamp('max(ts_utc)')} AS last_seen FROM hits GROUP BY {groups} HAVING {having}"""
    if detector == "D-08" and kind == "cluster":
        cluster += f""" UNION ALL SELECT 'stale-rule:host:' || host || ':' || path, 0, 0, {_stamp('indexed_at')}, {_stamp('indexed_at')}
            FROM rules JOIN (SELECT DISTINCT host FROM obs WHERE ts_utc < TIMESTAMP '{span.start}' EXCEPT
              SELECT DISTINCT host FROM obs WHERE ts_utc >= TIMESTAMP '{span.start}') h
            ON stale = 0 AND list_contains(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), host)"""
    body = {
        "cluster": cluster,
        "session": f"SELECT DISTINCT key, session_id {kept}",
        "week": f"SELECT DISTINCT key, {week} {kept}",
        "weekly": f"SELECT key, {week}, count(DISTINCT session_id) AS sessions, count(*) AS events {kept} GROUP BY ALL",
    }[kind]
    return f"WITH {views}, {hits}{good} {body}"


# --- inputs of the detectors --------------------------------------------------------------------

#: Rules of a gate catalogue; those that are off, do not block or look at something else are not enforced on commands.
CATALOG = [
    ("never", "shell", "odd", "^cmd[13]$", True, "deny", "command_regex"),
    ("never", "shell", "four", "cmd4", True, "deny", "command_regex"),
    ("never", "shell", "off", "^cmd", False, "deny", "command_regex"),
    ("never", "shell", "unsaid", "^cmd", None, "deny", "command_regex"),
    ("never", "shell", "hint", "^cmd", True, "additional_context", "command_regex"),
    ("never", "shell", "content", "^cmd", True, "deny", "content_regex"),
    ("never", "git", "all", "^cmd", True, "deny", "command_regex"),
    ("always", "git", "low", "^cmd[0-2]", None, None, "command_regex"),
    ("never", "opaque", "all", "^cmd", True, "deny", "command_regex"),
    ("always", "opaque", "engine", None, None, None, "predicate"),
]
_RULE = "verdict string, pack string, id string, pattern string, enabled boolean, action string, check string"


def _assessments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Candidates, overrides and episodes made of failed runs."""
    obs = A.observations(spark, sf_dir).where("kind = 'run_failed'")
    i = F.col("obs_id")
    sha = F.concat(F.lit("s"), i)
    assessment = obs.select(
        i.alias("candidate_id"), i.alias("episode_id"), F.concat(F.lit("D-"), 12 + i % 5).alias("family"),
        F.concat(F.lit("autonomy:"), i % 17).alias("cluster_key"), F.when(i % 11 < 6, "supported").otherwise("rejected").alias("disposition"),
        sha.alias("input_sha"), F.lit("e").alias("evidence_sha"), F.col("ts_utc").alias("assessed_at"),
    )
    adjudication = obs.where(i % 13 == 0).select(
        i.alias("candidate_id"), F.when(i % 2 == 0, "supported").otherwise("rejected").alias("disposition"), sha.alias("input_sha"),
        F.when(i % 3 == 0, "old").otherwise("e").alias("evidence_sha"),
    )
    episode = obs.select(i.alias("episode_id"), "session_id", F.when(i % 19 == 0, "changed").otherwise(sha).alias("input_sha"))
    return {"assessment": assessment, "adjudication": adjudication, "episode": episode}


def detector_inputs(spark: SparkSession, sf_dir: str, detector: str) -> dict[str, DataFrame]:
    obs = A.observations(spark, sf_dir, interrupts=detector == "D-06")
    if detector == "D-04":
        return {"hook_denial": obs.where("kind = 'run_failed'").select("rule_id", "session_id", "ts_utc")}
    if detector == "D-08":
        return {"observation": obs, "rule_doc": A.rule_docs(spark, sf_dir)}
    if detector == "D-10":
        return {"observation": obs, "catalog": enforced(spark.createDataFrame(CATALOG, _RULE))}
    if detector == "D-12":
        return _assessments(spark, sf_dir)
    return {"observation": obs}


def run_detector(spark: SparkSession, sf_dir: str, detector: str, kind: str, span: D.Span) -> DataFrame:
    return D.DETECTORS[detector].run(kind, span, **detector_inputs(spark, sf_dir, detector))


def _add_detectors() -> None:
    for name in D.DETECTORS:
        for kind in D.KINDS:
            span = LATE if name == "D-08" else SPAN
            label = "d12_d16" if name == "D-12" else name.replace("-", "").lower()

            def run(spark: SparkSession, sf_dir: str, name=name, kind=kind, span=span) -> DataFrame:
                return run_detector(spark, sf_dir, name, kind, span)

            query(f"{label}_{kind}", _projection_sql(name, kind, span))(run)


_add_detectors()


@query(
    "d09_cluster",
    f"""WITH {OBS}, {RULES} SELECT 'unread-rule-doc:' || path AS key, CAST(0 AS BIGINT) AS sessions, CAST(0 AS BIGINT) AS events,
      {_stamp('indexed_at')} AS first_seen, {_stamp('indexed_at')} AS last_seen FROM rules d WHERE stale = 0
      AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.sha = d.sha AND r.last_read >= TIMESTAMP '{LATE.start}')
      AND NOT EXISTS (SELECT 1 FROM rules r JOIN obs o ON o.path = r.path
        WHERE r.sha = d.sha AND o.kind = 'file_read' AND o.ts_utc >= TIMESTAMP '{LATE.start}')""",
)
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unread_rules(LATE, A.observations(spark, sf_dir), A.rule_docs(spark, sf_dir))


_BUCKETS = f"""{OBS}, bucket AS (SELECT host, CAST(ts_utc AS DATE) AS day, substr(sha256(signature), 1, 12) AS sig_hash, count(*) AS events,
  min(ts_utc) AS a, max(ts_utc) AS b FROM obs WHERE kind = 'run_failed' GROUP BY ALL),
  rows AS (SELECT * FROM bucket WHERE host <> 'host5' AND day >= DATE '2024-01-15' AND day {{last}} DATE '2024-01-31')"""


@query(
    "d11_cluster",
    f"""WITH {_BUCKETS.replace('{last}', '<=')} SELECT 'cross-host-signature:' || sig_hash AS key, count(DISTINCT host) AS sessions, CAST(sum(events) AS BIGINT) AS events,
      {_stamp('min(a)')} AS first_seen, {_stamp('max(b)')} AS last_seen FROM rows GROUP BY sig_hash HAVING count(DISTINCT host) >= 2""",
)
def d11(spark: SparkSession, sf_dir: str, weekly: bool = False) -> DataFrame:
    bucket = A.host_buckets(A.observations(spark, sf_dir)).withColumn("scheme", F.lit("v1"))
    # host5 reports another scheme, so its buckets do not count
    report = bucket.select("host", F.when(F.col("host") == "host5", "v0").otherwise("v1").alias("scheme"))
    return D.cross_host(LATE, bucket, report, weekly)


@query(
    "d11_weekly",
    f"""WITH {_BUCKETS.replace('{last}', '<')} SELECT 'cross-host-signature:' || sig_hash AS key, strftime(day, '%G-W%V') AS week, count(DISTINCT host) AS sessions,
      CAST(sum(events) AS BIGINT) AS events FROM rows WHERE sig_hash IN (SELECT sig_hash FROM rows GROUP BY 1 HAVING count(DISTINCT host) >= 2)
      GROUP BY ALL""",
)
def d11_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d11(spark, sf_dir, True)


@query(
    "cross_host_contributors",
    f"""WITH {_BUCKETS.replace('{last}', '<=')}, per AS (SELECT sig_hash, host, sum(events) AS events, string_agg(strftime(day, '%Y-%m-%d'), ';' ORDER BY day) AS days
      FROM bucket GROUP BY ALL) SELECT sig_hash, count(*) AS hosts, CAST(sum(events) AS BIGINT) AS events,
      string_agg(host || '=' || days, '|' ORDER BY host || '=' || days) AS contributors FROM per GROUP BY sig_hash""",
)
def cross_host_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contributors(A.host_buckets(A.observations(spark, sf_dir)))


# --- clusters of several detectors --------------------------------------------------------------

SEVERAL = ("D-01", "D-02", "D-03", "D-05", "D-07")


def cells(spark: SparkSession, sf_dir: str, *spans: D.Span) -> DataFrame:
    """Daily cells of the five detectors in all windows, from one pass over the observations."""
    return D.daily_cells(D.session_hits(A.observations(spark, sf_dir), list(spans)))


def clusters(spark: SparkSession, sf_dir: str, span: D.Span = SPAN) -> DataFrame:
    return D.clusters_of(cells(spark, sf_dir, span)).drop("span", "part")


def cluster_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.counted_cells(cells(spark, sf_dir, SPAN)).select("detector_id", "key", "session_id").distinct()


def cluster_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = D.counted_cells(cells(spark, sf_dir, SPAN)).groupBy("detector_id", "key", E.iso_week(F.col("day").cast("timestamp")).alias("week"))
    return by.agg(F.count_distinct("session_id").alias("sessions"), F.sum("n").alias("events"))


def two_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of the later and of the earlier window, out of one pass."""
    both = D.clusters_of(cells(spark, sf_dir, LATE, FIRST_HALF))
    return tuple(both.where(F.col("span") == i).drop("span", "part") for i in (0, 1))


def _several(kind: str, span: D.Span = SPAN) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS detector_id, * FROM ({_projection_sql(d, kind, span)})" for d in SEVERAL)


query("cluster_union", _several("cluster"))(clusters)

_SCORE = f"""4 * ln(1 + sessions) + ln(1 + events)
  + pow(2, -greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(last_seen AS TIMESTAMP))) / 86400000000.0 / 30)"""
_ORDER = "s DESC, sessions DESC, events DESC, last_seen DESC, detector_id, key"


@query(
    "rank_top10",
    f"""SELECT detector_id, key, sessions, events, round(s, 6) AS score, row_number() OVER (ORDER BY {_ORDER}) AS place
      FROM (SELECT *, {_SCORE} AS s FROM ({_several('cluster')})) ORDER BY place LIMIT 10""",
)
def rank_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(clusters(spark, sf_dir), NOW, 30, 10)


def _split(column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN round(sum({column} / hits), 6) END"


@query(
    "waste_equal_split",
    f"""WITH {USAGE}, cs AS ({_several('session')}), shares AS (SELECT session_id, count(*) AS hits FROM cs GROUP BY 1)
      SELECT detector_id, key, count(*) AS sessions, {_split('cost_usd')} AS est_cost, {_split('tokens')} AS est_tokens
      FROM cs JOIN shares USING (session_id) LEFT JOIN usage USING (session_id) GROUP BY ALL""",
)
def waste_equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.equal_split_waste(cluster_sessions(spark, sf_dir), A.usage(spark, sf_dir))


def _cells_sql() -> str:
    parts = []
    for d in SEVERAL:
        views, hits, groups, having = _hits_sql(SPAN)[d]
        parts.append(
            f"""SELECT '{d}' AS detector_id, * FROM (WITH {views}, {hits}, good AS (SELECT {groups} FROM hits GROUP BY {groups} HAVING {having})
            SELECT key, session_id, strftime(ts_utc, '%G-W%V') AS week, count(*) AS n FROM hits JOIN good USING ({groups}) GROUP BY ALL)"""
        )
    return " UNION ALL ".join(parts)


@query(
    "weekly_waste",
    f"""WITH {USAGE}, cells AS ({_cells_sql()}), kept AS (SELECT detector_id, key, week FROM cells GROUP BY ALL HAVING sum(n) >= 2),
      own AS (SELECT cells.* FROM cells JOIN kept USING (detector_id, key, week)),
      shares AS (SELECT session_id, count(*) AS hits FROM own GROUP BY 1)
      SELECT detector_id, key, week, count(*) AS sessions, {_split('cost_usd')} AS est_waste_usd
      FROM own JOIN shares USING (session_id) LEFT JOIN usage USING (session_id) GROUP BY ALL""",
)
def weekly_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = E.iso_week(F.col("day").cast("timestamp")).alias("week")
    hits = D.counted_cells(cells(spark, sf_dir, SPAN)).select("detector_id", "key", week, "session_id", "n")
    kept = hits.groupBy("detector_id", "key", "week").agg(F.sum("n").alias("n")).where("n >= 2")
    return R.weekly_waste(hits, kept, A.usage(spark, sf_dir))


_GRID = f"""cw AS ({_several('weekly')}), cal AS (SELECT CAST(d AS DATE) AS d, strftime(d, '%G-W%V') AS week
    FROM (SELECT unnest(range(TIMESTAMP '2023-01-02', TIMESTAMP '2025-12-29', INTERVAL 7 DAY)) AS d)),
  ends AS (SELECT detector_id, max(d) AS last FROM cw JOIN cal USING (week) GROUP BY 1),
  labels AS (SELECT detector_id, week, d = last AS newest FROM ends JOIN cal ON d > last - 84 AND d <= last),
  hist AS (SELECT detector_id, count(DISTINCT week) AS history FROM labels JOIN cw USING (detector_id, week) GROUP BY 1),
  grid AS (SELECT detector_id, key, week, newest, coalesce(sessions, 0) AS sessions, coalesce(events, 0) AS events
    FROM (SELECT DISTINCT detector_id, key FROM cw) JOIN labels USING (detector_id) LEFT JOIN cw USING (detector_id, key, week))"""


@query("weekly_zero_filled", f"WITH {_GRID} SELECT detector_id, key, week, sessions, events FROM grid")
def weekly_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.zero_filled(cluster_weeks(spark, sf_dir))


def _band_sql(c: str) -> str:
    level = f"list_reduce([CAST(x.{c} AS DOUBLE) FOR x IN prior], lambda l, x: 0.3 * x + 0.7 * l)"
    return f"({level} + 2 * list_aggregate([CAST(x.{c} AS DOUBLE) FOR x IN prior], 'stddev_pop'))"


def _trend_sql(minimum: int) -> str:
    return f"""WITH {_GRID}, series AS (SELECT detector_id, key, list(struct_pack(week := week, sessions := sessions, events := events) ORDER BY week) AS a
      FROM grid GROUP BY ALL), parts AS (SELECT *, a[-1] AS l, a[1:len(a) - 1] AS prior FROM series JOIN hist USING (detector_id)),
      before AS (SELECT DISTINCT detector_id, key FROM cw LEFT JOIN labels USING (detector_id, week) WHERE NOT coalesce(newest, false) AND (sessions > 0 OR events > 0)),
      ex AS (SELECT *, l.events - {_band_sql('events')} AS ee, l.sessions - {_band_sql('sessions')} AS se FROM parts),
      st AS (SELECT ex.*, CASE WHEN history < {minimum} THEN 'insufficient_history'
        WHEN before.key IS NULL AND (l.sessions > 0 OR l.events > 0) THEN 'new'
        WHEN ee > 0 OR se > 0 THEN 'accelerating' END AS status FROM ex LEFT JOIN before ON before.detector_id = ex.detector_id AND before.key = ex.key)
      SELECT detector_id, key, status, l.week AS week, l.sessions AS sessions, l.events AS events,
        CASE WHEN history < {minimum} THEN NULL WHEN ee >= se THEN 'events' ELSE 'sessions' END AS metric,
        CASE WHEN history >= {minimum} THEN round(greatest(ee, se), 6) END AS excess FROM st WHERE status IS NOT NULL"""


@query("trend_ewma", _trend_sql(3))
def trend_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trends(cluster_weeks(spark, sf_dir), 12, 3)


@query("trend_insufficient", _trend_sql(6))
def trend_insufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trends(cluster_weeks(spark, sf_dir))


@query(
    "recurrence_direction",
    f"""WITH {OBS}, cw AS (SELECT 'D-04' AS detector_id, rule_id AS key, date_trunc('week', ts_utc) AS monday, count(*) AS events,
      count(DISTINCT session_id) AS sessions FROM obs WHERE kind = 'run_failed' AND NOT (rule_id = 'r3' AND ts_utc >= TIMESTAMP '2024-01-22'
        AND ts_utc < TIMESTAMP '2024-01-29') GROUP BY ALL),
      p AS (SELECT *, lag(monday) OVER w AS m0, lag(events) OVER w AS e0, lag(sessions) OVER w AS s0,
        row_number() OVER (PARTITION BY key ORDER BY monday DESC) AS n FROM cw WINDOW w AS (PARTITION BY key ORDER BY monday))
      SELECT detector_id, key, strftime(monday, '%Y-%m-%d') AS monday, events, CASE WHEN m0 IS NULL OR date_diff('day', m0, monday) <> 7 THEN 'unknown'
        WHEN events > e0 THEN 'up' WHEN events < e0 THEN 'down' WHEN sessions > s0 THEN 'up' WHEN sessions < s0 THEN 'down' ELSE 'flat' END AS direction
      FROM p WHERE n = 1""",
)
def recurrence_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).where("kind = 'run_failed'")
    gap = (F.col("rule_id") == "r3") & E.in_window("ts_utc", "2024-01-22", "2024-01-29")
    cells = rows.where(~gap).groupBy("rule_id", F.to_date(F.date_trunc("week", "ts_utc")).alias("monday")).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions")
    )
    return R.recurrence(cells.select(F.lit("D-04").alias("detector_id"), F.col("rule_id").alias("key"), "monday", "events", "sessions"))


@query(
    "digest_verdicts",
    f"""SELECT coalesce(a.detector_id, b.detector_id) AS detector_id, coalesce(a.key, b.key) AS key, coalesce(a.sessions, 0) AS sessions,
      coalesce(b.sessions, 0) AS sessions_before, coalesce(a.events, 0) AS events, coalesce(b.events, 0) AS events_before,
      CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'gone' WHEN a.sessions > b.sessions OR a.events > b.events THEN 'worsening'
        WHEN a.sessions < b.sessions OR a.events < b.events THEN 'improving' END AS verdict
      FROM (SELECT * FROM ({_several('cluster', LATE)})) a FULL JOIN (SELECT * FROM ({_several('cluster', FIRST_HALF)})) b
      ON a.detector_id = b.detector_id AND a.key = b.key WHERE coalesce(a.key, b.key) <> 'cmd1'""",
)
def digest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("D-03", "cmd1")], "detector_id string, key string")
    return R.digest(*two_windows(spark, sf_dir), gone)


@query(
    "cluster_refresh",
    f"""WITH n AS ({_several('cluster', LATE)}), o AS (SELECT *, CASE WHEN sessions % 3 = 0 THEN 'dismissed' ELSE 'open' END AS state
      FROM ({_several('cluster', FIRST_HALF)})) SELECT coalesce(n.detector_id, o.detector_id) AS detector_id, coalesce(n.key, o.key) AS key,
      coalesce(n.sessions, o.sessions) AS sessions, coalesce(n.events, o.events) AS events, coalesce(o.state, 'open') AS state
      FROM o FULL JOIN n ON o.detector_id = n.detector_id AND o.key = n.key WHERE n.key IS NOT NULL OR o.state <> 'open'""",
)
def cluster_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = two_windows(spark, sf_dir)
    old = old.withColumn("state", F.when(F.col("sessions") % 3 == 0, "dismissed").otherwise("open"))
    return R.refreshed_clusters(old, new)


@query(
    "week_upsert",
    f"""SELECT detector_id, key, week, coalesce(n.sessions, o.sessions) AS sessions, coalesce(n.events, o.events) AS events
      FROM (SELECT 'D-01' AS detector_id, * FROM ({_projection_sql('D-01', 'weekly', FIRST_HALF)})) o
      FULL JOIN (SELECT 'D-01' AS detector_id, * FROM ({_projection_sql('D-01', 'weekly', D.Span(start='2024-01-10 00:00:00'))})) n
      USING (detector_id, key, week)""",
)
def week_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda span: run_detector(spark, sf_dir, "D-01", "weekly", span).withColumn("detector_id", F.lit("D-01"))
    return R.merged_weeks(one(FIRST_HALF), one(D.Span(start="2024-01-10 00:00:00")))


# --- rules --------------------------------------------------------------------------------------

_COVER = f"""{OBS}, {RULES}, m AS (SELECT DISTINCT o.program AS phrase, r.path, r.stale FROM (SELECT DISTINCT program FROM obs) o JOIN rules r
  ON list_contains(regexp_split_to_array(lower(r.text), '[^\\p{{L}}\\p{{N}}]+'), o.program))"""


@query(
    "coverage_phrase",
    f"""WITH {_COVER} SELECT phrase, path, stale, n_rules FROM (SELECT *, count(*) OVER (PARTITION BY phrase) AS n_rules,
      row_number() OVER (PARTITION BY phrase ORDER BY stale, path) AS n FROM m) WHERE n = 1""",
)
def coverage_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.rule_docs(spark, sf_dir)
    names = A.observations(spark, sf_dir).select(F.col("program").alias("phrase"))
    return R.covering_rule(D.phrase_matches(docs, names), docs)


_REPORT_AT = "2024-04-05"
_MONDAYS = f"""p AS (SELECT program AS phrase, date_trunc('week', ts_utc) AS monday, count(*) AS events, count(DISTINCT session_id) AS sessions FROM obs WHERE CAST(substr(program, 4) AS INTEGER) % 3 <> 0 OR ts_utc < TIMESTAMP '2024-01-03' GROUP BY ALL),
  w AS (SELECT *, lag(monday) OVER s AS m0, lag(events) OVER s AS e0, lag(sessions) OVER s AS s0, row_number() OVER (PARTITION BY phrase ORDER BY monday DESC) AS n FROM p WINDOW s AS (PARTITION BY phrase ORDER BY monday)),
  up AS (SELECT phrase, date_diff('day', m0, monday) = 7 AND (events > e0 OR (events = e0 AND sessions > s0)) AS up FROM w WHERE n = 1)"""


@query(
    "rule_report",
    f"""WITH {_COVER}, {_MONDAYS}, best AS (SELECT phrase, path FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY stale, path) AS n FROM m) WHERE n = 1),
      seen AS (SELECT program AS phrase, max(ts_utc) AS last_seen FROM obs WHERE CAST(substr(program, 4) AS INTEGER) % 3 <> 0 OR ts_utc < TIMESTAMP '2024-01-03' GROUP BY 1),
      cv AS (SELECT path, count(*) AS covers, max(last_seen) AS last_seen, count(*) FILTER (up) AS up FROM best JOIN seen USING (phrase) JOIN up USING (phrase) GROUP BY 1),
      rd AS (SELECT sha, max(read_at) AS last_read FROM (SELECT sha, last_read AS read_at FROM rules UNION ALL SELECT sha, ts_utc FROM rules JOIN obs ON obs.path = rules.path AND kind = 'file_read') GROUP BY 1),
      x AS (SELECT r.path, coalesce(covers, 0) AS covers, coalesce(up, 0) AS up, rd.last_read IS NULL AS never, coalesce(rd.last_read, indexed_at) AS since, cv.last_seen,
        (epoch_us(TIMESTAMP '{_REPORT_AT}') - epoch_us(coalesce(rd.last_read, indexed_at))) / 86400000000.0 AS age FROM rules r LEFT JOIN rd USING (sha) LEFT JOIN cv ON cv.path = r.path WHERE r.stale = 0)
      SELECT path, covers, up, {_stamp('since')} AS unread_since, CAST(floor(greatest(0, age)) AS BIGINT) AS unread_days, never OR age > 70 AS unread, (never OR age > 70) AND age >= 70 AND covers = 0 AS deletion_candidate,
        (never OR age > 70) AND age >= 80 AND (covers = 0 OR last_seen <= TIMESTAMP '{_REPORT_AT}' - INTERVAL 80 DAY) AS retire FROM x""",
)
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rules, the programs they cover, a third of which was only seen in the first days, and what may go."""
    docs, obs = A.rule_docs(spark, sf_dir), A.observations(spark, sf_dir)
    reads = obs.where("kind = 'file_read'").select("path", "ts_utc")
    early = F.col("ts_utc") < F.lit("2024-01-03").cast("timestamp")
    seen = obs.where((F.substring("program", 4, 9).cast("int") % 3 != 0) | early)
    best = R.covering_rule(D.phrase_matches(docs, obs.select(F.col("program").alias("phrase")).distinct()), docs).select(F.col("phrase").alias("key"), F.col("path").alias("covered_by"))
    cells = seen.groupBy(F.lit("D-04").alias("detector_id"), F.col("program").alias("key"), F.to_date(F.date_trunc("week", "ts_utc")).alias("monday"))
    weekly = R.recurrence(cells.agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))).select("key", "direction")
    clusters = seen.groupBy(F.col("program").alias("key")).agg(F.max("ts_utc").alias("last_seen")).join(best, "key").join(weekly, "key")
    rows = R.rule_report(docs, clusters, reads, _REPORT_AT, 70, 80, 80)
    return rows.select("path", "covers", "up", E.stamp("unread_since").alias("unread_since"), "unread_days", "unread", "deletion_candidate", "retire")


_KNOWN = """k AS (SELECT path, layer, sha, stale FROM rules WHERE CAST(substr(path, 4) AS BIGINT) % 9 <> 0),
  f AS (SELECT CASE WHEN i % 17 = 0 THEN path || '.new' ELSE path END AS path, CASE WHEN i % 12 = 0 THEN 'other' ELSE layer END AS layer,
    CASE WHEN i % 14 = 0 THEN 'x' ELSE sha END AS sha FROM (SELECT *, CAST(substr(path, 4) AS BIGINT) AS i FROM rules) WHERE i % 8 <> 0)"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = A.rule_docs(spark, sf_dir).withColumn("i", F.expr("try_cast(substring(path, 4, 30) AS long)"))
    i = F.col("i")
    listed = docs.where(i % 8 != 0).select(
        F.when(i % 17 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"),
        F.when(i % 12 == 0, "other").otherwise(F.col("layer")).alias("layer"),
        F.when(i % 14 == 0, "x").otherwise(F.col("sha")).alias("sha"),
    )
    return docs.where(i % 9 != 0).select("path", "layer", "sha", "stale"), listed


@query(
    "corpus_index_diff",
    f"""WITH {RULES}, {_KNOWN} SELECT coalesce(f.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'indexed'
      WHEN f.path IS NULL AND k.stale = 1 THEN 'still_stale' WHEN f.path IS NULL THEN 'vanished' WHEN k.stale = 1 THEN 'restored'
      WHEN k.sha <> f.sha THEN 'reindexed' WHEN k.layer <> f.layer THEN 'relayered' ELSE 'unchanged' END AS change
      FROM k FULL JOIN f ON k.path = f.path""",
)
def corpus_index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_changes(*_corpus(spark, sf_dir))


@query(
    "corpus_moves",
    f"""WITH {RULES}, {_KNOWN} SELECT g.path, string_agg(DISTINCT n.path, ',' ORDER BY n.path) AS "to"
      FROM (SELECT * FROM k WHERE path NOT IN (SELECT path FROM f)) g JOIN (SELECT * FROM f WHERE path NOT IN (SELECT path FROM k)) n
      ON g.sha = n.sha GROUP BY g.path""",
)
def corpus_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moved(*_corpus(spark, sf_dir))


@query(
    "read_resolution",
    f"""WITH {RULES}, reads AS (SELECT event_id AS read_id, CAST(event_id % 200 AS VARCHAR) AS p FROM events WHERE event_type = 'view'),
      c AS (SELECT read_id, 0 AS rank, p AS at FROM reads UNION ALL SELECT read_id, 1, '/f/' || p FROM reads WHERE read_id % 2 = 0
        UNION ALL SELECT read_id, 2, '/f/' || p FROM reads)
      SELECT read_id, arg_min(sha, rank) AS sha, CAST(min(rank) AS BIGINT) AS rank FROM c JOIN rules ON rules.path = c.at GROUP BY read_id""",
)
def read_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = A.table(spark, sf_dir, "events").where("event_type = 'view'").select(
        F.col("event_id").alias("read_id"), (F.col("event_id") % 200).cast("string").alias("path"),
        F.when(F.col("event_id") % 2 == 0, "/f").otherwise("/g").alias("cwd"), F.lit("/f").alias("launch_dir"),
    )
    return R.resolved_reads(reads, A.rule_docs(spark, sf_dir))


# --- measurements -------------------------------------------------------------------------------

_DAILY = f"""{OBS}, cal AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
  m AS (SELECT path AS lesson_id, CAST(ts_utc AS DATE) AS day, count(*) AS events, count(DISTINCT session_id) AS sessions
    FROM obs WHERE kind = 'run_failed' GROUP BY ALL),
  daily AS (SELECT lesson_id, day, coalesce(events, 0) AS events, coalesce(sessions, 0) AS sessions
    FROM (SELECT DISTINCT lesson_id FROM m) CROSS JOIN cal LEFT JOIN m USING (lesson_id, day))"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).where("kind = 'run_failed'")
    by = rows.groupBy(F.col("path").alias("lesson_id"), F.to_date("ts_utc").alias("day")).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions")
    )
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    grid = by.select("lesson_id").distinct().select("lesson_id", F.explode(days).alias("day"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "sessions")]
    return grid.join(by, ["lesson_id", "day"], "left").select("lesson_id", "day", *zero)


@query(
    "resolution_streak",
    f"""WITH {_DAILY}, z AS (SELECT *, CAST(day - CAST(row_number() OVER (PARTITION BY lesson_id ORDER BY day) AS INTEGER) AS DATE) AS island FROM daily WHERE events = 0)
      SELECT lesson_id, strftime(min(day), '%Y-%m-%d') AS "first", strftime(min(day) + 1, '%Y-%m-%d') AS resolved, count(*) AS length
      FROM z GROUP BY lesson_id, island HAVING count(*) >= 2""",
)
def resolution_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolution_streaks(_daily(spark, sf_dir), 2)


_LESSONS = f"""ls AS (SELECT lesson_id, ['environment', 'hook', 'wrapper', 'skill', 'agents_md', 'memory', 'retrieval_only'][k % 7 + 1] AS layer, CASE WHEN k % 7 > 0 THEN ['environment', 'hook', 'wrapper', 'skill', 'agents_md', 'memory'][k % 7] END AS next_layer,
    CASE WHEN k % 4 = 0 THEN TIMESTAMP '2023-12-20' ELSE TIMESTAMP '2024-01-03' + CAST(k % 6 AS INTEGER) * INTERVAL 1 DAY + INTERVAL 2 HOUR END AS t, k % 9 AS s0, k % 11 * 3 AS e0
    FROM (SELECT DISTINCT lesson_id, CAST(substr(lesson_id, 4) AS BIGINT) AS k FROM daily) WHERE k % 5 <> 4),
  pt AS (SELECT lesson_id, CAST(day AS TIMESTAMP) + CAST(CAST(substr(lesson_id, 4) AS BIGINT) % 4 AS INTEGER) * INTERVAL 1 HOUR AS tm, sessions, events FROM daily)"""


def _measured_lessons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lessons applied before and within the measured days, some at the strongest layer, some not applied at all."""
    k = F.substring("lesson_id", 4, 9).cast("long")
    daily = _daily(spark, sf_dir)
    points = daily.select("lesson_id", (F.col("day").cast("timestamp") + F.make_dt_interval(hours=(k % 4).cast("int"))).alias("measured_at"), "sessions", "events")
    layers = F.array(*[F.lit(x) for x in R.LAYERS])
    applied = F.when(k % 4 == 0, F.lit("2023-12-20").cast("timestamp")).otherwise(F.lit("2024-01-03 02:00:00").cast("timestamp") + F.make_dt_interval(days=(k % 6).cast("int")))
    state = F.when(k % 5 == 4, "accepted").otherwise(F.concat(F.lit("applied:"), F.get(layers, (k % 7).cast("int"))))
    lessons = daily.select("lesson_id").distinct().select("lesson_id", state.alias("state"), applied.alias("applied_at"), (k % 9).alias("sessions"), (k % 11 * 3).alias("events"))
    return lessons, points


@query(
    "escalation_ladder",
    f"""WITH {_DAILY}, {_LESSONS}, x AS (SELECT ls.*, b.tm AS base_at, coalesce(b.sessions, s0) AS sb, coalesce(b.events, e0) AS eb, a.tm AS after_at, a.sessions AS sa, a.events AS ea
        FROM ls ASOF LEFT JOIN pt b ON b.lesson_id = ls.lesson_id AND b.tm <= ls.t ASOF LEFT JOIN pt a ON a.lesson_id = ls.lesson_id AND a.tm >= ls.t + INTERVAL 21 DAY)
      SELECT lesson_id, layer, next_layer, {_stamp('base_at')} AS base_at, sb AS sessions_before, eb AS events_before, {_stamp('after_at')} AS measured_at, sa AS sessions, ea AS events
      FROM x WHERE next_layer IS NOT NULL AND t + INTERVAL 21 DAY <= TIMESTAMP '2024-01-29' AND after_at <= TIMESTAMP '2024-01-29' AND NOT (2 * sa <= sb AND 2 * ea <= eb)""",
)
def escalation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons, points = _measured_lessons(spark, sf_dir)
    rows = R.escalations(lessons, points, "2024-01-29")
    return rows.select("lesson_id", "layer", "next_layer", E.stamp("base_at").alias("base_at"), "sessions_before", "events_before", E.stamp("measured_at").alias("measured_at"), "sessions", "events")


@query(
    "lesson_resolutions",
    f"""WITH {_DAILY}, {_LESSONS}, d AS (SELECT lesson_id, t, CAST(tm AS DATE) AS day, max(tm) AS tm, arg_max(events, tm) AS n FROM pt JOIN ls USING (lesson_id)
        WHERE tm > t AND tm <= TIMESTAMP '2024-01-29' AND CAST(substr(lesson_id, 4) AS BIGINT) % 6 <> 5 GROUP BY ALL),
      z AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY lesson_id ORDER BY day) AS INTEGER) AS island FROM d WHERE n = 0),
      r AS (SELECT *, row_number() OVER w AS place, first_value(tm) OVER w AS since FROM z WINDOW w AS (PARTITION BY lesson_id, island ORDER BY day))
      SELECT lesson_id, {_stamp('min(t)')} AS applied_at, {_stamp('min(since)')} AS first_zero_at, {_stamp('min(tm)')} AS resolved_at FROM r WHERE place = 2 GROUP BY lesson_id""",
)
def lesson_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lessons of the ladder, those of an autonomy family among them, whose failures were gone for two days."""
    k = F.substring("lesson_id", 4, 9).cast("long")
    lessons, points = _measured_lessons(spark, sf_dir)
    family = F.when(k % 6 == 5, "D-14@2").otherwise("D-01@1")
    rows = R.resolutions(lessons.withColumn("detector_id", family), points.withColumn("window_days", F.lit(7)), "2024-01-29", 2)
    return rows.select("lesson_id", *[E.stamp(c).alias(c) for c in ("applied_at", "first_zero_at", "resolved_at")])


@query(
    "measurement_latest_per_day",
    f"""WITH {OBS}, m AS (SELECT path AS lesson_id, CAST(ts_utc AS DATE) AS day, obs_id AS measured_at, obs_id % 3 = 0 AS mirror FROM obs)
      SELECT lesson_id, strftime(day, '%Y-%m-%d') AS day, measured_at, mirror FROM (SELECT *, row_number() OVER
      (PARTITION BY lesson_id, day ORDER BY mirror DESC, measured_at DESC) AS n FROM m) WHERE n = 1""",
)
def measurement_latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).select(
        F.col("path").alias("lesson_id"), F.to_date("ts_utc").alias("day"), F.col("obs_id").alias("measured_at"), (F.col("obs_id") % 3 == 0).alias("mirror")
    )
    return R.latest_per_day(rows).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_SHAPES = """c AS (SELECT 's' || (user_id % 3) AS source, CAST(ts AS DATE) AS run, event_type || (CASE WHEN ts < TIMESTAMP '2024-01-28'
  THEN user_id % 2 ELSE user_id % 3 END) AS record_type, count(*) AS n FROM events GROUP BY ALL)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.when(F.col("ts") < F.lit("2024-01-28").cast("timestamp"), F.col("user_id") % 2).otherwise(F.col("user_id") % 3)
    return A.table(spark, sf_dir, "events").groupBy(
        F.concat(F.lit("s"), F.col("user_id") % 3).alias("source"), F.to_date("ts").alias("run"), F.concat("event_type", half).alias("record_type")
    ).agg(F.count("*").alias("n"))


@query("record_type_histogram", f"WITH {_SHAPES} SELECT source, strftime(run, '%Y-%m-%d') AS run, record_type, n FROM c")
def record_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir).withColumn("run", F.date_format("run", "yyyy-MM-dd"))


@query(
    "parse_shape_drift",
    f"""WITH {_SHAPES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS place FROM (SELECT DISTINCT source, run FROM c)),
      g AS (SELECT r.source, t.record_type, place, coalesce(n, 0) AS n FROM r JOIN (SELECT DISTINCT source, record_type FROM c) t USING (source)
        LEFT JOIN c ON c.source = r.source AND c.run = r.run AND c.record_type = t.record_type WHERE place <= 10),
      x AS (SELECT source, record_type, CAST(sum(CASE WHEN place <= 2 THEN n END) AS BIGINT) AS recent,
        CAST(quantile_disc(CASE WHEN place > 2 THEN n END, 0.5) AS BIGINT) AS median, max(CASE WHEN place > 2 THEN n END) AS most, count(CASE WHEN place > 2 THEN 1 END) AS runs FROM g GROUP BY ALL)
      SELECT source, record_type, recent, median, CASE WHEN runs < 3 THEN 'unarmed' WHEN median > 0 AND recent = 0 THEN 'vanished'
        WHEN most = 0 AND recent > 0 THEN 'appeared' ELSE 'steady' END AS verdict FROM x""",
)
def parse_shape_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shape_drift(_shapes(spark, sf_dir))


# --- sessions -----------------------------------------------------------------------------------


@query(
    "session_cap",
    """SELECT user_id, least(count(*), 20) AS retained, greatest(count(*) - 20, 0) AS omitted, min(ordinal) FILTER (n > 20) AS omitted_first,
      max(ordinal) FILTER (n > 20) AS omitted_last FROM (SELECT user_id, event_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
      FROM events) GROUP BY user_id""",
)
def session_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"))
    return R.omitted_after(rows, ["user_id"], ["ordinal"], 20)


@query(
    "evidence_first_rows",
    f"""WITH {OBS} SELECT signature, obs_id, n AS place FROM (SELECT signature, obs_id, row_number() OVER (PARTITION BY signature ORDER BY ts_utc DESC, obs_id) AS n
      FROM obs WHERE kind = 'run_failed') WHERE n <= 16""",
)
def evidence_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.observations(spark, sf_dir).where("kind = 'run_failed'").select("signature", "obs_id", "ts_utc")
    first = R.first_rows(rows, ["signature"], [F.desc("ts_utc"), F.asc("obs_id")], 16)
    return first.select("signature", "obs_id", F.col("place").cast("long").alias("place"))


@query(
    "prompt_budget",
    """WITH RECURSIVE own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
      r AS (SELECT conv_id // 5 AS prompt, conv_id, turn, octet_length(encode(coalesce(text, ''))) AS b, conv_id % 5 + 1 AS c, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY turn, conv_id) AS n FROM own WHERE k <= 16),
      f AS (SELECT DISTINCT prompt, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS b, false AS fits, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS taken, CAST([-1, -1, -1, -1, -1] AS BIGINT[]) AS used FROM r
        UNION ALL SELECT prompt, n, conv_id, turn, b, fits, CASE WHEN fits THEN total + b ELSE total END, CASE WHEN fits THEN taken + 1 ELSE taken END,
          CASE WHEN fits THEN CAST([CASE WHEN c = i THEN greatest(used[i], 0) + b ELSE used[i] END FOR i IN [1, 2, 3, 4, 5]] AS BIGINT[]) ELSE used END
        FROM (SELECT r.prompt, r.n, r.conv_id, r.turn, r.b, r.c, f.total, f.taken, f.used, (r.turn = 0 OR f.used[r.c] >= 0) AND greatest(f.used[r.c], 0) + r.b <= 900 AND f.total + r.b <= 3000 AS fits
          FROM f JOIN r ON r.prompt = f.prompt AND r.n = f.n + 1))
      SELECT conv_id, turn, b AS bytes, taken FROM f WHERE fits""",
)
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of five conversations, the first turn of each being its own text, under 900 and 3,000 bytes."""
    first = R.first_rows(A.table(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn")], 16)
    rows = first.select(F.floor(F.col("conv_id") / 5).alias("prompt"), "conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return R.packed(rows, "prompt", "conv_id", "turn", "bytes", 900, 3000).select("conv_id", "turn", "bytes", "taken")


@query(
    "usage_delta",
    """SELECT user_id AS session_id, event_id AS at, total, CASE WHEN p IS NULL OR total < p THEN total ELSE total - p END AS delta
      FROM (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, event_id % 1000 AS total FROM events))""",
)
def usage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("at"), (F.col("event_id") % 1000).alias("total"))
    return R.token_deltas(rows)


@query(
    "usage_rollup",
    """WITH m AS (SELECT user_id, event_id // 3 AS message_id, max(event_id % 50) AS tokens, arg_max(event_type, event_id) AS model FROM events GROUP BY ALL)
      SELECT user_id, CAST(sum(tokens) AS BIGINT) AS tokens, arg_max(model, message_id) AS last_model, count(*) AS messages FROM m GROUP BY user_id""",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = A.table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 3).alias("message_id"))
    m = by.agg(F.max(F.col("event_id") % 50).alias("tokens"), F.max_by("event_type", "event_id").alias("model"))
    return m.groupBy("user_id").agg(F.sum("tokens").alias("tokens"), F.max_by("model", "message_id").alias("last_model"), F.count("*").alias("messages"))


@query(
    "fair_round_robin",
    """SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS round FROM customer""",
)
def fair_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "customer")
    return R.fair_order(rows, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_nationkey", "round")


_CALLS = """calls AS (SELECT 'u' || user_id AS session_id, event_id AS tool_use_id, event_id AS at,
    CASE WHEN event_id % 3 <> 0 THEN 'cmd' END AS command FROM events),
  results AS (SELECT c.session_id, c.tool_use_id, d AS at, c.at % 4 = 0 AS is_error, c.at % 5 = 0 AS rejected,
    CASE WHEN c.at % 2 = 0 THEN 'Exit code ' || (c.at % 3 + d) || chr(10) || 'boom' ELSE 'fine' END AS text
    FROM calls c, (VALUES (0), (1)) AS t(d) WHERE c.at % 6 <> 0)"""


@query(
    "paired_runs",
    f"""WITH {_CALLS}, x AS (SELECT c.session_id, c.tool_use_id, command, is_error, rejected,
      try_cast(nullif(regexp_extract(r.text, '^Exit code (\\d{{1,9}})(?:\\n|$)', 1), '') AS INTEGER) AS exit_code
      FROM calls c LEFT JOIN results r ON c.session_id = r.session_id AND c.tool_use_id = r.tool_use_id AND r.at = 0)
      SELECT session_id, tool_use_id, exit_code, CASE WHEN coalesce(rejected, false) THEN 'tool_rejected'
        WHEN command IS NOT NULL AND exit_code = 0 THEN 'run_succeeded' WHEN command IS NOT NULL AND exit_code IS NOT NULL THEN 'run_failed'
        WHEN command IS NOT NULL THEN 'run' WHEN coalesce(is_error, false) THEN 'tool_error' ELSE 'tool' END AS kind FROM x""",
)
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    i = F.col("event_id")
    calls = e.select(
        F.concat(F.lit("u"), "user_id").alias("session_id"), i.alias("tool_use_id"), i.alias("at"), F.when(i % 3 != 0, "cmd").alias("command")
    )
    at = F.col("at")
    text = F.when(at % 2 == 0, F.concat(F.lit("Exit code "), at % 3 + F.col("d"), F.lit("\nboom"))).otherwise("fine")
    results = calls.where(at % 6 != 0).withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "session_id", "tool_use_id", (at % 4 == 0).alias("is_error"), (at % 5 == 0).alias("rejected"), text.alias("text"), F.col("d").alias("at")
    )
    return S.paired_runs(calls, results).select("session_id", "tool_use_id", "exit_code", "kind")


_FOLD = """f AS (SELECT 'u' || user_id AS session_id, event_id AS obs_id, CASE event_type WHEN 'error' THEN 'marker' WHEN 'view' THEN 'turn'
  WHEN 'purchase' THEN 'action' END AS kind, CASE WHEN event_id % 4 = 0 THEN '/w/' || (event_id % 9) END AS cwd FROM events)"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "marker").when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "purchase", "action")
    cwd = F.when(i % 4 == 0, F.concat(F.lit("/w/"), i % 9))
    return A.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("session_id"), i.alias("obs_id"), kind.alias("kind"), cwd.alias("cwd"))


@query(
    "correction_flags",
    f"""WITH {_FOLD} SELECT obs_id, kind = 'turn' AND coalesce(l = 'marker', false) AS is_correction FROM (SELECT *, last_value(kind IGNORE NULLS)
      OVER (PARTITION BY session_id ORDER BY obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM f) WHERE kind IS NOT NULL""",
)
def correction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.corrections(_folded(spark, sf_dir)).where("kind is not null").select("obs_id", "is_correction")


@query(
    "sticky_cwd",
    f"""WITH {_FOLD} SELECT obs_id, last_value(cwd IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY obs_id ROWS UNBOUNDED PRECEDING) AS cwd FROM f""",
)
def sticky_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sticky(_folded(spark, sf_dir), "cwd").select("obs_id", "cwd")


@query(
    "turn_numbers",
    """SELECT conv_id AS session_key, turn AS ordinal, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_id
      FROM conversations""",
)
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_numbers(A.interactions(spark, sf_dir)).select("session_key", "ordinal", "turn_id")


@query(
    "funnel_stages",
    """WITH a AS (SELECT user_id, min(event_id) AS at_0 FROM events WHERE event_type = 'signup' GROUP BY 1),
      b AS (SELECT user_id, at_0, min(event_id) AS at_1 FROM events JOIN a USING (user_id) WHERE event_type = 'view' AND event_id > at_0 GROUP BY 1, 2)
      SELECT user_id AS session_id, at_0, at_1, min(event_id) AS at_2 FROM events JOIN b USING (user_id) WHERE event_type = 'purchase' AND event_id > at_1 GROUP BY 1, 2, 3""",
)
def funnel_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("obs_id"), F.col("event_type").alias("kind"))
    return S.funnel(rows, ["signup", "view", "purchase"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions whose requests ask for actions and for how things stand, cancel, and report work done."""
    n = (F.col("session_key") * 7 + F.col("ordinal") * 5) % 11
    action = F.concat(F.lit("Please fix item "), F.col("session_key") % 5, F.lit("-"), F.floor(F.col("ordinal") / 4), F.lit("."))
    said = F.when(n < 4, action).when(n < 6, "status?").when(n == 6, "cancel that").when(n == 7, "This is done.").when(n == 8, "continue")
    said = said.otherwise(F.concat(F.lit("look at "), n))
    return A.interactions(spark, sf_dir).withColumn("text", F.when(F.col("origin") == "human_request", said).otherwise(F.col("text")))


#: Every human row of these requests opens an episode, ends one or is part of the open one.
_EPISODES = """r AS (SELECT conv_id, turn, role, (conv_id * 7 + turn * 5) % 11 AS n FROM conversations),
  k AS (SELECT *, CASE WHEN role <> 'user' THEN NULL WHEN n IN (4, 5) THEN 'status' WHEN n = 6 THEN 'cancelled' WHEN n = 7 THEN 'completed' WHEN n = 8 THEN 'on' ELSE 'open' END AS what FROM r),
  a AS (SELECT *, lag(CASE WHEN what IN ('open', 'on', 'cancelled', 'completed') THEN what END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM k),
  b AS (SELECT *, sum(CASE WHEN what IN ('cancelled', 'completed') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM a),
  o AS (SELECT *, what = 'open' OR (what = 'on' AND count(*) FILTER (what IN ('open', 'on')) OVER (PARTITION BY conv_id, coalesce(stops, 0) ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0) AS starts FROM b),
  e AS (SELECT conv_id, turn, n, what, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS episode FROM o WHERE starts),
  c AS (SELECT e.conv_id, e.turn, min(x.turn) AS stop FROM e JOIN o x ON x.conv_id = e.conv_id AND x.turn > e.turn AND (x.starts OR x.what IN ('cancelled', 'completed')) GROUP BY 1, 2),
  s AS (SELECT e.*, c.stop, (SELECT CASE WHEN o.starts THEN 'superseded' ELSE o.what END FROM o WHERE o.conv_id = e.conv_id AND o.turn = c.stop) AS ended,
    CASE WHEN e.n < 4 THEN 'fix:item ' || (e.conv_id % 5) || '-' || (e.turn // 4) END AS action_key FROM e LEFT JOIN c USING (conv_id, turn)),
  ep AS (SELECT s.conv_id AS session_key, CAST(s.episode AS BIGINT) AS episode, s.action_key, s.turn AS start_ordinal,
    coalesce(s.stop, (SELECT max(turn) FROM r WHERE r.conv_id = s.conv_id AND r.role IN ('user', 'assistant'))) AS end_ordinal,
    coalesce(s.ended, 'active') AS lifecycle, CASE WHEN s.ended = 'cancelled' THEN 'revoked' WHEN s.n < 4 THEN 'authorized' ELSE 'unknown' END AS authority,
    CASE WHEN s.n < 4 THEN 'known' ELSE 'unknown' END AS context FROM s)"""


@query("episodes", f"WITH {_EPISODES} SELECT * FROM ep")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.episodes(_requests(spark, sf_dir))
    return rows.select("session_key", F.col("episode").cast("long").alias("episode"), "action_key", "start_ordinal", "end_ordinal", "lifecycle", "authority", "context")


@query(
    "episode_spans",
    f"""WITH {_EPISODES} SELECT ep.session_key, ep.episode, ep.action_key, c.turn AS ordinal, c.role FROM ep
      JOIN conversations c ON c.conv_id = ep.session_key AND c.turn BETWEEN ep.start_ordinal AND ep.end_ordinal""",
)
def episode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requests(spark, sf_dir)
    rows = S.spans_of(S.episodes(asked), asked)
    role = F.when(F.col("origin") == "human_request", "user").when(F.col("origin") == "assistant_text", "assistant").otherwise("system")
    return rows.select("session_key", F.col("episode").cast("long").alias("episode"), "action_key", "ordinal", role.alias("role"))


# --- text ---------------------------------------------------------------------------------------


@query(
    "intervention_classes",
    "SELECT conv_id AS session_key, turn AS ordinal, CASE WHEN n = 1 THEN 'task_start' "
    + " ".join(f"WHEN regexp_matches(trim(text), '{p.replace(chr(39), chr(39) * 2)}', 'is') THEN '{n}'" for n, p in E.INTERVENTIONS)
    + f""" WHEN contains(text, '?') OR regexp_matches(text, '{E.QUESTION}', 'i') THEN 'question'
      WHEN regexp_matches(trim(text), '{E.ORDINARY}', 'i') THEN 'ordinary_request' ELSE 'ambiguous' END AS category
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user')""",
)
def intervention_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.interactions(spark, sf_dir).where("origin = 'human_request'")
    first = F.row_number().over(Window.partitionBy("session_key").orderBy("ordinal")) == 1
    rows = rows.withColumn("first", first)
    return rows.select("session_key", "ordinal", E.intervention(F.col("text"), F.col("first")).alias("category"))


def _replace_sql(column: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in steps:
        flags = "g"
        if pattern.startswith("(?i)"):
            pattern, flags = pattern[4:], "gi"
        text = pattern.replace("'", "''")
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        column = f"regexp_replace({column}, '{text}', '{to}', '{flags}')"
    return column


_RE2_SIGNATURE = tuple(s for s in E.SIGNATURE_STEPS if "(?<!" not in s[0])
_ERRORS = """'Error 0x1F in /home/u' || user_id || '/a.py: ' || event_id || ' src/x' || (event_id % 9) || '.py  id=deadbeef' || (event_id % 10)"""


@query(
    "signature_normalize",
    f"""SELECT event_id, trim({_replace_sql(_ERRORS, _RE2_SIGNATURE)}) AS signature FROM events WHERE event_type = 'error'""",
)
def signature_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.concat(
        F.lit("Error 0x1F in /home/u"), "user_id", F.lit("/a.py: "), i, F.lit(" src/x"), i % 9, F.lit(".py  id=deadbeef"), i % 10
    )
    rows = A.table(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.select("event_id", E.signature(text).alias("signature"))


@query("redact_documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    clean = E.redacted(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.length(clean).cast("long").alias("n_chars"), F.regexp_count(clean, F.lit("<redacted:")).cast("long").alias("n_redacted"))


#: Names that must not leave; some begin like others.
FENCES = ("the", "the ing", "Tion", "ueber", "der ", "ß", "de la", "que", "ÉE", "entre", ".*", "a|b")


def _fence_sql() -> str:
    names = "|".join(re.escape(f) for f in sorted(FENCES, key=len, reverse=True))
    return f"regexp_replace(coalesce(text, ''), '{names}', '<redacted:content-fence>', 'gi')"


@query("fenced_documents", f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT doc_id, {_fence_sql()} AS t FROM documents)")
def fenced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fenced(FENCES)(F.coalesce("text", F.lit("")))
    rows = A.table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


#: A detector as a user would give it: slow programs, whose failures come in three sessions or more.
SLOW = SqlDetector(
    "D-90", 1, "programs that fail in several sessions",
    """WITH failed AS (SELECT * FROM observation WHERE kind = 'run_failed' AND ts_utc >= CAST(:start AS TIMESTAMP) AND ts_utc < CAST(:end AS TIMESTAMP))
      SELECT 'slow:' || program AS key, count(DISTINCT session_id) AS sessions, count(*) AS events, min(ts_utc) AS first_seen, max(ts_utc) AS last_seen
      FROM failed GROUP BY program HAVING count(DISTINCT session_id) >= 3;""",
    session="SELECT DISTINCT 'slow:' || program AS key, session_id FROM observation WHERE kind = 'run_failed' AND ts_utc >= CAST(:start AS TIMESTAMP) AND ts_utc < CAST(:end AS TIMESTAMP)",
    weekly="""SELECT 'slow:' || program AS key, concat(extract(YEAROFWEEK FROM ts_utc), '-W', lpad(weekofyear(ts_utc), 2, '0')) AS week, count(DISTINCT session_id) AS sessions, count(*) AS events
      FROM observation WHERE kind = 'run_failed' AND ts_utc >= CAST(:start AS TIMESTAMP) AND ts_utc < CAST(:end AS TIMESTAMP) GROUP BY ALL""",
)
_SLOW = f"FROM obs WHERE kind = 'run_failed' AND {_in(SPAN)}"
_SLOW_SQL = {
    "cluster": f"SELECT 'slow:' || program AS key, count(DISTINCT session_id) AS sessions, count(*) AS events, {_stamp('min(ts_utc)')} AS first_seen, {_stamp('max(ts_utc)')} AS last_seen {_SLOW} GROUP BY program HAVING count(DISTINCT session_id) >= 3",
    "session": f"SELECT DISTINCT 'slow:' || program AS key, session_id {_SLOW}",
    "weekly": f"SELECT 'slow:' || program AS key, strftime(ts_utc, '%G-W%V') AS week, count(DISTINCT session_id) AS sessions, count(*) AS events {_SLOW} GROUP BY ALL",
}


def _add_sql_detector() -> None:
    for kind, sql in _SLOW_SQL.items():

        def run(spark: SparkSession, sf_dir: str, kind=kind) -> DataFrame:
            return SLOW.run(kind, SPAN, observation=A.observations(spark, sf_dir))

        query(f"d90_sql_{kind}", f"WITH {OBS} {sql}")(run)


_add_sql_detector()


@query(
    "impact_groups",
    """SELECT c_mktsegment AS source, 'n' || (c_nationkey % 4) AS family, count(*) AS n, count(*) FILTER (x = 0) AS completed, count(*) FILTER (x = 1) AS interrupted,
      count(*) FILTER (x = 2) AS unknown, round(count(*) FILTER (x = 0) / nullif(count(*) FILTER (x < 2), 0), 6) AS rate
      FROM (SELECT *, c_custkey % 3 AS x FROM customer) GROUP BY ALL""",
)
def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_custkey") % 3
    rows = A.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("source"), F.concat(F.lit("n"), F.col("c_nationkey") % 4).alias("family"),
        F.when(x == 0, "completed").when(x == 1, "interrupted").otherwise("unknown").alias("lifecycle"),
    )
    return R.impact(rows)


@query(
    "paired_trials",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS arm, o_orderkey // 2 AS case_id, 0 AS repetition,
      CASE WHEN (o_orderkey // 2) % 4 = 0 THEN 'holdout' ELSE 'train' END AS split, CASE WHEN o_custkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS status FROM orders)
      SELECT a.split, count(*) AS pairs, count(*) FILTER (b.status = 'pass' AND a.status <> 'pass') AS better,
      count(*) FILTER (a.status = 'pass' AND b.status <> 'pass') AS worse, bool_and(NOT (a.status = 'pass' AND b.status <> 'pass')) AS never_worse,
      bool_or(b.status = 'pass' AND a.status <> 'pass') AS ever_better FROM t a JOIN t b ON a.arm = 'baseline' AND b.arm = 'candidate'
      AND a.case_id = b.case_id AND a.split = b.split GROUP BY a.split""",
)
def paired_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.floor(F.col("o_orderkey") / 2)
    rows = A.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("candidate").alias("arm"), case.alias("case_id"), F.lit(0).alias("repetition"),
        F.when(case % 4 == 0, "holdout").otherwise("train").alias("split"), F.when(F.col("o_custkey") % 3 == 0, "pass").otherwise("fail").alias("status"),
    )
    return R.paired_verdict(rows)


@query(
    "retention_prune",
    """SELECT event_id FROM events WHERE event_id % 50 = 0 OR ts >= TIMESTAMP '2024-01-20'""",
)
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 50 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    rows = A.table(spark, sf_dir, "events").select("event_id", text.alias("stamp"))
    return R.retained(rows, "stamp", "2024-01-20 00:00:00").select("event_id")


@query(
    "target_brief",
    f"""WITH {OBS} SELECT signature AS key, count(DISTINCT session_id) AS sessions, count(*) AS events, {_stamp('min(ts_utc)')} AS first_seen,
      {_stamp('max(ts_utc)')} AS last_seen, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools FROM obs
      WHERE kind = 'run_failed' AND session_id IN (SELECT session_id FROM obs WHERE path = '/f/7') GROUP BY signature""",
)
def target_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.observations(spark, sf_dir)
    scope = obs.where("path = '/f/7'").select("session_id").distinct()
    rows = obs.where("kind = 'run_failed'").join(scope, "session_id", "left_semi")
    return rows.groupBy(F.col("signature").alias("key")).agg(
        F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events"), E.stamp(F.min("ts_utc")).alias("first_seen"),
        E.stamp(F.max("ts_utc")).alias("last_seen"), F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
    )


from snagline.plans import digest_queries, review_queries  # noqa: E402, F401  they register their queries here
