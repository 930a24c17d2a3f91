"""Registered queries of transcripts, lanes, follow-up, health and autonomy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions import exprs as E
from snagline.operators import detectors as D
from snagline.operators import review as V
from snagline.operators import sessions as S
from snagline.plans.registry import (
    _EPISODES,
    _ORDER,
    _SCORE,
    LATE,
    NOW,
    OBS,
    ORACLES,
    RULES,
    _assessments,
    _in,
    _requests,
    _several,
    cluster_sessions,
    cluster_weeks,
    clusters,
    intervention_classes,
    query,
    trend_ewma,
    waste_equal_split,
)
from snagline.sources import adapters as A
from snagline.sources import sinks, transcripts
from snagline.sources.files import error_streak

# --- transcripts --------------------------------------------------------------------------------

#: Of every event two records: a call and its result, or a human's words and an empty one.
_TEXTS = {"error": "Exit code 3\nboom", "purchase": "Exit code 0\nfine", "view": "contents", "signup": "Sorry: The user doesn't want to take this action"}


def _lines(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """(path, line, text): a file of JSON lines for each user, made of their events."""
    e, kind = A.table(spark, sf_dir, "events"), F.col("event_type")
    i = F.concat(F.lit("t"), "event_id")
    human = ~kind.isin(*_TEXTS)
    result = F.lit("nothing")
    for name, text in _TEXTS.items():
        result = F.when(kind == name, text).otherwise(result)
    file = F.when(kind == "view", F.concat(F.lit("/f/"), F.col("event_id") % 9))
    command = F.when(kind != "view", F.concat(F.lit("make "), F.col("event_id") % 4))
    tool = F.when(kind == "view", "Read").otherwise("Bash")
    asked = F.struct(command.alias("command"), file.alias("file_path"))
    if shape == "a":
        head = [F.concat(F.lit("u"), "user_id").alias("sessionId"), F.col("ts").cast("string").alias("timestamp")]
        block = lambda *x: F.struct(F.array(F.struct(*x)).alias("content"))
        call = F.struct(F.lit("assistant").alias("type"), *head, block(F.lit("tool_use").alias("type"), i.alias("id"), tool.alias("name"), asked.alias("input")).alias("message"))
        answer = F.struct(F.lit("user").alias("type"), *head, block(F.lit("tool_result").alias("type"), i.alias("tool_use_id"), result.alias("content")).alias("message"))
        said = F.struct(F.lit("user").alias("type"), *head, F.struct(F.concat(F.lit("do it "), "event_id").alias("content")).alias("message"))
        other = F.struct(F.lit("cost-state").alias("type"), *head)
    else:
        item = lambda *x: F.struct(F.lit("response_item").alias("type"), F.col("ts").cast("string").alias("timestamp"), F.struct(*x).alias("payload"))
        call = item(F.lit("function_call").alias("type"), i.alias("call_id"), tool.alias("name"), F.to_json(asked).alias("arguments"))
        answer = item(F.lit("function_call_output").alias("type"), i.alias("call_id"), result.alias("output"))
        words = F.array(F.struct(F.lit("input_text").alias("type"), F.concat(F.lit("do it "), "event_id").alias("text")))
        said = item(F.lit("message").alias("type"), F.lit("user").alias("role"), words.alias("content"))
        other = item(F.lit("reasoning").alias("type"))
        # the second shape reports a stopped turn itself
        stopped = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("turn_aborted").alias("type"), F.lit("stop").alias("reason")).alias("payload")))
    pair = F.array(F.when(human, F.to_json(said)).otherwise(F.to_json(call)), F.when(human, F.to_json(other)).otherwise(F.to_json(answer)))
    if shape == "b":
        pair = F.when(kind == "signup", F.array(stopped, F.to_json(other))).otherwise(pair)
    path = F.concat(F.lit("/u"), "user_id")
    rows = e.select(path.alias("path"), F.col("event_id"), F.posexplode(pair).alias("k", "text"))
    lines = rows.select("path", (2 * F.col("event_id") + F.col("k")).alias("line"), "text")
    if shape == "b":
        meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("u"), "user_id").alias("id")).alias("payload")))
        first = e.groupBy("user_id").agg(F.count("*")).select(path.alias("path"), F.lit(-1).cast("long").alias("line"), meta.alias("text"))
        lines = lines.unionByName(first)
    return lines


#: A rejection stands where it was reported, one line behind its call; the second shape has an interrupt there.
_KINDS = """SELECT 'u' || user_id AS session_id, 2 * event_id + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS line, CASE event_type WHEN 'error' THEN 'run_failed' WHEN 'purchase' THEN 'run_succeeded'
    WHEN 'view' THEN 'file_read' WHEN 'signup' THEN 'tool_rejected' ELSE CASE WHEN before = 'signup' THEN 'user_turn_after_correction' ELSE 'turn' END END AS kind,
    CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 0 END AS exit_code, CASE WHEN event_type = 'view' THEN '/f/' || (event_id % 9) END AS file_path
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"""


@query("transcript_events_a", _KINDS)
def transcript_events_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "a")
    parts = transcripts.parts_of(lines)
    rows = transcripts.events_of(transcripts.blocks_a(lines, parts), parts)
    return rows.select("session_id", "line", "kind", "exit_code", "file_path")


@query("transcript_events_b", _KINDS.replace("CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END", "0").replace("'tool_rejected'", "'interrupt'"))
def transcript_events_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "b")
    parts = transcripts.parts_of(lines)
    rows = transcripts.events_of(transcripts.blocks_b(lines, parts), parts)
    return rows.select("session_id", "line", "kind", "exit_code", "file_path")


@query(
    "transcript_interactions",
    """WITH x AS (SELECT user_id, 2 * event_id + k AS line, CASE WHEN event_type NOT IN ('error', 'purchase', 'view', 'signup') THEN 'human_request'
        WHEN k = 0 THEN 'tool_call' ELSE 'tool_result' END AS origin FROM events, (VALUES (0), (1)) AS t(k)
        WHERE k = 0 OR event_type IN ('error', 'purchase', 'view', 'signup')),
      y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line) - 1 AS ordinal,
        nullif(sum(CASE WHEN origin = 'human_request' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY line), 0) AS turn_id FROM x)
      SELECT 'u' || user_id AS session_key, ordinal, line, origin, CAST(turn_id AS BIGINT) AS turn_id FROM y WHERE ordinal < 1000""",
)
def transcript_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, "a")
    parts = transcripts.parts_of(lines)
    rows = transcripts.interactions_of(transcripts.blocks_a(lines, parts), parts=parts)
    return rows.select("session_key", "ordinal", "line", "origin", "turn_id")


@query(
    "transcript_threads",
    """WITH t AS (SELECT user_id, event_id, event_type AS k, event_id % 4 = 0 AS sidechain FROM events),
      b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ordinal, lag(CASE WHEN k IN ('error', 'view', 'signup') THEN k END IGNORE NULLS) OVER w AS before,
        lag(CASE WHEN k = 'error' THEN event_id END IGNORE NULLS) OVER w AS question FROM t WINDOW w AS (PARTITION BY user_id, sidechain ORDER BY event_id)),
      o AS (SELECT *, CASE WHEN k = 'error' THEN 'question' WHEN k = 'purchase' THEN 'assistant_text' WHEN k = 'view' AND before = 'error' THEN 'human_answer' WHEN k = 'view' THEN 'human_request' ELSE 'harness' END AS origin FROM b),
      e AS (SELECT *, sum(CASE WHEN origin = 'human_request' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, sidechain ORDER BY event_id) AS turn,
        lead(CASE WHEN k = 'signup' THEN 'interrupted' WHEN origin = 'human_request' THEN 'unknown' WHEN k = 'purchase' THEN 'none' END IGNORE NULLS) OVER (PARTITION BY user_id, sidechain ORDER BY event_id) AS ended FROM o)
      SELECT 'u' || e.user_id AS session_key, e.ordinal, e.origin, e.sidechain, CAST(nullif(e.turn, 0) AS BIGINT) AS turn_id, CASE WHEN e.origin = 'human_answer' THEN q.ordinal END AS question_ordinal,
        CASE WHEN e.k = 'purchase' THEN coalesce(ended, 'unknown') WHEN e.k = 'signup' THEN 'interrupted' ELSE 'none' END AS terminal_state
      FROM e LEFT JOIN b q ON q.event_id = e.question AND q.user_id = e.user_id WHERE e.ordinal < 500""",
)
def transcript_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, replies, words of humans, interrupts and harness records of a main and a delegated thread."""
    kind, i = F.col("event_type"), F.col("event_id")
    asks = F.array(F.struct(F.lit("tool_use").alias("type"), i.cast("string").alias("id"), F.lit("AskUserQuestion").alias("name"), F.struct(F.lit("Which?").alias("question")).alias("input")))
    record = lambda role, content: F.to_json(F.struct(
        F.lit(role).alias("type"), F.concat(F.lit("u"), "user_id").alias("sessionId"), (i % 4 == 0).alias("isSidechain"), (~kind.isin("error", "purchase", "view", "signup")).alias("isMeta"),
        F.struct(F.concat(F.lit("m"), i).alias("id"), content.alias("content")).alias("message"),
    ))
    words = F.array(F.struct(F.lit("text").alias("type"), F.lit("Done.").alias("text")))
    text = F.when(kind == "error", record("assistant", asks)).when(kind == "purchase", record("assistant", words)).when(kind == "signup", record("user", F.lit(transcripts.INTERRUPT)))
    text = text.otherwise(record("user", F.concat(F.lit("do it "), i)))
    lines = A.table(spark, sf_dir, "events").select(F.concat(F.lit("/u"), "user_id").alias("path"), i.alias("line"), text.alias("text"))
    parts = transcripts.parts_of(lines)
    rows = transcripts.interactions_of(transcripts.blocks_a(lines, parts), 500, parts)
    return rows.select("session_key", "ordinal", "origin", "sidechain", "turn_id", "question_ordinal", "terminal_state")


@query(
    "transcript_usage",
    """WITH m AS (SELECT user_id, event_id // 4 AS m, max(event_id % 90) AS i, max(event_id % 7) AS o, arg_max('m' || (event_id % 3), event_id) AS model, max(event_id) AS l FROM events GROUP BY ALL)
      SELECT 'u' || user_id AS session_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, arg_max(model, l) AS model, count(*) AS messages FROM m GROUP BY user_id""",
)
def transcript_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    counters = F.struct((i % 90).alias("input_tokens"), (i % 7).alias("output_tokens"))
    message = F.struct(F.concat(F.lit("msg"), F.floor(i / 4)).alias("id"), F.concat(F.lit("m"), i % 3).alias("model"), counters.alias("usage"))
    text = F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("u"), "user_id").alias("sessionId"), message.alias("message")))
    lines = A.table(spark, sf_dir, "events").select(F.concat(F.lit("/u"), "user_id").alias("path"), i.alias("line"), text.alias("text"))
    return transcripts.usage_of(lines, transcripts.parts_of(lines))


@query("transcript_sources", "SELECT DISTINCT '/u' || user_id AS path, CASE WHEN user_id % 3 = 0 THEN 'b' WHEN user_id % 3 = 1 THEN 'a' ELSE 'generic' END AS source FROM events")
def transcript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = {x: _lines(spark, sf_dir, x).withColumn("u", F.substring("path", 3, 20).cast("long")) for x in "ab"}
    plain = lines["a"].where("u % 3 = 2").withColumn("text", F.lit('{"type":"note"}'))
    rows = lines["b"].where("u % 3 = 0").unionByName(lines["a"].where("u % 3 = 1")).unionByName(plain)
    first = rows.groupBy("path").agg(F.min("line").alias("first"))
    return transcripts.source_kinds(rows.join(first, "path").withColumn("line", F.col("line") - F.col("first")))


@query("generic_texts", "SELECT doc_id, nullif(concat_ws(chr(10), text, lang, source), '') AS found FROM documents")
def generic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    inner = F.struct(F.col("lang").alias("text"), F.array(F.col("source")).alias("content"), F.lit("no").alias("other"))
    record = F.to_json(F.struct(F.lit("x").alias("type"), F.col("text"), inner.alias("message")))
    return docs.select("doc_id", transcripts.text_within(record).alias("found"))


@query(
    "fallback_observations",
    """SELECT session_key, event_id, kind, path, n FROM (SELECT user_id AS session_key, event_id, CASE WHEN event_type = 'view' THEN 'file_read' ELSE 'session_activity' END AS kind,
      CASE WHEN event_type = 'view' THEN event_type END AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
      WHERE ts >= TIMESTAMP '2024-01-05' AND event_type <> 'signup') WHERE n <= 15""",
)
def fallback_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "signup", "  ").otherwise(F.col("event_type"))
    rows = A.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_key"), "event_id", F.col("ts").alias("ts_utc"), F.when(F.col("event_type") == "view", "file_read").otherwise("other").alias("kind"),
        text.alias("text"), F.col("event_id").alias("source_line"), F.lit(0).alias("event_index"),
    )
    return transcripts.fallback_observations(rows, "2024-01-05", 15).select("session_key", "event_id", "kind", "path", "n")


@query(
    "completed_from_history",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 0 THEN 'completed' WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'interrupted' ELSE 'none' END AS terminal_state,
      event_id % 12 = 0 AS history_confirmed FROM events""",
)
def completed_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = F.col("event_id"), A.table(spark, sf_dir, "events")
    session, message = F.concat(F.lit("u"), "user_id").alias("session_id"), F.concat(F.lit("m"), i).alias("message_id")
    turns = e.select(i.alias("turn_id"), session, F.when(i % 4 == 0, "completed").otherwise("open").alias("status"))
    pairs = transcripts.completed_pairs(turns, e.select(i.alias("turn_id"), message))
    rows = e.select(i, session, message, F.when(i % 3 == 0, "unknown").when(i % 3 == 1, "interrupted").otherwise("none").alias("terminal_state"))
    return transcripts.completed_from_history(rows, pairs).select("event_id", "terminal_state", "history_confirmed")


@query(
    "discovery_queue",
    """SELECT c_custkey, round FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3, c_acctbal DESC, c_name) AS round
      FROM customer WHERE c_custkey % 4 <> 0) ORDER BY round, c_nationkey LIMIT 60""",
)
def discovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = A.table(spark, sf_dir, "customer").select(k, F.col("c_nationkey").alias("pattern"), (k % 3).alias("attempted"), F.col("c_acctbal").alias("modified"), F.col("c_name").alias("path"), (k % 4 == 0).alias("done"))
    return transcripts.discovery_queue(rows, 60).select("c_custkey", "round")


@query("replaced_sessions", "SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM events WHERE user_id % 5 <> 0 OR event_id % 2 = 0")
def replaced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("event_id", "user_id")
    new = rows.where("user_id % 5 = 0 and event_id % 2 = 0").withColumn("state", F.lit("new"))
    return sinks.replaced_sessions(rows.withColumn("state", F.lit("old")), new, rows.where("user_id % 5 = 0"), "user_id").select("event_id", "user_id", "state")


@query(
    "additive_upsert",
    """SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
)
def additive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    # what two runs took in, which share most of their days
    run = F.when(F.col("event_id") % 3 == 1, "old").otherwise("new")
    part = lambda k: e.where(run == k).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return sinks.added_counts(part("old"), part("new"), ["event_type", "day"])


# --- coverage, lanes, measurement ---------------------------------------------------------------

_LANES = f"""{OBS}, {RULES}, cl AS (SELECT 'D-04' AS detector_id, program AS key, count(DISTINCT session_id) AS sessions FROM obs GROUP BY program),
  was AS (SELECT *, '/f/' || (CAST(substr(key, 4) AS INTEGER) + CASE WHEN CAST(substr(key, 4) AS INTEGER) % 4 = 0 THEN 120 ELSE 7 END) AS covered_by FROM cl),
  m AS (SELECT key, r.path, r.sha, r.stale FROM cl JOIN rules r ON list_contains(regexp_split_to_array(lower(r.text), '[^\\p{{L}}\\p{{N}}]+'), key)),
  x AS (SELECT w.detector_id, w.key, w.sessions, w.covered_by AS was, m.path, m.sha, m.stale, row_number() OVER (PARTITION BY w.key ORDER BY
      CASE WHEN m.stale = 0 AND m.sha = b.sha THEN 0 WHEN b.sha IS NOT NULL AND m.path = w.covered_by THEN 1 ELSE 2 END, m.stale, m.path) AS n
    FROM was w LEFT JOIN rules b ON b.path = w.covered_by LEFT JOIN m ON m.key = w.key),
  best AS (SELECT detector_id, key, sessions, path AS covered_by, coalesce(stale = 1, false) AS rule_stale, path IS DISTINCT FROM was AS changed,
    CASE CAST(substr(key, 4) AS INTEGER) % 3 WHEN 0 THEN 'escalation' WHEN 1 THEN 'open' ELSE 'dismissed' END AS state FROM x WHERE n = 1)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, obs = A.rule_docs(spark, sf_dir), A.observations(spark, sf_dir)
    k = F.substring("key", 4, 9).cast("int")
    own = obs.groupBy(F.col("program").alias("key")).agg(F.count_distinct("session_id").alias("sessions")).withColumn("detector_id", F.lit("D-04"))
    before = own.withColumn("covered_by", F.concat(F.lit("/f/"), k + F.when(k % 4 == 0, 120).otherwise(7)))
    rules = V.best_rule(D.phrase_matches(docs, own.select(F.col("key").alias("phrase"))), docs, before)
    state = F.when(k % 3 == 0, "escalation").when(k % 3 == 1, "open").otherwise("dismissed")
    return rules.join(own.select("key", "sessions"), "key").withColumn("state", state)


@query("coverage_refresh", f"WITH {_LANES} SELECT detector_id, key, covered_by, rule_stale, changed FROM best")
def coverage_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).select("detector_id", "key", "covered_by", "rule_stale", "changed")


@query(
    "review_lanes",
    f"""WITH {_LANES} SELECT key, state = 'open' AND covered_by IS NULL AND sessions > 0 AS candidate, covered_by IS NOT NULL AS covered,
      sessions > 0 AND (state = 'escalation' OR (state = 'open' AND covered_by IS NOT NULL AND NOT rule_stale)) AS escalation, covered_by IS NOT NULL AND rule_stale AS degraded FROM best""",
)
def review_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lanes(_covered(spark, sf_dir)).select("key", "candidate", "covered", "escalation", "degraded")


@query(
    "covered_measurement",
    f"""WITH {_LANES}, live AS (SELECT detector_id, key, covered_by FROM best WHERE state IN ('open', 'escalation') AND covered_by IN (SELECT path FROM rules WHERE stale = 0)),
      e AS (SELECT program AS key, count(DISTINCT session_id) AS s, count(*) AS n FROM obs WHERE kind = 'run_failed' AND {_in(LATE)} GROUP BY 1 HAVING count(*) > 3)
      SELECT detector_id, key, covered_by, coalesce(s, 0) AS sessions, coalesce(n, 0) AS events FROM live LEFT JOIN e USING (key)""",
)
def covered_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = V.live_coverage(_covered(spark, sf_dir), A.rule_docs(spark, sf_dir))
    failed = A.observations(spark, sf_dir).where((F.col("kind") == "run_failed") & E.in_window("ts_utc", LATE.start, LATE.end))
    by = failed.groupBy(F.col("program").alias("key")).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events")).where("events > 3")
    return V.measured(live, by.withColumn("detector_id", F.lit("D-04")))


@query(
    "lesson_backtest",
    f"""WITH c AS ({_several('cluster')}), w AS ({_several('weekly')}), l AS (SELECT DISTINCT detector_id || ':' || key AS lesson_id, detector_id, key FROM c
        UNION ALL SELECT 'none', 'D-01', 'nothing') SELECT lesson_id, coalesce(sessions, 0) AS sessions, substr(first_seen, 1, 10) AS first_seen,
      (SELECT count(DISTINCT week) FROM w WHERE w.detector_id = l.detector_id AND w.key = l.key) AS weeks_present FROM l LEFT JOIN c USING (detector_id, key)""",
)
def lesson_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(spark, sf_dir)
    none = spark.createDataFrame([("none", "D-01", "nothing")], "lesson_id string, detector_id string, key string")
    lessons = found.select(F.concat_ws(":", "detector_id", "key").alias("lesson_id"), "detector_id", "key").distinct().unionByName(none)
    return V.backtest(lessons, found, cluster_weeks(spark, sf_dir))


@query(
    "routing_layers",
    f"""SELECT detector_id, key, CASE WHEN detector_id = 'D-01' THEN 'environment' ELSE 'retrieval_only' END AS layer FROM ({_several('cluster')})""",
)
def routing_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).select("detector_id", "key", V.routing(F.concat("detector_id", F.lit("@1")), F.col("key")).alias("layer"))


@query(
    "digest_order",
    f"""WITH w AS ({ORACLES['waste_equal_split']}), r AS (SELECT *, CASE WHEN sessions % 4 = 0 THEN 0 WHEN sessions % 4 = 1 THEN 1 WHEN sessions % 4 = 2 THEN 2 ELSE 3 END AS t,
        CASE WHEN sessions % 3 = 0 THEN 0 WHEN sessions % 3 = 1 THEN 1 ELSE 4 END AS v FROM w)
      SELECT detector_id, key, row_number() OVER (ORDER BY t, v, est_cost DESC NULLS LAST, est_tokens DESC NULLS LAST, detector_id, key) AS place FROM r ORDER BY place LIMIT 25""",
)
def digest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sessions")
    trend = F.when(n % 4 == 0, "new").when(n % 4 == 1, "accelerating").when(n % 4 == 2, "insufficient_history")
    rows = waste_equal_split(spark, sf_dir).withColumn("trend", trend).withColumn("verdict", F.when(n % 3 == 0, "new").when(n % 3 == 1, "worsening"))
    rows = rows.withColumnRenamed("est_cost", "waste_usd").withColumnRenamed("est_tokens", "tokens")
    return V.numbered(rows, V.digest_order(), 25).select("detector_id", "key", "place")


@query(
    "trend_order",
    f"""SELECT detector_id, key, row_number() OVER (ORDER BY CASE WHEN status = 'new' THEN 0 ELSE 1 END, coalesce(excess, 0) DESC, detector_id, key) AS place
      FROM ({ORACLES['trend_ewma']}) ORDER BY place LIMIT 20""",
)
def trend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.numbered(trend_ewma(spark, sf_dir), V.trend_order(), 20).select("detector_id", "key", "place")


@query(
    "brief_top5",
    f"""WITH {OBS}, c AS ({_several('cluster')}), s AS (SELECT DISTINCT session_id FROM obs WHERE path = '/f/7'), h AS ({_several('session')}),
      m AS (SELECT detector_id, key, count(DISTINCT session_id) AS matched FROM h JOIN s USING (session_id) GROUP BY ALL)
      SELECT detector_id, key, matched, row_number() OVER (ORDER BY {_ORDER}) AS place FROM (SELECT *, {_SCORE} AS s FROM c JOIN m USING (detector_id, key)) ORDER BY place LIMIT 5""",
)
def brief_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = A.observations(spark, sf_dir).where("path = '/f/7'").select("session_id")
    found = V.brief(clusters(spark, sf_dir), cluster_sessions(spark, sf_dir), scope, NOW, 30, 5)
    return found.select("detector_id", "key", "matched", "place")


# --- places, sources, follow-up -----------------------------------------------------------------


@query(
    "host_freshness",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN event_id % 10 = 1 THEN 'ingested_later_than_generated' WHEN ts > TIMESTAMP '2024-01-20 00:05:00' THEN 'ahead_of_clock'
      WHEN ts < TIMESTAMP '2024-01-17' THEN 'generated_long_ago' WHEN ts - INTERVAL 6 HOUR < TIMESTAMP '2024-01-17' THEN 'ingested_long_ago' ELSE 'current' END AS state FROM events""",
)
def host_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, iso = F.col("event_id"), lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    made = F.when(i % 10 == 0, "yesterday").otherwise(iso("ts"))
    taken = iso(F.when(i % 10 == 1, F.col("ts") + F.expr("interval 1 second")).otherwise(F.col("ts") - F.expr("interval 6 hours")))
    return A.table(spark, sf_dir, "events").select("event_id", V.freshness(made, taken, F.lit("2024-01-20").cast("timestamp")).alias("state"))


@query("path_scope", "SELECT event_id, event_id % 3 <> 2 AS inside FROM events")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    place = F.when(i % 3 == 0, F.concat(F.lit("/w/r"), i)).when(i % 3 == 1, F.concat(F.lit("/w/r"), i, F.lit("/src"))).otherwise(F.concat(F.lit("/w/r"), i, F.lit("x")))
    return A.table(spark, sf_dir, "events").select("event_id", V.within(place, F.concat(F.lit("/w/r"), i)).alias("inside"))


@query("unseen_groups", "SELECT c_custkey AS group_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)")
def unseen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 3).alias("epoch"))
    return V.unseen_groups(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id")), refs, 1)


_LOCATED = """o AS (SELECT event_id AS obs_id, user_id AS session_id, ts, 't' || (event_id % 50) AS excerpt FROM events),
  ev AS (SELECT event_id, user_id AS session_id, ts, 't' || (event_id % 50) AS text FROM events WHERE event_id % 4 <> 0
    UNION ALL SELECT event_id + 1000000, user_id, ts, 't' || (event_id % 50) FROM events WHERE event_id % 9 = 1),
  loc AS (SELECT obs_id, o.session_id, CASE WHEN count(event_id) = 1 THEN min(event_id) END AS event_id, CASE count(event_id) WHEN 0 THEN 'missing' WHEN 1 THEN 'verified' ELSE 'ambiguous' END AS status
    FROM o LEFT JOIN ev ON ev.session_id = o.session_id AND ev.ts = o.ts AND ev.text = o.excerpt GROUP BY ALL)"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, text = A.table(spark, sf_dir, "events"), F.concat(F.lit("t"), F.col("event_id") % 50)
    obs = e.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("ts_utc"), text.alias("excerpt"))
    one = lambda rows, add: rows.select((F.col("event_id") + add).alias("event_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("ts_utc"), text.alias("text"))
    return V.located(obs, one(e.where("event_id % 4 <> 0"), 0).unionByName(one(e.where("event_id % 9 = 1"), 1_000_000)))


@query("source_locations", f"WITH {_LOCATED} SELECT obs_id, session_id, event_id, status FROM loc")
def source_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir)


@query(
    "verified_lessons",
    f"""WITH {_LOCATED}, s AS (SELECT session_id, bool_and(status = 'verified') AS ok FROM loc GROUP BY 1), l AS (SELECT DISTINCT user_id % 13 AS lesson_id, user_id AS session_id FROM events)
      SELECT lesson_id, count(*) AS expected, count(*) FILTER (ok) AS verified, count(*) = count(*) FILTER (ok) AS complete FROM l LEFT JOIN s USING (session_id) GROUP BY 1""",
)
def verified_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = A.table(spark, sf_dir, "events").select((F.col("user_id") % 13).alias("lesson_id"), F.col("user_id").alias("session_id")).distinct()
    return V.verified_lessons(lessons, _located(spark, sf_dir))


@query(
    "cut_keys",
    """WITH v AS (SELECT text AS value FROM documents WHERE length(text) >= 240), k AS (SELECT DISTINCT substr(value, 1, 240) AS key FROM v)
      SELECT 'D-02' AS detector_id, key, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) AS sources FROM k JOIN v ON substr(value, 1, 240) = key GROUP BY key""",
)
def cut_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = A.table(spark, sf_dir, "documents").select(F.col("text").alias("value")).where("length(value) >= 240")
    keys = values.select(F.lit("D-02").alias("detector_id"), F.substring("value", 1, 240).alias("key")).distinct()
    return V.cut_keys(keys, values)


@query(
    "source_coverage",
    """WITH i AS (SELECT user_id AS k, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1),
      s AS (SELECT DISTINCT user_id AS k, 'kind' || (user_id % 3) AS kind FROM events), x AS (SELECT k, 'src' || (k % 2) AS source, k % 5 AS omitted, k % 4 AS truncated FROM s WHERE k % 6 <> 0)
      SELECT coalesce(source, kind) AS source, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS interactions, CAST(sum(coalesce(omitted, 0)) AS BIGINT) AS omitted,
        CAST(sum(coalesce(truncated, 0)) AS BIGINT) AS truncated, count(*) FILTER (omitted IS NULL) AS missing_summaries FROM s JOIN i USING (k) LEFT JOIN x USING (k) GROUP BY 1""",
)
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_key"), F.col("ts").alias("ts_utc"))
    k, session = F.col("session_key"), e.select("session_key").distinct()
    summary = session.where(k % 6 != 0).select(k, F.concat(F.lit("src"), k % 2).alias("source"), (k % 5).alias("omitted"), (k % 4).alias("truncated"))
    return V.source_coverage(session.withColumn("source_kind", F.concat(F.lit("kind"), k % 3)), summary, e, "2024-01-05", "2024-01-12")


@query(
    "lesson_follow_up",
    """WITH l AS (SELECT * FROM (VALUES ('l1', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-20'), ('l2', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11'), ('l3', TIMESTAMP '2030-01-01', TIMESTAMP '2031-01-01')) AS t(lesson_id, a, b)),
      e AS (SELECT user_id AS k, ts, event_id % 6 = 0 AS advice, CASE event_id % 5 WHEN 0 THEN 'withheld' WHEN 1 THEN 'unknown' ELSE 'authorized' END AS au,
        CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'known' END AS cx, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'interrupted' END AS t, user_id % 4 <> 0 AS whole FROM events),
      j AS (SELECT *, NOT (advice OR au = 'withheld') AS counts, au = 'authorized' AND cx = 'known' AS plain FROM l JOIN e ON ts >= a AND ts < b),
      g AS (SELECT lesson_id, count(DISTINCT k) AS sessions, count(*) FILTER (counts AND plain) AS eligible, count(*) FILTER (counts AND NOT plain) AS unknown_opportunities,
        count(*) FILTER (counts AND plain AND whole AND t = 'completed') AS completed, count(*) FILTER (counts AND plain AND whole AND t = 'interrupted') AS interrupted FROM j GROUP BY 1)
      SELECT lesson_id, coalesce(sessions, 0) AS sessions, coalesce(eligible, 0) AS eligible, coalesce(unknown_opportunities, 0) AS unknown_opportunities, coalesce(completed, 0) AS completed,
        coalesce(interrupted, 0) AS interrupted, coalesce(eligible - completed - interrupted, 0) AS unknown FROM l LEFT JOIN g USING (lesson_id)""",
)
def lesson_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = F.col("event_id"), A.table(spark, sf_dir, "events")
    lessons = spark.createDataFrame([("l1", "2024-01-03", "2024-01-20"), ("l2", "2024-01-10", "2024-01-11"), ("l3", "2030-01-01", "2031-01-01")], "lesson_id string, a string, b string")
    lessons = lessons.select("lesson_id", F.col("a").cast("timestamp").alias("applied_at"), F.col("b").cast("timestamp").alias("until"))
    episode = e.select(
        F.col("user_id").alias("session_key"), F.col("ts").alias("started_at"), (i % 6 == 0).alias("advice_only"),
        F.when(i % 5 == 0, "withheld").when(i % 5 == 1, "unknown").otherwise("authorized").alias("authority"), F.when(i % 7 == 0, "unknown").otherwise("known").alias("context"),
        F.when(i % 3 == 0, "completed").when(i % 3 == 1, "interrupted").alias("terminal"),
    )
    return V.follow_up(lessons, episode, e.where("user_id % 4 <> 0").select(F.col("user_id").alias("session_key")))


@query(
    "lesson_recurrence",
    f"""WITH {OBS}, l AS (SELECT DISTINCT signature || '!' AS lesson_id, signature, TIMESTAMP '2024-01-09' AS a, TIMESTAMP '2024-01-16' AS b FROM obs)
      SELECT lesson_id, count(DISTINCT obs_id) FILTER (kind = 'run_failed' AND ts_utc >= a AND ts_utc < b) AS events FROM l LEFT JOIN obs USING (signature) GROUP BY 1""",
)
def lesson_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.observations(spark, sf_dir)
    at = lambda x: F.lit(x).cast("timestamp")
    lessons = obs.select(F.concat("signature", F.lit("!")).alias("lesson_id"), "signature", at("2024-01-09").alias("applied_at"), at("2024-01-16").alias("until")).distinct()
    return V.recurrences(lessons, obs)


@query(
    "lesson_flow",
    """WITH l AS (SELECT CASE event_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'accepted' WHEN 2 THEN 'applied' ELSE 'other' END AS state, ts AS m, ts + INTERVAL 40 DAY AS a FROM events)
      SELECT s.state, count(l.state) AS lessons FROM (VALUES ('draft'), ('accepted'), ('applied'), ('resolved')) AS s(state)
      LEFT JOIN l ON l.state = s.state AND CASE WHEN l.state = 'applied' THEN a ELSE m END BETWEEN TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AND TIMESTAMP '2024-02-15' GROUP BY 1""",
)
def lesson_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    state = F.when(i % 5 == 0, "draft").when(i % 5 == 1, "accepted").when(i % 5 == 2, "applied").otherwise("other")
    rows = A.table(spark, sf_dir, "events").select(state.alias("state"), F.col("ts").alias("modified_at"), (F.col("ts") + F.expr("interval 40 days")).alias("applied_at"))
    return V.lesson_flow(rows, "2024-02-15", 30)


@query(
    "learning_health",
    """WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'needs_evaluation' WHEN 2 THEN 'active' ELSE 'proposed' END AS state, CASE WHEN event_id % 9 <> 0 THEN ts END AS t FROM events)
      SELECT id, 'ownership_conflict' AS kind FROM r WHERE state = 'conflict' UNION ALL SELECT id, 'missing_evaluator' FROM r WHERE state = 'needs_evaluation'
      UNION ALL SELECT id, 'stale_pending' FROM r WHERE state <> 'active' AND (t IS NULL OR t < TIMESTAMP '2024-01-20' - INTERVAL 1 DAY)""",
)
def learning_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    state = F.when(i % 4 == 0, "conflict").when(i % 4 == 1, "needs_evaluation").when(i % 4 == 2, "active").otherwise("proposed")
    return V.learning_health(A.table(spark, sf_dir, "events").select(i.alias("id"), state.alias("state"), F.when(i % 9 != 0, F.col("ts")).alias("created_at")), "2024-01-20")


@query(
    "dead_man",
    f"""WITH {OBS} SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) AS arrivals, (SELECT count(*) FROM obs WHERE ts_utc BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20') AS observations,
      (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) > 0 AND (SELECT count(*) FROM obs WHERE ts_utc BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20') = 0 AS dead""",
)
def dead_man(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-01-19 12:00:00").cast("timestamp")).otherwise(F.lit("2023-01-01").cast("timestamp"))
    return V.dead_man(A.table(spark, sf_dir, "orders").select(at.alias("modified")), A.observations(spark, sf_dir), "2024-01-20")


@query("error_streaks", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END, 0) + 1 END AS runs FROM events")
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return A.table(spark, sf_dir, "events").select("event_id", error_streak(F.when(i % 5 != 0, i % 4), i % 3).alias("runs"))


#: What the turns of a conversation say, by their place in it; bits as in readings.cycle_code.
_CYCLE_SQL = """t AS (SELECT conv_id, turn, role, turn % 4 AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  c AS (SELECT *, CASE WHEN role = 'user' AND p IN (0, 1) AND conv_id % 5 < 4 THEN 9 WHEN role = 'user' AND conv_id % 7 = 3 THEN 2 WHEN role = 'user' AND p IN (2, 3) THEN 8
    WHEN role = 'assistant' AND p IN (1, 2) THEN 4 WHEN role = 'assistant' AND conv_id % 3 > 0 THEN 16 ELSE 0 END AS code FROM t)"""


@query(
    "work_cycles",
    f"""WITH RECURSIVE {_CYCLE_SQL},
      f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 0 AS stage, CAST([] AS BIGINT[]) AS turns, CAST(NULL AS BIGINT[]) AS found FROM c
        UNION ALL SELECT conv_id, k, CASE does WHEN 'begin' THEN 1 WHEN 'on' THEN stage + 1 WHEN 'add' THEN stage ELSE 0 END, CASE WHEN does = 'begin' THEN [turn] WHEN does IN ('on', 'add') THEN turns || [turn] ELSE CAST([] AS BIGINT[]) END,
          CASE WHEN does = 'end' THEN turns || [turn] END
        FROM (SELECT c.conv_id, c.k, c.turn, f.stage, f.turns, CASE WHEN f.stage = 0 THEN CASE WHEN code & 1 > 0 THEN 'begin' ELSE 'drop' END WHEN code & 2 > 0 OR len(f.turns) >= 24 THEN 'drop' WHEN f.stage = 4 AND code & 1 > 0 THEN 'end'
            WHEN (f.stage = 1 AND code & 4 > 0) OR (f.stage = 2 AND code & 8 > 0) OR (f.stage = 3 AND code & 16 > 0) THEN 'on' WHEN code & 1 > 0 AND f.stage <> 3 THEN 'begin' ELSE 'add' END AS does
          FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1))
      SELECT CAST(conv_id AS VARCHAR) AS session_key, found[1] AS "first", found[-1] AS "last", array_to_string(found, ',') AS ordinals FROM f WHERE found IS NOT NULL""",
)
def work_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, p, role = F.col("conv_id"), F.col("turn") % 4, F.col("role")
    text = (
        F.when((role == "user") & p.isin(0, 1) & (conv % 5 < 4), "Please complete the whole workflow").when((role == "user") & (conv % 7 == 3), "Stop now")
        .when((role == "user") & p.isin(2, 3), "What are the lessons?").when((role == "assistant") & p.isin(1, 2), "It is implemented and deployed.")
        .when((role == "assistant") & (conv % 3 > 0), "My earlier claim was\nfar too broad.").otherwise("hm")
    )
    turns = A.table(spark, sf_dir, "conversations").select(conv.alias("session_key"), F.col("turn").alias("ordinal"), "role", text.alias("text"))
    return S.work_cycles(turns).withColumn("ordinals", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ","))


# --- autonomy and interventions -----------------------------------------------------------------


@query(
    "autonomy_keys",
    """SELECT event_id, 'autonomy:D-12:fix:' || CASE WHEN event_id % 3 = 0 THEN 'unspecified' ELSE 'item' || (event_id % 7) END AS key, 'fix:' || CASE WHEN event_id % 3 = 0 THEN 'the' ELSE 'the item' || (event_id % 7) || ' now' END
      || CASE WHEN event_id % 2 = 0 THEN ' | write:docs' ELSE '' END AS actions FROM events""",
)
def autonomy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    thing = F.when(i % 3 == 0, "the").otherwise(F.concat(F.lit("The Item"), i % 7, F.lit("  now")))
    text = F.concat(F.lit("Please fix "), thing, F.when(i % 2 == 0, " and write docs.").otherwise("."))
    rows = A.table(spark, sf_dir, "events").withColumn("actions", V.actions_of(text))
    return rows.select("event_id", V.autonomy_key(F.lit("D-12"), F.col("actions")[0]).alias("key"), F.array_join("actions", " | ").alias("actions"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of the episodes, with replies that offer, abandon and block what may be pending, and tools that check and tell.

    Of three conversations one has a tool where the agent would offer, which checks that the agent can, or tells that it has finished.
    """
    conv, n = F.col("session_key"), (F.col("session_key") + F.col("ordinal")) % 4
    action = F.concat(F.lit("fix item "), conv % 5, F.lit("-"), F.floor(F.col("ordinal") / 4))
    checks = F.when(conv % 2 == 0, F.concat(F.lit("Capability check: "), action, F.lit(" available under current access. Exit code: 0"))).otherwise("The run has finished.")
    said = F.when((n == 0) & (conv % 3 == 0), checks).when(n == 0, F.concat(F.lit("I can "), action, F.lit(" if you approve.")))
    said = said.when(n == 1, F.concat(F.lit("I am abandoning "), action, F.when(conv % 2 == 0, ", approve it again.").otherwise(".")))
    said = said.when(n == 2, F.concat(F.lit("I cannot "), action, F.lit(" under current access."))).otherwise("fine")
    reply = F.col("origin") == "assistant_text"
    origin = F.when(reply & (n == 0) & (conv % 3 == 0), "tool_result").otherwise(F.col("origin"))
    return _requests(spark, sf_dir).withColumn("text", F.when(reply, said).otherwise(F.col("text"))).withColumn("origin", origin)


_SHORT = f"""{_EPISODES}, sa AS (SELECT conv_id, turn, (conv_id + turn) % 4 AS m, 'fix:item ' || (conv_id % 5) || '-' || (turn // 4) AS action FROM conversations WHERE role = 'assistant'),
  fam AS (SELECT conv_id, turn, action, unnest(CASE WHEN m = 0 AND conv_id % 3 = 0 THEN [] WHEN m = 0 THEN ['D-12', 'D-13'] WHEN m = 1 AND conv_id % 2 = 0 THEN [] WHEN m = 1 THEN ['D-15'] WHEN m = 2 THEN ['D-16'] ELSE [] END) AS family FROM sa),
  cand AS (SELECT session_key, episode, family, arg_min(action, turn) AS action, min(turn) AS ordinal FROM ep JOIN fam ON conv_id = session_key AND turn BETWEEN start_ordinal AND end_ordinal AND action = action_key GROUP BY ALL)"""


@query("autonomy_shortlist", f"WITH {_SHORT} SELECT * FROM cand")
def autonomy_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    return V.shortlist(S.episodes(rows), rows).withColumn("episode", F.col("episode").cast("long")).drop("text")


@query(
    "autonomy_assessment",
    f"""WITH {_SHORT}, x AS (SELECT cand.*, ep.lifecycle, ep.authority, ep.context, EXISTS (SELECT 1 FROM sa WHERE sa.conv_id = session_key AND m = 0 AND sa.conv_id % 6 = 3 AND sa.turn BETWEEN start_ordinal AND end_ordinal) AS told,
        EXISTS (SELECT 1 FROM sa WHERE sa.conv_id = session_key AND m = 0 AND sa.conv_id % 6 = 0 AND sa.turn BETWEEN start_ordinal AND end_ordinal AND sa.action = cand.action) AS checked FROM cand JOIN ep USING (session_key, episode))
      SELECT session_key, episode, family, 'autonomy:' || family || ':fix:item' AS cluster_key, CASE WHEN lifecycle IN ('cancelled', 'completed') OR told THEN 'dismissed'
        WHEN authority <> 'authorized' OR lifecycle <> 'active' OR family <> 'D-16' OR NOT checked THEN 'needs_review' ELSE 'supported' END AS disposition FROM x""",
)
def autonomy_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    found = S.episodes(rows)
    got = V.assessed(V.shortlist(found, rows), found, rows)
    return got.select("session_key", F.col("episode").cast("long").alias("episode"), "family", "cluster_key", "disposition")


@query(
    "autonomy_inspection",
    f"""WITH {OBS} SELECT obs_id AS candidate_id, 'D-' || (12 + obs_id % 5) AS family, session_id, CASE WHEN obs_id % 13 = 0 AND obs_id % 3 <> 0 THEN CASE WHEN obs_id % 2 = 0 THEN 'supported' ELSE 'rejected' END
      WHEN obs_id % 13 = 0 THEN 'needs_review' WHEN obs_id % 11 < 6 THEN 'supported' ELSE 'rejected' END AS disposition, obs_id % 39 = 0 AS stale_adjudication FROM obs WHERE kind = 'run_failed'""",
)
def autonomy_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inspected(**_assessments(spark, sf_dir))


@query(
    "intervention_signals",
    f"""SELECT session_key, ordinal, CASE WHEN category IN ('task_start', 'ordinary_request') THEN 'negative' WHEN category = 'ambiguous' THEN 'unknown' ELSE 'candidate' END AS signal,
      CASE category WHEN 'task_start' THEN 10 WHEN 'ordinary_request' THEN 15 WHEN 'question' THEN 80 WHEN 'ambiguous' THEN 40 ELSE 90 END AS rank FROM ({ORACLES['intervention_classes']})""",
)
def intervention_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervention_classes(spark, sf_dir).withColumn("s", V.intervention_signal(F.col("category")))
    return rows.select("session_key", "ordinal", "s.signal", "s.rank")


@query(
    "intervention_counts",
    f"""WITH c AS (SELECT *, CASE WHEN signal = 'negative' THEN 'negative_sample' ELSE 'pending_interpretation' END AS state FROM ({ORACLES['intervention_signals']}) JOIN ({ORACLES['intervention_classes']}) USING (session_key, ordinal))
      SELECT 'state' AS what, state AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'signal', signal, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY ALL
      UNION ALL SELECT 'flag', 'uncertain_intervention', count(*) FROM c WHERE category = 'ambiguous' HAVING count(*) > 0""",
)
def intervention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.intervention_signal(F.col("category"))
    state = F.when(s["signal"] == "negative", "negative_sample").otherwise("pending_interpretation")
    flags = F.when(F.col("category") == "ambiguous", F.array(F.lit("uncertain_intervention"))).otherwise(F.array().cast("array<string>"))
    return V.intervention_counts(intervention_classes(spark, sf_dir).select(state.alias("state"), s["signal"].alias("signal"), "category", flags.alias("flags")))


@query(
    "intervention_context",
    """WITH h AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'),
      p AS (SELECT h.conv_id, h.turn, a.turn AS pos, row_number() OVER (PARTITION BY h.conv_id, h.turn ORDER BY a.turn DESC) AS r FROM h JOIN a ON a.conv_id = h.conv_id AND a.turn < h.turn),
      f AS (SELECT h.conv_id, h.turn, a.turn AS pos, row_number() OVER (PARTITION BY h.conv_id, h.turn ORDER BY a.turn) AS r FROM h JOIN a ON a.conv_id = h.conv_id AND a.turn > h.turn
        WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = h.conv_id AND x.turn > h.turn AND x.turn < a.turn))
      SELECT h.conv_id AS session_key, h.turn AS ordinal, coalesce((SELECT string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FROM p WHERE p.conv_id = h.conv_id AND p.turn = h.turn AND r <= 2), '') AS previous,
        coalesce((SELECT string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FROM f WHERE f.conv_id = h.conv_id AND f.turn = h.turn AND r <= 3), '') AS following FROM h""",
)
def intervention_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.with_context(A.interactions(spark, sf_dir), 2, 3)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("session_key", "ordinal", text("previous"), text("following"))


@query(
    "standing_directions",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'global' WHEN 1 THEN 'repository' WHEN 2 THEN 'repository' END AS breadth FROM events""",
)
def standing_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, " For all future tasks: run the tests").when(k == 1, "Never push to main").when(k == 2, "From now on, use tabs").when(k == 3, 'Always "quote"')
        .when(k == 4, "Remember: user: said so").otherwise("please fix it")
    )
    return A.table(spark, sf_dir, "events").select("event_id", V.directive(text)["breadth"].alias("breadth"))


@query("sentinels", "SELECT event_id, event_id % 3 = 0 AS interrupted, event_id % 3 = 1 AS rejected FROM events")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, transcripts.INTERRUPT).when(k == 1, F.concat(F.lit("well: "), F.lit(transcripts.REJECTIONS[1]), F.lit(".")))
    text = text.otherwise(F.concat(F.lit("not "), F.lit(transcripts.INTERRUPT)))
    return A.table(spark, sf_dir, "events").select("event_id", transcripts.is_interrupt(text).alias("interrupted"), transcripts.is_rejection(text).alias("rejected"))
