"""What a reviewer reads: lanes, coverage, routing, follow-up, health and autonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.functions.exprs import VERBS, action_key, in_window
from snagline.operators.reports import AUTONOMY, ranked


# --- coverage and lanes -------------------------------------------------------------------------


def best_rule(matches: DataFrame, rule_doc: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters with the rule that covers them, or none; an obsolete marker is cleared.

    clusters has (detector_id, key, covered_by) and may have preferred_sha;
    matches has (phrase, path), the phrase being a key.  A live rule of the
    content that covered the cluster before comes first, wherever it stands now,
    then the path that did, then live before stale, by path.
    """
    docs = rule_doc.select("path", "sha", F.col("stale").alias("rule_stale"))
    before = docs.select(F.col("path").alias("covered_by"), F.col("sha").alias("sha_before"))
    asked = clusters.select("detector_id", "key", "covered_by", *([F.col("preferred_sha")] if "preferred_sha" in clusters.columns else [F.lit(None).cast("string").alias("preferred_sha")]))
    asked = asked.join(before, "covered_by", "left").withColumn("known", F.coalesce("preferred_sha", "sha_before"))
    found = asked.join(matches.select(F.col("phrase").alias("key"), "path"), "key").join(docs, "path")
    live = F.col("rule_stale") == 0
    rank = F.when(live & (F.col("sha") == F.col("known")), 0).when(F.col("known").isNotNull() & (F.col("path") == F.col("covered_by")), 1).otherwise(2)
    best = F.min_by(F.struct("path", "sha", "rule_stale"), F.struct(rank, "rule_stale", "path"))
    own = found.groupBy("detector_id", "key").agg(best.alias("rule"))
    rows = asked.select("detector_id", "key", F.col("covered_by").alias("was")).join(own, ["detector_id", "key"], "left")
    path = F.col("rule.path")
    return rows.select(
        "detector_id", "key", path.alias("covered_by"), F.col("rule.sha").alias("rule_sha"),
        F.coalesce(F.col("rule.rule_stale") == 1, F.lit(False)).alias("rule_stale"), (~path.eqNullSafe(F.col("was"))).alias("changed"),
    )


def lanes(clusters: DataFrame, no_lessons: tuple[str, ...] = ()) -> DataFrame:
    """Adds candidate, covered, escalation and degraded; clusters has state, covered_by, rule_stale and sessions."""
    enough = (F.col("sessions") > 0) & (~F.col("detector_id").isin(*AUTONOMY) | (F.col("sessions") >= 2))
    covered = F.col("covered_by").isNotNull()
    lesson = ~F.col("detector_id").isin(*no_lessons) if no_lessons else F.lit(True)
    again = (F.col("state") == "escalation") | ((F.col("state") == "open") & covered & ~F.col("rule_stale"))
    return clusters.select(
        "*", ((F.col("state") == "open") & ~covered & enough & lesson).alias("candidate"), covered.alias("covered"),
        (enough & again).alias("escalation"), (covered & F.col("rule_stale")).alias("degraded"),
    )


def live_coverage(clusters: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """Clusters under review that a live rule covers."""
    live = rule_doc.where("stale = 0").select(F.col("path").alias("covered_by"))
    return clusters.where(F.col("state").isin("open", "escalation")).join(live, "covered_by", "left_semi")


def measured(covered: DataFrame, emitted: DataFrame) -> DataFrame:
    """Counts of covered clusters in a replay of their detectors; what is not emitted any more has none."""
    now = emitted.select("detector_id", "key", "sessions", "events")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sessions", "events")]
    return covered.select("detector_id", "key", "covered_by").join(now, ["detector_id", "key"], "left").select("detector_id", "key", "covered_by", *zero)


def backtest(lessons: DataFrame, clusters: DataFrame, weeks: DataFrame) -> DataFrame:
    """What a lesson's cluster was over the replayed window: sessions, first day and weeks with hits."""
    present = weeks.groupBy("detector_id", "key").agg(F.count_distinct("week").alias("weeks_present"))
    own = clusters.select("detector_id", "key", F.col("sessions").alias("n"), F.substring("first_seen", 1, 10).alias("first_seen"))
    rows = lessons.join(own, ["detector_id", "key"], "left").join(present, ["detector_id", "key"], "left")
    some = F.coalesce(F.col("n") > 0, F.lit(False))
    return rows.select(
        "lesson_id", F.when(some, F.col("n")).otherwise(0).cast("long").alias("sessions"), F.when(some, F.col("first_seen")).alias("first_seen"),
        F.when(some, F.coalesce("weeks_present", F.lit(0))).otherwise(0).cast("long").alias("weeks_present"),
    )


def routing(detector_id: Column, key: Column) -> Column:
    """The strongest layer that the evidence bears out: a missing command can be installed, the rest only be told."""
    base = F.substring_index(detector_id, "@", 1)
    return F.when((base == "D-01") & F.startswith(key, F.lit("command-not-found:")), "environment").otherwise("retrieval_only")


def digest_order() -> list[Column]:
    """New, accelerating, unproven, other; then by verdict; known dollars first, the most before; then tokens."""
    trend = F.when(F.col("trend") == "new", 0).when(F.col("trend") == "accelerating", 1).when(F.col("trend") == "insufficient_history", 2).otherwise(3)
    verdict = F.when(F.col("verdict") == "new", 0).when(F.col("verdict") == "worsening", 1).when(F.col("verdict") == "gone", 2).when(F.col("verdict") == "improving", 3).otherwise(4)
    known = lambda c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c)).desc_nulls_last()
    return [trend, verdict, known("waste_usd"), known("tokens"), F.asc("detector_id"), F.asc("key")]


def trend_order() -> list[Column]:
    """New before the rest, the largest excess first."""
    return [F.when(F.col("status") == "new", 0).otherwise(1), F.coalesce("excess", F.lit(0.0)).desc(), F.asc("detector_id"), F.asc("key")]


def numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, with their place; only those are numbered."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def brief(clusters: DataFrame, hits: DataFrame, scope: DataFrame, now: str, days: int, limit: int) -> DataFrame:
    """Of the clusters that have a session in scope the first by score, with how many of them."""
    inside = hits.join(scope.select("session_id").distinct(), "session_id", "left_semi")
    matched = inside.groupBy("detector_id", "key").agg(F.count_distinct("session_id").alias("matched"))
    return ranked(clusters.join(matched, ["detector_id", "key"]), now, days, limit, "matched")


# --- hosts and places ---------------------------------------------------------------------------


def freshness(generated: Column, ingested: Column, now: Column) -> Column:
    """current, or what makes a host's report stale; a time that cannot be read is stale."""
    made, taken = F.try_to_timestamp(generated), F.try_to_timestamp(ingested)
    readable = generated.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & ingested.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & made.isNotNull() & taken.isNotNull()
    late = now - F.make_interval(hours=F.lit(72))
    return (
        F.when(~F.coalesce(readable, F.lit(False)), "malformed")
        .when(taken > made, "ingested_later_than_generated")
        .when(made > now + F.make_interval(mins=F.lit(5)), "ahead_of_clock")
        .when(made < late, "generated_long_ago")
        .when(taken < late, "ingested_long_ago")
        .otherwise("current")
    )


def within(place: Column, root: Column) -> Column:
    """Whether a folder is the root or below it."""
    return (place == root) | F.startswith(place, F.concat(root, F.lit("/")))


def unseen_groups(known: DataFrame, refs: DataFrame, epoch: int) -> DataFrame:
    """Groups that the listing of an epoch does not have."""
    return known.join(refs.where(F.col("epoch") == epoch).select("group_id"), "group_id", "left_anti")


def located(observation: DataFrame, event: DataFrame) -> DataFrame:
    """Observations with how many events of their session have their time and text: exactly one is the source.

    Returns obs_id, session_id, event_id (of the only one), status.
    """
    found = event.groupBy("session_id", "ts_utc", "text").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    o, f = observation.alias("o"), found.alias("f")
    same = (F.col("o.session_id") == F.col("f.session_id")) & (F.col("o.ts_utc") == F.col("f.ts_utc")) & (F.col("o.excerpt") == F.col("f.text"))
    status = F.when(F.col("f.n").isNull(), "missing").when(F.col("f.n") > 1, "ambiguous").otherwise("verified")
    return o.join(f, same, "left").select("o.obs_id", "o.session_id", F.when(F.col("f.n") == 1, F.col("f.event_id")).alias("event_id"), status.alias("status"))


def verified_lessons(lesson_sessions: DataFrame, located_rows: DataFrame) -> DataFrame:
    """Lessons with the sessions all of whose observations have one source, and whether those are all."""
    by = located_rows.groupBy("session_id").agg(F.bool_and(F.col("status") == "verified").alias("ok"))
    rows = lesson_sessions.join(by, "session_id", "left").groupBy("lesson_id").agg(F.count("*").alias("expected"), F.count(F.when(F.col("ok"), 1)).alias("verified"))
    return rows.withColumn("complete", F.col("expected") == F.col("verified"))


def cut_keys(clusters: DataFrame, evidence: DataFrame, chars: int = 240) -> DataFrame:
    """Clusters of a full-length key with the only whole value it can come from.

    A key of that length may be cut.  evidence has value; where exactly one
    value begins with the key it is the source, else none is named.
    """
    values = evidence.where(F.length("value") >= chars).groupBy(F.substring("value", 1, chars).alias("key")).agg(
        F.count_distinct("value").alias("n"), F.min("value").alias("value")
    )
    rows = clusters.where(F.length("key") == chars).join(values, "key", "left")
    return rows.select("detector_id", "key", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("sources"))


# --- follow-up and health -----------------------------------------------------------------------


def source_coverage(session: DataFrame, summary: DataFrame, interaction: DataFrame, start: str, end: str) -> DataFrame:
    """By source: sessions and interactions of a window, and what their summaries say is not there."""
    inside = interaction.where(in_window("ts_utc", start, end)).groupBy("session_key").agg(F.count("*").alias("n"))
    rows = session.join(inside, "session_key").join(summary.select("session_key", "source", "omitted", "truncated"), "session_key", "left")
    return rows.groupBy(F.coalesce("source", "source_kind").alias("source")).agg(
        F.count("*").alias("sessions"), F.sum("n").alias("interactions"), F.sum(F.coalesce("omitted", F.lit(0))).cast("long").alias("omitted"),
        F.sum(F.coalesce("truncated", F.lit(0))).cast("long").alias("truncated"), F.count(F.when(F.col("omitted").isNull(), 1)).alias("missing_summaries"),
    )


_COUNTS = ("eligible", "unknown_opportunities", "completed", "interrupted")


def in_scope(lesson: DataFrame, folder: DataFrame) -> DataFrame:
    """(lesson_id, session_key): sessions all of whose folders lie below the lesson's; lessons without folders have none.

    lesson has (lesson_id, folders), folder (session_key, folder).  A folder
    meets the lessons on its ancestors, which are equal to a lesson's folder or not.
    """
    parts = F.split(F.regexp_replace("folder", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    own = folder.select("session_key", "folder").distinct()
    size = own.groupBy("session_key").agg(F.count("*").alias("all"), F.count(F.nullif(F.col("folder"), F.lit(""))).alias("known")).where(F.col("all") == F.col("known"))
    roots = lesson.select("lesson_id", F.explode("folders").alias("root")).select("lesson_id", F.when(F.col("root") == "/", "/").otherwise(F.regexp_replace("root", "/+$", "")).alias("root"))
    met = own.select("session_key", "folder", F.explode(above).alias("root")).join(roots, "root").select("lesson_id", "session_key", "folder").distinct()
    return met.groupBy("lesson_id", "session_key").agg(F.count("*").alias("inside")).join(size, "session_key").where(F.col("inside") == F.col("all")).select("lesson_id", "session_key")


def follow_up(lesson: DataFrame, episode: DataFrame, covered: DataFrame, folder: DataFrame | None = None) -> DataFrame:
    """Per lesson: what became of the episodes that began after it was applied.

    episode has (session_key, started_at, authority, context, advice_only,
    terminal), covered the session_keys without gaps.  Advice and what was
    withheld or revoked is no opportunity; what is not plainly authorised and
    known is an unknown one.  lesson has (lesson_id, applied_at, until) and may
    have folders: those of a lesson with folders (not null) are the sessions in
    scope of folder (see in_scope), met by session.  For the others episodes are
    counted by day and by the day their session had its episode before; a lesson
    meets the days of its window, and single episodes only on its first and last
    day, so that no lesson is compared with every episode.
    """
    rows = episode.join(covered.select("session_key", F.lit(True).alias("whole")).distinct(), "session_key", "left")
    out = F.col("advice_only") | F.col("authority").isin("withheld", "revoked")
    plain = (F.col("authority") == "authorized") & (F.col("context") == "known")
    eligible, whole = ~out & plain, F.coalesce("whole", F.lit(False))
    flags = {
        "eligible": eligible, "unknown_opportunities": ~out & ~plain, "completed": eligible & whole & (F.col("terminal") == "completed"),
        "interrupted": eligible & whole & (F.col("terminal") == "interrupted"),
    }
    before = F.lag("started_at").over(Window.partitionBy("session_key").orderBy("started_at"))
    rows = rows.where("started_at is not null").withColumn("before", before).select(
        "session_key", "started_at", "before", F.to_date("started_at").alias("day"), F.to_date("before").alias("day_before"), *[F.coalesce(v, F.lit(False)).cast("long").alias(k) for k, v in flags.items()]
    )
    scoped = "folders" in lesson.columns
    if scoped and folder is None:
        raise ValueError("lessons with folders need the folders of sessions")
    every = lesson.where("folders is null") if scoped else lesson
    windows = every.where(F.col("until") > F.col("applied_at")).select("lesson_id", "applied_at", "until", F.to_date("applied_at").alias("a"), F.to_date("until").alias("b"))
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    # whole days: counts by day, and how many of them are a session's first since some day
    cells = rows.groupBy("day", "day_before").agg(F.count("*").alias("n"), *sums)
    inner = windows.where(F.date_diff("b", "a") > 1).select("lesson_id", "a", F.explode(F.sequence(F.date_add("a", 1), F.date_sub("b", 1))).alias("day"))
    first = F.col("day_before").isNull() | (F.col("day_before") < F.col("a"))
    days = inner.join(cells, "day").groupBy("lesson_id").agg(F.sum(F.when(first, F.col("n")).otherwise(0)).alias("sessions"), *sums)
    new = (F.col("before").isNull() | (F.col("before") < F.col("applied_at"))).cast("long")
    inside = (F.col("started_at") >= F.col("applied_at")) & (F.col("started_at") < F.col("until"))
    ends = windows.select("lesson_id", "applied_at", "until", F.explode(F.array_distinct(F.array("a", "b"))).alias("day"))
    edges = ends.join(rows, "day").where(inside).groupBy("lesson_id").agg(F.sum(new).alias("sessions"), *sums)
    # episodes of whole days whose session had one on the first day: before the lesson or after
    late = windows.join(rows, F.col("a") == F.col("day_before")).where((F.col("day") > F.col("a")) & (F.col("day") < F.col("b")))
    late = late.groupBy("lesson_id").agg(F.sum(new).alias("sessions"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    found = days.unionByName(edges).unionByName(late)
    if scoped:
        own = in_scope(lesson.where("folders is not null").select("lesson_id", "folders"), folder).join(lesson.select("lesson_id", "applied_at", "until"), "lesson_id")
        own = own.join(rows, "session_key").where(inside).groupBy("lesson_id").agg(F.sum(new).alias("sessions"), *sums)
        found = found.unionByName(own)
    found = found.groupBy("lesson_id").agg(F.sum("sessions").alias("sessions"), *sums)
    rest = F.col("eligible") - F.col("completed") - F.col("interrupted")
    counts = ["sessions", *_COUNTS, "unknown"]
    return lesson.select("lesson_id").join(found.withColumn("unknown", rest), "lesson_id", "left").select("lesson_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def recurrences(lesson: DataFrame, observation: DataFrame) -> DataFrame:
    """Per lesson (lesson_id, signature, applied_at, until): errors of its signature since it was applied."""
    errors = observation.where(F.col("kind").isin("run_failed", "tool_error")).select("signature", "ts_utc", "obs_id")
    inside = (F.col("ts_utc") >= F.col("applied_at")) & (F.col("ts_utc") < F.col("until"))
    by = lesson.join(errors, "signature").where(inside).groupBy("lesson_id").agg(F.count_distinct("obs_id").alias("events"))
    return lesson.select("lesson_id").join(by, "lesson_id", "left").select("lesson_id", F.coalesce("events", F.lit(0)).cast("long").alias("events"))


def lesson_flow(lessons: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """Lessons that came to each state in the trailing window; a state that none came to has zero."""
    end = F.lit(as_of).cast("timestamp")
    at = F.when(F.col("state") == "applied", F.col("applied_at")).otherwise(F.col("modified_at"))
    states = F.explode(F.array(*[F.lit(s) for s in ("draft", "accepted", "applied", "resolved")]))
    every = lessons.sparkSession.range(1).select(states.alias("state"))
    counted = lessons.where(at.between(end - F.make_dt_interval(days=F.lit(days)), end)).groupBy("state").count()
    return every.join(counted, "state", "left").select("state", F.coalesce("count", F.lit(0)).cast("long").alias("lessons"))


#: States of a candidate that something is still to be done about.
PENDING = ("proposed", "needs_evaluation", "evaluating", "conflict")


def learning_health(records: DataFrame, now: str, pending_seconds: int = 86_400) -> DataFrame:
    """Findings (kind, id) of candidates: conflicts, missing evaluators, stale and unreadable ages."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    stale = F.col("state").isin(*PENDING) & (age.isNull() | (age > pending_seconds))
    kinds = F.array_compact(F.array(
        F.when(F.col("state") == "conflict", F.lit("ownership_conflict")), F.when(F.col("state") == "needs_evaluation", F.lit("missing_evaluator")),
        F.when(stale, F.lit("stale_pending")),
    ))
    return records.select("id", F.explode(kinds).alias("kind"))


def dead_man(files: DataFrame, observation: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """One row: files that came and observations that were made in the last hours, and whether the pipeline looks dead."""
    end = F.lit(now).cast("timestamp")
    recent = lambda c: F.col(c).between(end - F.make_dt_interval(hours=F.lit(hours)), end)
    came = files.where(recent("modified")).agg(F.count("*").alias("arrivals"))
    made = observation.where(recent("ts_utc")).agg(F.count("*").alias("observations"))
    # one row each
    both = came.join(made, F.lit(True))
    return both.withColumn("dead", (F.col("arrivals") > 0) & (F.col("observations") == 0))


# --- autonomy -----------------------------------------------------------------------------------


def autonomy_key(family: Column, action: Column) -> Column:
    """autonomy:family:verb:first telling word of the object."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(action, "^[^:]*:", "")), F.lit("([a-z0-9]+)"))
    telling = F.filter(words, lambda w: ~w.isin("a", "an", "the", "my", "our", "this", "that"))
    return F.concat_ws(":", F.lit("autonomy"), family, F.substring_index(action, ":", 1), F.coalesce(F.get(telling, F.lit(0)), F.lit("unspecified")))


def actions_of(text: Column) -> Column:
    """Keys of the parts of a request that "and" joins, if each has one; else its own key, if any."""
    parts = F.transform(F.split(F.trim(text), r"(?i)\s+and\s+"), action_key)
    own = F.array_compact(F.array(action_key(text)))
    return F.when(F.exists(parts, lambda x: x.isNull()), own).otherwise(parts)


#: What an assistant says that makes an episode a candidate.
_ACT = rf"(?:{VERBS})\s+"
OFFER = rf"(?i)\b(?:I can|would you like me to|shall I)\s+({_ACT}[^?.;]+?)\s*(?:after (?:another|your|new) approval|if you (?:want|approve)|\?)"
APPROVAL_OFFER = r"(?i)\b(?:after (?:another|your|new) approval|approve .* again|if you approve)\b"
DEFECT = r"(?i)\b(?:found|acknowledge|identified|confirmed) (?:a |the )?(?:defect|bug|failure)\b"
IMPEDES = r"(?i)\b(?:blocks|prevents|impedes)\s+([^.;]+)"
ABANDON = r"(?i)\b(?:I am abandoning|I will abandon|I have stopped working on)\s+([^.;]+)"
BLOCKED = rf"(?i)\bI cannot\s+({_ACT}[^.;]+?)\s+under current access\b"


def shortlist(episode: DataFrame, interaction: DataFrame) -> DataFrame:
    """The earliest candidate of each family and episode: an offer, abandonment or block of a pending action.

    episode has (session_key, episode, start_ordinal, end_ordinal, action_key),
    interaction (session_key, ordinal, origin, text).  The span join is on the
    session, with the ordinals as its residual.

    Returns session_key, episode, family, action, ordinal, text (of the reply).
    """
    said = lambda pattern: action_key(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")))
    text = F.col("text")
    rows = interaction.where((F.col("origin") == "assistant_text") & text.isNotNull())
    offered, family = said(OFFER), lambda on, name, action: F.when(on, F.struct(F.lit(name).alias("family"), action.alias("action")))
    found = F.array_compact(F.array(
        family(offered.isNotNull(), "D-12", offered), family(offered.isNotNull() & text.rlike(APPROVAL_OFFER), "D-13", offered),
        family(offered.isNotNull() & text.rlike(DEFECT) & (said(IMPEDES) == offered), "D-14", offered),
        family(said(ABANDON).isNotNull(), "D-15", said(ABANDON)), family(said(BLOCKED).isNotNull(), "D-16", said(BLOCKED)),
    ))
    rows = rows.select("session_key", "ordinal", "text", F.explode(found).alias("c")).select("session_key", "ordinal", "text", "c.family", "c.action")
    e, i = episode.alias("e"), rows.alias("i")
    inside = (F.col("e.session_key") == F.col("i.session_key")) & F.col("i.ordinal").between(F.col("e.start_ordinal"), F.col("e.end_ordinal"))
    pending = e.join(i, inside).where(F.array_contains(F.split("e.action_key", r" \| "), F.col("i.action")))
    first = pending.groupBy("e.session_key", "e.episode", "i.family").agg(F.min_by("i.action", "i.ordinal").alias("action"), F.min("i.ordinal").alias("ordinal"), F.min_by("i.text", "i.ordinal").alias("text"))
    return first.select("session_key", "episode", "family", "action", "ordinal", "text")


#: Facts of an episode that speak against a finding.
ADVERSE = ("permission_hold", "approval_withheld", "external_wait", "external_wait_evidence", "revocation", "observed_completion", "scope_change")
#: What a turn says of completion, of changed conditions, of what is outside, and of a capability that was checked.
CAPABLE = r"(?i)\bcapability check:\s*([^.;]+?)\s+available under current access\b"
SUCCESS = r"(?i)\b(?:exit code|process exited with code)\s*:?\s*0\b"
COMPLETED = (
    r"(?i)\b(?:completed|finished|I (?:built|fixed|wrote|created|updated|deployed|tested|reviewed|published)"
    r"|already (?:built|fixed|wrote|created|updated|deployed|tested|reviewed|published))\b"
)
CHANGED = r"(?i)\b(?:new credentials|changed access|new approval|different permissions|after approval)\b"
EXTERNAL = r"(?i)\b(?:purchase|payment|physical intervention|onsite access|external approval)\b"
#: References kept of an assessment, and of each kind of evidence in an episode.
MOST_REFS = 24


def span_evidence(episode: DataFrame, interaction: DataFrame) -> DataFrame:
    """(session_key, episode, evidence): what the turns of an episode say, as (kind, ordinal, action), the first of each kind and action."""
    origin, text = F.col("origin"), F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    capable = action_key(F.nullif(F.regexp_extract(text, CAPABLE, 1), F.lit("")))
    one = lambda on, kind, action=none: F.when(on, F.struct(F.lit(kind).alias("kind"), action.alias("action")))
    found = F.array_compact(F.array(
        one(origin.isin("human_request", "tool_result", "assistant_text") & text.rlike(COMPLETED), "completion_or_check"), one(text.rlike(CHANGED), "changed_conditions"),
        one(origin.isin("human_request", "tool_result") & text.rlike(EXTERNAL), "external_approval"),
        one((origin == "tool_result") & capable.isNotNull() & text.rlike(SUCCESS), "capability_check", capable),
    ))
    said = interaction.select("session_key", "ordinal", F.explode(found).alias("f")).select("session_key", "ordinal", "f.kind", "f.action")
    e, i = episode.alias("e"), said.alias("i")
    inside = (F.col("e.session_key") == F.col("i.session_key")) & F.col("i.ordinal").between(F.col("e.start_ordinal"), F.col("e.end_ordinal"))
    rows = e.join(i, inside).select("e.session_key", "e.episode", "i.kind", "i.ordinal", "i.action")
    place = F.row_number().over(Window.partitionBy("session_key", "episode", "kind", "action").orderBy("ordinal"))
    rows = rows.withColumn("place", place).where(F.col("place") <= MOST_REFS)
    return rows.groupBy("session_key", "episode").agg(F.array_sort(F.collect_list(F.struct("kind", "ordinal", "action"))).alias("evidence"))


def assessed(candidate: DataFrame, episode: DataFrame, interaction: DataFrame) -> DataFrame:
    """Candidates with what supports, contradicts and misses, and a disposition.

    candidate is that of shortlist, episode has the columns of
    sessions.episodes, interaction (session_key, ordinal, origin, text).  Any
    contradiction dismisses, among them a turn of the episode that tells of
    completion, of changed conditions or of something outside that is needed;
    anything missing needs review; the rest is supported.

    Returns session_key, episode, family, action, cluster_key, disposition,
    supporting, disconfirming (arrays of kind and ordinal), missing.
    """
    own_rows = episode.join(candidate.select("session_key", "episode").distinct(), ["session_key", "episode"], "left_semi")
    said = span_evidence(own_rows, interaction)
    rows = candidate.alias("c").join(episode.alias("e"), ["session_key", "episode"]).join(said.alias("s"), ["session_key", "episode"], "left")
    facts, action, at, text = F.col("e.assertions"), F.col("c.action"), F.col("c.ordinal"), F.coalesce("c.text", F.lit(""))
    evidence = F.coalesce("s.evidence", F.array().cast("array<struct<kind:string,ordinal:bigint,action:string>>"))
    ref = lambda a: F.struct(a["kind"].alias("kind"), a["ordinal"].cast("long").alias("ordinal"))
    of = lambda kinds, strength=None: F.transform(
        F.filter(facts, lambda a: a["kind"].isin(*kinds) & (a["strength"] == strength if strength else F.lit(True))), ref
    )
    turns = lambda *kinds: F.transform(F.filter(evidence, lambda a: a["kind"].isin(*kinds)), ref)
    known = lambda kinds, more: F.exists(facts, lambda a: a["kind"].isin(*kinds) & (a["strength"] == "known") & more(a))
    earlier = lambda a: a["ordinal"] < at
    none = F.array().cast("array<struct<kind:string,ordinal:bigint>>")
    outside = turns("external_approval")
    against = F.concat(of(ADVERSE), F.when(F.col("e.advice_only"), of(("advice_only",))).otherwise(none), turns("completion_or_check", "changed_conditions"), outside)
    checks = F.transform(F.filter(evidence, lambda a: (a["kind"] == "capability_check") & (a["action"] == action)), ref)
    family = F.col("c.family")
    pending = known(("pending_action",), lambda a: a["value"] == action)
    closed = known(("terminal_reply",), lambda a: a["ordinal"] == at)
    impeded = action_key(F.nullif(F.regexp_extract(text, IMPEDES, 1), F.lit("")))
    missing = F.array_compact(F.array(
        F.when(~pending, "pending action"), F.when((F.col("e.authority") != "authorized") | ~known(("pending_action", "explicit_approval"), lambda a: a["value"] == action), "authority"),
        F.when(F.col("e.context") != "known", "context"), F.when(F.size(of(("scope_restriction",))) > 0, "restriction applicability"),
        F.when(F.col("e.lifecycle") != "active", "active objective"), F.when(F.size(outside) > 0, "outside approval"),
        F.when(family.isin("D-12", "D-13", "D-14") & ~closed, "completed reply"),
        F.when((family == "D-13") & ~known(("explicit_approval",), lambda a: (a["value"] == action) & earlier(a)), "settled approval"),
        F.when((family == "D-14") & ~F.coalesce(text.rlike(DEFECT) & (impeded == action), F.lit(False)), "defect in the way"),
        F.when((family == "D-15") & ~known(("status_exchange",), earlier), "status exchange"), F.when((family == "D-15") & ~text.rlike(APPROVAL_OFFER), "repeated approval"),
        F.when((family == "D-16") & text.rlike(OFFER), "blocked without an offer"), F.when((family == "D-16") & (F.size(checks) == 0), "capability check"),
    ))
    own = F.array(F.struct(F.lit("candidate").alias("kind"), at.cast("long").alias("ordinal")))
    for_it = F.concat(own, of(("pending_action", "explicit_approval", "question_answer", "same_outcome_resume", "status_exchange"), "known"), F.when(family == "D-16", checks).otherwise(none))
    disposition = F.when(F.size(against) > 0, "dismissed").when(F.size(missing) > 0, "needs_review").otherwise("supported")
    return rows.select(
        "session_key", "episode", "family", "action", autonomy_key(F.col("family"), F.col("action")).alias("cluster_key"), disposition.alias("disposition"),
        F.slice(for_it, 1, MOST_REFS).alias("supporting"), F.slice(against, 1, MOST_REFS).alias("disconfirming"), missing.alias("missing"),
    )


def inspected(assessment: DataFrame, adjudication: DataFrame, episode: DataFrame) -> DataFrame:
    """Assessments with the disposition that holds: an override of the same input and evidence, else, if it is stale, review."""
    a, j = assessment.alias("a"), adjudication.alias("j")
    rows = a.join(episode.select("episode_id", "session_id").alias("e"), "episode_id").join(j, F.col("a.candidate_id") == F.col("j.candidate_id"), "left")
    same = (F.col("j.input_sha") == F.col("a.input_sha")) & (F.col("j.evidence_sha") == F.col("a.evidence_sha"))
    there = F.col("j.candidate_id").isNotNull()
    holds = F.when(there & same, F.col("j.disposition")).when(there, "needs_review").otherwise(F.col("a.disposition"))
    return rows.select("a.candidate_id", "a.family", "e.session_id", holds.alias("disposition"), (there & ~same).alias("stale_adjudication"))


# --- interventions ------------------------------------------------------------------------------


def intervention_signal(category: Column) -> Column:
    """(signal, rank) of a category."""
    pair = lambda s, r: F.struct(F.lit(s).alias("signal"), F.lit(r).alias("rank"))
    return (
        F.when(category == "excluded_origin", pair("negative", 0))
        .when(category == "task_start", pair("negative", 10))
        .when(category == "ordinary_request", pair("negative", 15))
        .when(category == "interactive_answer", pair("candidate", 95))
        .when(category == "question", pair("candidate", 80))
        .when(category == "ambiguous", pair("unknown", 40))
        .otherwise(pair("candidate", 90))
    )


def intervention_counts(rows: DataFrame) -> DataFrame:
    """(what, value, n): episodes by state, signal and category, and their flags, each counted."""
    pairs = [F.struct(F.lit(c).alias("what"), F.col(c).alias("value")) for c in ("state", "signal", "category")]
    flags = F.transform("flags", lambda x: F.struct(F.lit("flag").alias("what"), x.alias("value")))
    each = rows.select(F.explode(F.concat(F.array(*pairs), flags)).alias("p"))
    return each.groupBy("p.what", "p.value").agg(F.count("*").alias("n"))


def with_context(interactions: DataFrame, before: int = 6, after: int = 6) -> DataFrame:
    """Human turns with the assistant's and tools' rows around them.

    The rows before are the last ones of the session, the rows after end with
    the next human turn.  Frames are counted among rows of the assistant alone,
    so long human passages do not push them out.
    """
    human = F.col("origin").isin("human_request", "human_answer")
    acts = F.col("origin").isin("assistant_text", "tool_call", "tool_result", "question")
    order = Window.partitionBy("session_key").orderBy("ordinal")
    rows = interactions.where(human | acts).withColumn("human", human)
    rows = rows.withColumn("acts", F.sum((~F.col("human")).cast("long")).over(order)).withColumn("turns", F.sum(F.col("human").cast("long")).over(order))
    own = rows.where("human").select("session_key", "ordinal", "text", F.col("acts").alias("upto"), F.col("turns").alias("turn"))
    other = rows.where("not human").select("session_key", F.col("ordinal").alias("at"), F.col("acts").alias("n"), F.col("turns").alias("under"))
    # an act stands before the next few turns and after one; both sides meet on the session and a block of acts
    size = before + after
    block = lambda x: F.floor(x / size)
    own = own.withColumn("block", F.explode(F.sequence(block(F.col("upto") - before), block(F.col("upto") + after))))
    other = other.withColumn("block", block(F.col("n")))
    near = (F.col("n") > F.col("upto") - before) & (F.col("n") <= F.col("upto") + after)
    mine = (F.col("n") <= F.col("upto")) | (F.col("under") == F.col("turn"))
    found = own.join(other, ["session_key", "block"]).where(near & mine)
    back, on = F.when(F.col("n") <= F.col("upto"), F.col("at")), F.when(F.col("n") > F.col("upto"), F.col("at"))
    by = found.groupBy("session_key", "ordinal").agg(F.array_sort(F.collect_list(back)).alias("previous"), F.array_sort(F.collect_list(on)).alias("following"))
    empty = F.array().cast("array<bigint>")
    return rows.where("human").select("session_key", "ordinal", "text").join(by, ["session_key", "ordinal"], "left").select(
        "session_key", "ordinal", "text", F.coalesce("previous", empty).alias("previous"), F.coalesce("following", empty).alias("following")
    )


#: How a standing direction begins, and what makes a text no plain one.
DIRECTIVE = (
    r"(?i)^(?:for all future tasks[,：:]\s*|remember for all future tasks:\s*|for future tasks in this repository[,：:]\s*"
    r"|remember for future tasks in this repository:\s*|(?:always|never)\s+|going forward,\s*|from now on,?\s+|remember:\s*)(.+)$"
)
NO_DIRECTIVE = r"(?i)[\n\r`<>\x00]|\b(?:system|developer|assistant|user)\s*:|\b(?:quoted?|example|pasted?|worker prompt|role spoof|transcript)\b"


def directive(text: Column) -> Column:
    """(instruction, breadth) of a standing direction in one plain line, else null."""
    plain = F.trim(text)
    rule = F.ltrim(F.regexp_extract(plain, DIRECTIVE, 1))
    fits = (F.length(plain) <= 4096) & ~plain.rlike(NO_DIRECTIVE) & (rule != "") & ~rule.rlike("^[\"'“]")
    breadth = F.when(F.lower(F.substring(plain, 1, 40)).contains("all future tasks"), "global").otherwise("repository")
    return F.when(fits, F.struct(plain.alias("instruction"), breadth.alias("breadth")))
