"""Ranking, waste, trends, digests, rules and measurements over clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snagline.functions.exprs import iso_week, known_amount, priority
from snagline.operators.asof import as_of as as_of_lookup


def ranked(clusters: DataFrame, now: str, days: int, limit: int, *more: str) -> DataFrame:
    """The first clusters by score, with their place; only those are numbered, and no sort takes all.  more names further columns that stay."""
    scored = clusters.withColumn("last", F.col("last_seen").cast("timestamp"))
    scored = scored.withColumn("score", priority("sessions", "events", "last", now, days))
    order = [F.desc("score"), F.desc("sessions"), F.desc("events"), F.desc("last_seen"), F.asc("detector_id"), F.asc("key")]
    scored = scored.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("long")
    return scored.select("detector_id", "key", "sessions", "events", F.round("score", 6).alias("score"), place.alias("place"), *more)


def equal_split_waste(hits: DataFrame, usage: DataFrame) -> DataFrame:
    """Cost and tokens of sessions, split equally among the clusters they are in.

    hits has (detector_id, key, session_id), one row each.  An unknown amount
    of any session makes the cluster's amount unknown, never zero.
    """
    shared = hits.withColumn("hits", F.count("*").over(Window.partitionBy("session_id")))
    rows = shared.join(usage, "session_id", "left")

    def split(column: str):
        amount = known_amount(column)
        return F.when(F.count(amount) == F.count("*"), F.round(F.sum(amount / F.col("hits")), 6))

    return rows.groupBy("detector_id", "key").agg(
        F.count("*").alias("sessions"), split("cost_usd").alias("est_cost"), split("tokens").alias("est_tokens")
    )


def weekly_waste(hits: DataFrame, cells: DataFrame, usage: DataFrame) -> DataFrame:
    """Cost of sessions, split equally among the weekly cells they are in, of all detectors and weeks.

    hits has (detector_id, key, week, session_id), cells the (detector_id, key,
    week) that are kept; hits of other cells do not count.  The shares of a
    session never add up to more than its cost.  A cell without hits, or with a
    session of unknown cost, has an unknown amount.
    """
    cell = ["detector_id", "key", "week"]
    own = hits.select(*cell, "session_id").distinct().join(cells.select(*cell).distinct(), cell, "left_semi")
    own = own.withColumn("hits", F.count("*").over(Window.partitionBy("session_id")))
    rows = own.join(usage, "session_id", "left")
    amount = known_amount("cost_usd")
    waste = F.when(F.count(amount) == F.count("*"), F.round(F.sum(amount / F.col("hits")), 6))
    found = rows.groupBy(*cell).agg(F.count("*").alias("sessions"), waste.alias("est_waste_usd"))
    kept = cells.select(*cell).distinct().join(found, cell, "left")
    return kept.select(*cell, F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), "est_waste_usd")


def monday_of(week: str | Column) -> Column:
    """The first day of YYYY-Www: the week of 4 January is the first."""
    week = F.col(week) if isinstance(week, str) else week
    first = F.trunc(F.to_date(F.concat(F.substring(week, 1, 4), F.lit("-01-04"))), "week")
    return F.date_add(first, (F.substring(week, 7, 2).cast("int") - 1) * 7)


def _calendars(cells: DataFrame, weeks: int) -> DataFrame:
    """(detector_id, labels, history): the trailing weeks up to a detector's last one, and how many of them it has."""
    seen = cells.groupBy("detector_id").agg(F.collect_set("week").alias("seen"))
    last = monday_of(F.array_max("seen"))
    label = lambda back: iso_week(F.date_add(last, -7 * back).cast("timestamp"))
    labels = F.transform(F.sequence(F.lit(weeks - 1), F.lit(0)), label)
    out = seen.select("detector_id", "seen", labels.alias("labels"))
    return out.select("detector_id", "labels", F.size(F.array_intersect("labels", "seen")).alias("history"))


def _series(cells: DataFrame, weeks: int) -> DataFrame:
    """(detector_id, key, points, history, quiet): a point for each week of the detector's calendar, zero where a cell lacks.

    quiet says that the cluster has no cell in any week but the last of the calendar.
    """
    own = F.map_from_entries(F.collect_list(F.struct("week", F.struct("sessions", "events"))))
    by = cells.groupBy("detector_id", "key").agg(own.alias("own"))
    rows = by.join(_calendars(cells, weeks), "detector_id")
    zero = F.struct(F.lit(0).cast("long").alias("sessions"), F.lit(0).cast("long").alias("events"))

    def point(week: Column) -> Column:
        cell = F.coalesce(F.try_element_at(F.col("own"), week), zero)
        return F.struct(week.alias("week"), cell["sessions"].alias("sessions"), cell["events"].alias("events"))

    active = F.map_filter("own", lambda week, x: (week != F.element_at("labels", -1)) & ((x["sessions"] > 0) | (x["events"] > 0)))
    return rows.select("detector_id", "key", "history", F.transform("labels", point).alias("points"), (F.size(F.map_keys(active)) == 0).alias("quiet"))


def zero_filled(cells: DataFrame, weeks: int = 12) -> DataFrame:
    """cells (detector_id, key, week, sessions, events; one row a week) over the trailing weeks of each detector."""
    return _series(cells, weeks).select("detector_id", "key", F.inline("points"))


def _ewma(values, alpha: float):
    start = F.element_at(values, 1).cast("double")
    rest = F.slice(values, 2, F.size(values))
    return F.aggregate(rest, start, lambda level, x: F.lit(alpha) * x + F.lit(1 - alpha) * level)


def _deviation(values):
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    square = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(square / F.size(values))


def trends(cells: DataFrame, weeks: int = 12, minimum: int = 6, alpha: float = 0.3, sigmas: float = 2.0) -> DataFrame:
    """New and accelerating clusters: the last week against a band over the weeks before it.

    Each detector has its own calendar of the trailing weeks up to the last one
    it has; weeks without a cell count zero.  The level is an exponential average
    seeded by the first week, the band `sigmas` population deviations of the same
    weeks above it.  A detector that has fewer weeks than the minimum gives
    insufficient_history; quiet clusters give no row.
    """
    n = F.size("points")
    series = _series(cells, weeks).withColumn("last", F.element_at("points", -1)).withColumn("prior", F.slice("points", F.lit(1), n - 1))
    for c in ("sessions", "events"):
        values = F.transform(f"prior.{c}", lambda x: x.cast("double"))
        series = series.withColumn(f"{c}_band", _ewma(values, alpha) + sigmas * _deviation(values))
        series = series.withColumn(f"{c}_excess", F.col(f"last.{c}") - F.col(f"{c}_band"))
    active = (F.col("last.sessions") > 0) | (F.col("last.events") > 0)
    armed = F.col("history") >= minimum
    status = (
        F.when(~armed, "insufficient_history")
        .when(F.col("quiet") & active, "new")
        .when((F.col("sessions_excess") > 0) | (F.col("events_excess") > 0), "accelerating")
    )
    metric = F.when(F.col("events_excess") >= F.col("sessions_excess"), "events").otherwise("sessions")
    found = series.withColumn("status", status).where("status is not null")
    return found.select(
        "detector_id",
        "key",
        "status",
        F.col("last.week").alias("week"),
        F.col("last.sessions").alias("sessions"),
        F.col("last.events").alias("events"),
        F.when(armed, metric).alias("metric"),
        F.when(armed, F.round(F.greatest("events_excess", "sessions_excess"), 6)).alias("excess"),
    )


def recurrence(cells: DataFrame) -> DataFrame:
    """Direction from the week before to the last week of each cluster; unknown unless they are adjacent.

    cells has monday (date) besides the counts.
    """
    by = Window.partitionBy("detector_id", "key").orderBy("monday")
    latest = Window.partitionBy("detector_id", "key").orderBy(F.desc("monday"))
    before = F.lag(F.struct("monday", "sessions", "events")).over(by)
    rows = cells.withColumn("before", before).withColumn("n", F.row_number().over(latest)).where("n = 1")
    adjacent = F.date_diff("monday", F.col("before.monday")) == 7
    direction = (
        F.when(F.col("before").isNull() | ~adjacent, "unknown")
        .when(F.col("events") > F.col("before.events"), "up")
        .when(F.col("events") < F.col("before.events"), "down")
        .when(F.col("sessions") > F.col("before.sessions"), "up")
        .when(F.col("sessions") < F.col("before.sessions"), "down")
        .otherwise("flat")
    )
    return rows.select("detector_id", "key", F.date_format("monday", "yyyy-MM-dd").alias("monday"), "events", direction.alias("direction"))


def digest(now: DataFrame, before: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Verdict per cluster of two windows; a rise of either count makes it worsening."""
    a, b = now.alias("a"), before.alias("b")
    both = a.join(b, (F.col("a.detector_id") == F.col("b.detector_id")) & (F.col("a.key") == F.col("b.key")), "full")
    v = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    (s, s0), (e, e0) = v("sessions"), v("events")
    verdict = (
        F.when(F.col("b.key").isNull(), "new")
        .when(F.col("a.key").isNull(), "gone")
        .when((s > s0) | (e > e0), "worsening")
        .when((s < s0) | (e < e0), "improving")
    )
    out = both.select(
        F.coalesce("a.detector_id", "b.detector_id").alias("detector_id"),
        F.coalesce("a.key", "b.key").alias("key"),
        *[F.coalesce(x, F.lit(0)).cast("long").alias(n) for x, n in ((s, "sessions"), (s0, "sessions_before"), (e, "events"), (e0, "events_before"))],
        verdict.alias("verdict"),
    )
    return out if dismissed is None else out.join(dismissed.select("detector_id", "key").distinct(), ["detector_id", "key"], "left_anti")


def refreshed_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot after a run: emitted rows, and old rows that a reviewer has moved on from `open`."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.detector_id") == F.col("n.detector_id")) & (F.col("o.key") == F.col("n.key")), "full")
    kept = both.where(F.col("n.key").isNotNull() | (F.col("o.state") != "open"))
    return kept.select(
        F.coalesce("n.detector_id", "o.detector_id").alias("detector_id"),
        F.coalesce("n.key", "o.key").alias("key"),
        F.coalesce("n.sessions", "o.sessions").alias("sessions"),
        F.coalesce("n.events", "o.events").alias("events"),
        F.coalesce("o.state", F.lit("open")).alias("state"),
    )


def merged_weeks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weekly cells after an upsert: new counts win, weeks that no longer occur stay."""
    keys = ["detector_id", "key", "week"]
    both = old.select(*keys, F.struct("sessions", "events").alias("o")).join(new.select(*keys, F.struct("sessions", "events").alias("n")), keys, "full")
    return both.select(*keys, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("sessions", "events")])


def covering_rule(matches: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """One rule per phrase: live before stale, then by path."""
    rows = matches.join(rule_doc.select("path", "stale", "sha"), "path")
    first = F.min_by(F.struct("path", "sha", "stale"), F.struct("stale", "path"))
    out = rows.groupBy("phrase").agg(first.alias("r"), F.count("*").alias("n_rules"))
    return out.select("phrase", F.col("r.path").alias("path"), F.col("r.stale").alias("stale"), "n_rules")


def last_reads(rule_doc: DataFrame, reads: DataFrame) -> DataFrame:
    """(sha, last_read): the last read of a content, as marked with any of its documents or seen at any of their paths."""
    marked = rule_doc.select("sha", F.col("last_read").alias("at"))
    seen = rule_doc.select("path", "sha").join(reads.select(F.trim("path").alias("path"), F.col("ts_utc").alias("at")).groupBy("path").agg(F.max("at").alias("at")), "path")
    return marked.unionByName(seen.select("sha", "at")).groupBy("sha").agg(F.max("at").alias("last_read"))


def rule_report(rule_doc: DataFrame, clusters: DataFrame, reads: DataFrame, now: str, days: int = 90, zero_days: int = 90, retire_days: int = 90) -> DataFrame:
    """Live rule documents with what they cover, when their content was read last, and what follows from it.

    clusters has (covered_by, last_seen) and may have direction, reads (path,
    ts_utc).  A content that was never read is as old as its index.  A document
    is a candidate for deletion when it is unread, old enough and covers
    nothing; it may be retired when it has been unread for so long and whatever
    it covers has been quiet for so long, where a time that cannot be read
    counts as recent.

    Returns path, layer, sha, covers, up, last_read, unread_since, unread_days,
    unread, deletion_candidate, last_occurrence, retire.
    """
    as_of = F.lit(now).cast("timestamp")
    own = clusters.where(F.col("covered_by").isNotNull()).withColumn("seen", F.try_to_timestamp(F.col("last_seen").cast("string")))
    rises = F.col("direction") == "up" if "direction" in clusters.columns else F.lit(False)
    by = own.groupBy(F.col("covered_by").alias("path")).agg(
        F.count("*").alias("covers"), F.count("seen").alias("dated"), F.max("seen").alias("last_occurrence"), F.count(F.when(rises, 1)).alias("up")
    )
    rows = rule_doc.where("stale = 0").select("path", "layer", "sha", "indexed_at").join(last_reads(rule_doc, reads), "sha", "left").join(by, "path", "left")
    since = F.coalesce("last_read", "indexed_at")
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(since)) / 86_400_000_000)
    old = since <= as_of - F.make_dt_interval(F.lit(days))
    unread = F.col("last_read").isNull() | (since < as_of - F.make_dt_interval(F.lit(days)))
    covers, dated = F.coalesce("covers", F.lit(0)), F.coalesce("dated", F.lit(0))
    quiet = (covers == 0) | ((dated == covers) & (F.col("last_occurrence") <= as_of - F.make_dt_interval(F.lit(zero_days))))
    return rows.select(
        "path", "layer", "sha", covers.cast("long").alias("covers"), F.coalesce("up", F.lit(0)).cast("long").alias("up"), "last_read", since.alias("unread_since"),
        F.floor(age).cast("long").alias("unread_days"), unread.alias("unread"), (unread & F.coalesce(old, F.lit(False)) & (covers == 0)).alias("deletion_candidate"),
        F.when(dated == covers, F.col("last_occurrence")).alias("last_occurrence"), (unread & F.coalesce(age >= retire_days, F.lit(False)) & F.coalesce(quiet, F.lit(False))).alias("retire"),
    )


def stale_rules(rule_doc: DataFrame) -> DataFrame:
    """Rule documents that are gone; the report has them apart."""
    return rule_doc.where("stale <> 0").select("path", "layer", "sha", "indexed_at", "last_read")


def shape_drift(counts: DataFrame, newest: int = 2, history: int = 8, armed: int = 3) -> DataFrame:
    """Record types whose recent count left the lower median of the runs before.

    counts has (source, run, record_type, n).  The newest runs of a source are
    pooled; types that a run lacks count zero there.  A type appeared when no
    run of the history has it at all.
    """
    runs = counts.select("source", "run").distinct()
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("run")))
    runs = runs.withColumn("place", place).where(F.col("place") <= newest + history)
    types = counts.select("source", "record_type").distinct()
    grid = runs.join(types, "source").join(counts, ["source", "run", "record_type"], "left")
    n = F.coalesce("n", F.lit(0))
    old = F.col("place") > newest
    out = grid.groupBy("source", "record_type").agg(
        F.sum(F.when(~old, n)).cast("long").alias("recent"),
        F.expr(f"percentile_disc(0.5) within group (order by case when place > {newest} then coalesce(n, 0) end)")
        .cast("long")
        .alias("median"),
        F.max(F.when(old, n)).alias("most"),
        F.count(F.when(old, 1)).alias("runs"),
    )
    verdict = (
        F.when(F.col("runs") < armed, "unarmed")
        .when((F.col("median") > 0) & (F.col("recent") == 0), "vanished")
        .when((F.col("most") == 0) & (F.col("recent") > 0), "appeared")
        .otherwise("steady")
    )
    return out.select("source", "record_type", "recent", "median", verdict.alias("verdict"))


#: Families whose findings count from two sessions on, and whose points do not prove a lesson resolved.
AUTONOMY = ("D-12", "D-13", "D-14", "D-15", "D-16")


def resolution_streaks(daily: DataFrame, days: int) -> DataFrame:
    """Islands of consecutive zero days of a lesson, at least `days` long, and the day they were reached.

    daily has (lesson_id, day, events), one row a day.
    """
    zero = daily.where("events = 0")
    n = F.row_number().over(Window.partitionBy("lesson_id").orderBy("day"))
    islands = zero.withColumn("island", F.date_sub("day", n))
    out = islands.groupBy("lesson_id", "island").agg(F.min("day").alias("first"), F.count("*").alias("length"))
    return out.where(F.col("length") >= days).select(
        "lesson_id",
        F.date_format("first", "yyyy-MM-dd").alias("first"),
        F.date_format(F.date_add("first", days - 1), "yyyy-MM-dd").alias("resolved"),
        "length",
    )


def resolutions(lessons: DataFrame, points: DataFrame, as_of: str, days: int = 21, window_days: int = 7, without: tuple = AUTONOMY) -> DataFrame:
    """Applied lessons whose measurements after the application were zero on so many days in a row, and when first.

    lessons has (lesson_id, detector_id, state, applied_at), points
    (lesson_id, measured_at, window_days, sessions, events).  The last point of
    a day counts; a day without one breaks a run, as does one that is not zero.
    Points up to the application, after as_of or of another window do not
    count, nor lessons whose time of application is null or whose family, the
    detector before its version, is in `without`.

    Returns lesson_id, detector_id, applied_at, first_zero_at, resolved_at.
    """
    family = F.substring_index("detector_id", "@", 1)
    applied = lessons.where(F.col("state").startswith("applied:") & ~family.isin(*without)).select("lesson_id", "detector_id", "applied_at")
    ours = points.where((F.col("window_days") == window_days) & (F.col("measured_at") <= F.lit(as_of).cast("timestamp")))
    after = ours.join(applied, "lesson_id").where(F.col("measured_at") > F.col("applied_at"))
    keys = ["lesson_id", "detector_id", "applied_at"]
    last = after.groupBy(*keys, F.to_date("measured_at").alias("day")).agg(F.max(F.struct("measured_at", "sessions", "events")).alias("p"))
    zero = last.where("p.sessions = 0 and p.events = 0").select(*keys, "day", F.col("p.measured_at").alias("at"))
    # the zero day so many rows before is as many days before only if none between is missing
    begins = F.lag(F.struct("day", "at"), days - 1).over(Window.partitionBy("lesson_id").orderBy("day"))
    runs = zero.withColumn("begin", begins).where(F.col("begin.day") == F.date_sub("day", days - 1))
    first = runs.groupBy(*keys).agg(F.min(F.struct("at", F.col("begin.at").alias("since"))).alias("r"))
    return first.select(*keys, F.col("r.since").alias("first_zero_at"), F.col("r.at").alias("resolved_at"))


def latest_per_day(measurements: DataFrame) -> DataFrame:
    """The last measurement of each lesson and day; a mirror row overrides the database."""
    order = Window.partitionBy("lesson_id", "day").orderBy(F.desc("mirror"), F.desc("measured_at"))
    return measurements.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


#: Where a lesson can be applied, the strongest first.
LAYERS = ("environment", "hook", "wrapper", "skill", "agents_md", "memory", "retrieval_only")


def stronger_layer(layer: Column) -> Column:
    """The next stronger layer; none above the strongest, nor for a layer that is not known."""
    order = F.array(*[F.lit(x) for x in LAYERS])
    place = F.array_position(order, layer)
    return F.when(place > 1, F.get(order, (place - 2).cast("int")))


def escalations(lessons: DataFrame, measurements: DataFrame, as_of: str, days: int = 21) -> DataFrame:
    """Applied lessons that are due and whose counts have not halved, with the layer they should move to.

    lessons has (lesson_id, state, applied_at, sessions, events), the counts
    being those of the evidence it was drawn from; measurements (lesson_id,
    measured_at, sessions, events).  The last measurement up to the application,
    else the evidence, is set against the first from `days` later; both are
    carried along one order of measurements and lessons.

    Returns lesson_id, layer, next_layer, applied_at, base_at, sessions_before, events_before, measured_at, sessions, events.
    """
    cutoff = F.lit(as_of).cast("timestamp")
    layer = F.regexp_extract("state", "^applied:(.*)$", 1)
    due = lessons.withColumn("layer", layer).withColumn("next_layer", stronger_layer(F.col("layer"))).where(F.col("next_layer").isNotNull() & F.col("applied_at").isNotNull())
    due = due.select("lesson_id", "layer", "next_layer", "applied_at", F.col("sessions").alias("own_sessions"), F.col("events").alias("own_events"), F.col("applied_at").alias("measured_at"))
    due = due.where(F.col("applied_at") + F.make_dt_interval(F.lit(days)) <= cutoff)
    points = measurements.where(F.col("measured_at") <= cutoff).select("lesson_id", "measured_at", "sessions", "events")
    rows = as_of_lookup(due, points, ["lesson_id"], "measured_at", "base")
    rows = as_of_lookup(rows.withColumn("measured_at", F.col("applied_at") + F.make_dt_interval(F.lit(days))), points, ["lesson_id"], "measured_at", "after", forward=True)
    before = {c: F.coalesce(f"base.{c}", f"own_{c}") for c in ("sessions", "events")}
    halved = (2 * F.col("after.sessions") <= before["sessions"]) & (2 * F.col("after.events") <= before["events"])
    return rows.where(F.col("after").isNotNull() & ~halved).select(
        "lesson_id", "layer", "next_layer", "applied_at", F.col("base.measured_at").alias("base_at"), *[c.alias(f"{n}_before") for n, c in before.items()],
        F.col("after.measured_at").alias("measured_at"), F.col("after.sessions").alias("sessions"), F.col("after.events").alias("events"),
    )


def packed(rows: DataFrame, prompt: str, cluster: str, position: str, bytes_: str, cluster_budget: int, total_budget: int) -> DataFrame:
    """Rows that fit into prompts under two budgets.

    A prompt has clusters in order, and of each its rows in order of position; the
    row at position 0 is the cluster's own text, without which none of its rows
    counts.  Own texts are taken first, then further rows in turns, one of each
    cluster; a row that would exceed the budget of its cluster or of the prompt is
    left out and the next one tried.  The caller limits the rows of a cluster
    (first_rows) and the clusters of a prompt; prompts are dealt by key, sorted
    and folded one after another.

    Returns the columns named, for the rows that are taken, and taken (their place in the prompt).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select(F.col(prompt).alias("prompt"), F.col(cluster).alias("cluster"), F.col(position).cast("long").alias("position"), F.col(bytes_).cast("long").alias("bytes"))
    schema = T.StructType([*named.schema.fields, T.StructField("taken", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, used, taken = None, 0, {}, 0
        for batch in batches:
            places = []
            for key, name, at, size in zip(batch["prompt"], batch["cluster"], batch["position"], batch["bytes"]):
                if key != now:
                    now, total, used, taken = key, 0, {}, 0
                fits = (at == 0 or name in used) and used.get(name, 0) + size <= cluster_budget and total + size <= total_budget
                if fits:
                    total, used[name], taken = total + size, used.get(name, 0) + size, taken + 1
                places.append(taken if fits else 0)
            yield batch.assign(taken=places)[lambda b: b["taken"] > 0]

    dealt = named.repartition(parts, "prompt").sortWithinPartitions("prompt", "position", "cluster")
    return dealt.mapInPandas(fold, schema).withColumnsRenamed({"prompt": prompt, "cluster": cluster, "position": position, "bytes": bytes_})


def first_rows(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the filter on the rank prunes before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def omitted_after(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """Per group: rows kept under a cap, rows beyond it and their first and last order value."""
    ranked_rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    over = F.col("place") > n
    return ranked_rows.groupBy(*group).agg(
        F.count(F.when(~over, 1)).alias("retained"),
        F.count(F.when(over, 1)).alias("omitted"),
        F.min(F.when(over, F.col("ordinal"))).alias("omitted_first"),
        F.max(F.when(over, F.col("ordinal"))).alias("omitted_last"),
    )


def fair_order(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Round robin: the first of every group, then the second of every group, and so on."""
    return rows.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def token_deltas(snapshots: DataFrame) -> DataFrame:
    """Growth of a cumulative counter per session; a decrease is a restart from zero."""
    before = F.lag("total").over(Window.partitionBy("session_id").orderBy("at"))
    delta = F.when(before.isNull() | (F.col("total") < before), F.col("total")).otherwise(F.col("total") - before)
    return snapshots.withColumn("delta", delta)


def paired_verdict(trials: DataFrame) -> DataFrame:
    """Baseline and candidate trials paired by case and repetition, per split."""
    a, b = trials.where("arm = 'baseline'").alias("a"), trials.where("arm = 'candidate'").alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("case_id", "repetition", "split")]
    pairs = a.join(b, on[0] & on[1] & on[2])
    better = (F.col("b.status") == "pass") & (F.col("a.status") != "pass")
    worse = (F.col("a.status") == "pass") & (F.col("b.status") != "pass")
    return pairs.groupBy(F.col("a.split").alias("split")).agg(
        F.count("*").alias("pairs"),
        F.count(F.when(better, 1)).alias("better"),
        F.count(F.when(worse, 1)).alias("worse"),
        F.bool_and(~worse).alias("never_worse"),
        F.bool_or(better).alias("ever_better"),
    )


def impact(rows: DataFrame) -> DataFrame:
    """Counts and rates by source and family; a rate over nothing is null."""
    n = F.count("*")
    done = F.count(F.when(F.col("lifecycle") == "completed", 1))
    stopped = F.count(F.when(F.col("lifecycle") == "interrupted", 1))
    rate = F.round(done / F.nullif(done + stopped, F.lit(0)), 6)
    return rows.groupBy("source", "family").agg(
        n.alias("n"), done.alias("completed"), stopped.alias("interrupted"), (n - done - stopped).alias("unknown"), rate.alias("rate")
    )


def retained(rows: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows from the cutoff on, and rows whose timestamp cannot be read."""
    at = F.try_to_timestamp(F.regexp_replace(ts, ",", "."))
    return rows.where(at.isNull() | (at >= F.lit(cutoff).cast("timestamp")))


def corpus_changes(known: DataFrame, listed: DataFrame) -> DataFrame:
    """What became of each rule file: known (path, layer, sha, stale) against listed (path, layer, sha)."""
    k, f = known.alias("k"), listed.alias("f")
    both = k.join(f, F.col("k.path") == F.col("f.path"), "full")
    kind = (
        F.when(F.col("k.path").isNull(), "indexed")
        .when(F.col("f.path").isNull() & (F.col("k.stale") == 1), "still_stale")
        .when(F.col("f.path").isNull(), "vanished")
        .when(F.col("k.stale") == 1, "restored")
        .when(F.col("k.sha") != F.col("f.sha"), "reindexed")
        .when(F.col("k.layer") != F.col("f.layer"), "relayered")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce("f.path", "k.path").alias("path"), kind.alias("change"))


def moved(known: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, to): vanished files whose content now stands at new paths."""
    gone = known.join(listed.select("path"), "path", "left_anti").select("path", "sha")
    new = listed.join(known.select("path"), "path", "left_anti").select(F.col("path").alias("new"), "sha")
    out = gone.join(new, "sha").groupBy("path").agg(F.array_sort(F.collect_set("new")).alias("to"))
    return out.select("path", F.array_join("to", ",").alias("to"))


def resolved_reads(reads: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """Each read's content: exact path first, then relative to cwd, then to the launch folder."""
    paths = F.array("path", F.concat_ws("/", "cwd", "path"), F.concat_ws("/", "launch_dir", "path"))
    each = reads.select("read_id", F.posexplode(paths).alias("rank", "at"))
    found = each.join(rule_doc.select(F.col("path").alias("at"), "sha"), "at")
    return found.groupBy("read_id").agg(F.min_by("sha", "rank").alias("sha"), F.min("rank").cast("long").alias("rank"))


def contributors(bucket: DataFrame) -> DataFrame:
    """Per signature: hosts, events and the days of each host in order."""
    by = bucket.groupBy("sig_hash", "host").agg(F.sum("events").alias("events"), F.array_sort(F.collect_set(F.date_format("day", "yyyy-MM-dd"))).alias("days"))
    rows = F.array_sort(F.collect_list(F.concat_ws("=", "host", F.array_join("days", ";"))))
    return by.groupBy("sig_hash").agg(F.count("*").alias("hosts"), F.sum("events").alias("events"), F.array_join(rows, "|").alias("contributors"))
