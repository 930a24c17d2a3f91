"""The detector catalogue.

A detector is one relation of hits (key, session_id, ts_utc and what else it
groups by) and a rule for which groups count.  Clusters, session hits, weeks
and weekly counts are projections of the same hits, so they cannot disagree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snagline.functions.exprs import hashed_key, in_window, iso_week, key_of, present, stamp
from snagline.functions.words import folded_stems, raw_words, stems, tokens, word_pattern

KINDS = ("cluster", "session", "week", "weekly")
CATALOGUE_ROWS = 10_000


@dataclass(frozen=True)
class Span:
    """The window a detector looks at: start <= ts < end."""

    start: str = "2024-01-01 00:00:00"
    end: str | None = "2024-01-31 00:00:00"
    days: int = 30


@dataclass(frozen=True)
class Detector:
    id: str
    version: int
    meaning: str
    hits: Callable[..., DataFrame]
    #: Condition on sessions, events and days of a group; None keeps all.
    qualifies: Callable[[], Column] | None = None
    groups: tuple[str, ...] = ("key",)
    extra: Callable[..., DataFrame] | None = field(default=None)
    #: Where every hit of a name counts for all keys of that name: all projections, without the hits by key.
    shared: Callable[..., DataFrame] | None = field(default=None)

    def run(self, kind: str, span: Span, **inputs: DataFrame) -> DataFrame:
        """One of the four projections over the window."""
        if kind not in KINDS:
            raise ValueError(f"unknown projection {kind!r}")
        if self.shared:
            return self.shared(kind, span, **inputs)
        hits = self.hits(span, **inputs)
        hits = _qualified(hits, self.groups, self.qualifies) if kind != "cluster" else hits
        if kind == "cluster":
            found = _aggregated(hits, self.groups)
            if self.qualifies:
                found = found.where(self.qualifies())
            found = found.select("key", "sessions", "events", stamp("first").alias("first_seen"), stamp("last").alias("last_seen"))
            return found.unionByName(self.extra(span, **inputs)) if self.extra else found
        if kind == "session":
            return hits.select("key", "session_id").distinct()
        if kind == "week":
            return hits.select("key", iso_week("ts_utc").alias("week")).distinct()
        return hits.groupBy("key", iso_week("ts_utc").alias("week")).agg(
            F.count_distinct("session_id").alias("sessions"), F.count("*").alias("events")
        )


def _aggregated(hits: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Counts per group in two steps: a hot group is spread over its sessions first."""
    by = hits.groupBy(*groups, "session_id", F.to_date("ts_utc").alias("day")).agg(
        F.count("*").alias("n"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last")
    )
    return by.groupBy(*groups).agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("day").alias("days"),
        F.sum("n").alias("events"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def _qualified(hits: DataFrame, groups: tuple[str, ...], qualifies: Callable[[], Column] | None) -> DataFrame:
    """Hits of the groups that qualify over the whole window, never week by week."""
    if qualifies is None:
        return hits
    good = _aggregated(hits, groups).where(qualifies()).select(*groups)
    return hits.join(good, list(groups), "left_semi")


def _recurs() -> Column:
    return F.col("sessions") >= 2


def _missing_binary(span: Span, observation: DataFrame) -> DataFrame:
    rows = observation.where(in_window("ts_utc", span.start, span.end) & (F.col("kind") == "run_failed"))
    rows = rows.where(present("program") & present("signature") & F.col("sig_hash").isNotNull())
    rows = rows.where(F.lower("signature").like("%command not found%"))
    return rows.select(key_of("command-not-found", "program").alias("key"), "program", "session_id", "ts_utc")


def _error_signature(span: Span, observation: DataFrame) -> DataFrame:
    rows = observation.where(in_window("ts_utc", span.start, span.end) & F.col("kind").isin("run_failed", "tool_error"))
    rows = rows.where(present("signature") & F.col("sig_hash").isNotNull())
    return rows.select(F.substring("signature", 1, 240).alias("key"), "sig_hash", "session_id", "ts_utc")


def _retry_loop(span: Span, observation: DataFrame) -> DataFrame:
    """Failures after the last success of the same command in the same session, three or more.

    The last success per (session, command) replaces a comparison of every
    failure with every success.
    """
    runs = observation.where(in_window("ts_utc", span.start, span.end) & F.col("kind").isin("run_failed", "run_succeeded"))
    runs = runs.where(present("command")).withColumn("command", F.trim("command"))
    at = F.struct("ts_utc", "obs_id")
    group = Window.partitionBy("session_id", "command")
    last = F.max(F.when(F.col("kind") == "run_succeeded", at)).over(group)
    open_runs = runs.withColumn("last", last).where((F.col("kind") == "run_failed") & (F.col("last").isNull() | (at > F.col("last"))))
    loops = open_runs.withColumn("n", F.count("*").over(group)).where("n >= 3")
    return loops.select(F.substring("command", 1, 240).alias("key"), "session_id", "ts_utc")


def _hook_denial(span: Span, hook_denial: DataFrame) -> DataFrame:
    rows = hook_denial.where(in_window("ts_utc", span.start, span.end))
    return rows.select(key_of("hook-denial", "rule_id").alias("key"), "session_id", "ts_utc")


def _corrected(span: Span, observation: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind whose next row in the whole session, by obs_id, is a correction in the window."""
    following = Window.partitionBy("session_id").orderBy("obs_id")
    after = F.lead(F.struct("kind", "excerpt", "ts_utc")).over(following)
    rows = observation.withColumn("after", after).where(in_window("ts_utc", span.start, span.end) & (F.col("kind") == kind))
    rows = rows.where((F.col("after.kind") == "user_turn_after_correction") & present(F.col("after.excerpt")))
    return rows.where(in_window("after.ts_utc", span.start, span.end))


def _rejected_call(span: Span, observation: DataFrame) -> DataFrame:
    rows = _corrected(span, observation, "tool_rejected").where(present("tool"))
    key = key_of("tool-rejected", F.trim("tool"), F.trim("after.excerpt"))
    return rows.select(key.alias("key"), "session_id", "ts_utc")


def _interrupt(span: Span, observation: DataFrame) -> DataFrame:
    rows = _corrected(span, observation, "interrupt")
    return rows.select(key_of("interrupt", F.trim("after.excerpt")).alias("key"), "session_id", "ts_utc")


def _rediscovery(span: Span, observation: DataFrame) -> DataFrame:
    rows = observation.where(in_window("ts_utc", span.start, span.end))
    edits = rows.where(present("path") & F.col("kind").isin("file_edit", "file_write", "file_changed"))
    reads = rows.where((F.col("kind") == "file_read") & present("path")).withColumn("thing", F.trim("path"))
    reads = reads.join(edits.select(F.trim("path").alias("thing")).distinct(), "thing", "left_anti")
    runs = rows.where(F.col("kind").isin("run", "run_succeeded", "run_failed") & present("command"))
    runs = runs.withColumn("thing", F.trim("command"))
    both = reads.select(F.lit("file").alias("family"), "thing", "session_id", "ts_utc").unionByName(
        runs.select(F.lit("command").alias("family"), "thing", "session_id", "ts_utc")
    )
    key = hashed_key(F.concat_ws(":", F.lit("rediscovery"), "family", "thing"))
    return both.select(key.alias("key"), "family", "session_id", "ts_utc")


def _rediscovered() -> Column:
    return (F.col("sessions") >= 2) & ((F.col("family") == "command") | (F.col("days") >= 2))


#: Phrases, and forms of words as documents have them, that are looked up in memory; more of them are joined.
MOST_FORMS = 100_000
#: Members of one block of keys and of sessions, about, sessions that follow a key at a time, and pairs of a task; see _shared_sessions.
KEYS, SESSIONS, RUN = 1_000, 4_000, 250
TASK_PAIRS = 4_000_000


def _asked(phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, n, offset, stem) of the distinct phrases, which are found once when they are few."""
    asked = phrases.select(F.col(phrase).alias("phrase")).distinct().withColumn("w", tokens(F.col("phrase"))).where(F.size("w") > 0)
    asked = asked.select("phrase", F.size("w").alias("n"), F.posexplode("w").alias("offset", "word")).select("phrase", "n", "offset", stems("word").alias("stem"))
    few = asked.limit(MOST_FORMS + 1).collect()
    return asked if len(few) > MOST_FORMS else phrases.sparkSession.createDataFrame(few, "phrase string, n int, offset int, stem string")


def _candidates(asked: DataFrame) -> str:
    """An expression of the words that begin like a stem that is asked for: stemming changes no letter but the last ones."""
    head = F.substring("stem", F.lit(1), F.least(F.lit(3), F.greatest(F.lit(1), F.length("stem") - 1)))
    heads = [r["head"] for r in asked.select(head.alias("head")).distinct().limit(MOST_FORMS + 1).collect()]
    return word_pattern(heads if len(heads) <= MOST_FORMS else None)


def phrase_matches(docs: DataFrame, phrases: DataFrame, doc: str = "path", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(doc, phrase) where the phrase's words stand consecutively in the document, by their stems.

    Documents are searched for words that begin like one that a phrase has, so
    that no other word leaves the scan.  Every distinct one, as it is written, is folded and
    stemmed once, and those whose stem a phrase has are the forms to look for: up to MOST_FORMS of them are looked up
    while documents are read.  A phrase of one word stands where that is.  Documents with a word of a longer phrase are
    split: a place less the word's offset in the phrase is where the phrase would begin;
    where all its words agree on that, it stands.  No text is shuffled.
    """
    asked = _asked(phrases, phrase)
    found = [_standing(docs, own, doc, text, n > 1) for n, own in ((1, asked.where("n = 1")), (2, asked.where("n > 1"))) if not own.isEmpty()]
    if not found:
        return docs.select(F.col(doc), F.lit("").alias(phrase)).limit(0)
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.select(F.col("doc").alias(doc), F.col("phrase").alias(phrase)).distinct()


def _standing(docs: DataFrame, asked: DataFrame, doc: str, text: str, long: bool) -> DataFrame:
    """(doc, phrase) for phrases that all have one word, or more where long."""
    pattern = _candidates(asked)
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    # an outer explode, since before a plain one Spark asks for the size and would search every text twice
    words = rows.select("doc", F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("word")).where("word is not null")
    known = words.select("word").distinct().select("word", folded_stems("word").alias("stem"))
    forms = known.join(asked.select("stem").distinct(), "stem", "left_semi")
    few = forms.limit(MOST_FORMS + 1).collect()
    if len(few) <= MOST_FORMS:
        forms = F.broadcast(docs.sparkSession.createDataFrame([(r["stem"], r["word"]) for r in few], "stem string, word string"))
    if not long:
        return words.join(forms, "word").select("doc", "stem").distinct().join(asked, "stem").select("doc", "phrase")
    split = rows.where(F.col("text").rlike(pattern)).select("doc", F.posexplode_outer(raw_words(F.col("text"))).alias("place", "written"))
    # a text may begin with marks, which belong to no word here
    split = split.select("doc", "place", F.regexp_replace("written", r"^\p{Mn}+", "").alias("word"))
    found = split.join(forms, "word").select("doc", "place", "stem").join(asked, "stem")
    spots = found.groupBy("doc", "phrase", "n", (F.col("place") - F.col("offset")).alias("at")).agg(F.count_distinct("offset").alias("words"))
    return spots.where("words = n").select("doc", "phrase")


def _live(rule_doc: DataFrame) -> DataFrame:
    return rule_doc.where((F.col("stale") == 0) & present("path"))


def _wordy(names: DataFrame) -> DataFrame:
    return names.where(F.col("phrase").rlike("[0-9a-zA-Z]"))


def _absent(span: Span, observation: DataFrame) -> DataFrame:
    """Programs that are missing in two sessions or more."""
    good = _aggregated(_missing_binary(span, observation), ("program",)).where(_recurs())
    return _wordy(good.select(F.col("program").alias("phrase")))


def _silent(span: Span, observation: DataFrame) -> DataFrame:
    """Hosts seen before the window but neither in it nor later."""
    by = observation.where(present("host")).groupBy(F.trim("host").alias("phrase")).agg(F.max("ts_utc").alias("last"))
    return _wordy(by.where(F.col("last") < F.lit(span.start).cast("timestamp")).select("phrase"))


def _stale_rule(span: Span, observation: DataFrame, rule_doc: DataFrame) -> DataFrame:
    named = phrase_matches(_live(rule_doc), _absent(span, observation)).withColumnRenamed("phrase", "program")
    rows = _missing_binary(span, observation).drop("key").join(named, "program")
    return rows.select(key_of("stale-rule:binary", "program", "path").alias("key"), "session_id", "ts_utc")


def _counted_hits(hits: DataFrame, by: str, kind: str, times: Column) -> DataFrame:
    """The projection of hits by a column that stays; every hit counts so many times."""
    week = iso_week("ts_utc").alias("week")
    if kind in ("session", "week"):
        return hits.select(by, "session_id" if kind == "session" else week).distinct()
    if kind == "weekly":
        cells = hits.groupBy(by, week, "session_id").agg(F.sum(times).alias("n"))
        return cells.groupBy(by, "week").agg(F.count("session_id").alias("sessions"), F.sum("n").alias("events"))
    cells = hits.groupBy(by, "session_id").agg(F.sum(times).alias("n"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last"))
    found = cells.groupBy(by).agg(F.count("session_id").alias("sessions"), F.sum("n").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select(by, "sessions", "events", stamp("first").alias("first_seen"), stamp("last").alias("last_seen"))


def _blocks(rows: DataFrame, sizes: DataFrame, column: str, own: str, other: str) -> DataFrame:
    """(program, own, other, members): the values of a column in blocks, each with every block of the other side."""
    block = F.pmod(F.xxhash64(column), F.col(f"{own}_blocks"))
    held = rows.join(sizes, "program").groupBy("program", f"{other}_blocks", block.alias(own)).agg(F.collect_list(F.struct(F.col(column).alias("x"))).alias("members"))
    return held.select("program", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(other), F.col("members").alias(f"{own}_members"))


def _shared_sessions(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, session_id) for sessions and keys of the same program, each pair once.

    The result has as many rows as the pairs; blocks of keys meet blocks of sessions, and only they are shuffled,
    to as many tasks as the pairs ask for.  A task has few distinct values, and the same run of sessions follows
    one key after the other, so that a file of the pairs stays small.
    """
    sizes = keys.groupBy("program").agg(F.count("*").alias("k")).join(sessions.groupBy("program").agg(F.count("*").alias("s")), "program")
    sizes = sizes.select("program", F.ceil(F.col("k") / KEYS).alias("key_blocks"), F.ceil(F.col("s") / SESSIONS).alias("session_blocks"), "k", "s")
    few = sizes.limit(MOST_FORMS + 1).collect()
    if len(few) <= MOST_FORMS:
        sizes = keys.sparkSession.createDataFrame(few, "program string, key_blocks long, session_blocks long, k long, s long")
    pairs = F.col("k").cast("double") * F.col("s") / TASK_PAIRS
    members = (F.col("k") * F.col("session_blocks") + F.col("s") * F.col("key_blocks")) / (KEYS + SESSIONS)
    asked = sizes.agg(F.sum(pairs).alias("pairs"), F.sum(members).alias("members")).first()
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, math.ceil(max(asked["pairs"] or 0, asked["members"] or 0)))
    dealt = lambda rows: rows.repartition(parts, "program", "key", "session")
    left = _blocks(keys.withColumnRenamed("key", "x"), sizes, "x", "key", "session")
    right = _blocks(sessions, sizes, "session_id", "session", "key")
    both = dealt(left).join(dealt(right), ["program", "key", "session"])
    runs = F.transform(F.sequence(F.lit(1), F.size("session_members"), F.lit(RUN)), lambda i: F.slice("session_members", i, RUN))
    each = both.select("key_members", F.explode(runs).alias("run"))
    return each.select(F.explode("key_members.x").alias("key"), "run").select("key", F.explode("run.x").alias("session_id"))


def stale_rules(kind: str, span: Span, observation: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """Projections of D-08: rules that name a missing program, and (clusters) a host that fell silent.

    All rules that name a program have the same hits, so hits are counted by
    program and the counts meet the rules; only keys that several programs give
    are counted hit by hit.
    """
    names = _absent(span, observation)
    hosts = _silent(span, observation) if kind == "cluster" else None
    named = phrase_matches(_live(rule_doc), names.unionByName(hosts) if hosts is not None else names)
    programs = named if hosts is None else named.join(names, "phrase", "left_semi")
    pairs = programs.groupBy(F.col("phrase").alias("program"), key_of("stale-rule:binary", "phrase", "path").alias("key")).agg(F.count("*").alias("copies"))
    keyed = pairs.groupBy("key").agg(F.collect_list(F.struct("program", "copies")).alias("of"))
    own = keyed.where(F.size("of") == 1).select("key", F.inline("of"))
    several = keyed.where(F.size("of") > 1).select("key", F.inline("of"))
    missing = _missing_binary(span, observation).drop("key")
    counts = _counted_hits(missing, "program", kind, F.lit(1))
    if kind == "session":
        found = _shared_sessions(counts, own.select("program", "key"))
    else:
        found = counts.join(own, "program")
        found = found.withColumn("events", F.col("events") * F.col("copies")) if "events" in found.columns else found
        found = found.select("key", *[c for c in counts.columns if c != "program"])
    found = found.unionByName(_counted_hits(missing.join(several, "program"), "key", kind, F.col("copies")))
    if hosts is None:
        return found
    silent = named.join(hosts, "phrase", "left_semi").join(rule_doc.select("path", "indexed_at"), "path")
    return found.unionByName(_of_hosts(silent))


def _silent_hosts(span: Span, observation: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """Rules that name a host seen before the window but not in it."""
    named = phrase_matches(_live(rule_doc), _silent(span, observation))
    return _of_hosts(named.join(rule_doc.select("path", "indexed_at"), "path"))


def _of_hosts(named: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return named.select(
        key_of("stale-rule:host", "phrase", "path").alias("key"),
        zero.alias("sessions"),
        zero.alias("events"),
        stamp("indexed_at").alias("first_seen"),
        stamp("indexed_at").alias("last_seen"),
    )


def unread_rules(span: Span, observation: DataFrame, rule_doc: DataFrame) -> DataFrame:
    """Live rule documents whose content nobody read in the window, under any of its paths."""
    reads = observation.where((F.col("kind") == "file_read") & in_window("ts_utc", span.start)).select("path").distinct()
    read = rule_doc.join(reads, "path", "left_semi").select("sha")
    recent = rule_doc.groupBy("sha").agg(F.max("last_read").alias("last")).where(F.col("last") >= F.lit(span.start).cast("timestamp"))
    known = read.unionByName(recent.select("sha")).distinct()
    zero = F.lit(0).cast("long")
    return _live(rule_doc).join(known, "sha", "left_anti").select(
        key_of("unread-rule-doc", "path").alias("key"),
        zero.alias("sessions"),
        zero.alias("events"),
        stamp("indexed_at").alias("first_seen"),
        stamp("indexed_at").alias("last_seen"),
    )


def gate_gaps(observation: DataFrame, catalog: DataFrame) -> DataFrame:
    """(obs_id, pack, id): commands that a deny rule matches and no allow rule of its pack does.

    The catalogue is configuration, tens to hundreds of patterns; a join by a
    pattern has no key, so it is the broadcast side, and a catalogue above
    CATALOGUE_ROWS is refused.
    """
    if catalog.limit(CATALOGUE_ROWS + 1).count() > CATALOGUE_ROWS:
        raise ValueError(f"a gate catalogue has {CATALOGUE_ROWS} patterns at most")
    ran = observation.where(F.col("kind").isin("run_succeeded", "run_failed") & present("command"))
    # patterns see each distinct command once
    commands = ran.select(F.trim("command").alias("command")).distinct()
    hit = F.expr("command rlike pattern")
    deny = commands.join(F.broadcast(catalog.where("verdict = 'never'")), hit).select("command", "pack", "id")
    allow = commands.join(F.broadcast(catalog.where("verdict = 'always'")), hit).select("command", "pack").distinct()
    gaps = deny.join(allow, ["command", "pack"], "left_anti")
    return ran.withColumn("command", F.trim("command")).join(gaps, "command").select("obs_id", "pack", "id", "session_id", "ts_utc")


def _gate_gap(span: Span, observation: DataFrame, catalog: DataFrame) -> DataFrame:
    rows = gate_gaps(observation.where(in_window("ts_utc", span.start, span.end)), catalog)
    return rows.select(key_of("gate-gap", "pack", "id").alias("key"), "session_id", "ts_utc")


def cross_host(span: Span, bucket: DataFrame, report: DataFrame, weekly: bool = False) -> DataFrame:
    """Signatures on two or more hosts; a bucket counts by whole days.

    bucket and report have a host and a signature scheme, and only buckets of a
    host's reported scheme count.  Clusters take the last day in; weeks end
    before it, unless the end has a time of day.
    """
    accepted = report.select("host", "scheme").distinct()
    rows = bucket.join(accepted, ["host", "scheme"], "left_semi").where("events > 0")
    first = F.to_date(F.lit(span.start))
    key = key_of("cross-host-signature", "sig_hash")
    if not weekly:
        rows = rows.where((F.col("day") >= first) & (F.col("day") <= F.date_add(first, span.days)))
        found = rows.groupBy("scheme", "sig_hash").agg(
            F.count_distinct("host").alias("sessions"), F.sum("events").alias("events"), F.min("first_seen").alias("first"), F.max("last_seen").alias("last")
        )
        return found.where("sessions >= 2").select(
            key.alias("key"), "sessions", "events", stamp("first").alias("first_seen"), stamp("last").alias("last_seen")
        )
    end = F.lit(span.end).cast("timestamp")
    inside = (F.col("day") < F.to_date(end)) | ((F.col("day") == F.to_date(end)) & (F.date_trunc("day", end) != end))
    rows = rows.where((F.col("day") >= first) & (inside if span.end else F.lit(True)))
    good = rows.groupBy("scheme", "sig_hash").agg(F.count_distinct("host").alias("hosts")).where("hosts >= 2")
    rows = rows.join(good.select("scheme", "sig_hash"), ["scheme", "sig_hash"], "left_semi")
    return rows.groupBy(key.alias("key"), iso_week(F.col("day").cast("timestamp")).alias("week")).agg(
        F.count_distinct("host").alias("sessions"), F.sum("events").alias("events")
    )


def _autonomy(span: Span, assessment: DataFrame, adjudication: DataFrame, episode: DataFrame) -> DataFrame:
    """Supported assessments; a matching override decides, a stale one blocks."""
    own = assessment.where(in_window("assessed_at", span.start, span.end)).alias("a")
    over = adjudication.alias("j")
    same = (F.col("j.input_sha") == F.col("a.input_sha")) & (F.col("j.evidence_sha") == F.col("a.evidence_sha"))
    supported = F.when(F.col("j.candidate_id").isNull(), F.col("a.disposition") == "supported").otherwise(
        (F.col("j.disposition") == "supported") & same
    )
    rows = own.join(over, F.col("a.candidate_id") == F.col("j.candidate_id"), "left").where(supported)
    now = episode.alias("e")
    rows = rows.join(now, (F.col("a.episode_id") == F.col("e.episode_id")) & (F.col("a.input_sha") == F.col("e.input_sha")))
    return rows.select(
        F.col("a.family").alias("family"), F.col("a.cluster_key").alias("key"), F.col("e.session_id").alias("session_id"), F.col("a.assessed_at").alias("ts_utc")
    )


#: Rows of sessions that a task sorts about; fewer bytes than Spark's own target, as rows repeat each other and travel small.
TASK_ROWS = 50_000


def dealt_by_session(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by session to as many tasks as their number asks for, which are not put together again."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    return rows.repartition(parts, "session_id")


def session_hits(observation: DataFrame, spans: list[Span]) -> DataFrame:
    """Hits of D-01, D-02, D-03, D-05 and D-07 in several windows, from one pass over the sessions.

    Rows are dealt by session once: the next row, the windows a row lies in and
    the last success of a command in each are all found there.  What D-07 leaves
    out for edited files is a join with the edited paths.

    Returns span (place in spans), detector_id, key, part (what groups besides
    the key), session_id, ts_utc.
    """
    after = F.lead(F.struct("kind", "excerpt", "ts_utc")).over(Window.partitionBy("session_id").orderBy("obs_id"))
    within = [F.when(in_window("ts_utc", s.start, s.end), F.lit(i)) for i, s in enumerate(spans)]
    rows = dealt_by_session(observation).withColumn("after", after).withColumn("span", F.explode(F.array_compact(F.array(*within))))
    kind, at = F.col("kind"), F.struct("ts_utc", "obs_id")
    rows = rows.withColumn("thing", F.trim("command"))
    group = Window.partitionBy("session_id", "span", "thing")
    success = F.max(F.when(kind == "run_succeeded", at)).over(group)
    failed = (kind == "run_failed") & present("command")
    rows = rows.withColumn("success", success).withColumn("still", failed & (F.col("success").isNull() | (at > F.col("success"))))
    rows = rows.withColumn("n", F.sum(F.col("still").cast("int")).over(group))
    signed = present("signature") & F.col("sig_hash").isNotNull()
    missing = (kind == "run_failed") & present("program") & signed & F.lower("signature").like("%command not found%")
    next_inside = F.lit(False)
    for i, s in enumerate(spans):
        next_inside = next_inside | ((F.col("span") == i) & in_window("after.ts_utc", s.start, s.end))
    corrected = (F.col("after.kind") == "user_turn_after_correction") & present(F.col("after.excerpt")) & next_inside
    family = F.when(kind.isin("run", "run_succeeded", "run_failed") & present("command"), "command").when((kind == "file_read") & present("path"), "file")
    named = F.when(family == "file", F.trim("path")).otherwise(F.col("thing"))
    hit = lambda on, name, key, part=F.lit(""): F.when(on, F.struct(F.lit(name).alias("detector_id"), key.alias("key"), part.alias("part")))
    hits = [
        hit(missing, "D-01", key_of("command-not-found", "program")),
        hit(kind.isin("run_failed", "tool_error") & signed, "D-02", F.substring("signature", 1, 240), F.col("sig_hash")),
        hit(F.col("still") & (F.col("n") >= 3), "D-03", F.substring("thing", 1, 240)),
        hit((kind == "tool_rejected") & corrected & present("tool"), "D-05", key_of("tool-rejected", F.trim("tool"), F.trim("after.excerpt"))),
        hit(family.isNotNull(), "D-07", hashed_key(F.concat_ws(":", F.lit("rediscovery"), family, named)), family),
    ]
    each = rows.select("span", "session_id", "ts_utc", F.trim("path").alias("thing"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    each = each.select("span", "hit.*", "session_id", "ts_utc", F.when(F.col("hit.part") == "file", F.col("thing")).alias("file"))
    edits = observation.where(present("path") & kind.isin("file_edit", "file_write", "file_changed"))
    edits = edits.select(F.trim("path").alias("file"), F.explode(F.array_compact(F.array(*within))).alias("span")).distinct()
    return each.join(edits, ["file", "span"], "left_anti").drop("file")


#: Of the detectors that session_hits finds: which groups count.
def _counts() -> Column:
    twice = F.col("sessions") >= 2
    seven = twice & ((F.col("part") == "command") | (F.col("days") >= 2))
    return F.when(F.col("detector_id").isin("D-01", "D-02"), twice).when(F.col("detector_id") == "D-07", seven).otherwise(True)


def daily_cells(hits: DataFrame) -> DataFrame:
    """Hits of session_hits counted by span, detector, key, session and day."""
    by = hits.groupBy("span", "detector_id", "key", "part", "session_id", F.to_date("ts_utc").alias("day"))
    return by.agg(F.count("*").alias("n"), F.min("ts_utc").alias("first"), F.max("ts_utc").alias("last"))


def clusters_of(cells: DataFrame) -> DataFrame:
    """Clusters (with span, detector_id and part) of daily cells."""
    found = cells.groupBy("span", "detector_id", "key", "part").agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("day").alias("days"),
        F.sum("n").alias("events"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    found = found.where(_counts())
    columns = ("sessions", "events", stamp("first").alias("first_seen"), stamp("last").alias("last_seen"))
    return found.select("span", "detector_id", "key", "part", *columns)


def counted_cells(cells: DataFrame) -> DataFrame:
    """Daily cells of the groups that qualify over their whole window; cells may be a stored table."""
    good = clusters_of(cells).select("span", "detector_id", "key", "part")
    return cells.join(good, ["span", "detector_id", "key", "part"], "left_semi")


DETECTORS = {
    d.id: d
    for d in (
        Detector("D-01", 1, "missing binary", _missing_binary, _recurs),
        Detector("D-02", 1, "recurring error signature", _error_signature, _recurs, ("sig_hash", "key")),
        Detector("D-03", 1, "command retried without success", _retry_loop),
        Detector("D-04", 1, "rule denied again", _hook_denial, _recurs),
        Detector("D-05", 1, "rejected call, then a correction", _rejected_call),
        Detector("D-06", 1, "interrupt, then a correction", _interrupt),
        Detector("D-07", 2, "rediscovered file or command", _rediscovery, _rediscovered, ("family", "key")),
        Detector("D-08", 2, "rule names what is gone", _stale_rule, None, ("key",), _silent_hosts, stale_rules),
        Detector("D-10", 1, "denied command executed", _gate_gap),
        Detector("D-12", 2, "autonomy findings", _autonomy, None, ("family", "key")),
    )
}


def register(detector: Detector) -> None:
    """Adds a detector; one version of an id is active."""
    if detector.id in DETECTORS:
        raise ValueError(f"{detector.id} is registered already")
    DETECTORS[detector.id] = detector


def contract_violations(clusters: DataFrame) -> DataFrame:
    """Keys that break the output contract: repeated, negative or without timestamps."""
    bad = F.count("*").alias("rows"), F.min("sessions").alias("s"), F.min("events").alias("e"), F.count("last_seen").alias("t")
    return clusters.groupBy("key").agg(*bad).where("rows > 1 or s < 0 or e < 0 or t < rows").select("key", "rows")
