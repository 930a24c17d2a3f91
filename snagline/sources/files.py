"""Transcript files, denial logs, catalogues and rule files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snagline.sources import ranges
from snagline.sources.ranges import PREFIX_BYTES


def listed(spark: SparkSession, *paths: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, size, modified, prefix): distinct files below the paths, with their first 4 KiB, newest first; no more is read of them."""
    return ranges.read(spark, paths, "files", pattern).orderBy(F.desc("modified"), "path")


def prefix_sha(prefix: Column, size: Column) -> Column:
    """Digest of the first 4 KiB of a file, or of a first part of so many bytes."""
    return F.sha2(F.substring(prefix, F.lit(1), F.least(F.lit(PREFIX_BYTES), size).cast("int")), 256)


def settled(files: DataFrame, now: str, seconds: int) -> DataFrame:
    """Files that were left alone for so long; a time in the future never is."""
    return files.where(F.col("modified") <= F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(seconds)))


def ingest_plan(cursor: DataFrame, files: DataFrame) -> DataFrame:
    """What to do with each file: parse, resume, reparse, skip; or missing, for a cursor without file.

    cursor has (path, size, offset, prefix_sha, modified, parse_errors,
    error_runs).  A file that is shorter than what was read is read again; so is
    one whose first bytes, over the span that the stored digest covered, have
    changed.  One of the same size and time is skipped.  error_runs counts the
    passes in a row that left errors, a skipped one among them.

    Returns path, action, reason, offset, error_runs.
    """
    c, f = cursor.alias("c"), files.alias("f")
    both = c.join(f, F.col("c.path") == F.col("f.path"), "full")
    changed = prefix_sha(F.col("f.prefix"), F.col("c.size")) != F.col("c.prefix_sha")
    same = (F.col("f.size") == F.col("c.size")) & (F.col("f.modified") == F.col("c.modified"))
    reason = F.when(F.col("f.size") < F.col("c.offset"), "shrank").when(changed, "identity_changed")
    action = (
        F.when(F.col("f.path").isNull(), "missing")
        .when(F.col("c.path").isNull(), "parse")
        .when(reason.isNotNull(), "reparse")
        .when(same, "skip")
        .otherwise("resume")
    )
    rows = both.select(F.coalesce("f.path", "c.path").alias("found"), action.alias("action"), F.when(action == "reparse", reason).alias("reason"), "c.*")
    offset = F.when(F.col("action").isin("resume", "skip"), F.col("offset")).when(F.col("action").isin("parse", "reparse"), F.lit(0))
    streak = F.when(F.col("action") == "skip", error_streak(F.col("error_runs"), F.col("parse_errors")))
    return rows.select(F.col("found").alias("path"), "action", "reason", offset.cast("long").alias("offset"), F.coalesce(streak, "error_runs").alias("error_runs"))


def error_streak(before: Column, errors: Column) -> Column:
    """Passes in a row that left parse errors, after one more with so many."""
    return F.when(errors > 0, F.coalesce(before, F.lit(0)) + 1).otherwise(0)


def complete_lines(spark: SparkSession, *paths: str, offsets: DataFrame | None = None, pattern: str = "*", range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(path, line, begin, text) of the lines that end in a line feed, with the byte at which each begins.

    A torn tail is left out; pending_tails has it.  Files are read by byte
    ranges, each by a task of its own; how many lines the ranges before have
    gives a line its number.  With offsets (path, offset, line; a row for each
    file) only what stands behind the offset is read of a file, and its lines are
    numbered on.
    """
    known = {r["path"]: (r["offset"], r["line"]) for r in offsets.collect()} if offsets is not None else {}
    scan = lambda rows: ranges.read(spark, paths, rows, pattern, range_bytes, {p: o for p, (o, _) in known.items()})
    first = spark.createDataFrame([(p, n) for p, (_, n) in known.items()], "path string, first long")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = scan("counts").join(first, "path", "left")
    base = counted.select("path", "part", (F.coalesce("first", F.lit(0)) + F.coalesce(F.sum("feeds").over(before), F.lit(0))).alias("base"))
    rows = scan("lines").join(base, ["path", "part"])
    return rows.select("path", (F.col("base") + F.col("local")).cast("int").alias("line"), "begin", "text")


def pending_tails(spark: SparkSession, *paths: str, pattern: str = "*") -> DataFrame:
    """(path, offset, tail): what stands behind the last line feed of a file, and where; an empty tail when nothing does."""
    return ranges.read(spark, paths, "tails", pattern)


def transcript_records(lines: DataFrame) -> DataFrame:
    """Lines as variants with their declared type; what is no object has the type `untyped`."""
    parsed = lines.withColumn("record", F.try_parse_json("text"))
    kind = F.coalesce(F.try_variant_get("record", "$.type", "string"), F.lit("untyped"))
    return parsed.withColumn("record_type", kind)


def content_blocks(records: DataFrame) -> DataFrame:
    """One row per block of message.content, which is a string or a list."""
    content = F.try_variant_get("record", "$.message.content", "array<variant>")
    # a list would be cast to its JSON
    plain = F.when(content.isNull(), F.try_variant_get("record", "$.message.content", "string"))
    block = F.explode_outer(content).alias("block")
    rows = records.select("path", "line", "record_type", F.try_variant_get("record", "$.sessionId", "string").alias("session_id"), plain.alias("plain"), block)
    get = lambda p, t="string": F.try_variant_get("block", p, t)
    return rows.select(
        "path",
        "line",
        "record_type",
        "session_id",
        F.coalesce(get("$.type"), F.when(F.col("plain").isNotNull(), "text")).alias("block_type"),
        F.coalesce(get("$.text"), get("$.content"), "plain").alias("text"),
        F.coalesce(get("$.id"), get("$.tool_use_id")).alias("tool_use_id"),
        get("$.name").alias("tool"),
        get("$.input.command").alias("command"),
        get("$.input.file_path").alias("file_path"),
        get("$.is_error", "boolean").alias("is_error"),
    )


DENIAL = "ts string, rule_id string, tool string, cwd string, session_id string, fragment string"


def denials(spark: SparkSession, *paths: str) -> DataFrame:
    """Denial log records; lines without all six strings are dropped."""
    lines = spark.read.text(list(paths))
    rows = lines.select(F.from_json("value", DENIAL).alias("r"), F.json_object_keys("value").alias("keys"))
    names = [x.split()[0] for x in DENIAL.split(", ")]
    whole = (F.size("keys") == len(names)) & (F.size(F.array_except("keys", F.array(*[F.lit(n) for n in names]))) == 0)
    rows = rows.where(whole).select("r.*").dropna()
    return rows.withColumn("ts_utc", F.try_to_timestamp("ts")).where("ts_utc is not null").drop("ts")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(verdict, pack, id, pattern, enabled, action, check) of a gate catalogue file; enabled is null where it is not said."""
    rule = "array<struct<id:string,pack:string,enabled:boolean,action:string,check:string,match:struct<regex:string>>>"
    whole = spark.read.schema(f"never {rule}, always {rule}").option("multiLine", "true").json(path)
    parts = [whole.select(F.lit(v).alias("verdict"), F.explode(v).alias("r")) for v in ("never", "always")]
    rows = parts[0].unionByName(parts[1])
    return rows.select("verdict", "r.pack", "r.id", F.col("r.match.regex").alias("pattern"), "r.enabled", "r.action", "r.check")


def enforced(rules: DataFrame) -> DataFrame:
    """(verdict, pack, id, pattern) of the rules that can be held against what ran.

    A denial counts when it is enabled, blocks (action deny) and looks at the
    command by an expression.  A pack with an exception that looks at something
    else is left out whole: its denials may have been allowed.
    """
    by_command = F.coalesce(F.col("check") == "command_regex", F.lit(False))
    opaque = rules.where((F.col("verdict") == "always") & ~by_command).select("pack").distinct()
    denies = (F.col("verdict") == "never") & F.coalesce(F.col("enabled"), F.lit(False)) & F.coalesce(F.col("action") == "deny", F.lit(False))
    kept = rules.where(by_command & (denies | (F.col("verdict") == "always"))).join(opaque, "pack", "left_anti")
    return kept.select("verdict", "pack", "id", "pattern")


def rule_files(spark: SparkSession, layer: str, *paths: str, limit: int = 4 << 20) -> DataFrame:
    """(path, layer, sha, text) of instruction files up to a size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).where(F.col("length") <= limit)
    return files.select(
        "path", F.lit(layer).alias("layer"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("text")
    ).dropDuplicates(["path"])
