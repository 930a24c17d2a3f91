"""Observations, usage, rules, denials and reports as views of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.functions.exprs import fingerprint12

KINDS = {"error": "run_failed", "purchase": "run_succeeded", "view": "file_read", "signup": "tool_rejected"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def observations(spark: SparkSession, sf_dir: str, interrupts: bool = False) -> DataFrame:
    """The main fact table: one row per event of a session."""
    kind = F.lit("user_turn_after_correction")
    for event, name in KINDS.items():
        kind = F.when(F.col("event_type") == event, "interrupt" if interrupts and event == "signup" else name).otherwise(kind)
    k = F.col("k")
    sign = F.when(k % 2 == 0, F.concat(F.lit("bin"), k, F.lit(": command not found"))).otherwise(F.concat(F.lit("error code "), k % 10))
    hosts = F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp"), 6).otherwise(4)
    return table(spark, sf_dir, "events").withColumn("k", _k()).select(
        F.col("event_id").alias("obs_id"),
        F.concat(F.lit("u"), "user_id").alias("session_id"),
        F.col("ts").alias("ts_utc"),
        kind.alias("kind"),
        F.concat(F.lit("bin"), k).alias("program"),
        F.concat(F.lit("cmd"), k % 5).alias("command"),
        sign.alias("signature"),
        fingerprint12(sign).alias("sig_hash"),
        F.concat(F.lit("tool"), k % 3).alias("tool"),
        F.concat(F.lit("/f/"), k).alias("path"),
        F.concat(F.lit("use "), k % 7).alias("excerpt"),
        F.concat(F.lit("host"), F.col("user_id") % hosts).alias("host"),
        F.concat(F.lit("r"), k % 8).alias("rule_id"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost per session; every tenth cost is unknown."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tokens"), F.sum("value").alias("value"))
    return by.select(
        F.concat(F.lit("u"), "user_id").alias("session_id"),
        F.col("tokens"),
        F.when(F.col("user_id") % 10 != 0, F.col("value")).alias("cost_usd"),
    )


def rule_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction files with their text."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/f/"), i).alias("path"),
        F.coalesce("lang", F.lit("none")).alias("layer"),
        F.sha2("text", 256).alias("sha"),
        F.concat(F.lit("Prefer bin"), i % 120, F.lit(" on host"), i % 6, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"),
        (i % 5 == 0).cast("int").alias("stale"),
        F.timestamp_seconds(F.lit(1704067200) + i % 86400).alias("indexed_at"),
        F.when(i % 7 == 0, F.timestamp_seconds(F.lit(1704067200) + i % 2592000)).alias("last_read"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("role") == "user", "human_request").when(F.col("role") == "assistant", "assistant_text").otherwise("harness")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_key"), F.col("turn").alias("ordinal"), origin.alias("origin"), "text"
    )


def host_buckets(obs: DataFrame) -> DataFrame:
    """Daily counts of each error signature by host."""
    errors = obs.where("kind = 'run_failed'")
    return errors.groupBy("host", F.to_date("ts_utc").alias("day"), "sig_hash").agg(
        F.count("*").alias("events"), F.min("ts_utc").alias("first_seen"), F.max("ts_utc").alias("last_seen")
    )
