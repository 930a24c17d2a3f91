"""What is written: replaced sessions, evidence tables, mirrors and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.operators.detectors import Detector, Span, contract_violations


def replaced_sessions(old: DataFrame, new: DataFrame, touched: DataFrame, key: str = "session_id") -> DataFrame:
    """All rows after some sessions were read again: theirs are the new ones, even if there are none."""
    return old.join(touched.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def write_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites the partitions that rows have, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_whole(rows: DataFrame, path: str) -> None:
    """Replaces a table of evidence; rows must not read the table itself."""
    rows.write.mode("overwrite").parquet(path)


def added_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counts of both, added by key."""
    return old.select(*keys, count).unionByName(new.select(*keys, count)).groupBy(*keys).agg(F.sum(count).alias(count))


def mirror_measurements(rows: DataFrame, path: str) -> None:
    """Appends measurements as JSON lines, a folder for each lesson."""
    rows.write.mode("append").partitionBy("lesson_id").json(path)


def manifest(spark: SparkSession, *paths: str, schema_version: int = 1) -> DataFrame:
    """(path, schema, bytes, sha256) of the files below the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.lit(schema_version).alias("schema"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])


RECEIPT = (
    "schema string, session_id string, ended_at string, reason string, cwd string, rules_consulted array<string>,"
    " denials array<struct<ts:string,rule_id:string,tool:string>>, unresolved_errors array<struct<kind:string,signature:string>>, ended_mid_task boolean"
)


def receipts(spark: SparkSession, *paths: str, schema: str = "friction-v1") -> DataFrame:
    """Session receipts, one JSON object a file; one of another schema or without a required field is left out."""
    rows = spark.read.schema(RECEIPT).option("multiLine", "true").json(list(paths))
    whole = rows.dropna(subset=["session_id", "ended_at", "reason", "rules_consulted", "denials", "unresolved_errors", "ended_mid_task"])
    return whole.where(F.col("schema") == schema).withColumn("ended_at", F.try_to_timestamp("ended_at")).where("ended_at is not null")


RUN = "detector_id string, version int, status string, clusters long, error string"


def run_detectors(
    spark: SparkSession, detectors: Iterable[Detector], span: Span, inputs: Callable[[Detector], dict[str, DataFrame]], path: str, versions: dict[str, int] | None = None
) -> DataFrame:
    """Runs detectors one by one and writes the clusters of each to a partition of its own.

    One that fails (error), breaks the output contract (error) or is older than
    the version that ran last (refused) writes nothing, and the others go on.
    Returns a row for each: ok, error or refused.
    """
    out = []
    for d in detectors:
        if (versions or {}).get(d.id, 0) > d.version:
            out.append((d.id, d.version, "refused", None, "a later version has run"))
            continue
        try:
            found = d.run("cluster", span, **inputs(d)).withColumn("detector_id", F.lit(d.id))
            bad = contract_violations(found).limit(3).collect()
            if bad:
                out.append((d.id, d.version, "error", None, "breaks the contract: " + ", ".join(r["key"] or "null" for r in bad)))
                continue
            write_partitions(found, path, "detector_id")
            out.append((d.id, d.version, "ok", found.count(), None))
        except (PySparkException, ValueError, KeyError, TypeError) as e:
            out.append((d.id, d.version, "error", None, str(e).split("\n")[0][:400]))
    return spark.createDataFrame(out, RUN)
