"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snagline.llm import (
    decontaminate,
    exact_dedup,
    hpylm,
    html,
    langid,
    licenses,
    lines,
    mixing,
    packed,
    repair,
    runs,
    secrets,
    simhash,
)
from snagline.llm.common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(read_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(read_table(spark, sf_dir, "documents")).drop("row")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(read_table(spark, sf_dir, "documents"))


def op11_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")), there=F.col("there"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_planted_runs(read_table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_html_extraction,
        op3_exact_dedup,
        op4_license_scan,
        op5_line_dedup,
        op6_secret_scan,
        op7_decontamination,
        op8_simhash,
        op9_mixing,
        op10_lm_scoring,
        op11_token_packing,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
               sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT item_id, w[i:i + 9] AS win
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        wn AS (SELECT DISTINCT win, len(win) AS n FROM iw),
        dw AS (SELECT rid, w, generate_subscripts(w, 1) AS i FROM d),
        spot AS (SELECT rid, i, n, w[i:i + n - 1] AS win
                 FROM dw, (SELECT DISTINCT n FROM wn) AS lengths WHERE i + n - 1 <= len(w)),
        hit AS (SELECT spot.rid, spot.i, wn.win, wn.n FROM spot JOIN wn ON spot.win = wn.win),
        nh AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
        ni AS (SELECT rid, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items
               FROM (SELECT DISTINCT hit.rid, CAST(iw.item_id AS VARCHAR) AS item FROM hit JOIN iw ON iw.win = hit.win)
               GROUP BY rid)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN nh ON nh.rid = d.rid LEFT JOIN ni ON ni.rid = d.rid""",
}
