"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocandra.llm.abuse import cases, scores, source_rates
from vocandra.llm.bpe import token_counts, token_ids
from vocandra.llm.canonical import mapped_values
from vocandra.llm.history import repeats_in_arrival_order
from vocandra.llm.lines import repeated_lines, without_repeated_lines
from vocandra.llm.names import employers, variant_pairs
from vocandra.llm.near_dup import alike_classes, alike_pairs
from vocandra.llm.packing import pack
from vocandra.llm.pii import found, redacted_texts
from vocandra.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "jobs"))


def p1_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employers(table(spark, sf_dir, "jobs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_values(*[table(spark, sf_dir, t) for t in ("jobs", "job_requirements", "ref_place", "ref_title", "skills")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_in_arrival_order(table(spark, sf_dir, "jobs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(table(spark, sf_dir, "jobs"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_classes(table(spark, sf_dir, "jobs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "jobs"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "jobs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidate_profile"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_texts(table(spark, sf_dir, "jobs"), table(spark, sf_dir, "candidate_profile"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_employers": p1_employers,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_redacted": p7_redacted,
    "p8_ids": p8_ids,
    "p9_packed": p9_packed,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_P6_LINES = r"""
WITH raw AS (
    SELECT job_id, source, company, string_split(description, chr(10)) AS parts FROM jobs WHERE description IS NOT NULL
), numbered AS (
    SELECT job_id, source, company, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM raw
), keyed AS (
    SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM numbered
), by_source AS (
    SELECT source, k FROM keyed JOIN (SELECT source, count(*) AS docs FROM jobs GROUP BY source) USING (source) WHERE k <> ''
    GROUP BY source, k, docs HAVING count(DISTINCT job_id) >= 8 AND count(DISTINCT job_id) >= 0.05 * docs
), by_company AS (
    SELECT company, k FROM keyed JOIN (SELECT company, count(*) AS docs FROM jobs GROUP BY company) USING (company)
    WHERE k <> '' AND trim(company) <> ''
    GROUP BY company, k, docs HAVING count(DISTINCT job_id) >= 8 AND count(DISTINCT job_id) >= 0.05 * docs
), hit AS (
    SELECT job_id, line_no, line, ((source, k) IN (SELECT (source, k) FROM by_source)
        OR coalesce((company, k) IN (SELECT (company, k) FROM by_company), false)) AS cut FROM keyed
)
"""

ORACLES: dict[str, str] = {
    "p6_found": _P6_LINES + "SELECT job_id, CAST(line_no AS INTEGER) AS line_no FROM hit WHERE cut",
    "p6_clean": _P6_LINES
    + """, rebuilt AS (
        SELECT job_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT cut), '') AS description FROM hit GROUP BY job_id
    ) SELECT j.job_id, r.description FROM jobs j LEFT JOIN rebuilt r USING (job_id)""",
}
