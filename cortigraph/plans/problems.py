"""Queries of the general data problems: interval periods and skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions.keys import file_key, latest_version, patient_key
from cortigraph.operators.intervals import periods_and_gaps
from cortigraph.operators.skew import top_per_key
from cortigraph.session import table


def _millis(c: str) -> Column:
    x = F.col(c).cast("double") * 1000
    return F.when(F.abs(x) < 4.6e18, F.round(x)).cast("bigint")  # what is no number, or no length in a bigint, is no bound


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    seizure = latest_version(table(spark, sf_dir, "seizure_events"), "event_id", "loaded_at", ["file_name", "start_sec", "end_sec"])
    window = latest_version(table(spark, sf_dir, "window_meta"), "window_id", "ingested_at", ["file_name", "start_sec", "end_sec"])
    one = lambda d, src: d.select(F.lit(src).alias("src"), file_key(F.col("file_name")).alias("file_name"), _millis("start_sec").alias("s"), _millis("end_sec").alias("e"))
    return one(seizure, "seizure").unionAll(one(window, "window"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(_intervals(spark, sf_dir), ["src", "file_name"], "s", "e")


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered time of every recording."""
    kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("end_ms") - F.col("start_ms")).otherwise(0))
    return p1_found(spark, sf_dir).groupBy("src", "file_name").agg(kind("period").alias("covered_ms"), kind("gap").alias("gap_ms"), F.count_if(F.col("kind") == "period").alias("n_periods"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_version(table(spark, sf_dir, "patient_result"), "result_id", "loaded_at", ["patient_id", "n_samples", "error"])
    return rows.where((F.col("n_samples") > 0) & (F.coalesce(F.col("error"), F.lit("")) == "")).select(patient_key(F.col("patient_id")).alias("key"), "result_id", "n_samples")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = table(spark, sf_dir, "patient_info").where(F.col("patient_id").isNotNull()).groupBy(patient_key(F.col("patient_id")).alias("info_key")).agg(F.min("patient_id").alias("clean"))
    order = [F.col("n_samples").desc(), F.col("result_id").asc()]
    top = top_per_key(_results(spark, sf_dir), "key", order, 3, ["result_id"], info, "info_key")
    return top.select(F.coalesce("clean", "key").alias("patient_id"), "result_id")


FOUND = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p2_found": p2_found}

_FILE = "nullif(lower(trim(regexp_replace(file_name, '^.*[/\\\\]', ''), chr(9) || chr(10) || chr(13) || chr(160) || ' ')), '')"
_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"

_P1 = f"""
WITH latest AS (
  SELECT 'seizure' AS src, file_name, CAST(start_sec AS DOUBLE) AS s, CAST(end_sec AS DOUBLE) AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC NULLS LAST, file_name DESC NULLS LAST, start_sec DESC NULLS LAST, end_sec DESC NULLS LAST) AS rn FROM seizure_events) WHERE rn = 1
  UNION ALL
  SELECT 'window', file_name, start_sec, end_sec FROM (
    SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ingested_at DESC NULLS LAST, file_name DESC NULLS LAST, start_sec DESC NULLS LAST, end_sec DESC NULLS LAST) AS rn FROM window_meta) WHERE rn = 1),
iv AS (SELECT src, {_FILE} AS file_name, CAST(round(s * 1000) AS BIGINT) AS s, CAST(round(e * 1000) AS BIGINT) AS e FROM latest WHERE s IS NOT NULL AND e IS NOT NULL AND NOT isnan(s) AND NOT isnan(e)),
ok AS (SELECT *, max(e) OVER (PARTITION BY src, file_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv WHERE e > s AND file_name IS NOT NULL),
isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY src, file_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ok),
per AS (SELECT src, file_name, g, min(s) AS start_ms, max(e) AS end_ms FROM isl GROUP BY ALL),
nx AS (SELECT *, lead(start_ms) OVER (PARTITION BY src, file_name ORDER BY start_ms) AS nxt FROM per),
found AS (SELECT src, file_name, 'period' AS kind, start_ms, end_ms FROM nx UNION ALL SELECT src, file_name, 'gap', end_ms, nxt FROM nx WHERE nxt IS NOT NULL)
"""

SQL = {
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_coverage": _P1
    + """SELECT src, file_name, CAST(sum(CASE WHEN kind = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS covered_ms,
  CAST(sum(CASE WHEN kind = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS gap_ms, count(*) FILTER (kind = 'period') AS n_periods FROM found GROUP BY src, file_name""",
    "p2_found": f"""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, patient_id DESC NULLS LAST, n_samples DESC NULLS LAST, error DESC NULLS LAST) AS rn FROM patient_result),
ok AS (SELECT {_PATIENT} AS key, result_id, n_samples FROM latest WHERE rn = 1 AND n_samples > 0 AND coalesce(error, '') = ''),
info AS (SELECT {_PATIENT} AS info_key, min(patient_id) AS clean FROM patient_info GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_samples DESC, result_id) AS rn FROM ok WHERE key IS NOT NULL)
SELECT coalesce(clean, key) AS patient_id, result_id FROM top LEFT JOIN info ON key = info_key WHERE rn <= 3""",
}
