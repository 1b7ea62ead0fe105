"""Queries of windows, exclusion zones, samples and folds over the recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions.keys import file_key, latest_version, patient_key
from cortigraph.operators import sampling, windows
from cortigraph.session import cut_lineage, table

LENGTH, STEP, GAP = 4.0, 2.0, 600.0


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "file_info").select(patient_key(F.col("patient_id")).alias("patient_id"), file_key(F.col("file_name")).alias("file_name"), "duration_sec")
    return d.where("patient_id is not null and file_name is not null and duration_sec > 0").groupBy("patient_id", "file_name").agg(F.max("duration_sec").alias("duration_sec"))


def seizures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of known files, inside the file, each (file, bounds) once."""
    e = latest_version(table(spark, sf_dir, "seizure_events"), "event_id", "loaded_at", ["file_name", "start_sec", "end_sec"])
    e = e.select(file_key(F.col("file_name")).alias("file_name"), "start_sec", "end_sec").where("start_sec >= 0 and end_sec > start_sec").distinct()
    return e.join(files(spark, sf_dir), "file_name").where("end_sec <= duration_sec").select("patient_id", "file_name", "start_sec", "end_sec")


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = latest_version(table(spark, sf_dir, "window_meta"), "window_id", "ingested_at", ["patient_id", "file_name", "label", "start_sec", "end_sec"])
    return w.select("window_id", patient_key(F.col("patient_id")).alias("patient_id"), file_key(F.col("file_name")).alias("file_name"), "label", "start_sec", "end_sec")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ictal windows per file: count and covered span."""
    w = windows.sliding(seizures(spark, sf_dir).withColumnRenamed("start_sec", "s").withColumnRenamed("end_sec", "e"), "s", "e", LENGTH, 1.0)
    return w.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.min("start_sec"), 3).alias("first_start"), F.round(F.max("end_sec"), 3).alias("last_end"))


def majority_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of window_meta that lie by more than half inside a marked event."""
    spans = seizures(spark, sf_dir).select("file_name", F.col("start_sec").cast("double").alias("lo"), F.col("end_sec").cast("double").alias("hi"))
    w = window_rows(spark, sf_dir).where("file_name is not null and end_sec > start_sec").select("window_id", "file_name", "start_sec", "end_sec").distinct()
    return windows.majority_inside(w, spans, ["file_name"]).select("window_id")


def exclusion_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = windows.exclusion_zones(seizures(spark, sf_dir), files(spark, sf_dir), GAP)
    return z.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lo"), 3).alias("first_lo"), F.round(F.max("hi"), 3).alias("last_hi"))


def merged_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = windows.exclusion_zones(seizures(spark, sf_dir), files(spark, sf_dir), GAP)
    return windows.merge_strict(z.distinct(), ["patient_id"]).select("patient_id", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


def interictal_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each file's minute grid away from every zone, counted by file."""
    w = windows.interictal(files(spark, sf_dir), seizures(spark, sf_dir), 60.0, 60.0, GAP)
    return w.groupBy("patient_id", "file_name").agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.sum("start_sec"), 3).alias("sum_start"))


def interictal_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two minute windows away from every zone for each marked event of a file."""
    f, e = files(spark, sf_dir), seizures(spark, sf_dir)
    wanted = e.groupBy("patient_id", "file_name").agg((2 * F.count(F.lit(1))).alias("n"))
    w = windows.interictal_draw(f, e, wanted, 60.0, 60.0, GAP)
    return w.groupBy("patient_id", "file_name").agg(F.count(F.lit(1)).alias("n_windows"), F.count_distinct("start_sec").alias("n_starts"), F.max("fallback").alias("fallback"))


def extended_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by more than half inside a marked event with a minute before and two after it."""
    spans = seizures(spark, sf_dir).select("file_name", F.col("start_sec").cast("double").alias("lo"), F.col("end_sec").cast("double").alias("hi"))
    w = window_rows(spark, sf_dir).where("file_name is not null and end_sec > start_sec").select("window_id", "file_name", "start_sec", "end_sec").distinct()
    return windows.majority_inside(w, windows.extended(spans, 60.0, 120.0), ["file_name"]).select("window_id")


def preictal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows before every onset of a file; one that lies before several onsets is a row of each."""
    e = seizures(spark, sf_dir).select("patient_id", "file_name", F.col("start_sec").cast("double").alias("onset")).distinct()
    w = windows.preictal(e, files(spark, sf_dir), 60.0, 0.5, 600.0)
    return w.select("patient_id", "file_name", F.round("onset", 3).alias("onset"), F.round("start_sec", 3).alias("start_sec"), F.size("segments").alias("n_segments"))


def file_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.predecessors(files(spark, sf_dir), "patient_id", "file_name", "duration_sec").select("patient_id", "file_name", "previous_file", "previous_duration")


def clock_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration by the clock texts against the stated one."""
    d = table(spark, sf_dir, "file_info").select("file_name", windows.clock_duration(F.col("start_time"), F.col("end_time")).alias("clock_sec"), "duration_sec")
    return d.where("clock_sec is not null").select("file_name", "clock_sec", (F.col("clock_sec") == F.col("duration_sec")).alias("agrees"))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_rows(spark, sf_dir).groupBy("patient_id").agg(F.count_if(F.col("label") == 1).alias("n_preictal"), F.count_if(F.col("label") == 0).alias("n_interictal"))


def sample_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.availability(window_rows(spark, sf_dir).where("label in (0, 1)"), "label", "patient_id")


def fair_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water-filled quotas of a tenth of all preictal windows."""
    rows = cut_lineage(window_rows(spark, sf_dir).where("label = 1 and patient_id is not null").select("patient_id"))
    counts = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.fair_quotas(counts, "patient_id", "n", rows.count() // 10)


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(window_rows(spark, sf_dir).where("label in (0, 1) and patient_id is not null").select("window_id", "label", "patient_id"))
    n = rows.where("label = 1").count() // 10
    return sampling.balanced_sample(rows, "window_id", "label", "patient_id", {1: n, 0: 2 * n}).groupBy("label", "patient_id").agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_folds(window_rows(spark, sf_dir).where("label in (0, 1)"), "window_id", "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sampling.group_folds(window_rows(spark, sf_dir).where("patient_id is not null"), "patient_id", 5)
    return f.groupBy("patient_id").agg(F.count_distinct("fold").alias("n_folds"), F.count(F.lit(1)).alias("n"))


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.permuted(window_rows(spark, sf_dir).select("window_id"), "window_id")


def permutation_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, different places, and the first and last place of the permutation."""
    p = permutation(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("n_places"), F.min("position").alias("first"), F.max("position").alias("last"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bootstrap(window_rows(spark, sf_dir).select("window_id", "label"), "window_id", 4).groupBy("replicate", "label").agg(F.sum("times").alias("drawn"))


FOUND = {
    f.__name__: f
    for f in (
        sliding_windows, majority_windows, extended_windows, interictal_draw, exclusion_zones, merged_zones, interictal_antijoin, preictal_windows, file_predecessors, clock_durations, window_counts, sample_availability,
        fair_quotas, balanced_sample, stratified_folds, group_folds, permutation, permutation_places, bootstrap,
    )
}

_FILE = "nullif(lower(trim(regexp_replace(file_name, '^.*[/\\\\]', ''), chr(9) || chr(10) || chr(13) || chr(160) || ' ')), '')"
_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"
BASE = f"""WITH f AS (SELECT pid AS patient_id, file AS file_name, max(duration_sec) AS duration_sec FROM (SELECT {_PATIENT} AS pid, {_FILE} AS file, duration_sec FROM file_info) WHERE pid IS NOT NULL AND file IS NOT NULL AND duration_sec > 0 GROUP BY 1, 2),
e0 AS (SELECT DISTINCT {_FILE} AS file, start_sec, end_sec FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC NULLS LAST, file_name DESC NULLS LAST, start_sec DESC NULLS LAST, end_sec DESC NULLS LAST) AS rn FROM seizure_events) WHERE rn = 1 AND start_sec >= 0 AND end_sec > start_sec),
e AS (SELECT f.patient_id, f.file_name, start_sec, end_sec FROM e0 JOIN f ON e0.file = f.file_name WHERE end_sec <= duration_sec),
w AS (SELECT window_id, {_PATIENT} AS patient_id, {_FILE} AS file_name, label, start_sec, end_sec FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ingested_at DESC NULLS LAST, patient_id DESC NULLS LAST, file_name DESC NULLS LAST, label DESC NULLS LAST, start_sec DESC NULLS LAST, end_sec DESC NULLS LAST) AS rn FROM window_meta) WHERE rn = 1),
o AS (SELECT *, coalesce(sum(duration_sec) OVER (PARTITION BY patient_id ORDER BY file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f),
z AS (SELECT e.patient_id, greatest(0, off + start_sec - 600.0) AS lo, off + least(end_sec + 600.0, duration_sec) AS hi FROM e JOIN o ON e.patient_id = o.patient_id AND e.file_name = o.file_name)
"""
_CLOCK = "(TRY_CAST(split_part({0}, ':', 1) AS INTEGER) * 3600 + TRY_CAST(split_part({0}, ':', 2) AS INTEGER) * 60 + TRY_CAST(split_part({0}, ':', 3) AS INTEGER))"
SQL = {
    "sliding_windows": BASE
    + "SELECT file_name, count(*) AS n_windows, round(CAST(min(s) AS DOUBLE), 3) AS first_start, round(CAST(max(s) + 4.0 AS DOUBLE), 3) AS last_end FROM (SELECT file_name, unnest(range(start_sec, end_sec - 4 + 1)) AS s FROM e WHERE end_sec - start_sec >= 4) GROUP BY file_name",
    "majority_windows": BASE
    + "SELECT DISTINCT w.window_id FROM (SELECT DISTINCT window_id, file_name, start_sec, end_sec FROM w WHERE end_sec > start_sec) w JOIN e ON w.file_name = e.file_name WHERE least(w.end_sec, e.end_sec) - greatest(w.start_sec, e.start_sec) > 0.5 * (w.end_sec - w.start_sec)",
    "exclusion_zones": BASE + "SELECT patient_id, count(*) AS n, round(CAST(min(lo) AS DOUBLE), 3) AS first_lo, round(CAST(max(hi) AS DOUBLE), 3) AS last_hi FROM z WHERE hi > lo GROUP BY patient_id",
    "merged_zones": BASE
    + """, d AS (SELECT DISTINCT * FROM z WHERE hi > lo), p AS (SELECT *, max(hi) OVER (PARTITION BY patient_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo >= prev THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM p)
SELECT patient_id, round(CAST(min(lo) AS DOUBLE), 3) AS lo, round(CAST(max(hi) AS DOUBLE), 3) AS hi FROM g GROUP BY patient_id, isl""",
    "interictal_antijoin": BASE
    + """, g AS (SELECT patient_id, file_name, off, unnest(range(0, CAST(duration_sec AS BIGINT) - 60 + 1, 60)) AS s FROM o WHERE duration_sec >= 60)
SELECT patient_id, file_name, count(*) AS n_windows, round(CAST(sum(s) AS DOUBLE), 3) AS sum_start FROM g WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.patient_id = g.patient_id AND hi > lo AND off + s < hi AND off + s + 60 > lo) GROUP BY 1, 2""",
    "preictal_windows": BASE
    + """, p AS (SELECT *, lag(file_name) OVER (PARTITION BY patient_id ORDER BY file_name) AS pf, lag(duration_sec) OVER (PARTITION BY patient_id ORDER BY file_name) AS pd FROM f),
x AS (SELECT DISTINCT patient_id, file_name, start_sec AS onset FROM e), k AS (SELECT x.*, pf, pd, onset - unnest(range(0, 19)) * 30.0 AS en FROM x JOIN p ON x.patient_id = p.patient_id AND x.file_name = p.file_name),
s AS (SELECT *, en - 60.0 AS st FROM k WHERE en > 0)
SELECT patient_id, file_name, round(CAST(onset AS DOUBLE), 3) AS onset, round(CAST(st AS DOUBLE), 3) AS start_sec, CASE WHEN st < 0 AND pf IS NOT NULL THEN 2 ELSE 1 END AS n_segments FROM s
WHERE abs((CASE WHEN st < 0 AND pf IS NOT NULL THEN pd - greatest(0, pd + st) ELSE 0 END) + en - greatest(0, st) - 60.0) <= 0.1""",
    "file_predecessors": BASE + "SELECT patient_id, file_name, lag(file_name) OVER (PARTITION BY patient_id ORDER BY file_name) AS previous_file, lag(duration_sec) OVER (PARTITION BY patient_id ORDER BY file_name) AS previous_duration FROM f",
    "clock_durations": f"SELECT file_name, CASE WHEN d < 0 THEN d + 86400 ELSE d END AS clock_sec, (CASE WHEN d < 0 THEN d + 86400 ELSE d END) = duration_sec AS agrees FROM (SELECT file_name, duration_sec, {_CLOCK.format('end_time')} - {_CLOCK.format('start_time')} AS d FROM file_info) WHERE d IS NOT NULL",
    "window_counts": BASE + "SELECT patient_id, count(*) FILTER (label = 1) AS n_preictal, count(*) FILTER (label = 0) AS n_interictal FROM w GROUP BY patient_id",
    "sample_availability": BASE + "SELECT label, count(*) AS available, count(DISTINCT patient_id) AS n_groups FROM w WHERE label IN (0, 1) GROUP BY label",
    # Round-robin: the r-th window of each patient comes before any (r+1)-th.
    "fair_quotas": BASE
    + """, c AS (SELECT patient_id, count(*) AS n FROM w WHERE label = 1 AND patient_id IS NOT NULL GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) // 10 AS target FROM c),
r AS (SELECT patient_id, unnest(range(1, n + 1)) AS k FROM c), s AS (SELECT patient_id, row_number() OVER (ORDER BY k, patient_id) AS rn FROM r)
SELECT c.patient_id, n, count(s.rn) AS quota FROM c LEFT JOIN s ON s.patient_id = c.patient_id AND rn <= (SELECT target FROM t) GROUP BY 1, 2""",
    "stratified_folds": BASE + ", r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY window_id) - 1 AS k FROM w WHERE label IN (0, 1)) SELECT label, CAST(k % 5 AS INTEGER) AS fold, count(*) AS n FROM r GROUP BY 1, 2",
    "group_folds": BASE + "SELECT patient_id, CAST(1 AS BIGINT) AS n_folds, count(*) AS n FROM w WHERE patient_id IS NOT NULL GROUP BY patient_id",
}
SQL["extended_windows"] = SQL["majority_windows"].replace("least(w.end_sec, e.end_sec) - greatest(w.start_sec, e.start_sec)", "least(w.end_sec, e.end_sec + 120.0) - greatest(w.start_sec, greatest(0, e.start_sec - 60.0))")
SQL["interictal_draw"] = (
    BASE
    + """, m AS (SELECT patient_id, file_name, 2 * count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT o.patient_id, o.file_name, off, unnest(range(0, CAST(duration_sec AS BIGINT) - 60 + 1, 60)) AS s FROM o WHERE duration_sec >= 60),
k AS (SELECT *, NOT EXISTS (SELECT 1 FROM z WHERE z.patient_id = g.patient_id AND hi > lo AND off + s < hi AND off + s + 60 > lo) AS away FROM g),
c AS (SELECT m.patient_id, m.file_name, any_value(m.n) AS n, count(*) AS grid, count(*) FILTER (away) AS away FROM m JOIN k ON k.patient_id = m.patient_id AND k.file_name = m.file_name GROUP BY 1, 2)
SELECT patient_id, file_name, least(n, CASE WHEN away > 0 THEN away ELSE grid END) AS n_windows, least(n, CASE WHEN away > 0 THEN away ELSE grid END) AS n_starts, away = 0 AS fallback FROM c"""
)
SQL["permutation_places"] = BASE + "SELECT count(*) AS n, count(*) AS n_places, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM w"
SQL["balanced_sample"] = (
    BASE
    + """, c AS (SELECT label, patient_id, count(*) AS n FROM w WHERE label IN (0, 1) AND patient_id IS NOT NULL GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS BIGINT) // 10 AS target FROM c WHERE label = 1),
r AS (SELECT label, patient_id, unnest(range(1, n + 1)) AS k FROM c), s AS (SELECT label, patient_id, row_number() OVER (PARTITION BY label ORDER BY k, patient_id) AS rn FROM r)
SELECT label, patient_id, count(*) AS n FROM s, t WHERE rn <= (CASE WHEN label = 1 THEN target ELSE 2 * target END) GROUP BY 1, 2"""
)
