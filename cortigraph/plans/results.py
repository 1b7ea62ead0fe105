"""Queries of classifier results and metrics over patient_result and feature_bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array

from cortigraph.functions import arrays as A
from cortigraph.functions.keys import latest_version, patient_key
from cortigraph.operators import evaluation, experiments
from cortigraph.plans.signals import trials
from cortigraph.session import cut_lineage, table

_COLUMNS = ["patient_id", "noise_type", "noise_level", "n_samples", "n_class0", "n_class1", "feature_dim", "error", "scores"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of every successful run, scores as sorted entries."""
    raw = table(spark, sf_dir, "patient_result").withColumn("scores", F.array_sort(F.map_entries("classifier_results")))
    d = latest_version(raw, "result_id", "loaded_at", _COLUMNS)
    return d.withColumn("patient_id", patient_key(F.col("patient_id"))).where("coalesce(error, '') = ''")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """result_id, patient_id, noise_type, noise_level, model, accuracy: NaN and null scores left out."""
    d = runs(spark, sf_dir).withColumn("s", F.explode("scores"))
    d = d.select("result_id", "patient_id", "noise_type", "noise_level", F.col("s.key").alias("model"), F.col("s.value").alias("accuracy"))
    return d.where("accuracy is not null and not isnan(accuracy)")


def summary_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.grouped_summary(scores(spark, sf_dir), ["noise_type", "noise_level", "model"], ["accuracy"])
    return g.select("noise_type", "noise_level", "model", "n", F.round("accuracy_mean", 10).alias("accuracy_mean"), F.round("accuracy_std", 10).alias("accuracy_std"))


def summary_with_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.with_average(scores(spark, sf_dir), "model", ["accuracy"]).select("model", F.round("accuracy", 10).alias("accuracy"))


def pivot_scale_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of each model (rows) by noise type (columns)."""
    kinds = ["clean", "awgn", "emg_burst", "eog_blink"]
    p = scores(spark, sf_dir).groupBy("model").pivot("noise_type", kinds).agg(F.avg("accuracy"))
    return p.select("model", *[F.round(k, 10).alias(k) for k in kinds])


def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model of every patient by mean accuracy."""
    means = scores(spark, sf_dir).groupBy("patient_id", "model").agg(F.round(F.avg("accuracy"), 10).alias("accuracy"))
    return evaluation.best_per_group(means, ["patient_id"], "model", "accuracy").select("patient_id", "model", F.round("accuracy", 10).alias("accuracy"))


def reference_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = scores(spark, sf_dir).where("noise_type = 'clean'").groupBy("model").agg(F.round(F.avg("accuracy"), 10).alias("accuracy"))
    return clean.orderBy(F.col("accuracy").desc(), "model").limit(1)


def condition_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions in report order: clean, falling SNR, then mild to severe."""
    c = scores(spark, sf_dir).select("noise_type", "noise_level").distinct()
    w = Window.orderBy(*evaluation.condition_order(F.col("noise_type"), F.col("noise_level")))
    return c.select("noise_type", "noise_level", F.row_number().over(w).alias("position"))


def near_best_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells (condition, model) whose mean accuracy is within 0.01 of the best."""
    cells = scores(spark, sf_dir).groupBy("noise_type", "noise_level", "model").agg(F.avg("accuracy").alias("a"))
    top = cells.agg(F.max("a").alias("top"))
    return cells.crossJoin(F.broadcast(top)).where("a >= top - 0.01").select("noise_type", "noise_level", "model", F.round("a", 10).alias("accuracy"))


def condition_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model of every condition and best condition of every model, by mean accuracy: the smaller name among equals."""
    level = F.concat_ws(":", "noise_type", "noise_level").alias("condition")
    means = scores(spark, sf_dir).groupBy(level, "model").agg(F.round(F.avg("accuracy"), 10).alias("accuracy"))
    of = lambda key, what: evaluation.best_per_group(means, [key], what, "accuracy").select(F.lit(key).alias("by"), F.col(key).alias("name"), F.col(what).alias("best"), "accuracy")
    return of("condition", "model").unionByName(of("model", "condition"))


def summary_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary by condition with a row per measure."""
    return summary_by_condition(spark, sf_dir).unpivot(["noise_type", "noise_level", "model"], ["accuracy_mean", "accuracy_std"], "measure", "value").where("value is not null")


def patient_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, failures and mean accuracy of each patient."""
    raw = latest_version(table(spark, sf_dir, "patient_result"), "result_id", "loaded_at", ["patient_id", "error"])
    counts = raw.groupBy(patient_key(F.col("patient_id")).alias("patient_id")).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_failed"))
    acc = scores(spark, sf_dir).groupBy("patient_id").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"))
    return counts.join(acc, "patient_id", "left").select("patient_id", "n_runs", "n_failed", F.round("mean", 10).alias("mean_accuracy"), F.round("std", 10).alias("std_accuracy"))


def parse_key_rsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail = evaluation.split_key(F.concat_ws("_", "noise_type", "model", F.lit("accuracy")))
    return scores(spark, sf_dir).groupBy(head.alias("name"), tail.alias("metric")).agg(F.count(F.lit(1)).alias("n"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of each configuration, with its number of runs."""
    text = F.concat_ws("|", "noise_type", "noise_level", F.col("feature_dim").cast("string"))
    return runs(spark, sf_dir).groupBy(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


def pending_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that a patient has no successful run of: parameter grid minus done keys."""
    done = runs(spark, sf_dir).where("patient_id is not null").select("patient_id", "noise_type").distinct()
    kinds = spark.createDataFrame([(k,) for k in ("clean", "awgn", "emg_burst", "eog_blink")], "noise_type string")
    grid = done.select("patient_id").distinct().crossJoin(F.broadcast(kinds))
    return grid.join(done, ["patient_id", "noise_type"], "left_anti")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("n_props"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("sum_k"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label against the sign of the first feature; the first feature is the score."""
    return trials(spark, sf_dir).where("label in (0, 1)").select("sample_id", "patient_id", "label", F.get("v", F.lit(0)).alias("score"), (F.get("v", F.lit(0)) > 0).cast("int").alias("predicted"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_predictions(spark, sf_dir), "label", "predicted")


def sens_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.per_class(_predictions(spark, sf_dir), "label", "predicted")
    return c.select("label", "support", "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "specificity", "f1")])


def prf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summary(_predictions(spark, sf_dir), "label", "predicted")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.auc(_predictions(spark, sf_dir), "label", "score").select("positives", "negatives", F.round("auc", 6).alias("auc"))


def auc_by_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _predictions(spark, sf_dir).where("patient_id is not null")
    return evaluation.auc(d, "label", "score", ["patient_id"]).select("patient_id", "positives", "negatives", F.round("auc", 6).alias("auc"))


def consensus_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the mean vote of 1 to 16 landmark similarities, over four random orders."""
    rows = latest_version(table(spark, sf_dir, "feature_bundle"), "sample_id", "built_at", ["similarity", "label"])
    p = A.doubles(F.col("similarity"))
    rows = rows.where("label in (0, 1)").select("label", p.alias("p")).where((F.size("p") == 16) & A.finite(F.col("p")))
    return evaluation.consensus(rows.withColumn("p", F.transform("p", lambda x: (x + 1) / 2)), "p", "label", 16, 4)


def _learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = trials(spark, sf_dir).where("label in (0, 1)").withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "sample_id"), F.lit(5)).cast("int"))
    # Fitting reads the rows many times; written once, they also can't be reached by filters on predictions.
    d = cut_lineage(d.select("sample_id", "label", "fold", "v"))
    d = d.withColumn("label", F.col("label").cast("double")).withColumn("features", array_to_vector("v")).select("sample_id", "label", "fold", "features")
    return StandardScaler(inputCol="features", outputCol="x", withMean=True).fit(d.where("fold > 0")).transform(d).drop("features").withColumnRenamed("x", "features")


def _classifier(estimator):
    """Hold-out metrics of a model fitted on four folds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _learning(spark, sf_dir)
        model = estimator().fit(d.where("fold > 0"))
        out = model.transform(d.where("fold = 0")).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
        return evaluation.summary(out, "label", "predicted")

    return query


def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _learning(spark, sf_dir)
    p = PCA(k=2, inputCol="features", outputCol="y").fit(d).transform(d).withColumn("y", vector_to_array("y"))
    return p.select("sample_id", F.col("label").cast("int").alias("label"), F.get("y", F.lit(0)).alias("pc1"), F.get("y", F.lit(1)).alias("pc2"))


FOUND = {
    f.__name__: f
    for f in (
        summary_by_condition, summary_with_average, pivot_scale_coupling, best_per_group, reference_classifier, condition_ranks, near_best_cells, condition_trend, summary_long, patient_report, parse_key_rsplit,
        fingerprints, pending_conditions, json_props, confusion, sens_spec, prf_weighted, auc_rank, auc_by_patient, consensus_curve, pca_projection,
    )
} | {
    "logistic_regression": _classifier(lambda: experiments.model("logistic")),
    "random_forest": _classifier(lambda: experiments.model("forest")),
    "gradient_boosting": _classifier(lambda: experiments.model("boosting")),
}

_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"
RUNS = f"""WITH a AS (SELECT *, {_PATIENT} AS pid FROM (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC NULLS LAST, patient_id DESC NULLS LAST, noise_type DESC NULLS LAST, noise_level DESC NULLS LAST, n_samples DESC NULLS LAST) AS rn FROM patient_result) WHERE rn = 1),
r AS (SELECT * FROM a WHERE coalesce(error, '') = ''),
s AS (SELECT result_id, pid AS patient_id, noise_type, noise_level, m.key AS model, m.value AS accuracy FROM (SELECT *, unnest(map_entries(classifier_results)) AS m FROM r) WHERE m.value IS NOT NULL AND NOT isnan(m.value))
"""
PRED = f"""WITH b AS (SELECT sample_id, label, {_PATIENT} AS patient_id, CAST(features AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY built_at DESC NULLS LAST, features DESC NULLS LAST, label DESC NULLS LAST) AS rn FROM feature_bundle) WHERE rn = 1),
d AS (SELECT label, patient_id, v[1] AS score, CAST(v[1] > 0 AS INTEGER) AS predicted FROM b WHERE label IN (0, 1) AND len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64)
"""
_CLASS = (
    PRED
    + """, l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT l.label, count(*) FILTER (d.label = l.label) AS support, count(*) FILTER (d.label = l.label AND predicted = l.label) AS tp, count(*) FILTER (d.label <> l.label AND predicted = l.label) AS fp,
  count(*) FILTER (d.label = l.label AND predicted <> l.label) AS fn, count(*) FILTER (d.label <> l.label AND predicted <> l.label) AS tn FROM d, l GROUP BY 1),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
"""
)
_AUC = """, x AS (SELECT {k} label, rank() OVER ({p} ORDER BY score) + (count(*) OVER ({q} score) - 1) / 2.0 AS r FROM d {w})
SELECT {k} count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0), 6) AS auc FROM x {g}"""
SQL = {
    "summary_by_condition": RUNS + "SELECT noise_type, noise_level, model, count(*) AS n, round(avg(accuracy), 10) AS accuracy_mean, round(stddev_samp(accuracy), 10) AS accuracy_std FROM s GROUP BY 1, 2, 3",
    "summary_with_average": RUNS + "SELECT model, round(avg(accuracy), 10) AS accuracy FROM s GROUP BY model UNION ALL SELECT 'AVERAGE', round(avg(accuracy), 10) FROM s",
    "pivot_scale_coupling": RUNS + "SELECT model, " + ", ".join(f"round(avg(accuracy) FILTER (noise_type = '{k}'), 10) AS {k}" for k in ("clean", "awgn", "emg_burst", "eog_blink")) + " FROM s GROUP BY model",
    "best_per_group": RUNS + ", g AS (SELECT patient_id, model, round(avg(accuracy), 10) AS a FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY a DESC, model) AS rn FROM g) SELECT patient_id, model, round(a, 10) AS accuracy FROM k WHERE rn = 1",
    "reference_classifier": RUNS + "SELECT model, round(avg(accuracy), 10) AS accuracy FROM s WHERE noise_type = 'clean' GROUP BY model ORDER BY 2 DESC, 1 LIMIT 1",
    "condition_ranks": RUNS
    + ", c AS (SELECT DISTINCT noise_type, noise_level FROM s) SELECT noise_type, noise_level, CAST(row_number() OVER (ORDER BY CASE noise_type WHEN 'clean' THEN 0 WHEN 'awgn' THEN 1 ELSE 2 END, noise_type NULLS FIRST, -coalesce(TRY_CAST(noise_level AS DOUBLE), 0), CASE noise_level WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 ELSE 4 END, noise_level NULLS FIRST) AS INTEGER) AS position FROM c",
    "condition_trend": RUNS
    + ", m AS (SELECT concat_ws(':', noise_type, noise_level) AS condition, model, round(avg(accuracy), 10) AS accuracy FROM s GROUP BY 1, 2) SELECT 'condition' AS by, condition AS name, arg_min(model, (-accuracy, model)) AS best, max(accuracy) AS accuracy FROM m GROUP BY condition UNION ALL SELECT 'model', model, arg_min(condition, (-accuracy, condition)), max(accuracy) FROM m GROUP BY model",
    "summary_long": RUNS
    + ", g AS (SELECT noise_type, noise_level, model, round(avg(accuracy), 10) AS a, round(stddev_samp(accuracy), 10) AS d FROM s GROUP BY 1, 2, 3) SELECT noise_type, noise_level, model, 'accuracy_mean' AS measure, a AS value FROM g UNION ALL SELECT noise_type, noise_level, model, 'accuracy_std', d FROM g WHERE d IS NOT NULL",
    "near_best_cells": RUNS + ", c AS (SELECT noise_type, noise_level, model, avg(accuracy) AS a FROM s GROUP BY 1, 2, 3) SELECT noise_type, noise_level, model, round(a, 10) AS accuracy FROM c WHERE a >= (SELECT max(a) FROM c) - 0.01",
    "patient_report": RUNS
    + ", n AS (SELECT pid, count(*) AS n_runs, count(*) FILTER (coalesce(error, '') <> '') AS n_failed FROM a GROUP BY 1), g AS (SELECT patient_id, round(avg(accuracy), 10) AS m, round(stddev_samp(accuracy), 10) AS sd FROM s GROUP BY 1) SELECT pid AS patient_id, n_runs, n_failed, m AS mean_accuracy, sd AS std_accuracy FROM n LEFT JOIN g ON pid = g.patient_id",
    "parse_key_rsplit": RUNS + "SELECT concat_ws('_', noise_type, model) AS name, 'accuracy' AS metric, count(*) AS n FROM s GROUP BY 1",
    "fingerprints": RUNS + "SELECT substr(sha256(concat_ws('|', noise_type, noise_level, CAST(feature_dim AS VARCHAR))), 1, 16) AS fingerprint, count(*) AS n FROM r GROUP BY 1",
    "pending_conditions": RUNS + ", g AS (SELECT p.pid AS patient_id, k.noise_type FROM (SELECT DISTINCT pid FROM r WHERE pid IS NOT NULL) p, (SELECT unnest(['clean', 'awgn', 'emg_burst', 'eog_blink']) AS noise_type) k) SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pid = g.patient_id AND r.noise_type = g.noise_type)",
    "json_props": "SELECT event_type, count(json_extract_string(props, '$.k')) AS n_props, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type",
    "confusion": PRED + "SELECT label, predicted, count(*) AS n FROM d GROUP BY 1, 2",
    "sens_spec": _CLASS + "SELECT label, support, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1 FROM m",
    "prf_weighted": _CLASS + "SELECT round(sum(tp) / sum(support), 6) AS accuracy, " + ", ".join(f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * support) / sum(support), 6) AS weighted_{m}" for m in ("precision", "recall", "specificity", "f1")) + " FROM m",
    "auc_rank": PRED + _AUC.format(k="", p="", q="PARTITION BY", w="", g=""),
    "auc_by_patient": PRED + _AUC.format(k="patient_id,", p="PARTITION BY patient_id", q="PARTITION BY patient_id,", w="WHERE patient_id IS NOT NULL", g="GROUP BY patient_id"),
}
