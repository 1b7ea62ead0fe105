"""Queries of classification by patient, by scale and under noise, over feature_bundle and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.operators import grouped, noise, robustness, sampling, signal
from cortigraph.plans import graphs
from cortigraph.plans.signals import RATE, trials
from cortigraph.session import cut_lineage, table

FOLDS = 5
DIM = 64
#: Feature groups of a vector and their unions.
GROUPS = {"S": [(1, 21)], "T": [(22, 21)], "D": [(43, 22)]}
SETS = {name: [s for g in name.split("+") for s in GROUPS[g]] for name in ("S", "T", "D", "S+T", "S+D", "T+D", "S+T+D")}
#: Noise conditions as type:level.
CONDITIONS = ("clean", "awgn:20", "awgn:10", "awgn:5", "awgn:0", "emg_burst:mild", "emg_burst:moderate", "emg_burst:severe", "eog_blink:mild", "eog_blink:moderate", "eog_blink:severe")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, patient_id, label, v, fold of the usable trials of both classes; folds are stratified by patient and label."""
    return _with_fold(_usable(spark, sf_dir))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).where("label in (0, 1) and patient_id is not null").select(F.col("sample_id").alias("id"), "patient_id", "label", "v")


def _with_fold(d: DataFrame) -> DataFrame:
    h = F.xxhash64(F.lit(42), F.col("id"))
    d = sampling.spread_rank(d, ["patient_id", "label"], sampling.hash_band(h, 4), [h, F.col("id")], "_r")
    return d.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(FOLDS)).cast("int")).drop("_r")


def _light_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, fold, v of `_rows`, v of the table's own type: only rows without an id carry it while folds are made, the others get it back by id."""
    d = _usable(spark, sf_dir)
    folds = _with_fold(d.select("id", "patient_id", "label", F.when(F.col("id").isNull(), F.col("v")).alias("_own"))).drop("patient_id")
    rows = folds.join(d.where("id is not null").select("id", "v"), "id", "left").withColumn("v", F.coalesce("_own", "v")).drop("_own")
    return rows.withColumn("v", F.col("v").cast(table(spark, sf_dir, "feature_bundle").schema["features"].dataType))


def patient_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with at least five samples of either class."""
    return grouped.eligible(_rows(spark, sf_dir), "patient_id", "label")


def _by_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(_rows(spark, sf_dir))
    enough = grouped.eligible(rows, "patient_id", "label").select("patient_id")
    rows = rows.join(enough, "patient_id", "left_semi")
    models = grouped.fold_models(grouped.moments(rows, ["patient_id", "fold"], "v", "label", DIM), ["patient_id"], "fold", SETS, DIM)
    return grouped.predicted(rows, models, ["patient_id", "fold"], "v")


def patient_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of every patient with enough samples, by feature set; tuned: folds whose penalty isn't the default."""
    p = cut_lineage(_by_patient(spark, sf_dir))
    tuned = p.groupBy("patient_id", "set").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("tuned"), F.col("fold"))).alias("tuned"))
    return grouped.group_metrics(p, ["patient_id", "set"], "label").join(tuned, ["patient_id", "set"])


def patient_pipeline_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every patient and feature set: each row once."""
    return _by_patient(spark, sf_dir).groupBy("patient_id", "set").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_rows"))


def patient_pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over the patients of each feature set and metric, in long form."""
    m = patient_pipeline(spark, sf_dir)
    names = ["accuracy", "macro_recall", "macro_specificity", "macro_f1", "auc"]
    long = m.unpivot(["patient_id", "set"], names, "metric", "value").where("value is not null")
    return long.groupBy("set", "metric").agg(F.count(F.lit(1)).alias("n_patients"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def best_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature set with the best mean of each metric, and how far the worst lies behind."""
    s = patient_pipeline_summary(spark, sf_dir)
    return s.groupBy("metric").agg(F.max_by("set", F.struct("mean", "set")).alias("best_set"), F.max("mean").alias("best"), (F.max("mean") - F.min("mean")).alias("span"))


def conditions_of(names: tuple[str, ...], wanted: str | None = None) -> list[tuple[str, str]]:
    """(type, level) of the conditions 'type:level'; `wanted` selects by a list with commas, of types or of types with levels."""
    pairs = [(n.partition(":")[0], n.partition(":")[2]) for n in names]
    chosen = None if wanted is None else {w.strip() for w in wanted.split(",") if w.strip()}
    return [p for p in pairs if chosen is None or p[0] in chosen or ":".join(p).rstrip(":") in chosen]


def _noisy(spark: SparkSession, sf_dir: str, wanted: str | None = None) -> DataFrame:
    """The rows under every condition: condition, id, label, fold, v."""
    rows = signal.standardise(_rows(spark, sf_dir), "v").select("id", "label", "fold", "v")
    out = None
    for kind, level in conditions_of(CONDITIONS, wanted):
        part = noise.apply(rows, "v", "id", kind, float(level) if kind == "awgn" else level or None, RATE)
        part = part.select(F.lit(f"{kind}:{level}".rstrip(":")).alias("condition"), "id", "label", "fold", "v")
        out = part if out is None else out.unionByName(part)
    return out


def noise_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every noise condition by protocol: fitted on clean rows, or on rows under the same noise; always other folds."""
    rows = cut_lineage(robustness.by_window(_light_rows(spark, sf_dir), "id"))
    rows = noise.places(signal.standardise(rows.withColumn("v", A.doubles(F.col("v"))), "v"), "id", DIM, RATE)
    conditions = conditions_of(CONDITIONS)
    models = grouped.fold_models(robustness.moments(rows, conditions, RATE, DIM), ["condition"], "fold", {"all": [(1, DIM)]}, DIM)
    return robustness.metrics(rows, models, conditions, RATE, DIM)


def noise_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under each condition, and whether white noise has the power that its ratio says (within a twentieth)."""
    rows = cut_lineage(_noisy(spark, sf_dir))
    clean = rows.where("condition = 'clean'").select("id", F.col("v").alias("c"))
    both = rows.join(clean, "id").withColumn("d", F.zip_with("v", "c", lambda x, y: x - y))
    snr = 10 * F.log10(F.try_divide(F.avg(A.dot(F.col("c"), F.col("c"))), F.avg(A.dot(F.col("d"), F.col("d")))))
    level = F.regexp_extract("condition", "awgn:(.*)", 1).try_cast("double")
    return both.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.abs(snr - F.first(level)) < 0.22, F.lit(False)).alias("as_stated"))


#: Node features of a scale: strength, edges | root of the squared weights, mean weight.
SCALE_SETS = {"size": [(1, 2)], "weight": [(3, 2)], "size+weight": [(1, 4)]}


def scale_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of every scale of the graph and set of node features; classes are the labels below 2 and the others."""
    v = graphs.vectors(spark, sf_dir)
    sums, _, _ = graphs.scale_sums(spark, sf_dir)
    f = F.array(F.col("degree"), F.col("edges").cast("double"), F.sqrt("squares"), F.coalesce(F.try_divide("degree", "edges"), F.lit(0.0)))
    known = v.where("label is not null").select(F.col("id").alias("node"), (F.col("label") >= 2).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64(F.lit(42), "node"), F.lit(FOLDS)).cast("int")
    rows = cut_lineage(sums.select("scale", "node", f.alias("v")).join(known, "node").select("scale", F.col("node").alias("id"), "label", "v", fold.alias("fold")))
    models = grouped.fold_models(grouped.moments(rows, ["scale", "fold"], "v", "label", 4), ["scale"], "fold", SCALE_SETS, 4)
    return grouped.group_metrics(cut_lineage(grouped.predicted(rows, models, ["scale", "fold"], "v")), ["scale", "set"], "label")


FOUND = {f.__name__: f for f in (patient_counts, patient_pipeline, patient_pipeline_size, patient_pipeline_summary, best_sets, scale_ablation, noise_robustness, noise_conditions)}

_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"
_T = f"""WITH b AS (SELECT sample_id, label, {_PATIENT} AS patient_id, CAST(features AS DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY built_at DESC NULLS LAST, features DESC NULLS LAST, label DESC NULLS LAST) AS rn FROM feature_bundle) WHERE rn = 1),
t AS (SELECT * FROM b WHERE label IN (0, 1) AND patient_id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64),
e AS (SELECT patient_id, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM t GROUP BY 1 HAVING count(*) FILTER (label = 0) >= 5 AND count(*) FILTER (label = 1) >= 5)
"""
SQL = {
    "patient_counts": _T + "SELECT patient_id, n0, n1 FROM e",
    "patient_pipeline_size": _T + f"SELECT patient_id, s.set, n0 + n1 AS n, n0 + n1 AS n_rows FROM e, (SELECT unnest({list(SETS)}) AS set) s",
    "noise_conditions": _T + f"SELECT c.condition, count(*) AS n, c.condition LIKE 'awgn:%' AS as_stated FROM t, (SELECT unnest({list(CONDITIONS)}) AS condition) c GROUP BY c.condition",
}
