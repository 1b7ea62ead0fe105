"""Queries of signal cleaning, statistics and similarity to landmarks, over feature_bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.functions.keys import latest_version, patient_key
from cortigraph.operators import noise, signal, similarity
from cortigraph.session import table

RATE = 64.0


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_version(table(spark, sf_dir, "feature_bundle"), "sample_id", "built_at", ["features", "label", "patient_id"])
    return rows.select("sample_id", A.doubles(F.col("features")).alias("v"), "label", patient_key(F.col("patient_id")).alias("patient_id"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark, sf_dir).where((F.size("v") == 64) & A.finite(F.col("v")))


def _stats(v, **parts) -> F.Column:
    """Rounded numbers of one array, which is computed once."""
    return A.let(v, lambda x: F.struct(*[F.round(f(x), 5).alias(n) for n, f in parts.items()]))


def _summary(df: DataFrame) -> DataFrame:
    parts = _stats(F.col("v"), first=lambda x: F.get(x, F.lit(0)), last=lambda x: F.get(x, F.size(x) - 1), low=F.array_min, high=F.array_max, mean=A.mean)
    return df.select("sample_id", parts.alias("s")).select("sample_id", "s.*")


def _cleaning(f):
    return lambda spark, sf_dir: _summary(f(trials(spark, sf_dir)))


def bad_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark, sf_dir).where("v is not null").select("sample_id", signal.bad_signal(F.col("v"), limit=500.0).alias("bad"))


def good_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bundle(spark, sf_dir).where("v is not null")
    return rows.join(bad_trials(spark, sf_dir).where("bad").select("sample_id"), "sample_id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def nonfinite_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bundle(spark, sf_dir).where("size(v) > 0")
    dirty = F.size("v") - F.size(F.filter("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("sample_id", dirty.alias("n_replaced"), F.round(A.total(A.cleaned(F.col("v"))), 4).alias("total"))


def x_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _stats(F.col("v"), mean=A.mean, max=F.array_max, min=F.array_min, median=lambda x: A.quantile(x, 0.5), std=A.deviation)
    return trials(spark, sf_dir).select("sample_id", parts.alias("s")).select("sample_id", "s.*")


def moments6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, extremes, skewness and excess kurtosis (biased) of each trial; 0 where it is constant."""

    def power(x, k):
        z = A.let(A.mean(x), lambda m: A.let(A.deviation(x), lambda s: F.when(s > 0, F.aggregate(x, F.lit(0.0), lambda t, y: t + F.pow((y - m) / s, F.lit(float(k)))) / F.size(x))))
        return F.coalesce(z, F.lit(0.0 if k == 3 else 3.0))

    parts = _stats(F.col("v"), mean=A.mean, std=A.deviation, max=F.array_max, min=F.array_min, skew=lambda x: power(x, 3), kurt=lambda x: power(x, 4) - 3)
    return trials(spark, sf_dir).select("sample_id", parts.alias("s")).select("sample_id", "s.*")


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity of each patient's features: deviation, variance, Frobenius norm, entropy of 20 bins.

    Bins span the patient's own range; sums are combined before each shuffle.
    """
    rows = signal.standardise(trials(spark, sf_dir).where("patient_id is not null"), "v").select("patient_id", F.explode("v").alias("x"))
    by = rows.groupBy("patient_id").agg(F.stddev_pop("x").alias("std"), F.var_pop("x").alias("variance"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("frobenius"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    place = F.least(F.lit(19), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 20 + 1e-9)).cast("int")
    bins = rows.join(by.select("patient_id", "lo", "hi"), "patient_id").groupBy("patient_id", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    entropy = bins.join(by.select("patient_id", "n"), "patient_id").groupBy("patient_id").agg((-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias("entropy"))
    return by.join(entropy, "patient_id").select("patient_id", *[F.round(c, 4).alias(c) for c in ("std", "variance", "frobenius", "entropy")])


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bundle(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("label", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("percent"))


def filtered(*steps: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _summary(signal.filtered(trials(spark, sf_dir).select("sample_id", "v"), "v", list(steps)))

    return query


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(signal.clean(trials(spark, sf_dir).select("sample_id", "v"), "v", RATE, 0.5, 30.0, points=8))


def _noise(kind: str, level):
    """Power of the noise that each condition adds, by label."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = trials(spark, sf_dir).select("sample_id", "label", "v", F.col("v").alias("clean"))
        noisy = noise.apply(rows, "v", "sample_id", kind, level, RATE)
        gain = F.try_divide(similarity.squared_distance(F.col("v"), F.col("clean")), A.dot(F.col("clean"), F.col("clean")))
        return noisy.groupBy("label", "noise_type", "noise_level").agg(F.count(F.lit(1)).alias("n"), F.avg(gain).alias("noise_to_signal"))

    return query


def _landmarks(method: str, gamma: float = 1.0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = signal.standardise(trials(spark, sf_dir), "v") if method in ("rbf", "laplacian") else trials(spark, sf_dir)
        marks = table(spark, sf_dir, "landmark_sample").select("landmark_id", A.doubles(F.col("features")).alias("features"))
        marks = signal.standardise(marks, "features") if method in ("rbf", "laplacian") else marks
        s = similarity.against(rows.select("sample_id", "v"), "v", marks, "landmark_id", "features", method, gamma)
        return s.groupBy("sample_id").agg(F.max_by("landmark_id", F.struct(F.round("similarity", 9), -F.col("landmark_id"))).alias("nearest"), F.round(F.max("similarity"), 8).alias("best"), F.round(F.avg("similarity"), 8).alias("mean"))

    return query


def landmark_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored similarity rows against recomputed ones: largest difference by label."""
    rows = latest_version(table(spark, sf_dir, "feature_bundle"), "sample_id", "built_at", ["features", "similarity", "label"])
    rows = rows.select("sample_id", "label", A.doubles(F.col("features")).alias("v"), A.doubles(F.col("similarity")).alias("stored")).where((F.size("v") == 64) & A.finite(F.col("v")) & (F.size("stored") == 16) & A.finite(F.col("stored")))
    marks = table(spark, sf_dir, "landmark_sample")
    s = similarity.against(rows, "v", marks, "landmark_id", "features", "pearson")
    order = marks.agg(F.array_sort(F.collect_set("landmark_id")).alias("ids"))
    d = s.crossJoin(F.broadcast(order)).select("label", F.abs(F.col("similarity") - F.get("stored", (F.array_position("ids", F.col("landmark_id")) - 1).cast("int"))).alias("d"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("mean_difference"))


FOUND = {
    "baseline_correct": _cleaning(lambda d: signal.baseline(d, "v", 16)),
    "baseline_zscore": _cleaning(lambda d: signal.baseline_zscore(d, "v", 16)),
    "mad_outliers": _cleaning(lambda d: signal.mad_outliers(d, "v", 3.0)),
    "trial_standardize": _cleaning(lambda d: signal.standardise(d, "v")),
    "global_standardize": _cleaning(lambda d: signal.standardise_global(d, "v")),
    "minmax": _cleaning(lambda d: signal.minmax(d, "v", -1.0, 1.0)),
    "robust_scale": _cleaning(lambda d: signal.robust(d, "v")),
    "feature_scaler": _cleaning(lambda d: signal.scale_features(d, "v")),
    "feature_minmax": _cleaning(lambda d: signal.scale_features(d, "v", "minmax")),
    "bad_trials": bad_trials,
    "good_trials": good_trials,
    "nonfinite_cleanup": nonfinite_cleanup,
    "x_stats": x_stats,
    "moments6": moments6,
    "diversity": diversity,
    "class_distribution": class_distribution,
    "bandpass": filtered({"kind": "band", "rate": RATE, "low": 4.0, "high": 12.5}),
    "notch": filtered({"kind": "notch", "rate": RATE, "low": 20.0}),
    "highpass": filtered({"kind": "high", "rate": RATE, "low": 2.0}),
    "lowpass": filtered({"kind": "low", "rate": RATE, "high": 16.0}),
    "eeg_filter": filtered({"kind": "band", "rate": RATE, "low": 8.0, "high": 12.5}, {"kind": "notch", "rate": RATE, "low": 25.0}),
    "clean_pipeline": clean_pipeline,
    "noise_gaussian": _noise("gaussian", 0.5),
    "noise_awgn": _noise("awgn", 10.0),
    "noise_emg": _noise("emg_burst", "moderate"),
    "noise_eog": _noise("eog_blink", "moderate"),
    "landmark_pearson": _landmarks("pearson"),
    "landmark_cosine": _landmarks("cosine"),
    "landmark_spearman": _landmarks("spearman"),
    "landmark_rbf": _landmarks("rbf", 0.02),
    "landmark_laplacian": _landmarks("laplacian", 0.02),
    "landmark_check": landmark_check,
}

_PATIENT = "nullif(lower(translate(patient_id, chr(9) || chr(10) || chr(13) || chr(160) || ' -_', '')), '')"
BUNDLE = f"""WITH b AS (SELECT sample_id, label, {_PATIENT} AS patient_id, CAST(features AS DOUBLE[]) AS v, CAST(similarity AS DOUBLE[]) AS stored FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY built_at DESC NULLS LAST, features DESC NULLS LAST, label DESC NULLS LAST) AS rn FROM feature_bundle) WHERE rn = 1),
t AS (SELECT * FROM b WHERE len(v) = 64 AND len(list_filter(v, lambda x: isfinite(x))) = 64)
"""


def _sql(stats: str, value: str) -> str:
    return (
        BUNDLE
        + f""", s AS (SELECT *, {stats} FROM t), o AS (SELECT sample_id, list_transform(v, lambda x: {value}) AS y FROM s)
SELECT sample_id, round(y[1], 5) AS first, round(y[len(y)], 5) AS last, round(list_min(y), 5) AS low, round(list_max(y), 5) AS high, round(list_avg(y), 5) AS mean FROM o"""
    )


_UNIT = "list_transform({0}, lambda x: x - list_avg({0}))"
_LAND = """, m AS (SELECT landmark_id, CAST(features AS DOUBLE[]) AS f FROM landmark_sample),
{prep}
p AS (SELECT t2.sample_id, m2.landmark_id, {pair} AS w FROM t2, m2)
SELECT sample_id, max_by(landmark_id, (round(w, 9), -landmark_id)) AS nearest, round(max(w), 8) AS best, round(avg(w), 8) AS mean FROM p GROUP BY sample_id"""


def _two(a: str, b: str) -> str:
    return f"t2 AS (SELECT sample_id, {a} AS a FROM t), m2 AS (SELECT landmark_id, {b} AS b FROM m),"


_Z = "list_transform({0}, lambda x: (x - list_avg({0})) / (CASE WHEN list_aggregate({0}, 'stddev_pop') < 1e-6 THEN 1e-6 ELSE list_aggregate({0}, 'stddev_pop') END))"
_R = "list_transform({0}, lambda x: len(list_filter({0}, lambda y: y < x)) + (len(list_filter({0}, lambda y: y = x)) + 1) / 2.0)"
_COS = "list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-300)"
_DEV = "list_aggregate({0}, 'stddev_pop')"

SQL = {
    "baseline_correct": _sql("list_avg(v[1:16]) AS m", "x - m"),
    "baseline_zscore": _sql("list_avg(v[1:16]) AS m, CASE WHEN list_aggregate(v[1:16], 'stddev_pop') = 0 THEN 1e-6 ELSE list_aggregate(v[1:16], 'stddev_pop') END AS s", "(x - m) / s"),
    "mad_outliers": _sql("list_aggregate(v, 'median') AS m, list_aggregate(list_transform(v, lambda x: abs(x - list_aggregate(v, 'median'))), 'median') AS d", "CASE WHEN abs(x - m) / (CASE WHEN d = 0 THEN 1e-6 ELSE d END) > 3.0 THEN m ELSE x END"),
    "trial_standardize": _sql("list_avg(v) AS m, greatest(list_aggregate(v, 'stddev_pop'), 1e-6) AS s", "(x - m) / s"),
    "global_standardize": _sql("(SELECT avg(x) FROM (SELECT unnest(v) AS x FROM t)) AS m, (SELECT stddev_pop(x) FROM (SELECT unnest(v) AS x FROM t)) AS s", "(x - m) / s"),
    "minmax": _sql("list_min(v) AS a, CASE WHEN list_max(v) = list_min(v) THEN 1.0 ELSE list_max(v) - list_min(v) END AS w", "(x - a) / w * 2.0 - 1.0"),
    "robust_scale": _sql("list_aggregate(v, 'median') AS m, CASE WHEN list_aggregate(v, 'quantile_cont', 0.75) = list_aggregate(v, 'quantile_cont', 0.25) THEN 1e-6 ELSE list_aggregate(v, 'quantile_cont', 0.75) - list_aggregate(v, 'quantile_cont', 0.25) END AS w", "(x - m) / w"),
    "bad_trials": BUNDLE
    + """, n AS (SELECT sample_id, v, list_filter(v, lambda x: x IS NOT NULL AND NOT isnan(x)) AS c FROM b WHERE v IS NOT NULL)
SELECT sample_id, coalesce(len(c) = 0 OR len(list_filter(c, lambda x: x <> 0)) = 0 OR (CASE WHEN len(list_filter(c, lambda x: isinf(x))) > 0 THEN false ELSE list_avg(list_transform(c, lambda x: pow(x - list_avg(c), 2))) < 1e-6 END) OR (len(v) - len(c)) / len(v) > 0.1 OR len(list_filter(c, lambda x: abs(x) > 500.0)) > 0, true) AS bad FROM n""",
    "nonfinite_cleanup": BUNDLE + "SELECT sample_id, CAST(len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) AS INTEGER) AS n_replaced, round(coalesce(list_sum(list_filter(v, lambda x: isfinite(x))), 0), 4) AS total FROM b WHERE len(v) > 0",
    "x_stats": BUNDLE + "SELECT sample_id, round(list_avg(v), 5) AS mean, round(list_max(v), 5) AS max, round(list_min(v), 5) AS min, round(list_aggregate(v, 'median'), 5) AS median, round(list_aggregate(v, 'stddev_pop'), 5) AS std FROM t",
    "moments6": BUNDLE
    + """, s AS (SELECT *, list_avg(v) AS m, list_aggregate(v, 'stddev_pop') AS d FROM t)
SELECT sample_id, round(m, 5) AS mean, round(d, 5) AS std, round(list_max(v), 5) AS max, round(list_min(v), 5) AS min,
  CASE WHEN d > 0 THEN round(list_avg(list_transform(v, lambda x: pow((x - m) / d, 3))), 5) ELSE 0 END AS skew, CASE WHEN d > 0 THEN round(list_avg(list_transform(v, lambda x: pow((x - m) / d, 4))) - 3, 5) ELSE 0 END AS kurt FROM s""",
    "diversity": BUNDLE
    + f""", z AS (SELECT patient_id, unnest({_Z.format("v")}) AS x FROM t WHERE patient_id IS NOT NULL),
g AS (SELECT patient_id, stddev_pop(x) AS std, var_pop(x) AS variance, sqrt(sum(x * x)) AS frobenius, min(x) AS lo, max(x) AS hi, count(*) AS n FROM z GROUP BY 1),
h AS (SELECT z.patient_id, least(19, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 20 + 1e-9)) AS bin, count(*) AS c FROM z JOIN g ON z.patient_id = g.patient_id GROUP BY 1, 2),
e AS (SELECT h.patient_id, -sum(c / n * ln(c / n)) AS entropy FROM h JOIN g ON h.patient_id = g.patient_id GROUP BY 1)
SELECT g.patient_id, round(std, 4) AS std, round(variance, 4) AS variance, round(frobenius, 4) AS frobenius, round(entropy, 4) AS entropy FROM g JOIN e ON g.patient_id = e.patient_id""",
    "class_distribution": BUNDLE + "SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM b GROUP BY label",
    "feature_scaler": BUNDLE
    + """, x AS (SELECT sample_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM t), f AS (SELECT p, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM x GROUP BY p),
o AS (SELECT sample_id, list((x.x - m) / s ORDER BY x.p) AS y FROM x JOIN f ON x.p = f.p GROUP BY sample_id)
SELECT sample_id, round(y[1], 5) AS first, round(y[len(y)], 5) AS last, round(list_min(y), 5) AS low, round(list_max(y), 5) AS high, round(list_avg(y), 5) AS mean FROM o""",
    "feature_minmax": BUNDLE
    + """, x AS (SELECT sample_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM t), f AS (SELECT p, min(x) AS m, CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END AS s FROM x GROUP BY p),
o AS (SELECT sample_id, list((x.x - m) / s ORDER BY x.p) AS y FROM x JOIN f ON x.p = f.p GROUP BY sample_id)
SELECT sample_id, round(y[1], 5) AS first, round(y[len(y)], 5) AS last, round(list_min(y), 5) AS low, round(list_max(y), 5) AS high, round(list_avg(y), 5) AS mean FROM o""",
    "landmark_pearson": BUNDLE + _LAND.format(prep=_two(_UNIT.format("v"), _UNIT.format("f")), pair=_COS),
    "landmark_cosine": BUNDLE + _LAND.format(prep=_two("v", "f"), pair=_COS),
    "landmark_spearman": BUNDLE + _LAND.format(prep="tr AS (SELECT sample_id, " + _R.format("v") + " AS r FROM t), mr AS (SELECT landmark_id, " + _R.format("f") + " AS r FROM m), t2 AS (SELECT sample_id, " + _UNIT.format("r") + " AS a FROM tr), m2 AS (SELECT landmark_id, " + _UNIT.format("r") + " AS b FROM mr),", pair=_COS),
    "landmark_rbf": BUNDLE + _LAND.format(prep=_two(_Z.format("v"), _Z.format("f")), pair="exp(-0.02 * list_sum(list_transform(list_zip(a, b), lambda z: pow(z[1] - z[2], 2))))"),
    "landmark_laplacian": BUNDLE + _LAND.format(prep=_two(_Z.format("v"), _Z.format("f")), pair="exp(-0.02 * list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))))"),
}
SQL["landmark_check"] = (
    # Versions of one time are ordered by the columns that are asked for.
    BUNDLE.replace("features DESC NULLS LAST, label", "features DESC NULLS LAST, similarity DESC NULLS LAST, label")
    + f""", m AS (SELECT landmark_id, {_UNIT.format("f")} AS b, row_number() OVER (ORDER BY landmark_id) AS p FROM (SELECT landmark_id, CAST(features AS DOUBLE[]) AS f FROM landmark_sample)),
u AS (SELECT label, {_UNIT.format("v")} AS a, stored FROM t WHERE len(stored) = 16 AND len(list_filter(stored, lambda x: isfinite(x))) = 16)
SELECT label, count(*) AS n, round(avg(abs(greatest(-1, least(1, coalesce({_COS}, 0))) - stored[p])), 4) AS mean_difference FROM u, m GROUP BY label"""
)
SQL["good_trials"] = SQL["bad_trials"].replace("SELECT sample_id, coalesce", ", q AS (SELECT sample_id, coalesce", 1) + ") SELECT label, count(*) AS n FROM b JOIN q ON b.sample_id = q.sample_id WHERE NOT bad GROUP BY label"
