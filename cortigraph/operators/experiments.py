"""Cross-validation, ablations, transfer to noisy signals and bagged pools with MLlib models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortigraph.operators import evaluation, sampling
from cortigraph.session import cut_lineage

#: Estimators by name; parameters follow the usual library defaults for these models.
MODELS: dict[str, Callable[[], object]] = {
    "logistic": lambda: LogisticRegression(maxIter=100, regParam=1e-3),
    "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42),
    "boosting": lambda: GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=42),
    "boosting_multiclass": lambda: OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=42)),
    "svm": lambda: LinearSVC(maxIter=100, regParam=1e-3),
}


def model(name: str, **parameters):
    """A fresh estimator with some parameters changed; unknown names raise KeyError."""
    m = MODELS[name]()
    return m.copy({m.getParam(k): v for k, v in parameters.items()}) if parameters else m


def vectors(df: DataFrame, v: str, label: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(v).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))


def fourier_features(df: DataFrame, v: str, n: int = 256, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """v replaced by n random Fourier features of the RBF kernel; gamma defaults to 1 / length (for scaled inputs)."""
    schema = df.schema
    at = schema.fieldNames().index(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            rng = np.random.default_rng(seed)
            g = gamma or 1 / max(1, x.shape[1])
            w = rng.normal(0, (2 * g) ** 0.5, (x.shape[1], n))
            y = np.cos(x @ w + rng.uniform(0, 2 * np.pi, n)) * (2 / n) ** 0.5
            cols = [*b.columns]
            cols[at] = pa.array(list(y), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    wide = df.withColumn(v, F.col(v).cast("array<double>"))
    return wide.mapInArrow(run, wide.schema)


def _predict(train: DataFrame, test: DataFrame, estimator, by: list[str] | None = None) -> DataFrame:
    estimator.setFeaturesCol("scaled")
    fitted = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), estimator]).fit(train)
    return fitted.transform(test).select("id", *(by or []), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def cross_validate(df: DataFrame, make: Callable[[], object], folds: int = 5) -> DataFrame:
    """Out-of-fold predictions (id, label, predicted, fold); df: id, label, features, fold. Scaling is fitted per fold."""
    out = None
    for f in range(folds):
        part = _predict(df.where(F.col("fold") != f), df.where(F.col("fold") == f), make()).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def prepared(df: DataFrame, row_id: str, v: str, label: str, folds: int, group: str | None = None) -> DataFrame:
    """id, label, v, fold, written once: folds stratified by label, or by group where given."""
    d = df.select(F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(v).alias("v"), *([F.col(group).alias("group")] if group else []))
    d = sampling.group_folds(d, "group", folds).drop("group") if group else sampling.stratified_folds(d, "id", "label", folds)
    return cut_lineage(d.select("id", "label", "v", "fold"))


def ablation(df: DataFrame, sets: dict[str, list[tuple[int, int]]], models: dict[str, Callable[[], object]], folds: int = 5) -> DataFrame:
    """Metrics of every feature set (slices of v: from, length) and model, out of fold."""
    out = None
    for name, slices in sets.items():
        part = vectors(df.withColumn("v", F.concat(*[F.slice("v", a, n) for a, n in slices])), "v", "label")
        for m, make in models.items():
            row = evaluation.summary(cross_validate(part, make, folds), "label", "predicted").withColumn("features", F.lit(name)).withColumn("model", F.lit(m))
            out = row if out is None else out.unionByName(row)
    return out


def transfer(clean: DataFrame, noisy: DataFrame, make: Callable[[], object], folds: int = 5, by: list[str] | None = None) -> DataFrame:
    """Fitted on clean rows, tested on the noisy form of the other folds' rows; metrics of each condition in `by`."""
    out = None
    for f in range(folds):
        part = _predict(vectors(clean, "v", "label").where(F.col("fold") != f), vectors(noisy, "v", "label").where(F.col("fold") == f), make(), by)
        out = part if out is None else out.unionByName(part)
    return evaluation.summary(out, "label", "predicted", by)


def bagged(df: DataFrame, pool: int, make: Callable[[], object]) -> DataFrame:
    """id, label, votes: the share of `pool` bootstrap models for class 1 on the rows of fold 0; fitted on the others.

    Models must take weights: a bootstrap is the number of times a row is drawn.
    """
    train = sampling.bootstrap(vectors(df, "v", "label").where("fold > 0"), "id", pool)
    test, out = vectors(df, "v", "label").where("fold = 0"), None
    for r in range(pool):
        estimator = make()
        estimator.setWeightCol("times")
        part = _predict(train.where(F.col("replicate") == r).withColumn("times", F.col("times").cast("double")), test, estimator)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id", "label").agg(F.avg("predicted").alias("votes"))
