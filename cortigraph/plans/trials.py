"""Experiments over feature_bundle: ablation, transfer to noise, bagging, kernel machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.operators import evaluation, experiments, noise, signal
from cortigraph.plans.pipeline import CONDITIONS, conditions_of
from cortigraph.plans.signals import RATE, trials
from cortigraph.session import cut_lineage

FOLDS = 5


def _rows(spark: SparkSession, sf_dir: str, group: str | None = None) -> DataFrame:
    d = signal.standardise(trials(spark, sf_dir).where("label in (0, 1) and patient_id is not null"), "v")
    return experiments.prepared(d, "sample_id", "v", "label", FOLDS, group)


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feature sets by one linear model, folds by patient."""
    sets = {"low": [(1, 16)], "high": [(49, 16)], "all": [(1, 64)]}
    return experiments.ablation(_rows(spark, sf_dir, "patient_id"), sets, {"logistic": lambda: experiments.model("logistic")}, FOLDS)


def noise_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean to noisy by logistic regression: metrics of every noise condition; each fold's model is fitted once."""
    d, noisy = _rows(spark, sf_dir), None
    for kind, level in conditions_of(CONDITIONS):
        part = noise.apply(d, "v", "id", kind, float(level) if kind == "awgn" else level or None, RATE)
        noisy = part if noisy is None else noisy.unionByName(part)
    return experiments.transfer(d, cut_lineage(noisy), lambda: experiments.model("logistic"), FOLDS, ["noise_type", "noise_level"])


def bagged_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = experiments.bagged(_rows(spark, sf_dir), 20, lambda: experiments.model("logistic"))
    return evaluation.summary(votes.withColumn("predicted", (F.col("votes") >= 0.5).cast("int")), "label", "predicted")


def kernel_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RBF kernel machine by random Fourier features and a linear SVM, out of fold."""
    d = experiments.vectors(experiments.fourier_features(_rows(spark, sf_dir), "v", 256), "v", "label")
    return evaluation.summary(experiments.cross_validate(d, lambda: experiments.model("svm"), FOLDS), "label", "predicted")


FOUND = {f.__name__: f for f in (ablation, noise_transfer, bagged_pool, kernel_svm)}
