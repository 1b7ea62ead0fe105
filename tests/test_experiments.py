import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.functions.ranking import running_total
from cortigraph.operators import evaluation, experiments


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6))
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), f"g{i % 20}") for i in range(240)], "id bigint, label int, v array<double>, g string")
    return experiments.prepared(df, "id", "v", "label", 3)


def test_ablation_prefers_the_informative_features(rows):
    a = experiments.ablation(rows, {"first": [(1, 2)], "rest": [(3, 4)]}, {"logistic": lambda: experiments.model("logistic", maxIter=20)}, 3)
    acc = {r["features"]: r["accuracy"] for r in a.collect()}
    assert acc["first"] > 0.85 > 0.65 > acc["rest"]


def test_transfer_and_bagging(rows):
    make = lambda: experiments.model("logistic", maxIter=20)
    assert experiments.transfer(rows, rows, make, 3).first()["accuracy"] > 0.85
    votes = experiments.bagged(rows, 3, make)
    assert votes.count() == rows.where("fold = 0").count() and votes.where("votes < 0 or votes > 1").count() == 0


def test_fourier_features_approach_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(6, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    z = np.array([r["v"] for r in experiments.fourier_features(df, "v", 4000, 0.3).orderBy("id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(z @ z.T, want, atol=0.08)


def test_votes_and_consensus(spark):
    near = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "id bigint, other bigint, rank int")
    labels = spark.createDataFrame([(1, 0), (10, 1), (11, 0), (12, 0)], "id bigint, label int")
    got = {r["k"]: r["predicted"] for r in evaluation.knn_votes(near, labels, [1, 2, 3]).collect()}
    assert got == {1: 1, 2: 0, 3: 0}  # a tie goes to the smaller label
    df = spark.createDataFrame([(1, [0.9, 0.8, 0.1]), (0, [0.2, 0.1, 0.3])], "y int, p array<double>")
    c = {r["m"]: r["mean"] for r in evaluation.consensus(df, "p", "y", 3, 5).collect()}
    assert c[3] == 1.0 and 0 <= c[1] <= 1


def test_running_total(spark):
    df = spark.createDataFrame([(i, (i * 7) % 50, i % 3) for i in range(200)], "id bigint, x int, n int")
    got = running_total(df, [], F.floor(F.col("x") / 7), [F.col("x"), F.col("id")], "n", "t").orderBy("x", "id").collect()
    total = 0
    for r in got:
        assert r["t"] == total
        total += r["n"]
