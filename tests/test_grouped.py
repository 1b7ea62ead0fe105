import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.operators import grouped
from cortigraph.plans.pipeline import CONDITIONS, conditions_of

DIM = 6


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        g = "hot" if i < 600 else f"p{i % 4}"
        y = int(rng.integers(0, 2))
        x = rng.normal(size=DIM) * [1, 5, 0.1, 1, 1, 2] + y * np.array([1.0, 0, 0.05, 0, -1.0, 0])
        out.append((i, g, y, x.tolist(), i % 5))
    bad = [(900, "hot", 1, [float("nan")] * DIM, 0), (901, "hot", 1, None, 0), (902, "hot", None, [0.0] * DIM, 0), (903, None, 1, [1.0] * DIM, 1), (904, "hot", 1, [1.0], 1), (905, "one", 1, [1.0] * DIM, 0), (906, "hot", 7, [1.0] * DIM, 2)]
    return out, spark.createDataFrame(out + bad, "id bigint, g string, label int, v array<double>, fold int").repartition(7)


def test_sums_of_products(rows):
    plain, df = rows
    sums = grouped.moments(df.withColumnRenamed("g", "who"), ["who", "fold"], "v", "label", DIM).collect()
    got = {(r["who"], r["fold"]): np.frombuffer(r["g"]).reshape(DIM + 2, DIM + 2) for r in sums}
    assert len(sums) == len(got) == 5 * 5 + 2
    for (who, fold), g in got.items():
        z = np.array([[1, y, *x] for i, w, y, x, f in plain if w == who and f == fold])
        if len(z):
            assert np.allclose(g, z.T @ z)


def test_out_of_fold_predictions_like_numpy(rows):
    plain, df = rows
    df = df.withColumnRenamed("g", "who").where("who in ('hot', 'p1') and id < 900")
    sets = {"all": [(1, DIM)], "ends": [(1, 1), (5, 2)]}
    models = grouped.fold_models(grouped.moments(df, ["who", "fold"], "v", "label", DIM), ["who"], "fold", sets, DIM, penalties=(1.0,))
    got = {(r["id"], r["set"]): r["score"] for r in grouped.predicted(df, models, ["who", "fold"], "v").collect()}
    for who in ("hot", "p1"):
        for fold in range(5):
            for name, at in (("all", list(range(DIM))), ("ends", [0, 4, 5])):
                train = [(y, np.array(x)[at]) for _, w, y, x, f in plain if w == who and f != fold]
                y, x = np.array([t[0] for t in train]), np.array([t[1] for t in train])
                m, s = x.mean(0), x.std(0)
                z = (x - m) / s
                w = np.linalg.solve(z.T @ z + np.eye(len(at)), z.T @ (y - y.mean()))
                for i, k, _, v, f in plain:
                    if k == who and f == fold:
                        assert abs(got[i, name] - (y.mean() + ((np.array(v)[at] - m) / s) @ w)) < 1e-8
    metrics = grouped.group_metrics(grouped.predicted(df, models, ["who", "fold"], "v"), ["who", "set"], "label").collect()
    assert len(metrics) == 4 and all(r["auc"] > 0.7 and r["accuracy"] > 0.65 for r in metrics if r["who"] == "hot")


def test_penalty_is_kept_unless_another_is_better(rows):
    _, df = rows
    df = df.withColumnRenamed("g", "who").where("who = 'p1' and id < 900")
    sums = grouped.moments(df, ["who", "fold"], "v", "label", DIM)
    far = grouped.fold_models(sums, ["who"], "fold", {"all": [(1, DIM)]}, DIM, penalties=(1e6, 1.0)).collect()
    assert len(far) == 5 and all(r["tuned"] for r in far)
    assert not any(r["tuned"] for r in grouped.fold_models(sums, ["who"], "fold", {"all": [(1, DIM)]}, DIM, penalties=(1.0, 1e6)).collect())


def test_class_minimum_and_empty(rows):
    _, df = rows
    assert {r["g"] for r in grouped.eligible(df, "g", "label").collect()} == {"hot", "p0", "p1", "p2", "p3"}
    none = df.limit(0).withColumnRenamed("g", "who")
    assert grouped.fold_models(grouped.moments(none, ["who", "fold"], "v", "label", DIM), ["who"], "fold", {"all": [(1, DIM)]}, DIM).count() == 0


def test_condition_selector():
    assert conditions_of(CONDITIONS, "awgn:5, clean") == [("clean", ""), ("awgn", "5")]
    assert [p[1] for p in conditions_of(CONDITIONS, "eog_blink")] == ["mild", "moderate", "severe"]
    assert len(conditions_of(CONDITIONS)) == 11 and conditions_of(CONDITIONS, "") == []
