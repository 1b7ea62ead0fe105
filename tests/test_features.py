import itertools

import numpy as np
import pytest

from cortigraph.operators import features, similarity


def test_steps():
    assert features.steps_of(64, 16) == [16, 32, 48, 63] and features.steps_of(64, 16, 20) == [20, 36, 52, 63] and features.steps_of(33, 16) == [16, 32]


def test_windows_like_slices(spark):
    x = np.random.default_rng(0).normal(size=40)
    df = spark.createDataFrame([(1, x.tolist(), "a"), (2, [], "b"), (3, [5.0], "c")], "id bigint, v array<double>, step0 string")
    for width in (None, 8):
        got = {(r["id"], r["step"]): r["f"] for r in features.features_at_steps(df, "v", [3, 20, 39], width).collect()}
        for s in (3, 20, 39):
            y = x[0 if width is None else max(0, s - width) : s + 1]
            assert np.allclose(got[1, s], [y.mean(), y.max(), y.min(), np.median(y), y.std()])
            assert got[2, s] == [0.0] * 5
        assert got[3, 3] == [5.0, 5.0, 5.0, 5.0, 0.0]


@pytest.mark.parametrize("block", [4, 1024])
def test_mean_distance(spark, block):
    x = np.random.default_rng(1).normal(size=(23, 3))
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, 100, [1.0, 2.0, 3.0])]
    got = {r["k"]: r["mean_distance"] for r in features.mean_distance(spark.createDataFrame(rows, "k int, id bigint, f array<double>"), "k", "id", "f", block).collect()}
    want = np.mean([np.linalg.norm(a - b) for a, b in itertools.combinations(x, 2)])
    assert abs(got[0] - want) < 1e-9 and got[1] == 0


def test_diversity_like_numpy(spark):
    x = np.random.default_rng(2).normal(size=(60, 4)) * [1, 2, 3, 4] + [0, 5, 0, -5]
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)] + [(1, 99, [2.0, 2.0, 2.0, 2.0])], "k int, id bigint, f array<double>")
    r = {x["k"]: x for x in features.diversity(df, "k", "id", "f").collect()}
    h = np.histogram(x.ravel(), bins=20)[0] + 1e-10
    h = h / h.sum()
    assert np.allclose([r[0]["std"], r[0]["variance"], r[0]["frobenius"], r[0]["entropy"]], [x.std(axis=0).mean(), x.var(), np.linalg.norm(x), -(h * np.log(h)).sum()])
    assert r[0]["combined"] == 0 and (r[1]["std"], r[1]["variance"], r[1]["mean_distance"], r[1]["combined"]) == (0, 0, 0, 0)
    assert features.diversity(df.limit(0), "k", "id", "f").count() == 0


def test_sequences(spark):
    rows = [(7, 1, [1.0, 2.0], [3.0, 4.0]), (7, 0, [5.0, 6.0], [7.0, 8.0]), (8, 0, [9.0], [10.0])]
    got = {r["node"]: r["v"] for r in features.sequences(spark.createDataFrame(rows, "node bigint, scale int, x array<double>, y array<double>"), "node", "scale", ["x", "y"]).collect()}
    assert got == {7: [[5.0, 7.0, 1.0, 3.0], [6.0, 8.0, 2.0, 4.0]], 8: [[9.0, 10.0]]}


def test_channels(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 3, 10))
    x[:, 1] = 4.0  # constant everywhere
    x[3, 2] = 1.0  # constant in one recording
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    r = lambda i, j, c: 0.0 if x[i, c].std() < 1e-9 or x[j, c].std() < 1e-9 else np.corrcoef(x[i, c], x[j, c])[0, 1]
    for live, n in ((False, 3), (True, 2)):
        got = {(e["i"], e["j"]): e["w"] for e in similarity.multichannel_pearson(df, 3, -2.0, live, block=5).collect()}
        assert len(got) == 66 and all(abs(got[i, j] - sum(r(i, j, c) for c in range(3)) / n) < 1e-9 for i, j in got)
    gamma = [1 / (10 * x[:, c].var()) if x[:, c].var() > 0 else 1.0 for c in range(3)]
    got = {(e["i"], e["j"]): e["w"] for e in similarity.multichannel_rbf(df, 3, block=5).collect()}
    assert all(abs(w - np.mean([np.exp(-gamma[c] * ((x[i, c] - x[j, c]) ** 2).sum()) for c in range(3)])) < 1e-9 for (i, j), w in got.items()) and len(got) == 66
