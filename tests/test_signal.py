import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.functions import iir
from cortigraph.operators import noise, signal


def frame(spark, *rows):
    return spark.createDataFrame([(i, list(map(float, r)) if r is not None else None) for i, r in enumerate(rows)], "id bigint, v array<double>")


def one(df):
    return [np.array(r["v"]) if r["v"] is not None else None for r in df.orderBy("id").collect()]


def test_projections_against_numpy(spark):
    x = np.random.default_rng(0).normal(3, 2, (3, 40))
    df = frame(spark, *x)
    np.testing.assert_allclose(one(signal.baseline(df, "v", 8)), x - x[:, :8].mean(1, keepdims=True))
    np.testing.assert_allclose(one(signal.standardise(df, "v")), (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True))
    np.testing.assert_allclose(one(signal.standardise_global(df, "v")), (x - x.mean()) / x.std())
    q = np.percentile(x, [25, 50, 75], axis=1)[..., None]
    np.testing.assert_allclose(one(signal.robust(df, "v")), (x - q[1]) / (q[2] - q[0]))
    lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
    np.testing.assert_allclose(one(signal.minmax(df, "v", -1, 1)), (x - lo) / (hi - lo) * 2 - 1)
    np.testing.assert_allclose(one(signal.scale_features(df, "v")), (x - x.mean(0)) / x.std(0))


def test_constant_signals_and_outliers(spark):
    df = frame(spark, [2, 2, 2, 2], [0, 1, 0, 1, 0, 100])
    assert one(signal.standardise(df, "v"))[0].tolist() == [0, 0, 0, 0]
    assert one(signal.mad_outliers(df, "v"))[1].tolist() == [0, 1, 0, 1, 0, 0.5]
    with pytest.raises(Exception, match="baseline longer"):
        signal.baseline(df, "v", 5).collect()


def test_bad_signals(spark):
    rows = [[0, 0, 0, 0], [1, 1, 1, 1], [float("nan")] * 4, [1, 5, 2, 9], [1, float("nan"), 3, 4], [], None]
    bad = [r["b"] for r in frame(spark, *rows).orderBy("id").select(signal.bad_signal(F.col("v")).alias("b")).collect()]
    assert bad == [True, True, True, False, True, True, True]


def test_filters_keep_phase_and_handle_dirty_rows(spark):
    t = np.arange(512) / 256
    slow, fast = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 60 * t)
    rows = [slow + fast, [1.0, float("nan"), 2.0], None, []]
    low, dirty, null, empty = one(signal.filtered(frame(spark, *rows), "v", [{"kind": "low", "rate": 256, "high": 25}]))
    assert np.abs(low - slow)[40:-40].max() < 0.02 and dirty is None and null is None and empty is None
    b, a = iir.design("notch", 256, low=60)
    assert np.abs(iir.both_ways(b, a, fast[None])[0][150:-150]).max() < 0.1
    b, a = iir.design("band", 256, 8, 12.5)
    w = np.exp(-2j * np.pi * np.array([10, 2, 60]) / 256)
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert gain[0] > 0.99 and gain[1] < 0.01 and gain[2] < 0.01


def test_noise_is_repeatable_and_of_the_right_power(spark):
    df = frame(spark, *np.random.default_rng(1).normal(0, 1, (40, 200)))
    a, b = (np.array(one(noise.apply(df.repartition(n), "v", "id", "awgn", 10.0))) for n in (1, 7))
    assert (a == b).all()
    clean = np.array(one(df))
    assert abs(((a - clean) ** 2).mean() / (clean**2).mean() - 0.1) < 0.01
    for kind, level in (("emg_burst", "severe"), ("eog_blink", "mild"), ("clean", None), ("gaussian", 0.3)):
        assert noise.apply(df, "v", "id", kind, level).count() == 40
    with pytest.raises(ValueError):
        noise.apply(df, "v", "id", "rain", 1)
