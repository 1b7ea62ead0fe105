import numpy as np
from pyspark.sql import functions as F

from cortigraph.functions import ode
from cortigraph.operators import dynamics, noise


def network(field):
    return ode.Network(np.array([[0.0, 2.0], [2.0, 0.0]]), np.array([0.5]), field, "x_only")


def test_coupling_enters_y_for_lorenz_and_x_for_roessler():
    s = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])[:, :, None]
    pull = -0.5 * 2.0 * np.array([1.0 - 4.0, 4.0 - 1.0])  # -eps * (degree * x - A x)
    lorenz = np.array([[10 * (2 - 1), 1 * (60 - 3) - 2, 1 * 2 - 8 / 3 * 3], [10 * (5 - 4), 4 * (60 - 6) - 5, 4 * 5 - 8 / 3 * 6]])
    lorenz[:, 1] += pull
    assert np.allclose(network("lorenz")(s)[..., 0], lorenz)
    roessler = np.array([[-2 - 3, 1 + 0.2 * 2, 0.2 + 3 * (1 - 5.7)], [-5 - 6, 4 + 0.2 * 5, 0.2 + 6 * (4 - 5.7)]])
    roessler[:, 0] += pull
    assert np.allclose(network("roessler")(s)[..., 0], roessler)


def test_ring_and_diffusive_coupling():
    s = np.array([[1.0, 0.0, 0.0], [4.0, 0.0, 0.0], [9.0, 0.0, 0.0]])[:, :, None]
    a = np.ones((3, 3)) - np.eye(3)
    plain = ode.lorenz(s)
    ring = ode.Network(a, np.array([0.1]), mode="nearest")(s) - plain
    assert np.allclose(ring[:, 0, 0], 0.1 * np.array([4 + 9 - 2, 9 + 1 - 8, 1 + 4 - 18]))
    assert np.allclose(ode.Network(a, np.array([0.1]), mode="diffusive")(s) - plain, ring)


def test_neighbour_lists_like_the_matrix():
    rng = np.random.default_rng(3)
    a = np.where(rng.random((80, 80)) < 0.01, rng.random((80, 80)), 0)
    a = np.triu(a, 1) + np.triu(a, 1).T
    s = rng.normal(size=(80, 6))
    lists = ode.Neighbours(a, sparse_below=1.0)
    assert lists.dense is None and np.allclose(lists(s), a @ s) and np.allclose(ode.Neighbours(np.zeros((4, 4)))(s[:4]), 0)


def test_sync_in_the_kernel_like_corrcoef():
    path = np.random.default_rng(1).normal(size=(50, 4, 3))
    path[:, 2] = 1.0
    got = ode.sync_with_first(path)
    assert got[2] == 0 and np.isclose(got[3], np.corrcoef(path[:, 0].ravel(), path[:, 3].ravel())[0, 1]) and np.isclose(got[0], 1)


def test_bursts():
    found = [b for w in range(40) for b in noise.bursts(7, w, 256, 256.0)]
    assert 40 <= len(found) <= 120
    for start, values, first, last in found:
        assert 0 <= start and start + len(values) <= 256 and 26 <= len(values) <= 128 and 1 <= last - first <= 3
        assert abs(np.sqrt(np.mean(values**2)) - 1) < 1e-3 and values[0] == values[-1] == 0
    power = np.zeros(129)
    for _, values, *_ in found:
        power += np.abs(np.fft.rfft(values, 256)) ** 2
    assert power[15:76].sum() > 0.9 * power.sum()
    assert noise.bursts(7, 3, 256, 256.0)[0][1].tolist() == noise.bursts(7, 3, 256, 256.0)[0][1].tolist()


def test_emg_is_shared_in_a_window_and_scaled_by_rms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(36, 256)) * np.arange(1, 37)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(36, None, "x"), (37, [], "x"), (None, [1.0], "x")], "row bigint, v array<double>, n string").repartition(5)
    got = {r["row"]: r["v"] for r in noise.emg_burst(df, "v", "row", "severe", 256.0).collect()}
    assert got[36] is None and got[37] == [] and got[None] == [1.0]
    for i in range(36):
        want = x[i].copy()
        for start, values, first, last in noise.bursts(42, i // 18, 256, 256.0):
            if first <= i % 18 <= last:
                want[start : start + len(values)] += np.sqrt(np.mean(x[i] ** 2)) * values
        assert np.allclose(got[i], want, atol=1e-6)


def test_blinks_have_the_stated_power(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(180, 200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row bigint, v array<double>")
    got = {r["row"]: np.array(r["v"]) for r in noise.eog_blink(df, "v", "row", "moderate", 100.0).collect()}
    weight = lambda c: 1.0 if c < 6 else 0.55 if c < 12 else 0.25
    ratio = {i: np.sqrt(np.mean((got[i] - x[i]) ** 2) / np.mean(x[i] ** 2)) / weight(i % 18) for i in got}
    for w in range(10):
        r = [ratio[i] for i in range(18 * w, 18 * w + 18)]
        assert max(r) - min(r) < 1e-6 and (r[0] == 0 or r[0] >= 0.99)
    assert len({round(ratio[18 * w], 3) for w in range(10)}) > 1


def test_lyapunov_and_sync(spark):
    x = [0.4]
    for _ in range(1200):
        x.append(4 * x[-1] * (1 - x[-1]))
    assert 0.05 < ode.largest_lyapunov(np.array(x)) < 0.9
    assert abs(ode.largest_lyapunov(np.sin(np.arange(1200) * 0.1))) < 0.05
    rows = [(0, 1.0, n, [float(n + 1) * v for v in (1, 2, 4)], [0.0] * 3, [0.5] * 3) for n in range(3)] + [(0, 1.0, 3, [1.0] * 3, [1.0] * 3, [1.0] * 3)]
    paths = spark.createDataFrame(rows, "scale int, coupling double, node bigint, x array<double>, y array<double>, z array<double>")
    got = {r["node"]: r["sync"] for r in dynamics.sync_with_centre(paths).collect()}
    flat = lambda r: np.array(r[3] + r[4] + r[5])
    assert all(abs(got[n] - np.corrcoef(flat(rows[0]), flat(rows[n]))[0, 1]) < 1e-9 for n in range(3)) and got[3] == 0
    both = dynamics.lyapunov(paths.limit(1)).first()
    assert both["lyapunov"] == 0.0


def test_nearest_points():
    """Like brute force: the nearest at least `apart` off, the first among equals, the first of all where there is none."""
    rng = np.random.default_rng(5)
    for m, apart in ((200, 10), (70, 1), (65, 30), (12, 10)):
        e = rng.normal(size=(m, 3)).round(1)
        d = ((e[:, None] - e[None]) ** 2).sum(axis=2)
        i = np.arange(m)
        d[abs(i[:, None] - i) < apart] = np.inf
        j = ode._nearest(e, apart)
        assert np.allclose(d[i, j], d.min(axis=1)) and (j[np.isinf(d.min(axis=1))] == 0).all()


def test_couplings_whose_state_stands_still_are_not_computed_on(monkeypatch):
    """Strong additive coupling drives all nodes to the clip; the path is that of each coupling by itself, step by step."""
    rng = np.random.default_rng(4)
    a = np.triu(rng.random((30, 30)), 1)
    a += a.T
    eps = np.array([20.0, 0.0, 15.0, 0.01])
    s = rng.uniform(-10, 10, (30, 3, 1)).repeat(4, axis=2)
    widths, call = [], ode.Network.__call__
    monkeypatch.setattr(ode.Network, "__call__", lambda self, x: widths.append(x.shape[2]) or call(self, x))
    for method, transient in (("rk4", 0), ("rk4", 250), ("euler", 3)):
        widths.clear()
        path = ode.Network(a, eps).trajectory(s, 1e-3, 300, transient, method)
        assert widths[0] == 4 and widths[-1] == 2 and path.shape == (301 - transient, 30, 3, 4)
        one = ode.Network(a, eps, state_clip=200.0)
        want, x = [], s
        for _ in range(301):
            want.append(x)
            x = one._rk4(x, 1e-3, one) if method == "rk4" else one._euler(x, 1e-3, one)
        assert np.allclose(path, want[transient:], rtol=1e-6, atol=1e-6)
        assert (path[-1, ..., 0] == path[-2, ..., 0]).all() and len(np.unique(path[-1, ..., 1])) > 30
    widths.clear()
    assert (np.abs(ode.Network(a, eps[:1]).trajectory(s[..., :1], 1e-3, 3000, 2000)) == 205.0).all() and len(widths) < 4 * 400


def test_constant_series_has_exponent_zero_at_once(monkeypatch):
    monkeypatch.setattr(ode, "_nearest", None)
    assert ode.largest_lyapunov(np.full(1001, 205.0)) == 0.0
