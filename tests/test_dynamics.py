from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet
import pytest

from cortigraph.functions import ode
from cortigraph.operators import dynamics
from cortigraph.plans import graphs


def test_equal_series_of_a_node_are_estimated_once(spark, monkeypatch):
    """Node 3 has no edge: all couplings of a batch have its one series. The others' series differ."""
    edges = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 2, 0.3)], "scale int, i bigint, j bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node bigint")
    couplings = [0.0, 0.5, 1.0]
    options = {"h": 0.01, "steps": 160, "transient": 20}
    want = {(r["coupling"], r["node"]): ode.largest_lyapunov(np.array(r["x"])) for r in dynamics.evolve(edges, nodes, couplings, output="trajectory", **options).collect()}
    got = {(r["coupling"], r["node"]): r["lyapunov"] for r in dynamics.evolve(edges, nodes, couplings, output="lyapunov", **options).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 12 and len({got[c, 0] for c in couplings}) == 3

    # The function of a group, run here to count the estimates.
    kept = {}
    grouped = SimpleNamespace(cogroup=lambda other: SimpleNamespace(applyInArrow=lambda run, schema: kept.update(run=run)))
    monkeypatch.setattr(type(edges), "groupBy", lambda self, *c: grouped)
    monkeypatch.setattr(type(edges), "distinct", lambda self: self)
    dynamics.evolve(edges, nodes, couplings, output="lyapunov", **options)
    calls, estimate = [], ode.largest_lyapunov
    monkeypatch.setattr(ode, "largest_lyapunov", lambda v: calls.append(1) or estimate(v))
    e = pa.table({"i": [0, 1], "j": [1, 2], "w": [0.5, 0.3]})
    s = pa.table({"node": [0, 1, 2, 3], "x0": [1.0, 2.0, 3.0, 4.0], "y0": [1.0, -2.0, 3.0, -4.0], "z0": [9.0, 8.0, 7.0, 6.0], "on_scale": [0] * 4, "in_part": [0] * 4})
    assert kept["run"](e, s).num_rows == 12 and len(calls) == 10


@pytest.mark.parametrize("name", ["dynamics_additive", "dynamics_diffusive", "dynamics_roessler", "sync_corr", "lyapunov"])
def test_all_nodes_of_large_graphs_take_part(spark, tmp_path, monkeypatch, name):
    """More nodes than the 5,000 to which they were sampled once."""
    v = np.random.default_rng(1).normal(size=(5003, 64))
    pa.parquet.write_table(pa.table({"vec_id": range(len(v)), "embedding": list(v), "label": [0] * len(v)}), f"{tmp_path}/embeddings.parquet")
    asked, evolve = {}, dynamics.evolve
    monkeypatch.setattr(dynamics, "evolve", lambda scales, nodes, couplings, **options: asked.update(n=nodes.count(), k=scales.select("scale").distinct().count()) or evolve(scales, nodes, couplings, **options))
    graphs.FOUND[name](spark, str(tmp_path))
    assert asked == {"n": 5003, "k": 10}


def test_more_nodes_than_were_accepted(spark):
    edges = spark.createDataFrame([(0, 0, 5002, 0.5)], "scale int, i bigint, j bigint, w double")
    got = dynamics.evolve(edges, spark.range(5003).toDF("node"), [1.0], steps=2, transient=1).select("node", "x_mean").collect()
    assert len({r["node"] for r in got}) == len(got) == 5003


def _frames(spark, v, limits):
    """The nodes with vectors and least weights, and the same graph as edges."""
    nodes = spark.createDataFrame([(10 * i, x.tolist()) for i, x in enumerate(v)], "node bigint, v array<double>")
    with np.errstate(invalid="ignore"):  # a constant vector has none
        r = np.corrcoef(v)
    rows = [(k, 10 * i, 10 * j, float(r[i, j])) for k, t in enumerate(limits) for i in range(len(v)) for j in range(i + 1, len(v)) if r[i, j] > 0 and r[i, j] >= t]
    return nodes, spark.createDataFrame(list(enumerate(limits)), "scale int, least double"), spark.createDataFrame(rows, "scale int, i bigint, j bigint, w double")


@pytest.mark.parametrize("output", ["stats", "lyapunov"])
def test_pieces_of_nodes(spark, monkeypatch, output):
    v = np.random.default_rng(4).normal(size=(20, 16))
    nodes, limits, _ = _frames(spark, v, [0.3])
    options = {"h": 0.01, "steps": 120, "transient": 20, "output": output}
    found = []
    for n in (512, 7):
        monkeypatch.setattr(dynamics, "ROWS", n)
        found.append(sorted(dynamics.evolve(limits, nodes, [0.0, 1.0], **options).collect()))
    assert found[0] == found[1] and len(found[0]) == 40


@pytest.mark.parametrize("output, mode", [("stats", "diffusive"), ("sync", "additive"), ("lyapunov", "additive")])
def test_matrix_made_in_the_task_and_kept_in_a_file(spark, output, mode):
    """Edges, vectors, pieces of nodes and files give the same."""
    v = np.random.default_rng(2).normal(size=(30, 16))
    v[7] = 1.0  # has no correlation
    nodes, limits, edges = _frames(spark, v, [-1e-12, 0.2])
    options = {"h": 0.01, "steps": 120, "transient": 20, "output": output, "mode": mode}
    rows = lambda d: {(r["scale"], r["coupling"], r["node"]): list(r)[3:] for r in d.collect()}
    want = rows(dynamics.evolve(edges, nodes, [0.0, 1.0, 2.0], **options))
    got = [rows(dynamics.evolve(limits, nodes, [0.0, 1.0, 2.0], memory=m, **options)) for m in (3e8, 1.0)]
    assert len(want) == 180
    for g in got:
        assert g.keys() == want.keys() and all(g[k] == pytest.approx(want[k], rel=1e-5, abs=1e-5) for k in want)


def test_sync_by_pieces_of_nodes():
    path = np.random.default_rng(6).normal(size=(50, 20, 3))
    path[:, 9] = 2.0
    want = np.corrcoef(np.delete(path, 9, axis=1).transpose(1, 0, 2).reshape(19, -1))[0]
    for rows in (1, 7, 20, 512):
        got = ode.sync_with_first(path, rows)
        assert got[9] == 0 and np.delete(got, 9) == pytest.approx(want)


def test_room_is_a_file_above_the_memory():
    small, large = ode.room((10, 3), 240), ode.room((10, 3), 239)
    assert isinstance(large.base, np.memmap) and not isinstance(small.base, np.memmap)
    large[3] = 5
    assert large.sum() == 15 and small.sum() == 0


def test_no_positive_pair(spark, tmp_path):
    x = np.linspace(-1, 1, 64)
    pa.parquet.write_table(pa.table({"vec_id": [1, 2], "embedding": [x, -x], "label": [0, 1]}), f"{tmp_path}/embeddings.parquet")
    assert graphs.FOUND["sync_corr"](spark, str(tmp_path)).count() == 0
