import numpy as np
import pytest

from cortigraph.operators import dynamics, similarity
from cortigraph.plans import graphs, pipeline


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    """420 vectors, and their correlations."""
    at, v = tmp_path_factory.mktemp("sf"), np.random.default_rng(3).normal(size=(420, 64))
    spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), np.corrcoef(v)


def test_all_nodes_edges_and_scales(spark, embeddings):
    at, r = embeddings
    nodes, scales = graphs._sampled(spark, at)
    n = {x["scale"]: x["count"] for x in scales.groupBy("scale").count().collect()}
    assert nodes.count() == 420 and sorted(n) == list(range(10)) and n[0] == (np.triu(r, 1) > 0).sum() and n[9] == 1
    e = graphs.eigen_metrics(spark, at).where("scale = 0").first()
    a = np.where(r > 0, r, 0) - np.eye(420)
    assert e["largest"] == pytest.approx(np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[-1])


@pytest.mark.parametrize("name", ["dynamics_additive", "dynamics_diffusive", "dynamics_roessler", "sync_corr", "lyapunov"])
def test_whole_sweep(spark, embeddings, monkeypatch, name):
    asked = {}

    def evolve(scales, nodes, couplings, **options):
        asked.update(options, couplings=couplings)
        return spark.createDataFrame([], "scale int, coupling double, node bigint, x array<double>, y array<double>, z array<double>, sync double, lyapunov double")

    monkeypatch.setattr(dynamics, "evolve", evolve)
    graphs.FOUND[name](spark, embeddings[0])
    assert asked["couplings"] == list(np.arange(0, 20.5, 0.5)) and (asked["steps"], asked["transient"], asked["h"]) == (3000, 2000, 1e-3) and asked.get("stride", 1) == 1


def test_every_positive_pair_is_an_edge(spark, embeddings):
    at, r = embeddings
    w = r[np.triu_indices(420, 1)]
    n = int((w > 0).sum())
    assert graphs.degree_stats(spark, at).first()["edges"] == n
    assert graphs.sparsified(spark, at).count() == (w >= 1e-6).sum()
    for name in ("kernel_adjacency", "gaussian_kernel_edges"):
        assert graphs.FOUND[name](spark, at).count() == n
    assert graphs.multiscale_percentile(spark, at).where("scale = 2").first()["n_edges"] == (w > 0)[w >= np.median(w[w > 0])].sum()


def test_shift_counts_pairs_of_either_sign(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 16))
    u = v + rng.normal(size=v.shape)
    frame = lambda x: spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id bigint, v array<double>")
    d = np.corrcoef(u) - np.corrcoef(v)
    for block in (7, 64):
        got = similarity.pair_shift(frame(v), frame(u), block=block).first()
        assert tuple(got) == pytest.approx((np.abs(d).mean(), np.linalg.norm(d), np.abs(d).max()))
    assert tuple(similarity.pair_shift(frame(v[:0]), frame(u[:0])).first()) == (0.0, 0.0, 0.0)


def test_scale_ablation(spark, monkeypatch):
    """A class of alike vectors has strong nodes on every scale, the other one has not."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows = [(i, (base * (i % 2) * 3 + rng.normal(size=64)).tolist(), 2 * (i % 2)) for i in range(80)]
    monkeypatch.setattr(graphs, "vectors", lambda s, d: s.createDataFrame([*rows, (99, rows[0][1], None)], "id bigint, v array<double>, label int"))
    got = pipeline.scale_ablation(spark, "").collect()
    assert {r["set"] for r in got} == set(pipeline.SCALE_SETS)
    assert min(r["accuracy"] for r in got if r["scale"] == 0) > 0.95
    report = {r["measure"]: r["value"] for r in graphs.graph_report(spark, "").collect()}
    c = np.corrcoef([r[1] for r in [*rows, rows[0]]])
    w = c[np.triu_indices(81, 1)]
    w = w[w > 0]
    assert report["edges"] == len(w) and report["nodes"] == 81 and report["mean_weight"] == pytest.approx(w.mean(), abs=1e-5) and report["std_weight"] == pytest.approx(w.std(), abs=1e-5)
