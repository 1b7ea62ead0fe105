import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.functions import ode
from cortigraph.operators import dynamics, evaluation, graph, sampling, similarity


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(5).normal(size=(40, 12))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def matrix(rows, n):
    a = np.zeros((n, n))
    for r in rows:
        a[r["i"], r["j"]] = a[r["j"], r["i"]] = r["w"]
    return a


@pytest.mark.parametrize("method", ["pearson", "cosine", "rbf", "laplacian", "spearman"])
def test_all_pairs_in_blocks(cloud, method):
    x, df = cloud
    got = matrix(similarity.all_pairs(df, method, -2, gamma=0.1, block=16).collect(), 40)
    r = x.argsort(1).argsort(1).astype(float) if method == "spearman" else x
    want = {
        "pearson": np.corrcoef(x),
        "spearman": np.corrcoef(r),
        "cosine": (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)),
        "rbf": np.exp(-0.1 * ((x[:, None] - x[None]) ** 2).sum(-1)),
        "laplacian": np.exp(-0.1 * np.abs(x[:, None] - x[None]).sum(-1)),
    }[method]
    np.fill_diagonal(want, 0)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_block_sums_equal_edges(cloud):
    _, df = cloud
    edges = similarity.all_pairs(df, "pearson", 0.0, block=16)
    want = {r["node"]: (r["degree"], r["edges"]) for r in graph.degrees(edges).collect()}
    got = {r["node"]: (r["degree"], r["edges"]) for r in similarity.pair_summary(df, [0.0], block=16).collect()}
    for k, (d, n) in want.items():
        assert abs(got[k][0] - d) < 1e-9 and got[k][1] == n


def test_block_topk(cloud):
    x, df = cloud
    c = np.corrcoef(x)
    np.fill_diagonal(c, -2)
    for r in similarity.block_topk(df, df, 3, block=16).collect():
        assert np.argsort(-c[r["id"]])[r["rank"] - 1] == r["other"]


def test_spectra_by_identities(cloud):
    x, df = cloud
    edges = similarity.all_pairs(df, "pearson", 0.2, block=16)
    a = matrix(edges.collect(), 40)
    values = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
    t = graph.spectral_trace(graph.degrees(edges).withColumn("scale", F.lit(0)), 40, ["scale"]).first()
    assert abs(t["trace"] - values.sum()) < 1e-8 and abs(t["std"] - values.std()) < 1e-8
    for r in graph.leave_one_out(edges, 40).collect():
        b = np.delete(np.delete(a, r["node"], 0), r["node"], 1)
        v = np.linalg.eigvalsh(np.diag(b.sum(1)) - b)
        assert abs(r["d_sum"] - abs(values.sum() - v.sum())) < 1e-8 and abs(r["d_std"] - abs(values.std() - v.std())) < 1e-8
    e = graph.eigen_metrics(edges.withColumn("scale", F.lit(0)), "scale", 40).first()
    assert abs(e["largest"] - values[-1]) < 1e-8
    bars = graph.persistence(edges.withColumn("scale", F.lit(0)), "scale", least=-1.0).where("dim = 0").count()
    live = int((a.sum(1) > 0).sum())
    assert bars == live - (e["components"] - (40 - live))


def test_scales_bands_and_laplacian(spark, cloud):
    _, df = cloud
    edges = similarity.all_pairs(df, "pearson", 0.0)
    sizes = [r["count"] for r in graph.rank_bands(edges, 7).groupBy("scale").count().orderBy("scale").collect()]
    assert sum(sizes) == edges.count() and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    nested = graph.cut(edges, [0.0, 0.3, 0.6])
    assert nested.where("scale = 2").join(nested.where("scale = 1"), ["i", "j"], "left_anti").count() == 0
    rows = graph.laplacian(edges).groupBy("row").agg(F.sum("value").alias("s")).where("abs(s) > 1e-9").count()
    back = graph.laplacian_to_edges(graph.laplacian(edges)).count()
    assert rows == 0 and back == edges.count()
    assert graph.uniform_thresholds(0, 1, 2, skip_first=True) == [0.5, 1.0]
    none = spark.createDataFrame([], "i bigint, j bigint, w double")
    assert graph.rank_bands(none, 3).count() == 0 and graph.triangles(none).count() == 0
    with pytest.raises(ValueError):
        graph.percentile_thresholds(none, 3)


def test_oscillators():
    s0 = np.random.default_rng(0).uniform(-5, 5, (1, 3, 1))
    free = ode.Network(np.zeros((1, 1)), np.array([0.0]))
    ends = [free.trajectory(s0, h, round(0.2 / h), round(0.2 / h))[-1, 0, :, 0] for h in (0.004, 0.002, 0.001)]
    assert 8 < np.linalg.norm(ends[0] - ends[1]) / np.linalg.norm(ends[1] - ends[2]) < 32  # order 4
    two = np.repeat(s0, 2, axis=0)
    a = np.array([[0, 1.0], [1.0, 0]])
    same = ode.Network(a, np.array([2.0]), mode="diffusive").trajectory(two, 0.001, 50, 0)
    np.testing.assert_allclose(same[:, 0], free.trajectory(s0, 0.001, 50, 0)[:, 0])
    with pytest.raises(ValueError):
        ode.Network(a, np.array([1.0]), mode="other")


def test_evolve(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node bigint")
    edges = spark.createDataFrame([(0, 0, 1, 0.5), (0, 2, 3, 0.4), (1, 4, 5, 1.0)], "scale int, i bigint, j bigint, w double")
    out = dynamics.evolve(edges, nodes, [0.0, 1.0], h=0.01, steps=60, transient=20, batch=1)
    assert out.count() == 24 and out.where("x_max < x_min").count() == 0
    again = dynamics.evolve(edges.repartition(5), nodes, [0.0, 1.0], h=0.01, steps=60, transient=20, batch=2)
    assert out.select("scale", "coupling", "node", F.round("x_mean", 9)).exceptAll(again.select("scale", "coupling", "node", F.round("x_mean", 9))).count() == 0
    paths = dynamics.evolve(edges, nodes, [1.0], h=0.01, steps=60, transient=20, output="trajectory")
    assert dynamics.sync_with_centre(paths).where("node = 0 and abs(sync - 1) > 1e-9").count() == 0
    inside = dynamics.evolve(edges, nodes, [1.0], h=0.01, steps=60, transient=20, output="sync").withColumnRenamed("sync", "here")
    assert dynamics.sync_with_centre(paths).join(inside, ["scale", "coupling", "node"]).where("abs(sync - here) < 1e-9").count() == 12
    chaos = dynamics.evolve(edges, nodes, [1.0], h=0.01, steps=160, transient=20, output="lyapunov").withColumnRenamed("lyapunov", "here")
    longer = dynamics.evolve(edges, nodes, [1.0], h=0.01, steps=160, transient=20, output="trajectory")
    assert dynamics.lyapunov(longer).join(chaos, ["scale", "coupling", "node"]).where("abs(lyapunov - here) < 1e-9").count() == 12


def test_metrics(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.7), (1, 1, 0.7), (1, 1, 0.9), (1, 0, 0.2), (None, 1, 0.5)]
    df = spark.createDataFrame(rows, "y int, p int, s double")
    c = {r["label"]: r for r in evaluation.per_class(df, "y", "p").collect()}
    assert (c[1]["tp"], c[1]["fp"], c[1]["fn"], c[1]["tn"]) == (2, 1, 1, 1)
    s = evaluation.summary(df, "y", "p").first()
    assert abs(s["accuracy"] - 0.6) < 1e-12 and abs(s["macro_specificity"] - (2 / 3 + 1 / 2) / 2) < 1e-12
    pos, neg = [0.7, 0.9, 0.2], [0.1, 0.7]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 6
    assert abs(evaluation.auc(df, "y", "s").first()["auc"] - want) < 1e-12


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("label"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 7).alias("g"))
    a = sampling.permuted(df, "id").select("id", "position")
    b = sampling.permuted(df.repartition(9), "id").select("id", "position")
    assert a.exceptAll(b).count() == 0 and a.agg(F.count_distinct("position")).first()[0] == 1000
    folds = sampling.stratified_folds(df, "id", "label", 4).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert folds.where("d > 1").count() == 0
    counts = df.groupBy("g").agg(F.count("*").alias("n"))
    q = {r["g"]: (r["n"], r["quota"]) for r in sampling.fair_quotas(counts, "g", "n", 200).collect()}
    assert sum(x[1] for x in q.values()) == 200 and all(a <= n for n, a in q.values())
    assert sampling.pick_nodes(df.select(F.col("id").alias("node")), "node", 100).count() == 100
    assert sampling.pick_nodes(df.select(F.col("id").alias("node")), "node", 100, "uniform").count() == 100
