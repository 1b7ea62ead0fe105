import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.functions.ranking import quantiles, sorted_rank
from cortigraph.operators import graph, sampling


def test_places_over_the_whole_table(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 31).alias("x"))
    got = {r["id"]: r["rank"] for r in sorted_rank(df, [F.col("x").desc(), F.col("id")]).collect()}
    want = sorted(range(3000), key=lambda i: (-(i * 7919 % 31), i))
    assert [got[i] for i in want] == list(range(1, 3001))
    assert sorted_rank(df.limit(0), [F.col("x")]).count() == 0


@pytest.mark.parametrize("values", [[1.0], [2.0] * 500 + [3.0], [0.1 * i for i in range(701)], [random.Random(2).random() for _ in range(1000)]])
def test_quantiles_like_numpy(spark, values):
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", shares)
    assert np.allclose(got, np.quantile(values, shares), atol=1e-12)
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) is None


def edges(spark, pairs):
    return spark.createDataFrame([(i, j, 1.0) for i, j in pairs], "i bigint, j bigint, w double")


def test_triangles_listed_and_counted(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(0, 6000, 97), 2))) for _ in range(500)} | {(0, 97 * k) for k in range(1, 60)}
    near = {}
    for i, j in pairs:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    want = {(i, j, k) for i, j in pairs for k in near[i] & near[j] if k > j}
    e = edges(spark, pairs)
    assert sorted(map(tuple, graph.triangles(e).collect())) == sorted(want)
    counts = {}
    for t in want:
        for x in t:
            counts[x] = counts.get(x, 0) + 1
    assert {r["node"]: r["n_triangles"] for r in graph.triangle_counts(e).collect()} == counts
    assert graph.triangle_counts(e.limit(0)).count() == 0


def test_equal_weights_in_bands(spark):
    e = edges(spark, [(i, j) for i in range(20) for j in range(i + 1, 20)])
    got = {r["scale"]: r["n"] for r in graph.rank_bands(e, 7).groupBy("scale").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: 28 if i == 0 else 27 for i in range(7)}


def bars_by_columns(i, j, d):
    """All triangles as columns, reduced one by one."""
    order = sorted(range(len(d)), key=lambda e: (d[e], i[e], j[e]))
    index = {(i[e], j[e]): r for r, e in enumerate(order)}
    parent, out, born = {x: x for x in [*i, *j]}, [], {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r, e in enumerate(order):
        a, b = root(i[e]), root(j[e])
        if a != b:
            parent[a] = b
            out.append((0, 0.0, d[e]))
        else:
            born[r] = d[e]
    nodes = sorted(parent)
    triangles = [sorted(index[p] for p in ((a, b), (a, c), (b, c))) for a in nodes for b in nodes for c in nodes if a < b < c and (a, b) in index and (a, c) in index and (b, c) in index]
    low = {}
    for sides in sorted(triangles, key=lambda t: t[::-1]):
        column = set(sides)
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            out.append((1, born.pop(max(column)), d[order[sides[2]]]))
    return sorted(x for x in out + [(1, b, float("inf")) for b in born.values()] if x[2] > x[1])


def test_bars_like_the_plain_reduction():
    rng = random.Random(6)
    for n, share in ((8, 0.9), (14, 0.5), (20, 0.35), (12, 1.0)):
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < share]
        for ties in (False, True):
            d = [round(rng.random(), 1) if ties else rng.random() for _ in pairs]
            i, j = [p[0] for p in pairs], [p[1] for p in pairs]
            got = sorted(x for x in graph.rips_bars(np.array(i), np.array(j), np.array(d)) if x[2] > x[1])
            assert got == bars_by_columns(i, j, d)


def test_binarised(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.2), (2, 3, 0.9)], "i bigint, j bigint, w double")
    assert sorted(map(tuple, graph.binarise(e, 0.4).collect())) == [(1, 2, 1.0), (2, 3, 1.0)]


@pytest.mark.parametrize("method", ["uniform", "hybrid", "random"])
def test_picked_nodes(spark, method):
    nodes = spark.range(1000).select((F.col("id") * 3).alias("node"))
    got = sorted(r["node"] for r in sampling.pick_nodes(nodes, "node", 100, method).collect())
    assert len(got) == len(set(got)) == 100
    if method == "uniform":
        assert got == [3 * int(i * 999 / 99) for i in range(100)]


def test_poisson_draws_have_no_limit(spark):
    d = sampling.bootstrap(spark.range(20_000), "id", 3)
    r = d.groupBy("replicate").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("times")).alias("q"), F.max("times").alias("most")).collect()
    assert len(r) == 3 and all(abs(x["n"] / 20_000 - 1) < 0.03 and abs(x["q"] / 20_000 - 2) < 0.1 and x["most"] >= 6 for x in r)
