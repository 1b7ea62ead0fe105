"""Multi-scale graphs on undirected edge lists i < j, w."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.functions.ranking import quantiles, sorted_rank


def kernel_weight(w: Column, sigma: float = 3.0, k: float = 1.0) -> Column:
    """1 - exp(-w^k / sigma^k), negatives as 0."""
    c = F.greatest(w, F.lit(0.0))
    return 1 - F.exp(-F.pow(c, F.lit(k)) / F.lit(sigma**k))


def gaussian_weight(edges: DataFrame, exponent: float = 1.0, sigma: float | None = None, floor: float = 1e-10) -> DataFrame:
    """exp(-(1-w)^p / sigma^p); sigma defaults to the median distance of the edges, 1 if that is 0."""
    if sigma is None:
        m = quantiles(edges.select((1 - F.col("w")).alias("d")), "d", [0.5])
        sigma = 1.0 if m is None or m[0] < floor else m[0]
    return edges.withColumn("w", F.exp(-F.pow(1 - F.col("w"), F.lit(exponent)) / F.lit(sigma**exponent)))


def uniform_thresholds(lo: float, hi: float, k: int, skip_first: bool = False) -> list[float]:
    """linspace(lo, hi, k), or its k values after the first of k + 1."""
    n = k if skip_first else max(1, k - 1)
    return [lo + (hi - lo) * i / n for i in range(1 if skip_first else 0, k + (1 if skip_first else 0))]


def cut(edges: DataFrame, thresholds: list[float], band: bool = False) -> DataFrame:
    """Edges of each scale: w >= threshold (nested), or up to the next threshold only (bands)."""
    scales = [F.struct(F.lit(i).alias("scale"), F.lit(float(t)).alias("alpha"), F.lit(float(thresholds[i + 1]) if band and i + 1 < len(thresholds) else float("inf")).alias("top")) for i, t in enumerate(thresholds)]
    wide = edges.withColumn("_c", F.explode(F.filter(F.array(*scales), lambda c: (F.col("w") >= c["alpha"]) & (F.col("w") < c["top"]))))
    return wide.select(F.col("_c.scale").alias("scale"), "i", "j", "w")


def percentile_thresholds(edges: DataFrame, k: int) -> list[float]:
    """Exact percentiles 0..100 of the weights, linearly interpolated."""
    found = quantiles(edges, "w", [i / max(1, k - 1) for i in range(k)])
    if found is None:
        raise ValueError("no positive edge")
    return found


def rank_bands(edges: DataFrame, k: int) -> DataFrame:
    """k disjoint bands of nearly equal size by weight, heaviest first; the first take the remainder.

    Ranks are made in ranges of (weight, i, j), so equal weights are no one task's work.
    """
    n = edges.count()
    ranked = sorted_rank(edges, [F.col("w").desc(), F.col("i"), F.col("j")], "_r")
    size, extra = divmod(n, k)
    r = F.col("_r") - 1
    head = extra * (size + 1)
    scale = F.when(r < head, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - head) / max(1, size)))
    return ranked.select(scale.cast("int").alias("scale"), "i", "j", "w")


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, w for both ends of every edge."""
    rest = [c for c in edges.columns if c not in ("i", "j")]
    ends = F.explode(F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("other")), F.struct(F.col("j").alias("node"), F.col("i").alias("other"))))
    return edges.withColumn("_e", ends).select(F.col("_e.node").alias("node"), F.col("_e.other").alias("other"), *rest)


def degrees(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return both_ways(edges).groupBy(*by, "node").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("edges"), F.sum(F.col("w") * F.col("w")).alias("squares"))


def knn_graph(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each node, kept if either end keeps them."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("w").desc(), F.col("other")))
    kept = both_ways(edges).withColumn("_r", rank).where(F.col("_r") <= k)
    return kept.groupBy(F.least("node", "other").alias("i"), F.greatest("node", "other").alias("j")).agg(F.max("w").alias("w"))


def binarise(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(F.col("w") > threshold).withColumn("w", F.lit(1.0))


def sparsify(edges: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Weights below `floor` and loops out, the rest divided by the largest."""
    kept = edges.where((F.abs("w") >= floor) & (F.col("i") != F.col("j")))
    most = kept.agg(F.max("w").alias("_m"))
    return kept.crossJoin(F.broadcast(most)).withColumn("w", F.col("w") / F.col("_m")).drop("_m")


def laplacian(edges: DataFrame) -> DataFrame:
    """row, column, value of D - |A|, each off-diagonal entry both ways."""
    positive = edges.withColumn("w", F.abs("w"))
    d = degrees(positive).select(F.col("node").alias("row"), F.col("node").alias("column"), F.col("degree").alias("value"))
    return d.unionByName(both_ways(positive).select(F.col("node").alias("row"), F.col("other").alias("column"), (-F.col("w")).alias("value")))


def laplacian_to_edges(entries: DataFrame) -> DataFrame:
    """Edges of a Laplacian: -L off the diagonal, clipped at 0."""
    return entries.where("row < column").select(F.col("row").alias("i"), F.col("column").alias("j"), F.greatest(-F.col("value"), F.lit(0.0)).alias("w")).where("w > 0")


def degree_stats(edges: DataFrame, nodes: int) -> DataFrame:
    d = degrees(edges)
    active = F.count(F.lit(1))
    return d.agg(
        F.coalesce(F.sum("edges") / 2, F.lit(0)).cast("bigint").alias("edges"),
        (F.lit(nodes) - active).alias("isolated"),
        F.coalesce(F.sum("degree") / nodes, F.lit(0.0)).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0.0)).alias("max_degree"),
        F.when(active < nodes, F.lit(0.0)).otherwise(F.min("degree")).alias("min_degree"),
    )


def spectral_trace(degree_rows: DataFrame, nodes: int, by: list[str]) -> DataFrame:
    """Sum, mean and deviation of the Laplacian eigenvalues by trace identities.

    degree_rows: `by`, node, degree, squares (sum of squared weights of the node).
    """
    s = degree_rows.groupBy(*by).agg(F.sum("degree").alias("trace"), F.sum(F.col("degree") * F.col("degree") + F.col("squares")).alias("_q"), F.count_if(F.col("edges") > 0).alias("active_nodes"))
    mean = F.col("trace") / nodes
    return s.select(*by, "active_nodes", "trace", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / nodes - mean * mean)).alias("std"))


def leave_one_out(edges: DataFrame, nodes: int) -> DataFrame:
    """Change of the spectral sum, mean and deviation when each node is taken out: closed form, O(edges)."""
    d = degrees(edges)
    ends = both_ways(edges).join(d.select(F.col("node").alias("other"), F.col("degree").alias("_od")), "other")
    near = ends.groupBy("node").agg(F.sum(F.col("w") * F.col("_od")).alias("_wd"))
    total = d.agg(F.sum("degree").alias("_t"), F.sum(F.col("degree") * F.col("degree") + F.col("squares")).alias("_q"))
    x = d.join(near, "node").crossJoin(F.broadcast(total))
    t1 = F.col("_t") - 2 * F.col("degree")
    # Removing node i takes a_ij from each d_j: sum of squared degrees and of squared weights change accordingly.
    q1 = F.col("_q") - F.col("degree") * F.col("degree") - 2 * F.col("_wd") + F.col("squares") - 2 * F.col("squares")
    m0, m1 = F.col("_t") / nodes, t1 / (nodes - 1)
    s0, s1 = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / nodes - m0 * m0)), F.sqrt(F.greatest(F.lit(0.0), q1 / (nodes - 1) - m1 * m1))
    return x.select("node", F.abs(F.col("_t") - t1).alias("d_sum"), F.abs(m0 - m1).alias("d_mean"), F.abs(s0 - s1).alias("d_std"))


def triangles(edges: DataFrame) -> DataFrame:
    """i < j < k with all three edges, each once.

    Edges point from the end with fewer edges to the one with more (by degree,
    then id): no node has more than about sqrt(2 * edges) edges that point away
    from it, so wedges at their source aren't many at a hub. A third join closes them.
    """
    ends = both_ways(edges)
    n = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    place = lambda c, name: n.select(F.col("node").alias(c), F.struct(F.col("n"), F.col("node")).alias(name))
    pointed = edges.select("i", "j").join(place("i", "pi"), "i").join(place("j", "pj"), "j")
    pointed = pointed.select(F.least("pi", "pj").alias("a"), F.greatest("pi", "pj").alias("b")).select("a.node", F.col("b").alias("to"))
    one, two = pointed.withColumnRenamed("to", "x"), pointed.withColumnRenamed("to", "y")
    wedges = one.join(two, "node").where("x < y").select("node", F.col("x.node").alias("p"), F.col("y.node").alias("q"))
    closing = pointed.select(F.col("node").alias("p"), F.col("to.node").alias("q"))
    s = F.array_sort(F.array("node", "p", "q"))
    return wedges.join(closing, ["p", "q"]).select(s.alias("s")).select(F.get("s", F.lit(0)).alias("i"), F.get("s", F.lit(1)).alias("j"), F.get("s", F.lit(2)).alias("k"))


#: Neighbours that one row of bits stands for.
BITS = 1024


def triangle_counts(edges: DataFrame) -> DataFrame:
    """node, n_triangles of the nodes in a triangle, without listing triangles.

    A node's neighbours are bits, BITS of them to a row. Each edge brings the rows
    of its end with fewer edges beside those of the other end, and the common bits
    are its triangles: work is edges times rows of bits, in built-in expressions.
    """
    width = BITS // 64
    word = F.floor(F.pmod("other", F.lit(BITS)) / 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("other", F.lit(64)).cast("int"))
    ends = both_ways(edges.select("i", "j"))
    words = ends.groupBy("node", F.floor(F.col("other") / BITS).alias("part"), word.alias("word")).agg(F.bit_or(one).alias("bits"))
    rows = words.groupBy("node", "part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    rows = rows.select("node", "part", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("bigint"))).alias("bits"))
    n = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    place = lambda c, name: n.select(F.col("node").alias(c), F.struct(F.col("n"), F.col("node")).alias(name))
    pointed = edges.select("i", "j").join(place("i", "pi"), "i").join(place("j", "pj"), "j")
    pointed = pointed.select(F.least("pi", "pj").getField("node").alias("a"), F.greatest("pi", "pj").getField("node").alias("b"))
    both = pointed.join(rows.select(F.col("node").alias("a"), "part", F.col("bits").alias("x")), "a").join(rows.select(F.col("node").alias("b"), "part", F.col("bits").alias("y")), ["b", "part"])
    common = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    # A triangle is common to two edges of each of its nodes.
    by = both.select("a", "b", common.alias("c")).where("c > 0")
    return by.select(F.explode(F.array("a", "b")).alias("node"), "c").groupBy("node").agg((F.sum("c") / 2).cast("bigint").alias("n_triangles"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in `nodes` (node)."""
    return edges.join(nodes.select(F.col("node").alias("i")), "i", "left_semi").join(nodes.select(F.col("node").alias("j")), "j", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, d: b minus a, missing edges as 0."""
    x, y = a.withColumnRenamed("w", "_a"), b.withColumnRenamed("w", "_b")
    return x.join(y, ["i", "j"], "full_outer").select("i", "j", (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("d"))


def correlation_shift(a: DataFrame, b: DataFrame, nodes: int) -> DataFrame:
    """Mean |d| over the full matrix, Frobenius norm and largest |d|."""
    d = difference(a, b)
    return d.agg((2 * F.coalesce(F.sum(F.abs("d")), F.lit(0.0)) / nodes**2).alias("mean_abs"), F.sqrt(2 * F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0))).alias("frobenius"), F.coalesce(F.max(F.abs("d")), F.lit(0.0)).alias("max_abs"))


def _dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    i, j, w = (t.column(c).to_numpy() for c in ("i", "j", "w"))
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a = np.zeros((len(nodes), len(nodes)))
    a[at[: len(i)], at[len(i) :]] = w
    return nodes, a + a.T


def eigen_metrics(edges: DataFrame, by: str, nodes: int, max_nodes: int = 5000, near_zero: float = 1e-8) -> DataFrame:
    """Largest and smallest non-zero Laplacian eigenvalue of each graph.

    A dense solve per graph: graphs are cut to at most max_nodes nodes beforehand
    (see sampling.pick_nodes); a larger one is refused.
    """

    def solve(t: pa.Table) -> pa.Table:
        ids, a = _dense(t)
        if len(ids) > max_nodes:
            raise ValueError(f"{len(ids)} nodes: sample the graph to {max_nodes} first")
        values = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
        live = values[values > near_zero]
        return pa.table({by: t.column(by)[:1], "largest": [values[-1]], "smallest_nonzero": [live[0] if len(live) else 0.0], "components": pa.array([int(nodes - len(ids) + (values <= near_zero).sum())], pa.int64())})

    kind = edges.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInArrow(solve, f"{by} {kind}, largest double, smallest_nonzero double, components bigint")


def rips_bars(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, float, float]]:
    """(dim, birth, death) of the H0 and H1 bars of a Rips complex on a graph with edge lengths d.

    Edges come shortest first. Components die by Kruskal. The common neighbours of
    another edge's ends make triangles with it. Without one a cycle is born. Else
    the edge's own cycle ends at once and the edge equals the two other edges of a
    triangle, so every edge is a sum of edges that bear cycles (bits of an integer;
    edges of the forest are 0). Triangles over neighbours that shorter edges link
    say the same, as tetrahedra fill the space between them; each further component
    of the neighbours is one relation, which ends the youngest cycle that is left
    in it after the relations before.
    """
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.lexsort((j, i, d))
    ends, d = np.stack([at[: len(i)][order], at[len(i) :][order]], axis=1).tolist(), d[order].tolist()
    parent, near = list(range(len(nodes))), [0] * len(nodes)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, float, float]] = []
    sums: list[dict[int, int]] = [{} for _ in nodes]
    born: list[float] = []
    relations: dict[int, int] = {}
    for (a, b), length in zip(ends, d):
        both, value = near[a] & near[b], 0
        if both:
            out.append((1, length, length))
            first = True
            while both:
                c = both.bit_length() - 1
                other, both = sums[a][c] ^ sums[b][c], both ^ (1 << c)
                linked = both & near[c]
                while linked:
                    both ^= linked
                    wider = 0
                    while linked and both:
                        x = linked.bit_length() - 1
                        linked ^= 1 << x
                        wider |= near[x]
                    linked = both & wider
                if first:
                    value, first = other, False
                    continue
                relation = value ^ other
                while relation and (known := relations.get(relation.bit_length() - 1)) is not None:
                    relation ^= known
                if relation:
                    youngest = relation.bit_length() - 1
                    relations[youngest] = relation
                    out.append((1, born[youngest], length))
        elif (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((0, 0.0, length))
        else:
            value = 1 << len(born)
            born.append(length)
        sums[a][b] = sums[b][a] = value
        near[a] |= 1 << b
        near[b] |= 1 << a
    out += [(1, birth, float("inf")) for k, birth in enumerate(born) if k not in relations]
    return out


def persistence(edges: DataFrame, by: str, max_edges: int = 150_000, least: float = 2e-5) -> DataFrame:
    """H0 and H1 bars of the Rips complex on distances 1 - minmax(w), of more than `least`.

    One graph is one group; it holds at most max_edges edges, the strongest, as
    the measure is defined; they are picked by a top-k per graph before grouping.
    """
    order = Window.partitionBy(by).orderBy(F.col("w").desc(), F.col("i"), F.col("j"))
    top = edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_edges).drop("_r")
    kind = edges.schema[by].dataType.simpleString()

    def bars(t: pa.Table) -> pa.Table:
        i, j, w = (t.column(c).to_numpy() for c in ("i", "j", "w"))
        span = w.max() - w.min()
        kept = [x for x in rips_bars(i, j, 1 - (w - w.min()) / span if span > 0 else np.zeros(len(w))) if x[2] - x[1] > least]
        return pa.table({by: pa.array([t.column(by)[0].as_py()] * len(kept)), "dim": pa.array([x[0] for x in kept], pa.int32()), "birth": pa.array([x[1] for x in kept], pa.float64()), "death": pa.array([x[2] for x in kept], pa.float64())}, schema=pa.schema([(by, t.schema.field(by).type), ("dim", pa.int32()), ("birth", pa.float64()), ("death", pa.float64())]))

    return top.groupBy(by).applyInArrow(bars, f"{by} {kind}, dim int, birth double, death double")
