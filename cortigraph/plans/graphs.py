"""Queries of similarity graphs, spectra, neighbours and dynamics over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.operators import dynamics, evaluation, features, graph, noise, sampling, similarity
from cortigraph.session import cut_lineage, table

#: Weight from which pairs are edges in pearson_edges, cosine_edges and induced_subgraph.
LEAST = 0.25
SCALES = 10


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    return d.where((F.size("embedding") == 64) & A.finite(A.doubles(F.col("embedding")))).select(F.col("vec_id").alias("id"), A.doubles(F.col("embedding")).alias("v"), "label")


def _edges(method: str, least: float, gamma: float = 1.0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return similarity.all_pairs(vectors(spark, sf_dir), method, least, gamma=gamma).select("i", "j", F.round("w", 6).alias("w"))

    return query


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the pairs above LEAST; made once and read several times."""
    return cut_lineage(similarity.all_pairs(vectors(spark, sf_dir), "pearson", LEAST))


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph: all pairs of positive weight."""
    return cut_lineage(similarity.all_pairs(vectors(spark, sf_dir), "pearson"))


def _adjacency(w: np.ndarray) -> np.ndarray:
    return 1 - np.exp(-np.maximum(w, 0) / 3.0)


def scale_sums(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float], int]:
    v = vectors(spark, sf_dir)
    lo, hi = similarity.pair_range(v, weight=_adjacency)
    # A hair below each threshold: the last scale is an equality with the largest weight.
    limits = [t - 1e-12 for t in graph.uniform_thresholds(lo, hi, SCALES)]
    return similarity.pair_summary(v, limits, weight=_adjacency), limits, v.count()


def spectral_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nested scales of the full graph: active nodes and eigenvalue sum, mean, deviation by trace identities."""
    sums, _, n = scale_sums(spark, sf_dir)
    t = graph.spectral_trace(sums, n, ["scale"])
    return t.select("scale", "active_nodes", *[F.round(c, 4).alias(c) for c in ("trace", "mean", "std")])


def multiscale_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums, limits, n = scale_sums(spark, sf_dir)
    by = sums.groupBy("scale").agg((F.sum("edges") / 2).cast("bigint").alias("n_edges"), F.count_if(F.col("edges") == 0).alias("isolated"), F.round(F.max("degree"), 5).alias("max_degree"))
    return by


def multiscale_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = positive(spark, sf_dir)
    limits = [t - 1e-12 for t in graph.percentile_thresholds(e, 5)]
    return graph.cut(e, limits).groupBy("scale").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.min("w"), 6).alias("least"))


def multiscale_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = positive(spark, sf_dir)
    r = e.agg(F.min("w"), F.max("w")).first()
    return graph.cut(e, [t - 1e-12 for t in graph.uniform_thresholds(r[0], r[1], 6)], band=True).groupBy("scale").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 5).alias("weight"))


def multiscale_band_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rank_bands(positive(spark, sf_dir), 7).groupBy("scale").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.min("w"), 6).alias("low"), F.round(F.max("w"), 6).alias("high"))


def kernel_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.all_pairs(vectors(spark, sf_dir), "pearson").select("i", "j", F.round(graph.kernel_weight(F.col("w")), 6).alias("w"))


def gaussian_kernel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.gaussian_weight(positive(spark, sf_dir)).select("i", "j", F.round("w", 6).alias("w"))


def sparsified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sparsify(positive(spark, sf_dir)).select("i", "j", F.round("w", 6).alias("w"))


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    near = similarity.block_topk(v, v, 5)
    pairs = near.select(F.least("id", "other").alias("i"), F.greatest("id", "other").alias("j"), "w")
    return pairs.groupBy("i", "j").agg(F.round(F.max("w"), 6).alias("w"))


def knn_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_graph(positive(spark, sf_dir), 3).select("i", "j", F.round("w", 6).alias("w"))


def laplacian_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.laplacian(positive(spark, sf_dir)).select("row", "column", F.round("value", 5).alias("value"))


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.degree_stats(positive(spark, sf_dir), vectors(spark, sf_dir).count())
    return d.select("edges", "isolated", *[F.round(c, 5).alias(c) for c in ("avg_degree", "max_degree", "min_degree")])


def leave_one_out_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.leave_one_out(positive(spark, sf_dir), vectors(spark, sf_dir).count())
    return d.select("node", *[F.round(c, 5).alias(c) for c in ("d_sum", "d_mean", "d_std")])


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_counts(positive(spark, sf_dir))


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = vectors(spark, sf_dir).where("label >= 2").select(F.col("id").alias("node"))
    return graph.induced(sparse(spark, sf_dir), keep).select("i", "j", F.round("w", 6).alias("w"))


def correlation_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of all correlations by white noise of several strengths."""
    v, out = vectors(spark, sf_dir), None
    for ratio in (0.1, 0.5, 1.0):
        row = similarity.pair_shift(v, noise.gaussian(v, "v", "id", ratio)).withColumn("ratio", F.lit(ratio))
        out = row if out is None else out.unionByName(row)
    return out


def multichannel_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as recordings of four channels of sixteen values."""
    return similarity.multichannel_pearson(vectors(spark, sf_dir), 4, LEAST).select("i", "j", F.round("w", 6).alias("w"))


def multichannel_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.multichannel_rbf(vectors(spark, sf_dir), 4, 0.2).select("i", "j", F.round("w", 6).alias("w"))


def _step_features(width: int | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Features of each vector as a series, up to every 16th step and the last."""
        f = features.features_at_steps(vectors(spark, sf_dir).select("id", "v"), "v", features.steps_of(64, 16, width), width)
        return f.select("id", "step", *[F.round(F.get("f", F.lit(k)), 6).alias(n) for k, n in enumerate(features.FEATURES)])

    return query


def diversity_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity of the vectors' features over the steps."""
    f = features.features_at_steps(vectors(spark, sf_dir).select("id", "v"), "v", features.steps_of(64, 16))
    d = features.diversity(f, "step", "id", "f")
    return d.select("step", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


def critical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes whose loss changes the spectral sum most."""
    d = graph.leave_one_out(positive(spark, sf_dir), vectors(spark, sf_dir).count())
    return d.select("node", F.round("d_sum", 5).alias("d_sum")).orderBy(F.col("d_sum").desc(), "node").limit(10)


def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the whole similarity matrix, a row per measure; from the sums of each node, no pairs are written."""
    v = vectors(spark, sf_dir)
    d = similarity.pair_summary(v, [0.0]).agg(F.count_if(F.col("edges") > 0).alias("active"), F.sum("edges").alias("e"), F.sum("degree").alias("w"), F.sum("squares").alias("q"), F.max("degree").alias("top"))
    n, e = F.col("n").cast("double"), F.col("e")
    mean = F.try_divide("w", e)
    measures = {
        "nodes": n, "isolated": n - F.col("active"), "edges": e / 2, "density": F.try_divide(e, n * (n - 1)), "mean_weight": mean,
        "std_weight": F.sqrt(F.greatest(F.try_divide("q", e) - mean * mean, F.lit(0.0))), "mean_degree": F.try_divide("w", n), "max_degree": F.col("top"),
    }
    row = d.crossJoin(v.agg(F.count(F.lit(1)).alias("n"))).select(*[F.round(F.coalesce(c, F.lit(0.0)).cast("double"), 5).alias(name) for name, c in measures.items()])
    return row.unpivot([], list(measures), "measure", "value")


def _sampled(spark: SparkSession, sf_dir: str, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """All nodes, above `most` a hybrid sample of them (the same on all scales), and the nested scales of their whole graph."""
    nodes = cut_lineage(sampling.pick_nodes(vectors(spark, sf_dir).select(F.col("id").alias("node")), "node", most))
    e = cut_lineage(graph.induced(positive(spark, sf_dir), nodes))
    r = e.agg(F.min("w"), F.max("w")).first()
    return nodes, graph.cut(e, [t - 1e-12 for t in graph.uniform_thresholds(r[0] or 0.0, r[1] or 0.0, SCALES)])


def eigen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, scales = _sampled(spark, sf_dir)
    return graph.eigen_metrics(scales, "scale", nodes.count())


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scales = _sampled(spark, sf_dir)
    return graph.persistence(scales, "scale").groupBy("scale", "dim").agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("death") < float("inf")).alias("n_closed"))


#: Coupling strengths of the sweep: 0 to 20 by 0.5.
COUPLINGS = [k / 2 for k in range(41)]


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All nodes with their vectors, however many, and the least weight of each nested scale of their graph."""
    v = vectors(spark, sf_dir)
    r = similarity.positive_range(v)
    limits = graph.uniform_thresholds(*r, SCALES) if r else []
    return v.select(F.col("id").alias("node"), "v"), spark.createDataFrame([(k, t - 1e-12) for k, t in enumerate(limits)], "scale int, least double")


def _dynamics(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, scales = _whole(spark, sf_dir)
        return dynamics.evolve(scales, nodes, COUPLINGS, h=1e-3, steps=3000, transient=2000, **options)

    return query


def sync_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dynamics(output="sync")(spark, sf_dir)


def lyapunov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dynamics(output="lyapunov")(spark, sf_dir).groupBy("scale", "coupling").agg(F.avg("lyapunov").alias("mean_lyapunov"))


def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of k nearest neighbours of other folds, for every k from one ranking."""
    v = vectors(spark, sf_dir).withColumn("fold", F.pmod("id", F.lit(5)))
    near = similarity.block_topk(v, v, 20, "cosine", group=True)
    votes = evaluation.knn_votes(near, v.select("id", "label"), [1, 3, 5, 7, 9, 11, 15, 20])
    return evaluation.best_k(votes, v.select("id", "label")).select("k", F.round("accuracy", 6).alias("accuracy"), "n")


FOUND = {
    "spectral_trace": spectral_trace,
    "multiscale_uniform": multiscale_uniform,
    "pearson_edges": _edges("pearson", LEAST),
    "cosine_edges": _edges("cosine", LEAST),
    "spearman_edges": _edges("spearman", 0.2503),
    "rbf_edges": _edges("rbf", 0.1, 0.02),
    "laplacian_kernel_edges": _edges("laplacian", 0.1, 0.05),
    "prefix_features": _step_features(None),
    "trailing_features": _step_features(16),
    "dynamics_additive": _dynamics(mode="additive"),
    "dynamics_diffusive": _dynamics(mode="diffusive"),
    "dynamics_roessler": _dynamics(field="roessler", mode="x_only"),
    **{
        f.__name__: f
        for f in (
            multiscale_percentile, multiscale_bands, multiscale_band_rank, kernel_adjacency, gaussian_kernel_edges, sparsified, knn_graph, knn_cut, laplacian_entries, degree_stats,
            leave_one_out_spectral, critical_nodes, graph_report, triangles, induced_subgraph, multichannel_pearson, multichannel_rbf, diversity_steps, correlation_shift, eigen_metrics, persistence, sync_corr, lyapunov, knn_classify,
        )
    },
}

_S = "WITH s AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),\n"
_CENTRED = "list_transform({0}, lambda x: x - list_avg({0}))"
_RANKS = "list_transform(v, lambda x: len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) + 1) / 2.0)"
_CORR = "greatest(-1.0, least(1.0, list_dot_product(a.c, b.c) / (a.n * b.n)))"


def _pairs(prepare: str, pair: str) -> str:
    return _S + f"u0 AS (SELECT id, label, {prepare} AS c FROM s), u AS (SELECT *, sqrt(list_dot_product(c, c)) AS n FROM u0), p AS (SELECT a.id AS i, b.id AS j, {pair} AS w FROM u a JOIN u b ON a.id < b.id)\n"


PEARSON = _pairs(_CENTRED.format("v"), _CORR)
SPARSE = PEARSON + f", e AS (SELECT * FROM p WHERE w > {LEAST})\n"
POSITIVE = PEARSON + ", e AS (SELECT * FROM p WHERE w > 0)\n"
_ENDS = ", x AS (SELECT i AS node, j AS other, w FROM e UNION ALL SELECT j, i, w FROM e), d AS (SELECT node, sum(w) AS degree, sum(w * w) AS squares, count(*) AS edges FROM x GROUP BY node), c AS (SELECT count(*) AS n FROM s)\n"
_SCALED = (
    PEARSON
    + f", e AS (SELECT i, j, 1 - exp(-greatest(w, 0) / 3.0) AS w FROM p WHERE w > 0), r AS (SELECT min(w) AS lo, max(w) AS hi FROM e), t AS (SELECT k AS scale, lo + (hi - lo) * k / 9 - 1e-12 AS alpha FROM r, (SELECT unnest(range(0, {SCALES})) AS k)),\nq AS (SELECT scale, i, j, w FROM e JOIN t ON w >= alpha), dd AS (SELECT scale, node, sum(w) AS degree, sum(w * w) AS squares FROM (SELECT scale, i AS node, w FROM q UNION ALL SELECT scale, j, w FROM q) GROUP BY 1, 2)\n"
)
SQL = {
    "spectral_trace": _SCALED
    + "SELECT CAST(scale AS INTEGER) AS scale, count(*) AS active_nodes, round(sum(degree), 4) AS trace, round(sum(degree) / (SELECT count(*) FROM s), 4) AS mean, round(sqrt(greatest(0, sum(degree * degree + squares) / (SELECT count(*) FROM s) - pow(sum(degree) / (SELECT count(*) FROM s), 2))), 4) AS std FROM dd GROUP BY scale",
    "multiscale_uniform": _SCALED
    + "SELECT CAST(a.scale AS INTEGER) AS scale, n_edges, (SELECT count(*) FROM s) - active AS isolated, max_degree FROM (SELECT scale, count(*) AS n_edges FROM q GROUP BY 1) a JOIN (SELECT scale, count(*) AS active, round(max(degree), 5) AS max_degree FROM dd GROUP BY 1) b ON a.scale = b.scale",
    "pearson_edges": SPARSE + "SELECT i, j, round(w, 6) AS w FROM e",
    "cosine_edges": _pairs("v", _CORR) + f"SELECT i, j, round(w, 6) AS w FROM p WHERE w > {LEAST}",
    "spearman_edges": _pairs(_CENTRED.format("r"), _CORR).replace("u0 AS", f"sr AS (SELECT id, label, {_RANKS} AS r FROM s), u0 AS").replace("AS c FROM s)", "AS c FROM sr)") + "SELECT i, j, round(w, 6) AS w FROM p WHERE w > 0.2503",
    "rbf_edges": _pairs("v", "exp(-0.02 * (a.n * a.n + b.n * b.n - 2 * list_dot_product(a.c, b.c)))") + "SELECT i, j, round(w, 6) AS w FROM p WHERE w > 0.1",
    "laplacian_kernel_edges": _pairs("v", "exp(-0.05 * list_sum(list_transform(list_zip(a.c, b.c), lambda z: abs(z[1] - z[2]))))") + "SELECT i, j, round(w, 6) AS w FROM p WHERE w > 0.1",
    "kernel_adjacency": POSITIVE + "SELECT i, j, round(1 - exp(-w / 3.0), 6) AS w FROM e",
    "gaussian_kernel_edges": POSITIVE + "SELECT i, j, round(exp(-(1 - w) / (SELECT median(1 - w) FROM e)), 6) AS w FROM e",
    "sparsified": POSITIVE + "SELECT i, j, round(w / (SELECT max(w) FROM e), 6) AS w FROM e WHERE w >= 1e-6",
    "multiscale_percentile": POSITIVE
    + ", t AS (SELECT unnest(range(0, 5)) AS scale, unnest((SELECT quantile_cont(w, [0.0, 0.25, 0.5, 0.75, 1.0]) FROM e)) - 1e-12 AS alpha) SELECT CAST(scale AS INTEGER) AS scale, count(*) AS n_edges, round(min(w), 6) AS least FROM e JOIN t ON w >= alpha GROUP BY scale",
    "multiscale_bands": POSITIVE
    + ", r AS (SELECT min(w) AS lo, max(w) AS hi FROM e), t AS (SELECT k, lo + (hi - lo) * k / 5 - 1e-12 AS alpha FROM r, (SELECT unnest(range(0, 6)) AS k)), g AS (SELECT w, (SELECT max(k) FROM t WHERE w >= alpha) AS scale FROM e) SELECT CAST(scale AS INTEGER) AS scale, count(*) AS n_edges, round(sum(w), 5) AS weight FROM g GROUP BY scale",
    "multiscale_band_rank": POSITIVE + ", g AS (SELECT w, ntile(7) OVER (ORDER BY w DESC, i, j) - 1 AS scale FROM e) SELECT CAST(scale AS INTEGER) AS scale, count(*) AS n_edges, round(min(w), 6) AS low, round(max(w), 6) AS high FROM g GROUP BY scale",
    "knn_graph": PEARSON
    + ", x AS (SELECT i AS node, j AS other, w FROM p UNION ALL SELECT j, i, w FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(w, 12) DESC, other) AS rn FROM x) SELECT least(node, other) AS i, greatest(node, other) AS j, round(max(w), 6) AS w FROM k WHERE rn <= 5 GROUP BY 1, 2",
    "knn_cut": POSITIVE + _ENDS + ", k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, other) AS rn FROM x) SELECT least(node, other) AS i, greatest(node, other) AS j, round(max(w), 6) AS w FROM k WHERE rn <= 3 GROUP BY 1, 2",
    "laplacian_entries": POSITIVE + _ENDS + 'SELECT node AS "row", node AS "column", round(degree, 5) AS value FROM d UNION ALL SELECT node, other, round(-w, 5) FROM x',
    "degree_stats": POSITIVE + _ENDS + "SELECT CAST(sum(edges) // 2 AS BIGINT) AS edges, any_value(n) - count(*) AS isolated, round(sum(degree) / any_value(n), 5) AS avg_degree, round(max(degree), 5) AS max_degree, round(CASE WHEN count(*) < any_value(n) THEN 0 ELSE min(degree) END, 5) AS min_degree FROM d, c",
    "leave_one_out_spectral": POSITIVE
    + _ENDS
    + """, full0 AS (SELECT sum(degree) AS t, sum(degree * degree + squares) AS q FROM d),
loo AS (SELECT r.node AS gone, x.node, sum(x.w) AS degree, sum(x.w * x.w) AS squares FROM d r JOIN x ON x.node <> r.node AND x.other <> r.node GROUP BY 1, 2),
g AS (SELECT gone, sum(degree) AS t, sum(degree * degree + squares) AS q FROM loo GROUP BY gone)
SELECT gone AS node, round(abs(f.t - g.t), 5) AS d_sum, round(abs(f.t / n - g.t / (n - 1)), 5) AS d_mean, round(abs(sqrt(f.q / n - pow(f.t / n, 2)) - sqrt(greatest(0, g.q / (n - 1) - pow(g.t / (n - 1), 2)))), 5) AS d_std FROM g, full0 f, c""",
    "triangles": POSITIVE + ", t AS (SELECT a.i AS i, a.j AS j, b.j AS k FROM e a JOIN e b ON a.j = b.i JOIN e c ON c.i = a.i AND c.j = b.j) SELECT unnest([i, j, k]) AS node, count(*) AS n_triangles FROM t GROUP BY 1",
    "induced_subgraph": SPARSE + "SELECT i, j, round(w, 6) AS w FROM e WHERE i IN (SELECT id FROM s WHERE label >= 2) AND j IN (SELECT id FROM s WHERE label >= 2)",
    "knn_classify": _pairs("v", "list_dot_product(a.c, b.c) / (a.n * b.n)")
    + """, x AS (SELECT i AS id, j AS other, w FROM p UNION ALL SELECT j, i, w FROM p), f AS (SELECT x.*, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, other) AS rn FROM x WHERE id % 5 <> other % 5),
v AS (SELECT f.id, k, s.label, count(*) AS n FROM f JOIN s ON s.id = f.other JOIN (SELECT unnest([1, 3, 5, 7, 9, 11, 15, 20]) AS k) ON rn <= k GROUP BY 1, 2, 3),
b AS (SELECT id, k, arg_min(label, (-n, label)) AS predicted FROM v GROUP BY 1, 2)
SELECT k, round(avg(CASE WHEN predicted = s.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM b JOIN s ON s.id = b.id GROUP BY k""",
}

_CHANNELS = _S + ", ".join(f"c{c} AS (SELECT id, v[{16 * c + 1}:{16 * c + 16}] AS v FROM s)" for c in range(4))
SQL["multichannel_pearson"] = (
    _CHANNELS
    + ", "
    + ", ".join(f"u{c} AS (SELECT id, {_CENTRED.format('v')} AS c FROM c{c}), n{c} AS (SELECT id, c, sqrt(list_dot_product(c, c)) AS n FROM u{c})" for c in range(4))
    + ", w AS (SELECT a0.id AS i, b0.id AS j, ("
    + " + ".join(f"coalesce(list_dot_product(a{c}.c, b{c}.c) / nullif(a{c}.n * b{c}.n, 0), 0)" for c in range(4))
    + ") / 4 AS w FROM n0 a0 JOIN n0 b0 ON a0.id < b0.id "
    + " ".join(f"JOIN n{c} a{c} ON a{c}.id = a0.id JOIN n{c} b{c} ON b{c}.id = b0.id" for c in range(1, 4))
    + f") SELECT i, j, round(w, 6) AS w FROM w WHERE w > {LEAST}"
)
SQL["multichannel_rbf"] = (
    _CHANNELS
    + ", "
    + ", ".join(f"g{c} AS (SELECT 1 / (16 * var_pop(x)) AS g FROM (SELECT unnest(v) AS x FROM c{c}))" for c in range(4))
    + ", w AS (SELECT a0.id AS i, b0.id AS j, ("
    + " + ".join(f"exp(-g{c}.g * list_sum(list_transform(list_zip(a{c}.v, b{c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))" for c in range(4))
    + ") / 4 AS w FROM c0 a0 JOIN c0 b0 ON a0.id < b0.id "
    + " ".join(f"JOIN c{c} a{c} ON a{c}.id = a0.id JOIN c{c} b{c} ON b{c}.id = b0.id" for c in range(1, 4))
    + " CROSS JOIN g0 CROSS JOIN g1 CROSS JOIN g2 CROSS JOIN g3) SELECT i, j, round(w, 6) AS w FROM w WHERE w > 0.2"
)


def _step_sql(width: int | None) -> str:
    first = f"greatest(1, step + 1 - {width})" if width else "1"
    return _S + f"t AS (SELECT id, CAST(step AS INTEGER) AS step, v[{first}:step + 1] AS y FROM s, (SELECT unnest({features.steps_of(64, 16, width)}) AS step)), f AS (SELECT id, step, list_avg(y) AS mean, list_max(y) AS max, list_min(y) AS min, list_aggregate(y, 'median') AS median, list_aggregate(y, 'stddev_pop') AS std FROM t)\n"


_ROUNDED = "SELECT id, step, round(mean, 6) AS mean, round(max, 6) AS max, round(min, 6) AS min, round(median, 6) AS median, round(std, 6) AS std FROM f"
SQL["prefix_features"], SQL["trailing_features"] = _step_sql(None) + _ROUNDED, _step_sql(16) + _ROUNDED
SQL["diversity_steps"] = (
    _step_sql(None)
    + """, x AS (SELECT step, id, unnest([mean, max, min, median, std]) AS x, unnest([0, 1, 2, 3, 4]) AS p FROM f),
sd AS (SELECT step, avg(s) AS std FROM (SELECT step, p, stddev_pop(x) AS s FROM x GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT step, var_pop(x) AS variance, sqrt(sum(x * x)) AS frobenius, min(x) AS lo, max(x) AS hi, count(*) AS n FROM x GROUP BY 1),
h AS (SELECT x.step, least(19, floor(coalesce((x - lo) / nullif(hi - lo, 0), 0.5) * 20 + 1e-9)) AS bin, count(*) AS c FROM x JOIN a ON a.step = x.step GROUP BY 1, 2),
e AS (SELECT a.step, -sum((coalesce(c, 0) + 1e-10) / (n + 20e-10) * ln((coalesce(c, 0) + 1e-10) / (n + 20e-10))) AS entropy FROM a CROSS JOIN (SELECT unnest(range(0, 20)) AS bin) b LEFT JOIN h ON h.step = a.step AND h.bin = b.bin GROUP BY 1),
d AS (SELECT a.step, avg(sqrt(pow(a.mean - b.mean, 2) + pow(a.max - b.max, 2) + pow(a.min - b.min, 2) + pow(a.median - b.median, 2) + pow(a.std - b.std, 2))) AS mean_distance FROM f a JOIN f b ON a.step = b.step AND a.id < b.id GROUP BY 1)
SELECT a.step, round(std, 6) AS std, round(frobenius, 6) AS frobenius, round(mean_distance, 6) AS mean_distance, round(variance, 6) AS variance, round(entropy, 6) AS entropy,
  CASE WHEN std = mean_distance AND std = variance THEN round(std, 6) ELSE 0 END AS combined FROM a JOIN sd ON sd.step = a.step JOIN e ON e.step = a.step JOIN d ON d.step = a.step"""
)
SQL["critical_nodes"] = SQL["leave_one_out_spectral"].replace("SELECT gone AS node, round(abs(f.t - g.t), 5) AS d_sum,", "SELECT node, d_sum FROM (SELECT gone AS node, round(abs(f.t - g.t), 5) AS d_sum,") + ") ORDER BY d_sum DESC, node LIMIT 10"
SQL["graph_report"] = (
    POSITIVE
    + _ENDS
    + """, g AS (SELECT count(*) AS active, sum(edges) AS e, sum(degree) AS w, sum(squares) AS q, max(degree) AS top FROM d), m AS (SELECT *, CAST(c.n AS DOUBLE) AS k FROM g, c)
SELECT unnest(['nodes', 'isolated', 'edges', 'density', 'mean_weight', 'std_weight', 'mean_degree', 'max_degree']) AS measure,
  unnest([k, k - active, e / 2, round(e / (k * (k - 1)), 5), round(w / e, 5), round(sqrt(greatest(q / e - pow(w / e, 2), 0)), 5), round(w / k, 5), round(top, 5)]) AS value FROM m"""
)
