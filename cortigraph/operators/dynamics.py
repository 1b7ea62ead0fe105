"""Oscillator networks on each scale of a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.functions import ode
from cortigraph.functions.arrays import unit_hash
from cortigraph.operators import similarity

STATS = ("mean", "max", "min", "median", "var", "std")
#: Nodes whose series are copied at once.
ROWS = 512


def initial_state(nodes: DataFrame, *more: Column, seed: int = 42) -> DataFrame:
    """node, x0, y0, z0 and more columns: uniform in [-10, 10]^2 x [0, 50], fixed by the node's id."""
    u = lambda c: unit_hash(F.lit(seed), F.col("node"), F.lit(c))
    return nodes.select("node", (u("x") * 20 - 10).alias("x0"), (u("y") * 20 - 10).alias("y0"), (u("z") * 50).alias("z0"), *more)


def evolve(scale_edges: DataFrame, nodes: DataFrame, couplings: list[float], h: float = 1e-3, steps: int = 3000, transient: int = 2000, field: str = "lorenz", mode: str = "additive", method: str = "rk4", output: str = "stats", batch: int = 11, stride: int = 1, memory: float = ode.MEMORY) -> DataFrame:
    """Integrate the network of every (scale, coupling).

    scale_edges: scale, i, j, w; or scale, least, where nodes have vectors v of one
    length: the edges of a scale are then the pairs of positive correlation of at
    least that, made in the tasks, so that no pairs are written. nodes: node (unique;
    all nodes take part on every scale, however many they are). output 'stats': six statistics of x, y and z per node; 'sync': the
    correlation of a node's whole trajectory with that of the first node, 0 where
    undefined; 'lyapunov': the largest exponent of x; 'trajectory': arrays x, y, z
    with every stride-th step after the transient.

    A graph with its state is the unit of work. Couplings are split into batches that
    share the matrix, of at most `batch` and such that their trajectories take about
    `memory` bytes; (scale, batch) is the group, so scales and couplings run in
    parallel. A matrix, or the trajectory of one coupling, of more than `memory` bytes
    is kept in a file of the task.
    """
    n_nodes, made = nodes.count(), "least" in scale_edges.columns
    start = initial_state(nodes, *([similarity.centred_unit(F.col("v")).alias("v")] if made else []))
    batch = max(1, min(batch, int(memory / (24 * max(1, n_nodes) * (steps - transient + 1)))))
    batches = [couplings[i : i + batch] for i in range(0, len(couplings), batch)]
    scales = scale_edges.select(F.col("scale").alias("on_scale")).distinct()
    seeds = scales.crossJoin(start).withColumn("in_part", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))
    edges = scale_edges.select("scale", *(["least"] if made else ["i", "j", "w"])).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))
    columns = {"stats": [f"{c}_{s} double" for c in "xyz" for s in STATS], "sync": ["sync double"], "lyapunov": ["lyapunov double"], "trajectory": [f"{c} array<double>" for c in "xyz"]}
    schema = ", ".join(["scale int", "coupling double", "node bigint", *columns[output]])

    def run(e: pa.Table, s: pa.Table) -> pa.Table:
        order = np.argsort(s.column("node").to_numpy())
        ids = s.column("node").to_numpy()[order]
        state = np.stack([s.column(c).to_numpy()[order] for c in ("x0", "y0", "z0")], axis=1)
        a = ode.room((len(ids), len(ids)), memory)
        if made:
            similarity.correlations(s.column("v").take(order), e.column("least")[0].as_py(), a)
        elif e.num_rows:
            i, j, w = np.searchsorted(ids, e.column("i").to_numpy()), np.searchsorted(ids, e.column("j").to_numpy()), e.column("w").to_numpy()
            a[i, j] = w
            a[j, i] = w
        eps = np.array(batches[s.column("in_part")[0].as_py()])
        path = ode.Network(a, eps, field, mode).trajectory(np.repeat(state[:, :, None], len(eps), axis=2), h, steps, transient, method, memory)
        n, scale = len(ids), s.column("on_scale")[0].as_py()
        out = {"scale": np.full(n * len(eps), scale, np.int32), "coupling": np.repeat(eps, n), "node": np.tile(ids, len(eps))}
        if output == "stats":
            for k, c in enumerate("xyz"):
                found = np.empty((len(STATS) - 1, len(eps), n))
                for r in range(0, n, ROWS):
                    p = np.ascontiguousarray(path[:, r : r + ROWS, k].T)  # couplings, nodes, steps
                    for m, f in enumerate((np.mean, np.max, np.min, np.median, np.var)):
                        found[m, :, r : r + ROWS] = f(p, axis=-1)
                out.update({f"{c}_{name}": v.ravel() for name, v in zip(STATS, found)})
                out[f"{c}_std"] = np.sqrt(out[f"{c}_var"])
        elif output == "sync":
            out["sync"] = np.concatenate([ode.sync_with_first(path[..., k]) for k in range(len(eps))])
        elif output == "lyapunov":
            found = np.empty((len(eps), n))
            for r in range(0, n, ROWS):
                x, f = np.ascontiguousarray(path[:, r : r + ROWS, 0].T), found[:, r : r + ROWS]  # couplings, nodes, steps
                for k in range(len(eps)):
                    # Nodes without edges move alike under all couplings.
                    known = (x[k] == x[0]).all(axis=1) if k else np.zeros(x.shape[1], bool)
                    f[k] = np.where(known, f[0], 0.0)
                    f[k, ~known] = [ode.largest_lyapunov(v) for v in x[k, ~known]]
            out["lyapunov"] = found.ravel()
        else:
            for k, c in enumerate("xyz"):
                out[c] = pa.array(list(path[::stride, :, k].T.reshape(n * len(eps), -1)), pa.list_(pa.float64()))
        return pa.table(out)

    # Groups are few and each is long: more partitions than groups, so that tasks seldom get two of them.
    spread = 4 * len(batches) * max(1, scales.count())
    edges, seeds = edges.repartition(spread, "scale", "part"), seeds.repartition(spread, "on_scale", "in_part")
    return edges.groupBy("scale", "part").cogroup(seeds.groupBy("on_scale", "in_part")).applyInArrow(run, schema)


def sync_with_centre(paths: DataFrame) -> DataFrame:
    """Correlation of each node's whole trajectory with that of the first node; 0 where undefined."""
    flat = paths.select("scale", "coupling", "node", F.concat("x", "y", "z").alias("v"))
    centre = flat.groupBy("scale", "coupling").agg(F.min_by("v", "node").alias("c"))
    both = flat.join(centre, ["scale", "coupling"])
    return both.select("scale", "coupling", "node", F.coalesce(F.nanvl(similarity.pearson(F.col("v"), F.col("c")), F.lit(0.0)), F.lit(0.0)).alias("sync"))


def lyapunov(paths: DataFrame, v: str = "x") -> DataFrame:
    """Largest Lyapunov exponent of each row's series."""

    @F.pandas_udf("double")
    def estimate(s):
        return s.map(lambda x: ode.largest_lyapunov(np.asarray(x, float)))

    return paths.withColumn("lyapunov", estimate(v))


def wide_features(stats: DataFrame) -> DataFrame:
    """sample and its features of all scales side by side, named by scale."""
    names = [c for c in stats.columns if c not in ("scale", "coupling", "node")]
    long = stats.unpivot(["scale", "coupling", "node"], names, "name", "value")
    return long.groupBy("coupling", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", "name", "scale"), "value")))).alias("features"))
