"""Seeded samples and folds that don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.functions.arrays import unit_hash
from cortigraph.functions.ranking import sorted_rank, spread_rank


def hash_band(c: Column, bits: int = 8) -> Column:
    return F.shiftrightunsigned(c, 64 - bits).cast("int")


def shuffled_rank(df: DataFrame, keys: list[str], row_id: str, seed: int, name: str = "rank") -> DataFrame:
    """Number rows within `keys` in seeded random order."""
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    return spread_rank(df, keys, hash_band(h), [h, F.col(row_id)], name)


def permuted(df: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """position: the place of each row in a seeded permutation, from 0."""
    return shuffled_rank(df.withColumn("_one", F.lit(1)), ["_one"], row_id, seed, "position").withColumn("position", F.col("position") - 1).drop("_one")


def availability(df: DataFrame, label: str, group: str) -> DataFrame:
    """Rows and groups of each label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("available"), F.count_distinct(group).alias("n_groups"))


def fair_quotas(counts: DataFrame, group: str, n: str, target: int) -> DataFrame:
    """Water-filling: every group gets the same number, as far as it has it, until `target` is reached.

    counts: one row per group. The level is found from a histogram of the group
    sizes with running sums, so groups are neither collected nor looped over;
    what is left above the level goes one each to the first groups by name.
    """
    sizes = counts.groupBy(F.col(n).alias("size")).agg(F.count(F.lit(1)).alias("groups"))
    w = Window.orderBy("size")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    steps = sizes.withColumn("done", F.coalesce(F.sum(F.col("size") * F.col("groups")).over(below), F.lit(0))).withColumn("open", F.sum("groups").over(Window.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    # With level L in (previous size, size]: total = done + open * L.
    level = steps.where(F.col("done") + F.col("open") * F.col("size") >= target).agg(F.min(F.struct("size", "done", "open")).alias("s"))
    at = level.select(F.floor((F.lit(target) - F.col("s.done")) / F.col("s.open")).alias("level"), ((F.lit(target) - F.col("s.done")) % F.col("s.open")).alias("extra"))
    placed = counts.crossJoin(F.broadcast(at)).withColumn("_over", F.when(F.col(n) > F.col("level"), 1).otherwise(0))
    # Open groups come first in the order, so their places are from 1.
    ranked = sorted_rank(placed, [F.col("_over").desc(), F.col(group)], "_r")
    quota = F.when(F.col("level").isNull(), F.col(n)).otherwise(F.least(F.col(n), F.col("level") + F.when((F.col("_over") == 1) & (F.col("_r") <= F.col("extra")), 1).otherwise(0)))
    return ranked.select(group, n, quota.cast("bigint").alias("quota"))


def balanced_sample(df: DataFrame, row_id: str, label: str, group: str, per_label: dict[object, int], seed: int = 42) -> DataFrame:
    """Per label a sample of the wanted size, spread over groups by water-filling."""
    out = None
    for value, target in per_label.items():
        rows = df.where(F.col(label) == value)
        counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
        quotas = fair_quotas(counts, group, "_n", target).select(F.col(group).alias("_g"), "quota")
        ranked = shuffled_rank(rows, [group], row_id, seed, "_k")
        part = ranked.join(quotas, F.col(group) == F.col("_g")).where("_k <= quota").drop("_g", "quota", "_k")
        out = part if out is None else out.unionByName(part)
    return out


def stratified_folds(df: DataFrame, row_id: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """fold 0..k-1 with class counts that differ by one at most."""
    return shuffled_rank(df, [label], row_id, seed, "_r").withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_r")


def group_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """fold of each row by its group, so that a group is never in two folds."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(k)).cast("int"))


def bootstrap(df: DataFrame, row_id: str, replicates: int, seed: int = 42) -> DataFrame:
    """Poisson(1) bootstrap: replicate and times drawn, for the rows drawn at least once."""
    cut, p, total = [], 0.36787944117144233, 0.0
    while total + p > total:  # as far as a double tells two sums apart
        total += p
        cut.append(total)
        p /= len(cut)
    u = unit_hash(F.lit(seed), F.col(row_id), F.col("replicate"))
    times = sum((F.when(u > c, 1).otherwise(0) for c in cut), F.lit(0))
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("times", times).where("times > 0")


def pick_nodes(nodes: DataFrame, node: str, n: int, method: str = "hybrid", random_share: float = 0.3, seed: int = 42) -> DataFrame:
    """At most n nodes: 'random', 'uniform' (evenly spaced by id), or a share of each, topped up."""
    total = nodes.count()
    if total <= n:
        return nodes.select(node)
    ranked = sorted_rank(nodes.select(node), [F.col(node)], "_pos").withColumn("_one", F.lit(1))
    ranked = shuffled_rank(ranked, ["_one"], node, seed, "_rnd")

    def even(m: int) -> Column:
        """Is the place p one of floor(i * step), i < m? There is at most one such i, next to p / step."""
        p, step = F.col("_pos") - 1, (total - 1) / max(1, m - 1)
        near = [F.ceil(p / F.lit(step)) + d for d in (-1, 0, 1)] if step > 0 else [F.lit(0)]
        hit = F.lit(False)
        for i in near:
            hit = hit | ((i >= 0) & (i < m) & (F.floor(i * F.lit(step)) == p))
        return hit

    if method == "random":
        return ranked.where(F.col("_rnd") <= n).select(node)
    if method == "uniform":
        return ranked.where(even(n)).select(node)
    few = int(n * random_share)
    first = F.when(F.col("_rnd") <= few, 0).when(even(n - few), 1).otherwise(2)
    chosen = spread_rank(ranked.withColumn("_first", first), ["_one"], F.col("_first") * 64 + hash_band(F.xxhash64(F.lit(seed), F.col(node)), 6), [F.col("_rnd")], "_k")
    return chosen.where(F.col("_k") <= n).select(node)
