"""Features of series up to a step, and how much rows differ in their features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A

FEATURES = ("mean", "max", "min", "median", "std")
BINS = 20
BLOCK = 1024


def step_window(v: Column, step: int, width: int | None = None) -> Column:
    """The values up to `step` (from 0), or the last `width` + 1 of them; beyond the end as far as they go."""
    first = 0 if not width or width <= 0 else max(0, step - width)
    return F.slice(v, first + 1, step + 1 - first)


def series_features(v: Column) -> Column:
    """Array of FEATURES of a series; zeros where it is empty."""
    of = lambda x: F.array(A.mean(x), F.array_max(x), F.array_min(x), A.quantile(x, 0.5), A.deviation(x))
    return A.let(v, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array(*[F.lit(0.0)] * len(FEATURES))))


def steps_of(n: int, interval: int, width: int | None = None) -> list[int]:
    """Every interval-th step from the first whole window on; the last step is added."""
    steps = list(range(width if width and width > 0 else interval, n, interval))
    return steps if n - 1 in steps else [*steps, n - 1]


def features_at_steps(df: DataFrame, v: str, steps: list[int], width: int | None = None) -> DataFrame:
    """df without v, with step and f (see series_features): a row for each step."""
    at = F.array(*[F.struct(F.lit(s).alias("step"), series_features(step_window(F.col(v), s, width)).alias("f")) for s in steps])
    return df.withColumn("_s", F.explode(at)).drop(v).select("*", "_s.step", "_s.f").drop("_s")


def mean_distance(df: DataFrame, by: str, row_id: str, f: str, block: int = BLOCK) -> DataFrame:
    """by, mean_distance: mean Euclidean distance of all pairs of rows of a group, 0 for a single row.

    The pairs of a group are cut into block pairs, each of which returns its sum
    and count, so no pair is written and no group is one task's work.
    """
    n = df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    rows = df.select(by, row_id, F.col(f).alias("_f")).join(n, by).withColumn("_own", F.pmod(F.xxhash64(row_id), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    tiles = rows.select(by, F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own", "_f")

    def product(t: pa.Table) -> pa.Table:
        own, a, b = t.column("_own").to_numpy(), t.column("_a")[0].as_py(), t.column("_b")[0].as_py()
        x = np.array(t.column("_f").to_pylist(), float)
        total, pairs = 0.0, 0
        left, right = x[own == a], x[own == b]
        for i in range(len(left)):
            far = left[i + 1 :] if a == b else right
            total += float(np.sqrt(((far - left[i]) ** 2).sum(axis=1)).sum())
            pairs += len(far)
        return pa.table({by: t.column(by)[:1], "d": [total], "n": pa.array([pairs], pa.int64())})

    sums = tiles.groupBy(by, "_a", "_b").applyInArrow(product, f"{by} {df.schema[by].dataType.simpleString()}, d double, n bigint")
    return sums.groupBy(by).agg(F.coalesce(F.try_divide(F.sum("d"), F.sum("n")), F.lit(0.0)).alias("mean_distance"))


def diversity(df: DataFrame, by: str, row_id: str, f: str) -> DataFrame:
    """How much the rows of each group differ in their features f (array).

    std: mean of the features' deviations; variance and frobenius norm of all
    values; mean_distance of all pairs; entropy of BINS equal bins between the
    extremes (1e-10 added to each count, the last bin closed); combined: mean of
    std, mean_distance and variance after scaling these three to mean 0 and
    deviation 1, as they are where all three are equal.
    """
    long = df.select(by, F.posexplode(f).alias("p", "x"))
    each = long.groupBy(by, "p").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.stddev_pop("x").alias("sd"), F.var_pop("x").alias("vp"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    total = each.groupBy(by).agg(F.avg("sd").alias("std"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("vp")).alias("w"), F.collect_list(F.struct("n", "s")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Variance within features and between their means.
    m = F.col("s") / F.col("n")
    between = F.aggregate("parts", F.lit(0.0), lambda t, x: t + x["n"] * (x["s"] / x["n"] - m) * (x["s"] / x["n"] - m))
    total = total.select(by, "std", ((F.col("w") + between) / F.col("n")).alias("variance"), F.sqrt("q").alias("frobenius"), "lo", "hi", "n")
    place = F.least(F.lit(BINS - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)) * BINS + 1e-9)).cast("int")
    bins = long.join(total.select(by, "lo", "hi"), by).groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    p = (F.col("c") + 1e-10) / (F.col("n") + BINS * 1e-10)
    rest = (BINS - F.count(F.lit(1))) * (F.lit(1e-10) / (F.first("n") + BINS * 1e-10)) * F.log(F.lit(1e-10) / (F.first("n") + BINS * 1e-10))
    entropy = bins.join(total.select(by, "n"), by).groupBy(by).agg((-F.sum(p * F.log(p)) - rest).alias("entropy"))
    out = total.join(entropy, by).join(mean_distance(df, by, row_id, f), by)
    three = [F.col("std"), F.col("mean_distance"), F.col("variance")]
    mean = sum(three) / 3
    spread = F.sqrt(sum((x - mean) * (x - mean) for x in three) / 3)
    # Scaled to mean 0, the three cancel out.
    return out.select(by, "std", "frobenius", "mean_distance", "variance", "entropy", F.when(spread > 0, F.lit(0.0)).otherwise(mean).alias("combined"))


def sequences(df: DataFrame, sample: str, scale: str, columns: list[str]) -> DataFrame:
    """sample, v: the series of all scales side by side, (steps, scales * columns) as an array of arrays.

    At each step come the columns of the first scale, then those of the next; a
    sample's scales have equal lengths, shorter ones are filled with null.
    """
    steps = F.arrays_zip(*columns)
    by = df.select(sample, scale, steps.alias("_z")).groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(scale).alias("s"), F.col("_z").alias("z")))).alias("_all"))
    length = F.array_max(F.transform("_all", lambda a: F.size(a["z"])))
    row = lambda t: F.flatten(F.transform("_all", lambda a: F.array(*[F.get(a["z"], t)[c] for c in columns])))
    return by.select(sample, F.transform(F.sequence(F.lit(0), length - 1), row).alias("v"))
