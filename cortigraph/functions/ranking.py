"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.session import cut_lineage, shuffle_partitions

_IN_PARTITION = (1 << 33) - 1


def spread_rank(df: DataFrame, keys: list[str], band: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """row_number over `keys` by (band, *order), without one task per group.

    `band` is an integer that cuts a group into ordered pieces (a hash prefix for
    random order, a bucket of the value otherwise). Rows are numbered within
    (keys, band); one summary row per band carries the numbers of earlier bands.
    Null keys form a group of their own.
    """
    banded = df.withColumn("_band", band)
    inner = banded.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_band").orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        banded.groupBy(*keys, "_band")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_sband"), "_before")
    )
    on = F.col("_band").eqNullSafe(F.col("_sband"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inner.join(sums, on)
    return joined.withColumn(name, F.col("_before") + F.col("_rn")).drop("_band", "_rn", "_before", "_sband", *[f"_k{i}" for i in range(len(keys))])


def sorted_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Place of each row by `order` over the whole table, from 1, without one task for all rows.

    One range shuffle; the sorted rows are written, so that places within
    partitions stay, and each partition's numbers begin behind those before it.
    Equal rows by `order` are cut as well, so ties may hold most of the rows if
    `order` ends with something that tells them apart.
    """
    placed = cut_lineage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order))
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    # One row per partition.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_before")
    numbered = placed.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_IN_PARTITION)) + 1).drop("_at", "_part", "_p", "_before")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation; None if there is no value.

    Values are counted first, so that many equal ones are few rows; then only the
    values at the wanted places reach the driver, two per quantile.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sorted_rank(counts, [F.col("_v")], "_r")
    total = ranked.agg(F.sum("_c")).first()[0]
    if not total:
        return None
    below = running_total(ranked, [], F.floor((F.col("_r") - 1) / 65_536), [F.col("_r")], "_c", "_below")
    at = [q * (total - 1) for q in shares]
    wanted = sorted({int(x) for x in at} | {min(int(x) + 1, total - 1) for x in at})
    here = F.filter(F.array(*map(F.lit, wanted)), lambda w: (w >= F.col("_below")) & (w < F.col("_below") + F.col("_c")))
    value = {w: r["_v"] for r in below.select("_v", here.alias("w")).where(F.size("w") > 0).collect() for w in r["w"]}
    return [value[int(x)] + (value[min(int(x) + 1, total - 1)] - value[int(x)]) * (x - int(x)) for x in at]


def running_total(df: DataFrame, keys: list[str], band: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of `value` over the earlier rows of each group by (band, *order), without one task per group; from 0."""
    banded = df.withColumn("_band", band)
    inner = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = banded.groupBy(*keys, "_band").agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_band").alias("_sband"), "_before")
    on = F.col("_band").eqNullSafe(F.col("_sband"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = banded.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, on)
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_band", "_in", "_before", "_sband", *[f"_k{i}" for i in range(len(keys))])
