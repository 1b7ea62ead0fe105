"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.session import cut_lineage

HOUR_MS = 3_600_000


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, block: float = HOUR_MS, touch: bool = True) -> DataFrame:
    """Merge intervals into maximal periods and list the gaps between them.

    Input: one row per interval, bounds as whole milliseconds (bigint). Output:
    `keys`, kind ('period' or 'gap'), start_ms, end_ms. Rows with a null key or
    bound, and rows that don't end after their start, are ignored; bounds may be any
    bigint whose length is one too; intervals that touch belong to one period; repeated rows count once; other columns are
    dropped; an empty table gives an empty result. With touch=False intervals that
    only touch stay apart, and bounds may be of any numeric type.

    An entity's intervals are first merged within blocks of `block` milliseconds
    of start time by session_window with the interval's own length as its gap.
    Blocks, not entities, are the unit of work, so an entity that holds most of
    the rows is spread like any other. One summary row per block then carries the
    furthest end reached by earlier blocks, and the next block's first period,
    across the entity; lead over the periods gives each period's end and the gap
    behind it.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(start).alias("_s"), F.col(end).alias("_e"))
    for c in [*k, "_s", "_e"]:
        rows = rows.where(F.col(c).isNotNull())
    # At most one row per entity and start travels on: repeated marks collapse before the shuffle.
    rows = rows.where("_e > _s")
    if touch:  # whole numbers of any size
        rows = rows.withColumn("_at", F.pmod("_s", F.lit(int(block)).cast("bigint"))).withColumn("_b", F.expr(f"(_s - _at) div {int(block)}"))
    else:
        rows = rows.withColumn("_b", F.floor(F.col("_s") / F.lit(block)))
    longest = rows.groupBy(*k, "_b", "_s").agg(F.max("_e").alias("_e"), *([F.first("_at").alias("_at")] if touch else []))
    if not touch:
        return _joined(cut_lineage(longest.select(*k, "_b", "_s", "_e")), keys, k, F.col("_s") >= F.col("_prev"))
    # Within a block only the distance to other starts of the block counts, so the time is the place in it.
    reach = F.least(F.col("_e") - F.col("_s"), F.lit(2 * int(block)).cast("bigint"))
    gap = F.make_interval(secs=reach / F.lit(1000).cast("decimal(18,3)"))
    # The merged pieces are read several times below; they are written once.
    pieces = cut_lineage(
        longest.groupBy(*k, "_b", F.session_window(F.timestamp_millis("_at"), gap).alias("_w"))
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .select(*k, "_b", "_s", "_e"),
    )
    return _joined(pieces, keys, k, F.col("_s") > F.col("_prev"))


def _joined(pieces: DataFrame, keys: list[str], k: list[str], apart: Column) -> DataFrame:
    """Periods and gaps over the pieces of all blocks; `apart` tells whether a piece begins a period."""
    in_block = Window.partitionBy(*k, "_b").orderBy("_s")
    across = Window.partitionBy(*k).orderBy("_b")
    before = across.rowsBetween(Window.unboundedPreceding, -1)

    blocks = pieces.groupBy(*k, "_b").agg(F.max("_e").alias("_block_end")).withColumn("_carry", F.max("_block_end").over(before)).select(*k, "_b", "_carry")
    reached = F.max("_e").over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    heads = (
        pieces.join(blocks, [*k, "_b"])
        .withColumn("_prev", F.greatest("_carry", reached))
        .withColumn("_last", F.greatest("_carry", F.max("_e").over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        .where(F.col("_prev").isNull() | apart)
    )
    # What follows the last period of a block: the first period of the next block that begins one.
    head_blocks = heads.groupBy(*k, "_b").agg(F.min(F.struct("_s", "_prev")).alias("_first"))
    ends = pieces.groupBy(*k).agg(F.max("_e").alias("_entity_end"))
    following = head_blocks.withColumn("_next", F.lead("_first").over(across)).join(ends, k).select(*k, "_b", "_next", "_entity_end")
    following_in_block = F.lead(F.struct("_s", "_prev")).over(in_block)
    periods = (
        heads.withColumn("_then", following_in_block)
        .join(following, [*k, "_b"])
        .withColumn("_then", F.coalesce("_then", "_next"))
        .withColumn("_end", F.coalesce(F.col("_then._prev"), F.col("_entity_end")))
    )
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("s"), F.col("_end").alias("e")),
        F.struct(F.lit("gap").alias("kind"), F.col("_end").alias("s"), F.col("_then._s").alias("e")),
    )
    return (
        periods.select(*k, F.explode(both).alias("_o"))
        .where("_o.e is not null")
        .select(*[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("_o.kind").alias("kind"), F.col("_o.s").alias("start_ms"), F.col("_o.e").alias("end_ms"))
    )
