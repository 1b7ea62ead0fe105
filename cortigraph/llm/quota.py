"""Samples whose categories have given proportions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortigraph.functions.ranking import spread_rank
from cortigraph.session import cut_lineage

#: Ranks of a category that one row of work covers.
RANGE = 65_536
#: Rows of a piece that a group is cut into for numbering, about.
PIECE = 131_072


def _bits(most: int | None) -> int:
    """Bits of the hash that cut the largest group into pieces of PIECE rows."""
    return min(30, max(1, -(-(most or 0) // PIECE)).bit_length())


def _band(bits: int, *c) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*c), 64 - bits).cast("int")


def quota_sample(items: DataFrame, item_id: str, strata: list[str], needs: DataFrame, plan: str, needed: str, sigmas: float = 3.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Draw `needed` items of each stratum for each plan, without replacement.

    items: one row per item, with its strata. needs: one row per category, i.e.
    (plan, *strata, needed); plans draw independently of each other. Returns the
    sample (plan, *strata, item_id) and the report, a row per category: available,
    acceptance (the probability used), drawn and deficit = needed - drawn.

    Each category accepts items independently with probability
    (needed + sigmas * sqrt(needed) + 1) / available. The accepted ones are found
    by their geometric gaps over the stratum's items in random order, so that the
    draws follow the size of the sample, not plans times items; the items
    themselves are numbered once. Surplus is cut by a random priority. A category
    that accepted too few draws again, with more oversampling, among the items it
    left; what is short even then takes its other items one by one. Counts are
    therefore exact: drawn = min(needed, available).

    A category with null strata, or needed null or below 1, draws nothing; items
    with null strata are in no category; repeated item rows are repeated items.
    Other columns of both tables are ignored; without items every need is a deficit.
    Neither table is collected, and numbering is cut into pieces of about PIECE rows,
    so that a stratum or category may hold most of the rows.
    """
    names = [f"_s{i}" for i in range(len(strata))]
    pool = items.select(*[F.col(c).alias(n) for c, n in zip(strata, names)], F.col(item_id).alias("_item"))
    for n in names:
        pool = pool.where(F.col(n).isNotNull())
    # Items, categories and accepted ranks are read several times each; they are written once.
    pool = cut_lineage(pool)
    salt = F.lit(seed)
    available = cut_lineage(pool.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    bits = _bits(available.agg(F.max("_n")).first()[0])
    ranked = spread_rank(pool, names, _band(bits, "_item", salt), [F.xxhash64("_item", salt), F.col("_item")], "_rank")
    k = F.col("_need").cast("double")
    categories = cut_lineage(
        needs.select(F.col(plan).alias("_plan"), *[F.col(c).alias(n) for c, n in zip(strata, names)], F.col(needed).cast("bigint").alias("_need"))
        .join(available, names, "left")
        .withColumn("_n", F.coalesce("_n", F.lit(0)))
        .withColumn("_take", F.greatest(F.lit(0), F.least(F.coalesce("_need", F.lit(0)), "_n")))
        .withColumn("_p", F.when(F.col("_n") > 0, F.least(F.lit(1.0), (k + sigmas * F.sqrt(F.greatest(k, F.lit(0.0))) + 1) / F.col("_n")))),
    )
    cat = ["_plan", *names]
    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranks, prio, rep = [], [], []
            cols = [b.column(i).to_pylist() for i in range(1, 5)]
            for row, (s, lo, length, p) in enumerate(zip(*cols)):
                rng = np.random.default_rng(s & (2**63 - 1))
                if p >= 1:
                    at = np.arange(length)
                else:
                    at, last = [], -1
                    while last < length:
                        gaps = rng.geometric(p, int((length - last) * p + 4 * ((length - last) * p) ** 0.5 + 4))
                        step = last + np.cumsum(np.minimum(gaps, length + 1))
                        at.append(step)
                        last = int(step[-1])
                    at = np.concatenate(at)
                    at = at[at < length]
                ranks.append(at + lo + 1)
                prio.append(rng.random(len(at)))
                rep.append(np.full(len(at), row))
            cat_of = lambda v, t: pa.array(np.concatenate(v).astype(t) if v else np.empty(0, t))
            yield pa.RecordBatch.from_arrays([b.column(0).take(cat_of(rep, np.int64)), cat_of(ranks, np.int64), cat_of(prio, np.float64)], names=["c", "_rank", "_prio"])

    def drawn_by_chance(some: DataFrame, turn: int) -> DataFrame:
        """cat, _rank, _prio: ranks 1.._n that each category accepts with its _p."""
        ranges = some.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(RANGE).cast("bigint"))))
        work = ranges.select(F.struct(*cat, "_take").alias("c"), F.xxhash64(*cat, "_lo", F.lit(seed + turn)).alias("seed"), "_lo", F.least(F.lit(RANGE), F.col("_n") - F.col("_lo")).alias("len"), "_p")
        kind = work.schema["c"].dataType.simpleString()
        return work.mapInArrow(accept, f"c {kind}, _rank bigint, _prio double").select("c.*", "_rank", "_prio")

    wanted = categories.where("_take > 0")
    accepted = cut_lineage(drawn_by_chance(wanted, 0))
    got = cut_lineage(accepted.groupBy(*cat).agg(F.count(F.lit(1)).alias("_got")))
    fine = _bits(got.agg(F.max("_got")).first()[0])
    by_prio = lambda rows: spread_rank(rows, cat, F.floor(F.col("_prio") * (1 << fine)).cast("int"), [F.col("_prio"), F.col("_rank")], "_k")
    chosen = by_prio(accepted).where("_k <= _take").select(*cat, "_rank")
    missing = F.col("_take") - F.coalesce("_got", F.lit(0))
    left = (F.col("_n") - F.coalesce("_got", F.lit(0))).cast("double")
    more = F.least(F.lit(1.0), (F.col("_miss") + 2 * sigmas**2 + 2 * abs(sigmas) * F.sqrt("_miss") + 8) / left)
    short = cut_lineage(wanted.join(got, cat, "left").withColumn("_miss", missing).where("_miss > 0").withColumn("_p", more).drop("_got"))
    if not short.isEmpty():
        again = cut_lineage(drawn_by_chance(short.withColumn("_take", F.col("_miss")), 1).join(accepted.select(*cat, "_rank"), [*cat, "_rank"], "left_anti"))
        filled = cut_lineage(by_prio(again).where("_k <= _take").select(*cat, "_rank"))
        chosen = chosen.unionAll(filled)
        still = cut_lineage(short.join(filled.groupBy(*cat).agg(F.count(F.lit(1)).alias("_got")), cat, "left").withColumn("_miss", F.col("_miss") - F.coalesce("_got", F.lit(0))).where("_miss > 0"))
        if not still.isEmpty():
            others = (
                still.withColumn("_lo", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), F.lit(RANGE).cast("bigint"))))
                .withColumn("_rank", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + RANGE - 1, F.col("_n")))))
                .select(*cat, "_miss", "_rank")
                .join(accepted.select(*cat, "_rank").unionAll(filled), [*cat, "_rank"], "left_anti")
            )
            order = F.xxhash64(*cat, "_rank", salt)
            chosen = chosen.unionAll(spread_rank(others, cat, _band(bits, *cat, "_rank", salt), [order, F.col("_rank")], "_k").where("_k <= _miss").select(*cat, "_rank"))
    sample = chosen.join(ranked, [*names, "_rank"])
    drawn = sample.groupBy(*cat).agg(F.count(F.lit(1)).alias("_drawn"))
    report = categories.join(drawn, cat, "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    back = [F.col(n).alias(c) for c, n in zip(strata, names)]
    return (
        sample.select(F.col("_plan").alias(plan), *back, F.col("_item").alias(item_id)),
        report.select(F.col("_plan").alias(plan), *back, F.col("_need").alias("needed"), F.col("_n").alias("available"), F.col("_p").alias("acceptance"), F.col("_drawn").alias("drawn"), (F.col("_need") - F.col("_drawn")).alias("deficit")),
    )


def needs_of_plans(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """Needed items of each (plan_id, patient_id, label).

    plans: plan_id, n_requested, preictal_count, interictal_count,
    min_per_category; plans with a null in the first four are left out, a null
    minimum is 0. targets: plan_id, patient_id, weight; null, zero, negative and
    non-finite weights are ignored and repeated rows count once. The share of a
    category is weight / sum of weights * label count / both counts (0 if both
    counts are 0); needed is n_requested * share rounded half up, at least the
    minimum.
    """
    plans = plans.where(F.col("plan_id").isNotNull() & F.col("n_requested").isNotNull() & F.col("preictal_count").isNotNull() & F.col("interictal_count").isNotNull())
    finite = (F.col("weight") > 0) & (F.col("weight") < float("inf")) & F.col("patient_id").isNotNull()
    targets = targets.where(finite).select("plan_id", "patient_id", "weight").distinct().groupBy("plan_id", "patient_id").agg(F.sum("weight").alias("weight"))
    total = targets.groupBy("plan_id").agg(F.sum("weight").alias("total"))
    both = (F.col("preictal_count") + F.col("interictal_count")).cast("double")
    cases = plans.join(total, "plan_id").join(targets, "plan_id").withColumn("label", F.explode(F.array(F.lit(0), F.lit(1))))
    count = F.when(F.col("label") == 1, F.col("preictal_count")).otherwise(F.col("interictal_count"))
    wanted = F.coalesce(F.try_divide(F.col("n_requested") * F.col("weight") * count, F.col("total") * both), F.lit(0.0))
    return cases.select("plan_id", "patient_id", "label", F.greatest(F.floor(wanted + 0.5 + 1e-9), F.coalesce("min_per_category", F.lit(0))).cast("bigint").alias("needed"))
