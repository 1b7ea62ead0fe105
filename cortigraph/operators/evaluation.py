"""Classifiers' folds, votes and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.functions.arrays import unit_hash
from cortigraph.functions.ranking import running_total, sorted_rank


#: Distinct scores of a piece that is summed up by itself.
PIECE = 65_536


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Rows of each truth and prediction; n: the column that says how many rows a row stands for."""
    rows = F.sum(n) if n else F.count(F.lit(1))
    return df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*(by or []), truth, predicted).agg(rows.alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall (sensitivity), specificity, f1, support of every class; 0 where undefined."""
    by = by or []
    c = confusion(df, truth, predicted, by, n)
    cell = F.explode(
        F.array(
            F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("tp")),
        )
    )
    sums = c.select(*by, cell.alias("x")).groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.support").alias("support"), F.sum("x.named").alias("named"), F.sum("x.tp").alias("tp"))
    # One total per evaluation.
    total = c.groupBy(*by).agg(F.sum("n").alias("_all")) if by else c.agg(F.sum("n").alias("_all"))
    sums = sums.join(total, by) if by else sums.crossJoin(F.broadcast(total))
    fp, fn = F.col("named") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("_all") - F.col("tp") - fp - fn
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("named")), ratio(F.col("tp"), F.col("support"))
    return sums.select(*by, "label", "support", "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), p.alias("precision"), r.alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * p * r, p + r).alias("f1"))


def summary(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, n: str | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted metrics of each evaluation."""
    by = by or []
    x = per_class(df, truth, predicted, by, n)
    x = x.where("support > 0")
    out = [F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy")]
    for m in ("precision", "recall", "specificity", "f1"):
        out += [F.avg(m).alias(f"macro_{m}"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}")]
    return x.groupBy(*by).agg(*out) if by else x.agg(*out)


def auc(df: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """ROC AUC of a binary truth (0, 1) by average ranks of the scores.

    Scores are first counted by value; ranks come from running sums over the
    distinct scores in pieces of their order, as many as the scores need.
    """
    by = by or []
    d = df.where(F.col(truth).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))
    v = d.groupBy(*by, score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    placed = sorted_rank(v, [F.col(score), *map(F.col, by)], "_place")
    below = running_total(placed, by, F.floor((F.col("_place") - 1) / PIECE), [F.col(score)], "q", "_below")
    u = below.withColumn("u", F.col("p") * (F.col("_below") + F.col("q") / 2))
    a = F.try_divide(F.sum("u"), F.sum("p") * F.sum("q"))
    out = [F.sum("p").alias("positives"), F.sum("q").alias("negatives"), a.alias("auc")]
    return u.groupBy(*by).agg(*out) if by else u.agg(*out)


def knn_votes(neighbours: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Prediction for every k from one ranking of neighbours: id, k, predicted; ties to the smallest label.

    neighbours: id, other, rank. labels: id, label.
    """
    near = neighbours.join(labels.select(F.col("id").alias("other"), "label"), "other")
    votes = near.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank")))).groupBy("id", "k", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id", "k").agg(F.min(F.struct(-F.col("n"), F.col("label"))).alias("m")).select("id", "k", F.col("m.label").alias("predicted"))


def best_k(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """k and accuracy, best first, the smaller k among equals."""
    hit = (F.col("label") == F.col("predicted")).cast("double")
    return predictions.join(labels, "id").groupBy("k").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def consensus(df: DataFrame, probabilities: str, truth: str, models: int, repeats: int, seed: int = 42) -> DataFrame:
    """Accuracy of the mean of m random models, for m = 1..models, mean and deviation over repeats.

    probabilities: one array per row, a place for each model. Row by row, the
    subset of a repeat is the first m models in its seeded order; only sums by
    (m, repeat) are shuffled.
    """
    order = F.array(
        *[F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(models - 1)), lambda i: F.struct(unit_hash(F.lit(seed), F.lit(r), i).alias("h"), i.alias("i")))) for r in range(repeats)]
    )
    rows = df.select(truth, probabilities).withColumn("_o", F.explode(F.transform(order, lambda o, r: F.struct(r.alias("repeat"), o.alias("o")))))
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(models))))
    mean = F.aggregate(F.slice(F.col("_o.o"), F.lit(1), F.col("m")), F.lit(0.0), lambda s, x: s + F.get(F.col(probabilities), x["i"])) / F.col("m")
    hit = ((mean >= 0.5).cast("int") == F.col(truth)).cast("double")
    by = rows.groupBy("m", F.col("_o.repeat").alias("repeat")).agg(F.avg(hit).alias("accuracy"))
    return by.groupBy("m").agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"))


def grouped_summary(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of each value; the deviation of one row is null."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))])


def with_average(df: DataFrame, key: str, values: list[str], name: str = "AVERAGE") -> DataFrame:
    """Mean of each value per key, and one row over all rows, by rollup."""
    means = [F.avg(v).alias(v) for v in values]
    key_of = F.when(F.grouping(key) == 1, F.lit(name)).otherwise(F.col(key))
    return df.rollup(key).agg(*means, key_of.alias("_k")).drop(key).withColumnRenamed("_k", key)


def best_per_group(df: DataFrame, keys: list[str], what: str, score: str) -> DataFrame:
    """The `what` with the best score in each group, the smaller among equals."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(what).alias("w")))
    return df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys).agg(best.alias("m")).select(*keys, F.col("m.w").alias(what), (-F.col("m.s")).alias(score))


def split_key(c: Column) -> tuple[Column, Column]:
    """'a_b_metric' to ('a_b', 'metric'): split at the last underscore."""
    return F.regexp_extract(c, "^(.*)_([^_]+)$", 1), F.regexp_extract(c, "^(.*)_([^_]+)$", 2)


def condition_order(kind: Column, level: Column) -> list[Column]:
    """Clean first, then falling SNR, then mild, moderate, severe."""
    snr = level.try_cast("double")
    named = F.when(level == "mild", 1).when(level == "moderate", 2).when(level == "severe", 3).otherwise(4)
    return [F.when(kind == "clean", 0).when(kind == "awgn", 1).otherwise(2), kind, -F.coalesce(snr, F.lit(0.0)), named, level]
