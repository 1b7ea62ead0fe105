"""Cleaning of signals held as one array per row: projections without shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.functions import iir


def with_values(df: DataFrame, v: str, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(v, A.let(F.col(v), f))


def scaled(x: Column, centre: Callable[[Column], Column], width: Callable[[Column], Column]) -> Column:
    """(x - centre) / width, both computed once."""
    return A.let(centre(x), lambda m: A.let(width(x), lambda w: F.transform(x, lambda y: (y - m) / w)))


def baseline(df: DataFrame, v: str, points: int) -> DataFrame:
    """Subtract the mean of the first `points` values; a shorter signal is an error."""
    if points <= 0:
        raise ValueError("the baseline needs at least one point")
    head = lambda x: F.when(F.size(x) >= points, A.mean(F.slice(x, 1, points))).otherwise(F.raise_error(F.lit("baseline longer than the signal")).cast("double"))
    return with_values(df, v, lambda x: A.let(head(x), lambda m: F.transform(x, lambda y: y - m)))


def baseline_zscore(df: DataFrame, v: str, points: int, floor: float = 1e-6) -> DataFrame:
    head = lambda x: F.slice(x, 1, points)
    spread = lambda x: A.let(A.deviation(head(x)), lambda s: F.when(s == 0, F.lit(floor)).otherwise(s))
    return with_values(df, v, lambda x: scaled(x, lambda x: A.mean(head(x)), spread))


def mad_outliers(df: DataFrame, v: str, threshold: float = 8.0, replace: str = "median", floor: float = 1e-6) -> DataFrame:
    """Values further from the median than threshold * MAD become the median or NaN; MAD 0 counts as `floor`."""

    def fix(x: Column, m: Column, d: Column) -> Column:
        instead = m if replace == "median" else F.lit(float("nan"))
        return A.let(F.when(d == 0, F.lit(floor)).otherwise(d), lambda w: F.transform(x, lambda y: F.when(F.abs(y - m) / w > threshold, instead).otherwise(y)))

    mad = lambda x, m: A.quantile(F.transform(x, lambda y: F.abs(y - m)), 0.5)
    return with_values(df, v, lambda x: A.let(A.quantile(x, 0.5), lambda m: A.let(mad(x, m), lambda d: fix(x, m, d))))


def standardise(df: DataFrame, v: str, eps: float = 1e-6) -> DataFrame:
    """Each signal to mean 0 and population deviation 1; deviations below eps count as eps."""
    return with_values(df, v, lambda x: scaled(x, A.mean, lambda x: A.at_least(A.deviation(x), eps, eps)))


def standardise_global(df: DataFrame, v: str, eps: float = 1e-6) -> DataFrame:
    """All values of all signals together; one row of moments is joined back."""
    one = df.select(F.explode(v).alias("x")).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    joined = df.crossJoin(F.broadcast(one))
    return joined.withColumn(v, F.transform(v, lambda y: (y - F.col("_m")) / A.at_least(F.col("_s"), eps, eps))).drop("_m", "_s")


def minmax(df: DataFrame, v: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    width = lambda x: A.let(F.array_max(x) - F.array_min(x), lambda w: F.when(w == 0, F.lit(1.0)).otherwise(w))
    return with_values(df, v, lambda x: F.transform(scaled(x, F.array_min, width), lambda y: y * (hi - lo) + lo))


def robust(df: DataFrame, v: str, floor: float = 1e-6) -> DataFrame:
    """(x - median) / IQR with interpolated quartiles; IQR 0 counts as `floor`."""
    iqr = lambda x: A.let(A.quantile(x, 0.75) - A.quantile(x, 0.25), lambda w: F.when(w == 0, F.lit(floor)).otherwise(w))
    return with_values(df, v, lambda x: scaled(x, lambda x: A.quantile(x, 0.5), iqr))


def scale_features(df: DataFrame, v: str, method: str = "standardize") -> DataFrame:
    """Each position of the vectors to mean 0 and deviation 1, or to [0, 1], over all rows.

    One row of per-position moments, as long as a vector, is joined back.
    """
    long = df.select(F.posexplode(v).alias("p", "x"))
    by = long.groupBy("p").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    a, w = ("m", "s") if method == "standardize" else ("lo", None)
    width = F.col(w) if w else F.col("hi") - F.col("lo")
    by = by.select("p", F.col(a).alias("a"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias("w"))
    one = by.agg(F.array_sort(F.collect_list(F.struct("p", "a", "w"))).alias("_f"))
    scaled = F.zip_with(F.col(v), F.col("_f"), lambda x, f: (x - f["a"]) / f["w"])
    return df.crossJoin(F.broadcast(one)).withColumn(v, scaled).drop("_f")


def bad_signal(x: Column, min_variance: float = 1e-6, limit: float | None = None, max_nan: float = 0.1) -> Column:
    """All NaN, all 0, variance of the numbers below min_variance, beyond the limit, or too many NaN."""

    def judge(x: Column, numbers: Column) -> Column:
        nan_share = F.try_divide(F.size(x) - F.size(numbers), F.size(x))
        bad = (F.size(numbers) == 0) | F.forall(numbers, lambda y: y == 0) | (A.variance(numbers) < min_variance) | (nan_share > max_nan)
        return F.coalesce(bad if limit is None else bad | F.exists(numbers, lambda y: F.abs(y) > limit), F.lit(True))

    return A.let(x, lambda x: A.let(F.filter(x, lambda y: y.isNotNull() & ~F.isnan(y)), lambda numbers: judge(x, numbers)))


def filtered(df: DataFrame, v: str, steps: list[dict]) -> DataFrame:
    """Zero-phase IIR filters, one after the other, on every signal.

    Rows with the same length in an Arrow batch are filtered together. Null and
    empty signals and signals with non-finite values come out null.
    """
    coefficients = [iir.design(**s) for s in steps]
    schema = df.schema
    at = schema.fieldNames().index(v)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = np.array(column.value_lengths().fill_null(0))
            out: list = [None] * batch.num_rows
            for n in np.unique(sizes[sizes > 1]):
                rows = np.flatnonzero(sizes == n)
                x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                fine = np.isfinite(x).all(axis=1)
                y = x[fine]
                for b, a in coefficients:
                    y = iir.both_ways(b, a, y)
                for r, s in zip(rows[fine], y):
                    out[r] = s
            arrays = [*batch.columns]
            arrays[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return df.withColumn(v, A.doubles(F.col(v))).mapInArrow(kernel, df.withColumn(v, A.doubles(F.col(v))).schema)


def clean(df: DataFrame, v: str, rate: float, low: float, high: float, notch: float | None = None, points: int | None = None, threshold: float = 8.0) -> DataFrame:
    """Band-pass and notch, baseline, outliers, standardisation, then bad signals out."""
    steps = [{"kind": "band", "rate": rate, "low": low, "high": high}] + ([{"kind": "notch", "rate": rate, "low": notch}] if notch else [])
    out = filtered(df, v, steps).where(F.col(v).isNotNull())
    if points:
        out = baseline(out, v, points)
    return standardise(mad_outliers(out, v, threshold), v).where(~bad_signal(F.col(v)))
