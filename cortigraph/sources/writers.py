"""Sinks: partitioned bundles, manifests, and arrays for other tools."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16)


def write_bundle(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet by key; only the keys present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def not_done(df: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows whose keys the sink at `path` doesn't hold yet; all of them if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return df
    return df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def trajectories(df: DataFrame, components: str = "xyz", stride: int = 1, scales: list[int] | None = None, single: bool = False) -> DataFrame:
    """Chosen components and scales, every stride-th value, as float if `single`."""
    keep = df if scales is None else df.where(F.col("scale").isin(scales))
    thin = lambda c: F.filter(c, lambda x, i: i % stride == 0).cast("array<float>" if single else "array<double>")
    return keep.select("scale", "coupling", "node", *[thin(F.col(c)).alias(c) for c in components])


def window_manifest(df: DataFrame, label: str) -> DataFrame:
    """Counts of each class, the head of a metadata file."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 1).alias("n_preictal"), F.count_if(F.col(label) == 0).alias("n_interictal"))


def npy_files(df: DataFrame, key: str, row: str, v: str) -> DataFrame:
    """key, content: one .npy file body per key, rows in order; a key's rows must fit a task."""

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column(row).to_numpy())
        buffer = io.BytesIO()
        np.save(buffer, np.array(t.column(v).to_pylist(), float)[order], allow_pickle=False)
        return pa.table({key: t.column(key)[:1], "content": pa.array([buffer.getvalue()], pa.binary())})

    return df.select(key, row, v).groupBy(key).applyInArrow(build, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def matrix_rows(edges: DataFrame, value: str = "w") -> DataFrame:
    """Edge list both ways, the form of a matrix file: row, column, value."""
    flipped = edges.select(F.col("j").alias("row"), F.col("i").alias("column"), F.col(value).alias("value"))
    return edges.select(F.col("i").alias("row"), F.col("j").alias("column"), F.col(value).alias("value")).unionAll(flipped)
