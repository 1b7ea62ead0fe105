"""Window features and episodes of event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cortigraph.session import cut_lineage

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_stats(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Count, mean and extremes by event type in sliding windows; later events than `late` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "event_type")
    out = w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "low", "high")


def episodes(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events no further apart than `gap`."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def running_baseline(events: DataFrame) -> DataFrame:
    """Per event type and batch: count, mean and deviation of all values so far.

    Each batch is summed by its tasks before the few keys are shuffled, and only
    these sums meet the state, so a type with most events is no one task's stream.
    """
    return events.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))



def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds and return what it wrote.

    Output and offsets go to a folder of their own beside the checkpoints.
    """
    spark = stream.sparkSession
    cut_lineage(spark.range(1))
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/offsets").outputMode("append").trigger(availableNow=True).start()
    else:
        save = lambda d, i: d.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")
        q = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/offsets").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields] + ([] if mode == "append" else [T.StructField("batch", T.IntegerType())]))).parquet(f"{base}/out")
