import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.operators import windows
from cortigraph.sources import readers, writers
from cortigraph.streaming import events

SUMMARY = """Data Sampling Rate: 256 Hz
Channels in EDF Files:
Channel 1: FP1-F7
Channel 2: F7-T7

File Name: a_01.edf
File Start Time: 23:30:00
File End Time: 0:30:00
Number of Seizures in File: 2
Seizure 1 Start Time: 100 seconds
Seizure 1 End Time: 130 seconds
Seizure 2 Start Time: 900 seconds
Seizure 2 End Time: 960 seconds

File Name: a_02.edf
File Start Time: 24:10:00
File End Time: 25:10:00
Number of Seizures in File: 0
"""


def test_summary_texts(spark):
    df = spark.createDataFrame([("p", SUMMARY), ("q", None), ("r", "")], "patient string, text string")
    a, b = readers.summaries(df, "patient", "text").orderBy("file_name").collect()
    assert (a["file_name"], a["duration_sec"], a["n_seizures"], a["channels"]) == ("a_01.edf", 3600, 2, ["FP1-F7", "F7-T7"])
    assert [(x["start_sec"], x["end_sec"]) for x in a["events"]] == [(100, 130), (900, 960)]
    assert b["events"] == [] and b["duration_sec"] == 3600 and b["sampling_rate"] == 256


def test_text_and_npy_files(spark, tmp_path):
    (tmp_path / "b.TXT").write_text("4 5\n6")
    (tmp_path / "a.txt").write_text("1, 2, 3\n")
    (tmp_path / "c.txt").write_text("")
    rows = readers.text_signals(spark, str(tmp_path)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["v"]) for r in rows] == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    x = np.arange(12.0).reshape(3, 2, 2)
    np.save(tmp_path / "x.npy", np.asfortranarray(x))
    got = readers.npy_rows(spark, str(tmp_path)).orderBy("row").collect()
    np.testing.assert_array_equal([r["v"] for r in got], x.reshape(3, 4))
    buffer = io.BytesIO()
    np.save(buffer, np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        readers.decode_npy(buffer.getvalue())
    body = writers.npy_files(spark.createDataFrame([("k", 1, [3.0, 4.0]), ("k", 0, [1.0, 2.0])], "key string, row bigint, v array<double>"), "key", "row", "v").first()["content"]
    np.testing.assert_array_equal(readers.decode_npy(bytes(body)), [[1, 2], [3, 4]])


def edf(signals, rate):
    n = len(signals)
    head = lambda v, w: str(v).ljust(w).encode()
    out = head(0, 8) + head("", 80) + head("", 80) + head("", 8) + head("", 8) + head(256 * (n + 1), 8) + head("", 44) + head(len(signals[0]) // rate, 8) + head(1, 8) + head(n, 4)
    for values, w in (([f"C{i}" for i in range(n)], 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-1000] * n, 8), ([1000] * n, 8), ([""] * n, 80), ([rate] * n, 8), ([""] * n, 32)):
        out += b"".join(head(v, w) for v in values)
    for r in range(len(signals[0]) // rate):
        for s in signals:
            out += struct.pack(f"<{rate}h", *[round(v * 10) for v in s[r * rate : (r + 1) * rate]])
    return out


def test_edf(spark, tmp_path):
    t = np.arange(64) / 16
    (tmp_path / "R.edf").write_bytes(edf([np.sin(2 * np.pi * 2 * t) * 50, t], 16))
    (tmp_path / "other.edf").write_bytes(edf([t], 16))
    names = spark.createDataFrame([("r.edf",)], "file_name string")
    rows = readers.edf_channels(spark, str(tmp_path), rate=32.0, channels=3, names=names).orderBy("channel").collect()
    assert [len(r["v"]) for r in rows] == [128, 128, 128] and rows[2]["label"] == "" and not any(rows[2]["v"])
    np.testing.assert_allclose(rows[0]["v"], np.sin(2 * np.pi * 2 * np.arange(128) / 32) * 50, atol=0.6)


def test_bundles_are_resumable(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    assert writers.not_done(df, spark, path, ["k"]).count() == 2
    writers.write_bundle(df.where("k = 'a'"), path, ["k"])
    assert [r["k"] for r in writers.not_done(df, spark, path, ["k"]).collect()] == ["b"]


def test_windows(spark):
    w = spark.createDataFrame([("f", 0.0, 4.0), ("f", 2.0, 6.0), ("f", 900.0, 904.0), ("g", 0.0, 4.0), (None, 0.0, 4.0)], "k string, start_sec double, end_sec double")
    s = spark.createDataFrame([("f", 3.9, 5.0), ("f", 1.0, 3.5), ("f", 904.0, 990.0)], "k string, lo double, hi double")
    free = windows.overlapping(w, s, ["k"])
    assert sorted((r["k"] or "", r["start_sec"]) for r in free.collect()) == [("", 0.0), ("f", 900.0), ("g", 0.0)]
    assert [r["start_sec"] for r in windows.majority_inside(w, s, ["k"]).collect()] == [0.0]
    merged = windows.merge_strict(spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 8, 12)], "k string, lo int, hi int"), ["k"])
    assert sorted((r["lo"], r["hi"]) for r in merged.collect()) == [(0, 5), (5, 12)]
    span = spark.createDataFrame([(0.0, 10.0), (0.0, 3.0)], "a double, b double")
    assert windows.sliding(span, "a", "b", 4.0, 2.0).count() == 4
    assert windows.sliding(span, "a", "b", 4.0, 0).first()["start_sec"] == 3.0


def test_streams_drop_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [(i, f"2030-01-01 00:{i:02d}:00", i % 2, "t", float(i), None) for i in range(60)]
    cols = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    one = lambda part, name: spark.createDataFrame(part, cols).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(folder / name))
    one(rows, "x")
    src = spark.readStream.schema(events.SCHEMA).parquet(str(folder / "*")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.drained(events.sliding_stats(src, "10 minutes", "10 minutes", "5 minutes"))
    assert [r["n"] for r in out.orderBy("start").collect()] == [10] * 5  # the last window stays open
    base = events.drained(events.running_baseline(src), "update").first()
    assert base["n"] == 60 and abs(base["mean"] - 29.5) < 1e-9 and abs(base["std"] - np.std(range(60))) < 1e-9
