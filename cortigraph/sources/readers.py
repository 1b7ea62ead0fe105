"""Recordings and tables from files: text signals, NumPy arrays, EDF, summary texts."""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cortigraph.functions.ranking import sorted_rank
from cortigraph.operators.windows import clock_duration


def text_signals(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, path, v of every .txt below `path` (any case), in path order; values split at blanks or commas.

    Empty and unreadable files are left out; other values become errors through
    `same_length`.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]").select(F.col("_metadata.file_path").alias("path"), "value")
    v = F.transform(F.filter(F.split("value", r"[\s,;]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = raw.select("path", v.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    # Paths alone are sorted; the values stay where they are read.
    ranked = sorted_rank(rows.select("path"), [F.col("path")], "sample_id")
    return rows.join(ranked, "path").select((F.col("sample_id") - 1).alias("sample_id"), "path", "v")


def same_length(df: DataFrame, v: str) -> int:
    """The length of all signals; an error if there are several."""
    r = df.agg(F.min(F.size(v)).alias("a"), F.max(F.size(v)).alias("b")).first()
    if r["a"] != r["b"]:
        raise ValueError(f"signals of {r['a']} to {r['b']} values")
    return r["a"]


def decode_npy(data: bytes) -> np.ndarray:
    """A .npy file's array; pickled objects are refused."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = data[6] > 1
    size = struct.unpack("<I" if wide else "<H", data[8 : 12 if wide else 10])[0]
    start = (12 if wide else 10) + size
    head = ast.literal_eval(data[12 if wide else 10 : start].decode("latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("pickled arrays are refused")
    return np.frombuffer(data, kind, int(np.prod(head["shape"], dtype=np.int64)), start).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def npy_rows(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """path, row, v: the rows of every .npy array of two dimensions or more, flattened; a vector is one row.

    keep: condition on path; other files aren't opened.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = decode_npy(content).astype(float)
                a = a.reshape(a.shape[0], -1) if a.ndim > 1 else a.reshape(1, -1)
                for at in range(0, len(a), 1024):
                    part = a[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["path", "row", "v"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(path)
    files = files if keep is None else files.where(keep)
    return files.select("path", "content").mapInArrow(decode, "path string, row bigint, v array<double>")


def patient_arrays(spark: SparkSession, path: str, only: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """patient_id, row, v, label of every directory below `path` that holds x_data.npy, named by the directory.

    Labels come from y_labels.npy beside it, null where there is none. `only` and
    `without` choose directories before any file is opened.
    """
    patient = lambda name: F.regexp_extract("path", rf"([^/\\]+)[/\\]{name}\.npy$", 1)

    def chosen(name: str) -> Column:
        c = patient(name) != ""
        c = c if only is None else c & patient(name).isin(only)
        return c if not without else c & ~patient(name).isin(without)

    x = npy_rows(spark, path, chosen("x_data")).select(patient("x_data").alias("patient_id"), "row", "v")
    y = npy_rows(spark, path, chosen("y_labels")).select(patient("y_labels").alias("patient_id"), F.posexplode("v").alias("_p", "label"))
    return x.join(y.select("patient_id", F.col("_p").cast("bigint").alias("row"), F.col("label").cast("int").alias("label")), ["patient_id", "row"], "left").select("patient_id", "row", "v", "label")


def decode_edf(data: bytes) -> list[tuple[str, float, np.ndarray]]:
    """(label, rate, values) of the signals of an EDF file, in physical units."""
    n = int(data[252:256])
    records, seconds = int(data[236:244]), float(data[244:252])
    at = 256
    fields = {}
    for name, width in (("label", 16), ("sensor", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("rest", 32)):
        fields[name] = [data[at + i * width : at + (i + 1) * width].decode("latin1").strip() for i in range(n)]
        at += n * width
    counts = [int(x) for x in fields["samples"]]
    body = np.frombuffer(data, "<i2", offset=at)
    per = sum(counts)
    body = body[: (len(body) // per if records < 0 else records) * per].reshape(-1, per)
    out, col = [], 0
    for i in range(n):
        d0, d1, p0, p1 = (float(fields[k][i]) for k in ("dmin", "dmax", "pmin", "pmax"))
        raw = body[:, col : col + counts[i]].reshape(-1).astype(float)
        col += counts[i]
        out.append((fields["label"][i], counts[i] / seconds, (raw - d0) * (p1 - p0) / (d1 - d0) + p0))
    return out


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n values."""
    if len(x) == n:
        return x
    f = np.fft.rfft(x)
    keep = np.zeros(n // 2 + 1, complex)
    m = min(len(f), len(keep))
    keep[:m] = f[:m]
    return np.fft.irfft(keep, n) * (n / len(x))


def edf_channels(spark: SparkSession, path: str, rate: float = 256.0, channels: int = 23, names: DataFrame | None = None) -> DataFrame:
    """file_name, channel, label, v of every .edf file: resampled to `rate`, cut or zero-filled to `channels`.

    names (file_name): only these files are read, by a semi-join before decoding.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(label, resample(v, round(len(v) * rate / r))) for label, r, v in decode_edf(content)[:channels]]
                size = max((len(v) for _, v in rows), default=0)
                rows += [("", np.zeros(size))] * (channels - len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([x for x, _ in rows]), pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["file_name", "channel", "label", "v"]
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][dD][fF]").load(path)
    files = files.select(F.lower(F.regexp_extract("path", r"([^/\\]+)$", 1)).alias("file_name"), "content")
    if names is not None:
        files = files.join(names.select("file_name").distinct(), "file_name", "left_semi")
    return files.mapInArrow(decode, "file_name string, channel int, label string, v array<double>")


def summaries(texts: DataFrame, patient: str, text: str) -> DataFrame:
    """One row per recording of annotation summaries.

    patient, sampling_rate (256 if not given), channels, file_name, start_time,
    end_time, duration_sec (an earlier end is on the next day), n_seizures and
    events (start_sec, end_sec), in the order of the text.
    """
    t = F.regexp_replace(text, r"\r\n?", "\n")
    head = F.split(t, r"(?m)^File Name:", 2)
    number = lambda c, p: F.regexp_extract(c, p, 1).try_cast("int")
    numbers = lambda c, p: F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: x.try_cast("int"))
    base = texts.select(
        F.col(patient),
        F.coalesce(number(t, r"Data Sampling Rate:\s*(\d+)\s*Hz"), F.lit(256)).alias("sampling_rate"),
        F.transform(F.regexp_extract_all(F.get(head, F.lit(0)), F.lit(r"(?m)^Channel\s+\d+:\s*(\S+)"), F.lit(1)), F.btrim).alias("channels"),
        F.posexplode(F.filter(F.split(t, r"(?m)^File Name:"), lambda x, i: i > 0)).alias("position", "_b"),
    )
    b = F.col("_b")
    starts, ends = numbers(b, r"Seizure(?:\s+\d+)?\s+Start Time:\s*(\d+)\s*seconds"), numbers(b, r"Seizure(?:\s+\d+)?\s+End Time:\s*(\d+)\s*seconds")
    start, end = F.regexp_extract(b, r"File Start Time:\s*([\d:]+)", 1), F.regexp_extract(b, r"File End Time:\s*([\d:]+)", 1)
    return base.select(
        patient, "sampling_rate", "channels", F.btrim(F.regexp_extract(b, r"^\s*(\S+)", 1)).alias("file_name"), start.alias("start_time"), end.alias("end_time"), clock_duration(start, end).alias("duration_sec"),
        F.coalesce(number(b, r"Number of Seizures in File:\s*(\d+)"), F.lit(0)).alias("n_seizures"), F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("start_sec"), y.alias("end_sec"))).alias("events"),
    )


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """name, metric, value of result files {name_metric: value}."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    entries = F.explode(F.map_entries(F.from_json("value", "map<string,string>")))
    key = F.col("e.key")
    return raw.select(F.col("_metadata.file_name").alias("file_name"), entries.alias("e")).select("file_name", F.regexp_extract(key, "^(.*)_([^_]+)$", 1).alias("name"), F.regexp_extract(key, "^(.*)_([^_]+)$", 2).alias("metric"), F.col("e.value").try_cast("double").alias("value"))
