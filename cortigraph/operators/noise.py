"""Controlled noise on signals, fixed by seed, row and position."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.functions import iir, xxhash

SCALES = {"emg_burst": {"mild": 0.25, "moderate": 0.5, "severe": 1.0}, "eog_blink": {"mild": 0.5, "moderate": 1.0, "severe": 2.0}}
CHANNELS = 18
FLOOR = 1e-8


def window_and_channel(row: Column) -> tuple[Column, Column]:
    return F.floor(row / CHANNELS), F.pmod(row, F.lit(CHANNELS))


def _with_noise(df: DataFrame, v: str, row: str, seed: int, sd: Column) -> DataFrame:
    noisy = df.withColumn("_sd", sd)
    return noisy.withColumn(v, F.transform(v, lambda x, i: x + F.col("_sd") * A.normal_hash(F.lit(seed), F.col(row), i))).drop("_sd")


def gaussian(df: DataFrame, v: str, row: str, ratio: float, seed: int = 42) -> DataFrame:
    """sd = ratio * deviation of the signal, a deviation of 0 counting as 1."""
    s = A.deviation(F.col(v))
    return _with_noise(df, v, row, seed, F.lit(ratio) * F.when(s == 0, F.lit(1.0)).otherwise(s))


def awgn(df: DataFrame, v: str, row: str, snr_db: float, seed: int = 42) -> DataFrame:
    """White noise of the power that gives the signal-to-noise ratio, at least 1e-8."""
    power = A.dot(F.col(v), F.col(v)) / F.size(v)
    return _with_noise(df, v, row, seed, F.sqrt(F.greatest(power / F.lit(10 ** (snr_db / 10)), F.lit(1e-8))))


def _rms(v: Column) -> Column:
    return F.sqrt(A.dot(v, v) / F.size(v) + FLOOR)


def eog_blink(df: DataFrame, v: str, row: str, level: str, rate: float, seed: int = 42) -> DataFrame:
    """0 to 2 Gaussian pulses of 0.2 to 0.4 s at RMS 1, times the signal's RMS; front thirds of the channels get 1, 0.55, 0.25 of it."""
    window, channel = window_and_channel(F.col(row))
    u = lambda *k: A.unit_hash(F.lit(seed), window, *map(F.lit, k))
    weight = F.when(channel < CHANNELS / 3, 1.0).when(channel < 2 * CHANNELS / 3, 0.55).otherwise(0.25)
    out = df.withColumn("_n", F.floor(u("n") * 3)).withColumn("_a", weight * SCALES["eog_blink"][level] * _rms(F.col(v)))
    for p in range(2):
        centre, width = u("centre", p) * F.greatest(F.lit(1), F.size(v) - 1), F.greatest(F.lit(1.0), (0.2 + 0.2 * u("width", p)) * rate / 6)
        out = out.withColumn(f"_c{p}", centre).withColumn(f"_s{p}", width)
        pulse = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.exp(-F.pow((i - F.col(f"_c{p}")) / F.col(f"_s{p}"), F.lit(2.0)) / 2))  # noqa: B023
        scaled = A.let(pulse, lambda x: A.let(_rms(x), lambda r: F.transform(x, lambda y: y / r)))
        added = F.zip_with(F.col(v), scaled, lambda x, y: x + F.col("_a") * y)
        out = out.withColumn(v, F.when((F.col("_n") > p) & (F.size(v) > 0), added).otherwise(F.col(v)))
    return out.drop("_n", "_a", "_c0", "_s0", "_c1", "_s1")


def bursts(seed: int, window: int, size: int, rate: float) -> list[tuple[int, np.ndarray, int, int]]:
    """(start, values, first channel, last channel) of a window's 1 to 3 bursts of 0.1 to 0.5 s.

    White noise through a Butterworth band of 20 to 70 Hz (below the Nyquist rate),
    under a Hann window, at RMS 1; a burst of three values or fewer is silent. The
    2 to 4 neighbouring channels lie around one of them and end with the head.
    """
    return bursts_of(seed, [window], size, rate)[window]


def bursts_of(seed: int, windows: Iterable[int], size: int, rate: float) -> dict[int, list[tuple[int, np.ndarray, int, int]]]:
    """`bursts` of several windows; those of equal length run through the filter together."""
    drawn, lengths = [], {}
    for window in windows:
        rng = np.random.default_rng([seed, window])
        for _ in range(rng.integers(1, 4)):
            n = min(max(1, round(rng.uniform(0.1, 0.5) * rate)), size)
            start = int(rng.integers(0, max(1, size - n + 1)))
            white = rng.normal(size=n)
            group, centre = int(rng.integers(2, 5)), int(rng.integers(0, CHANNELS))
            lengths.setdefault(n, []).append(len(drawn))
            drawn.append((window, start, white, centre - group // 2, centre + group - group // 2 - 1))
    high = min(70.0 / (rate / 2), 0.999)
    low = max(20.0 / (rate / 2), 1e-4)
    b, a = iir.butterworth(4, "band", max(high * 0.5, 1e-4) if low >= high else low, high)
    values: list[np.ndarray] = [np.zeros(0)] * len(drawn)
    for n, at in lengths.items():
        x = np.zeros((len(at), n))
        if n > 3:
            x = iir.both_ways(b, a, np.stack([drawn[k][2] for k in at])) * np.hanning(n)
            x /= np.sqrt(np.mean(x**2, axis=1, keepdims=True) + FLOOR)
        for k, y in zip(at, x):
            values[k] = y
    out: dict[int, list] = {}
    for (window, start, _, first, last), y in zip(drawn, values):
        out.setdefault(window, []).append((start, y, first, last))
    return out


def emg_burst(df: DataFrame, v: str, row: str, level: str, rate: float, seed: int = 42) -> DataFrame:
    """Bursts (see `bursts`) times the signal's RMS on the channels of each window that they hit; fixed by seed and window."""
    schema = df.withColumn(v, A.doubles(F.col(v))).schema
    names = schema.fieldNames()
    at, by, scale = names.index(v), names.index(row), SCALES["emg_burst"][level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], list] = {}
        for batch in batches:
            out, rows = batch.column(at).to_pylist(), batch.column(by).to_pylist()
            if len(made) > 10_000:
                made.clear()
            missing: dict[int, set[int]] = {}
            for x, k in zip(out, rows):
                if x and k is not None and (k // CHANNELS, len(x)) not in made:
                    missing.setdefault(len(x), set()).add(k // CHANNELS)
            for size, windows in missing.items():
                made.update({(w, size): found for w, found in bursts_of(seed, windows, size, rate).items()})
            for i, k in enumerate(rows):
                if not out[i] or k is None:
                    continue
                x = np.array(out[i], float)
                rms = np.sqrt(np.mean(x**2) + FLOOR)
                for start, values, first, last in made[k // CHANNELS, len(x)]:
                    if first <= k % CHANNELS <= last:
                        x[start : start + len(values)] += scale * rms * values
                out[i] = x
            arrays = [*batch.columns]
            arrays[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.withColumn(v, A.doubles(F.col(v))).mapInArrow(run, schema)


def places(df: DataFrame, row: str, size: int, rate: float, seed: int = 42) -> DataFrame:
    """df with what `variants` needs of each row: number, centres and widths of its window's pulses (see eog_blink), as _blinks."""
    window, _ = window_and_channel(F.col(row))
    u = lambda *k: A.unit_hash(F.lit(seed), window, *map(F.lit, k))
    pulses = [c for p in range(2) for c in (u("centre", p) * max(1, size - 1), F.greatest(F.lit(1.0), (0.2 + 0.2 * u("width", p)) * rate / 6))]
    return df.withColumn("_blinks", F.array(F.floor(u("n") * 3).cast("double"), *pulses))


def variants(x: np.ndarray, rows: np.ndarray, blinks: np.ndarray, conditions: list[tuple[str, str]], rate: float, seed: int = 42) -> Iterator[np.ndarray]:
    """The signals x (row by row, of one length) under each (type, level) of `apply`, in turn.

    What the levels of a type share is made once: the normal numbers, the pulses
    (blinks: `_blinks` of `places`) and the bursts of the rows' windows. A masked row
    number is null: it has no bursts and counts as none of the front channels.
    """
    size = x.shape[1]
    known, rows = ~np.ma.getmaskarray(rows), np.ma.getdata(rows)
    kinds = {k for k, _ in conditions}
    power = np.mean(x * x, axis=1)
    rms = np.sqrt(power + FLOOR)
    windows, channel = rows // CHANNELS, rows % CHANNELS
    if "awgn" in kinds:
        normal = xxhash.normal(seed, rows, size, known)
    if "emg_burst" in kinds:
        made, burst = bursts_of(seed, np.unique(windows[known]).tolist(), size, rate), []
        for i, w, c in zip(np.flatnonzero(known).tolist(), windows[known].tolist(), channel[known].tolist()):
            burst += [(i, start, values) for start, values, first, last in made[w] if first <= c <= last]
    if "eog_blink" in kinds:
        weight = np.where(~known, 0.25, np.where(channel < CHANNELS / 3, 1.0, np.where(channel < 2 * CHANNELS / 3, 0.55, 0.25)))
        pulses = []
        for p in range(2):
            at = np.flatnonzero(blinks[:, 0] > p)
            y = np.exp(-(((np.arange(size) - blinks[at, 1 + 2 * p, None]) / blinks[at, 2 + 2 * p, None]) ** 2) / 2)
            pulses.append((at, y / np.sqrt(np.mean(y * y, axis=1, keepdims=True) + FLOOR)))
    for kind, level in conditions:
        if kind == "clean":
            yield x
        elif kind == "awgn":
            yield x + np.sqrt(np.maximum(power / 10 ** (float(level) / 10), 1e-8))[:, None] * normal
        elif kind == "emg_burst":
            y = x.copy()
            for i, start, values in burst:
                y[i, start : start + len(values)] += SCALES[kind][level] * rms[i] * values
            yield y
        elif kind == "eog_blink":
            y, strength = x.copy(), weight * SCALES[kind][level] * rms
            for at, pulse in pulses:
                y[at] += strength[at, None] * pulse
            yield y
        else:
            raise ValueError(f"unknown noise {kind!r}")


def apply(df: DataFrame, v: str, row: str, kind: str, level: str | float | None, rate: float = 256.0, seed: int = 42) -> DataFrame:
    """Noise by name, with noise_type and noise_level columns; 'clean' changes nothing."""
    kinds = {
        "clean": lambda: df,
        "gaussian": lambda: gaussian(df, v, row, float(level), seed),
        "awgn": lambda: awgn(df, v, row, float(level), seed),
        "emg_burst": lambda: emg_burst(df, v, row, level, rate, seed),
        "eog_blink": lambda: eog_blink(df, v, row, level, rate, seed),
    }
    if kind not in kinds:
        raise ValueError(f"unknown noise {kind!r}")
    return kinds[kind]().withColumn("noise_type", F.lit(kind)).withColumn("noise_level", F.lit("" if level is None else str(level)))
