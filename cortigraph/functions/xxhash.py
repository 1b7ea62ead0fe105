"""The numbers of arrays.normal_hash for whole NumPy arrays: Spark's xxhash64 of (int seed, bigint row, int place, int)."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def of_int(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of int values after the hashes `seed`; both uint64."""
    h = (seed + P5 + np.uint64(4)) ^ ((v & np.uint64(0xFFFFFFFF)) * P1)
    return _mixed(_turned(h, 23) * P2 + P3)


def of_long(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (seed + P5 + np.uint64(8)) ^ (_turned(v * P2, 31) * P1)
    return _mixed(_turned(h, 27) * P1 + P4)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def normal(seed: int, rows: np.ndarray, size: int, known: np.ndarray | None = None) -> np.ndarray:
    """(rows, size): normal_hash(lit(seed), row, place) of every row (bigint) and place (int, from 0); a row that isn't known is null, which a hash leaves out."""
    one = lambda v: np.array([v], np.int64).view(np.uint64)
    start = of_int(one(seed), one(42))
    row = of_long(rows.astype(np.int64).view(np.uint64), start)
    if known is not None:
        row = np.where(known, row, start)
    place = of_int(np.arange(size, dtype=np.uint64)[None], row[:, None])
    out = np.log(_unit(of_int(one(1), place)))
    out *= -2
    np.sqrt(out, out=out)
    return out * np.cos(2 * 3.141592653589793 * _unit(of_int(one(2), place)))
