"""Butterworth and notch filters, run forward and backward; NumPy only."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, kind: str, *cuts: float) -> tuple[np.ndarray, np.ndarray]:
    """b, a of a digital Butterworth filter; cuts as fractions of the Nyquist rate.

    Analog prototype poles, frequency transform, bilinear transform.
    """
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = 4 * np.tan(np.pi * np.asarray(cuts) / 2)
    if kind == "low":
        z, p, k = np.empty(0), w[0] * poles, w[0] ** order
    elif kind == "high":
        z, p, k = np.zeros(order), w[0] / poles, np.real(1 / np.prod(-poles))
    elif kind == "band":
        width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        z, p, k = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    else:
        raise ValueError(f"unknown filter {kind!r}")
    zd, pd = (4 + z) / (4 - z), (4 + p) / (4 - p)
    gain = k * np.real(np.prod(4 - z) / np.prod(4 - p))
    zd = np.concatenate([zd, -np.ones(len(pd) - len(zd))])
    return np.real(gain * np.poly(zd)), np.real(np.poly(pd))


def notch(w0: float, quality: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch at w0 (fraction of Nyquist)."""
    w = np.pi * w0
    gain = 1 / (1 + np.tan(w / quality / 2))
    b = gain * np.array([1, -2 * np.cos(w), 1])
    return b, np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    m = np.eye(n - 1) - np.vstack([np.column_stack([-a[1:], np.eye(n - 1)[:, : n - 2]])])
    return np.linalg.solve(m, b[1:] - a[1:] * b[0])


def run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form over the last axis, all rows of x at once."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))) / a[0], np.pad(a, (0, n - len(a))) / a[0]
    y = np.empty_like(x)
    z = np.concatenate([state, np.zeros((len(x), 1))], axis=1)
    for t in range(x.shape[1]):
        y[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:] + b[1:] * x[:, t : t + 1] - a[1:] * y[:, t : t + 1]
    return y


def both_ways(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter of the rows of x with odd padding and steady start states."""
    pad = min(3 * max(len(a), len(b)), x.shape[1] - 1)
    if pad < 1:
        return x.copy()
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    e = np.concatenate([left, x, right], axis=1)
    zi = _steady(b, a)
    y = run(b, a, e, zi[None, :] * e[:, :1])[:, ::-1]
    y = run(b, a, np.ascontiguousarray(y), zi[None, :] * y[:, :1])[:, ::-1]
    return y[:, pad:-pad]


def design(kind: str, rate: float, low: float | None = None, high: float | None = None, order: int = 4, quality: float = 30.0) -> tuple[np.ndarray, np.ndarray]:
    """Filter by name with cut-offs in Hz, clamped inside the Nyquist band."""
    half = rate / 2
    if kind == "band":
        return butterworth(order, "band", max(low / half, 0.001), min(high / half, 0.999))
    if kind == "notch":
        return notch(min(low / half, 0.99), quality)
    cut = low / half if kind == "high" else high / half
    return butterworth(order, kind, min(cut, 0.99))
