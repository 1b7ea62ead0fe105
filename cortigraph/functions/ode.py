"""Coupled oscillators on a graph, all couplings of a graph at once; NumPy only."""

from __future__ import annotations

import copy
import os
import tempfile

import numpy as np

LORENZ = {"sigma": 10.0, "rho": 60.0, "beta": 8.0 / 3.0}
ROESSLER = {"a": 0.2, "b": 0.2, "c": 5.7}
MODES = ("additive", "diffusive", "x_only", "nearest")
#: Equation that x_only coupling enters: y for Lorenz, x for Roessler.
COUPLED = {"lorenz": 1, "roessler": 0}
#: Steps after which it is looked whether states still move.
CHECKED = 10
#: Bytes from which a matrix or a trajectory is kept in a file.
MEMORY = 3e8


def room(shape: tuple[int, ...], memory: float = MEMORY) -> np.ndarray:
    """Zeros; above `memory` bytes in a mapped file without a name in the task's local folder, so that size is bounded by disk."""
    if 8 * np.prod(shape, dtype=float) <= memory:
        return np.zeros(shape)
    at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=at if os.path.isdir(at) else None) as file:
        return np.asarray(np.memmap(file, np.float64, "w+", shape=shape))


def lorenz(s: np.ndarray) -> np.ndarray:
    """Rates of states whose last axis but one is x, y, z."""
    x, y, z = s[..., 0, :], s[..., 1, :], s[..., 2, :]
    return np.stack([LORENZ["sigma"] * (y - x), x * (LORENZ["rho"] - z) - y, x * y - LORENZ["beta"] * z], axis=-2)


def roessler(s: np.ndarray) -> np.ndarray:
    x, y, z = s[..., 0, :], s[..., 1, :], s[..., 2, :]
    return np.stack([-y - z, x + ROESSLER["a"] * y, ROESSLER["b"] + z * (x - ROESSLER["c"])], axis=-2)


FIELDS = {"lorenz": lorenz, "roessler": roessler}


def _within(s: np.ndarray, limit: float, out: np.ndarray | None = None) -> np.ndarray:
    return np.clip(s, -limit, limit, out=out)


class Neighbours:
    """Product of a symmetric weight matrix with states: dense, or by neighbour lists where few pairs have a weight."""

    def __init__(self, a: np.ndarray, sparse_below: float = 0.008):
        self.dense = a if np.count_nonzero(a) > sparse_below * a.size else None
        if self.dense is not None:
            return
        row, column = np.nonzero(a)
        self.column, self.weight = column, a[row, column][:, None]
        self.first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else row
        self.rows = row[self.first]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return np.ascontiguousarray((np.ascontiguousarray(s.T) @ self.dense).T)  # by symmetry; few rows times the matrix take half the time of the matrix times few columns
        out = np.zeros_like(s)
        if len(self.rows):
            out[self.rows] = np.add.reduceat(s[self.column] * self.weight, self.first, axis=0)
        return out


class Network:
    """Right-hand side of N coupled oscillators for several coupling strengths.

    State: (N, 3, couplings). additive: eps * A s on all components. diffusive:
    -eps * L s. x_only: -eps * L x on one equation (COUPLED). nearest: eps * (next
    + previous - 2 s) on a ring. The state is clipped before the local field, the
    field and the sum are clipped; a clipped state is finite, so they are, too.
    """

    def __init__(self, a: np.ndarray, eps: np.ndarray, field: str = "lorenz", mode: str = "additive", state_clip: float = 200.0, rate_clip: float = 5000.0):
        if mode not in MODES:
            raise ValueError(f"unknown coupling mode {mode!r}")
        self.near, self.degree, self.eps = Neighbours(a), a.sum(axis=1)[:, None], np.asarray(eps, float)
        self.field, self.target, self.mode, self.state_clip, self.rate_clip = FIELDS[field], COUPLED[field], mode, state_clip, rate_clip

    def __call__(self, s: np.ndarray) -> np.ndarray:
        s = _within(s, self.state_clip)
        d = self.field(s)
        _within(d, self.rate_clip, d)
        if self.mode == "nearest":
            d += self.eps * (np.roll(s, 1, axis=0) + np.roll(s, -1, axis=0) - 2 * s)
        elif self.mode == "x_only":
            x = np.ascontiguousarray(s[:, 0])
            d[:, self.target] -= self.eps * (self.degree * x - self.near(x))
        else:
            spread = self.near(s.reshape(len(s), -1)).reshape(s.shape)
            if self.mode == "diffusive":
                spread -= self.degree[..., None] * s
            spread *= self.eps
            d += spread
        return _within(d, self.rate_clip, d)

    def trajectory(self, s: np.ndarray, h: float, steps: int, transient: int, method: str = "rk4", memory: float = MEMORY) -> np.ndarray:
        """(steps - transient + 1, N, 3, couplings) from the end of the transient; s: (N, 3, couplings), values that are no number count as 0.

        A coupling whose whole state a step leaves as it was (all values are clipped)
        stays there, as the rates depend on the state alone: it isn't computed on.
        """
        if method not in ("rk4", "euler"):
            raise ValueError(f"unknown method {method!r}")
        out = room((steps - transient + 1, *s.shape), memory)
        s = np.nan_to_num(s)
        moving, net, step = np.arange(s.shape[-1]), self, self._rk4 if method == "rk4" else self._euler
        for t in range(steps + 1):
            if t >= transient:
                out[t - transient][..., moving] = s
            before, s = s, step(s, h, net)
            if t % CHECKED:
                continue
            moved = (s != before).any(axis=(0, 1))
            if not moved.all():
                out[max(0, t + 1 - transient) :, ..., moving[~moved]] = s[..., ~moved]
                moving, s = moving[moved], np.ascontiguousarray(s[..., moved])
                if not len(moving):
                    break
                net = copy.copy(self)
                net.eps = self.eps[moving]
        return out

    def _euler(self, s: np.ndarray, h: float, net: Network) -> np.ndarray:
        s = _within(s, self.state_clip)
        return s + h * net(s)

    def _rk4(self, s: np.ndarray, h: float, net: Network) -> np.ndarray:
        s = _within(s, self.state_clip)
        k1 = net(s)
        k2 = net(s + h / 2 * k1)
        k3 = net(s + h / 2 * k2)
        k4 = net(s + h * k3)
        k2 += k3
        k2 *= 2
        k2 += k1
        k2 += k4
        return s + h / 6 * k2


def sync_with_first(path: np.ndarray, rows: int = 512) -> np.ndarray:
    """Correlation of each node's whole trajectory (steps, nodes, 3) with that of the first; 0 where undefined. `rows` nodes are copied at once."""
    out, first = np.zeros(path.shape[1]), None
    for a in range(0, len(out), rows):
        part = path[:, a : a + rows]
        v = part.transpose(1, 0, 2).reshape(part.shape[1], -1)
        v = v - v.mean(axis=1, keepdims=True)
        first = v[0] if first is None else first
        n = np.linalg.norm(v, axis=1) * np.linalg.norm(first)
        out[a : a + rows] = np.where(n > 0, v @ first / np.where(n > 0, n, 1), 0.0)
    return out


def _moving_sums(d: np.ndarray, width: int, gap: int, n: int) -> np.ndarray:
    """Sums of `width` values `gap` apart along the last axis, for the first n starts; a value is added log(width) times."""
    total, at, part, p = None, 0, d, 1
    while True:
        if width & p:
            piece = part[..., at * gap : at * gap + n]
            total = piece if total is None else total + piece
            at += p
        if 2 * p > width:
            return total
        part = part[..., : -p * gap] + part[..., p * gap :]
        p *= 2


def _nearest(e: np.ndarray, apart: int, rows: int = 64) -> np.ndarray:
    """For each point of e (points, dimension) the nearest one at least `apart` places off (the first where there is none).

    The own length is the same for all neighbours of a point, so q_j - 2 e_i e_j tells
    the nearest. Points at no finite distance stand before and after the real ones, so
    that the near places of `rows` points are one band of the product.
    """
    m, near = len(e), apart - 1
    left = np.column_stack([e, np.ones(m)])
    right = np.zeros((e.shape[1] + 1, m + 2 * near))
    right[:-1, near : near + m] = -2 * e.T
    right[-1] = np.inf
    right[-1, near : near + m] = (e**2).sum(axis=1)
    j = np.empty(m, np.int64)
    for a in range(0, m, rows):  # rows at a time, so that the products stay in the cache
        d = left[a : a + rows] @ right
        band = np.lib.stride_tricks.as_strided(d[:, a:], (len(d), 2 * near + 1), (d.strides[0] + d.strides[1], d.strides[1]))
        band[:] = np.inf
        j[a : a + rows] = d.argmin(axis=1) - near
    return np.maximum(j, 0)


def largest_lyapunov(x: np.ndarray, tau: int = 1, dimension: int = 10, separation: int = 10, length: int = 20) -> float:
    """Rosenstein: mean log divergence of nearest neighbours apart in time, slope of the line."""
    n = len(x) - (dimension - 1) * tau
    if n <= length + separation + 1:
        return 0.0
    if np.all(x == x[0]):  # all distances are 0
        return 0.0
    m = n - length
    steps = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(x, float), (dimension - 1) * tau + length)[:m]
    j = _nearest(steps[:, : (dimension - 1) * tau + 1 : tau], separation)
    # A pair's distance k steps on is made of squared differences that steps share.
    apart = steps - steps[j]
    apart *= apart
    apart = _moving_sums(apart, dimension, tau, length)
    some = apart > 0
    count = some.sum(axis=0)
    if not some.all():
        apart = np.where(some, apart, 1.0)
    t = np.flatnonzero(count)
    if len(t) < 2:
        return 0.0
    y = np.log(apart).sum(axis=0)[t] / (2 * count[t])
    t = t - t.mean()
    return float(t @ y / (t @ t))
