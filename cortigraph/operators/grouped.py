"""Linear classifiers of many groups at once, out of fold, from sums that Spark combines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortigraph.operators import evaluation

#: Penalties that a tuned model may take; the first is the default model's.
PENALTIES = (1.0, 0.1, 10.0, 100.0)
#: Sums that a task holds before it passes them on.
HELD = 256


def eligible(df: DataFrame, group: str, label: str, least: int = 5) -> DataFrame:
    """group, n0, n1 of the groups with at least `least` rows of either class (0, 1)."""
    by = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    return by.where((F.col("n0") >= least) & (F.col("n1") >= least))


def moments(df: DataFrame, keys: list[str], v: str, label: str, dim: int) -> DataFrame:
    """keys and g: the sums of products of (1, label, v) with itself over the rows of each key, as bytes.

    Each task adds up its own rows, so that a key with most of the rows sends as
    many sums as tasks read it; the sums of a key are added one after the other.
    Rows whose v has another length, or numbers that are not finite, are left out.
    """
    x = F.col(v).cast("array<double>")
    fine = df.where((F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col(label).isin(0, 1))
    kind = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for b in batches:
            if not b.num_rows:
                continue
            types = types or [b.column(i).type for i in range(len(keys))]
            rows = b.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            z = np.column_stack([np.ones(len(rows)), b.column(len(keys)).to_numpy(zero_copy_only=False), rows])
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(b.column(i).to_pylist() for i in range(len(keys))))):
                at.setdefault(k, []).append(i)
            for k, i in at.items():
                held[k] = held.get(k, 0) + z[i].T @ z[i]
            if len(held) > HELD:
                yield _record(held, keys, types)
                held = {}
        if held:
            yield _record(held, keys, types)

    parts = fine.select(*keys, F.col(label).cast("double").alias("_y"), x.alias("_x")).mapInArrow(add_rows, f"{kind}, g binary")
    return added(parts, keys)


def _record(held: dict[tuple, np.ndarray], keys: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([g.tobytes() for g in held.values()], pa.binary())], names=[*keys, "g"])


def added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and g, the sum of the parts g (doubles as bytes) of each key."""

    def add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, types = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            types = types or [b.column(i).type for i in range(len(keys))]
            done: dict[tuple, np.ndarray] = {}
            for k, g in zip(zip(*(b.column(i).to_pylist() for i in range(len(keys)))), b.column(len(keys)).to_pylist()):
                g = np.frombuffer(g)
                if k == last:
                    total = total + g
                else:
                    if last is not None:
                        done[last] = total
                    last, total = k, g
            if done:
                yield _record(done, keys, types)
        if last is not None:
            yield _record({last: total}, keys, types)

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add_sums, parts.schema)


def ridge(g: np.ndarray, columns: np.ndarray, penalty: float) -> np.ndarray | None:
    """Weights of (1, columns) for the label, on standardised columns; None where a class or rows are missing."""
    n, y = g[0, 0], g[0, 1]
    if n < 2 or y <= 0 or y >= n:
        return None
    mean = g[0, columns] / n
    cov = g[np.ix_(columns, columns)] / n - np.outer(mean, mean)
    s = np.sqrt(np.maximum(np.diag(cov), 0))
    s = np.where(s > 1e-12, s, 1.0)
    w = np.linalg.solve(cov / np.outer(s, s) * n + penalty * np.eye(len(columns)), (g[1, columns] - mean * y) / s) / s
    return np.concatenate([[y / n - mean @ w], w])


def _score(w: np.ndarray, g: np.ndarray, columns: np.ndarray) -> float:
    """Squared error of the weights over the rows that made g."""
    z = np.concatenate([[0], columns])
    return float(w @ g[np.ix_(z, z)] @ w - 2 * w @ g[1, z] + g[1, 1])


def fold_models(sums: DataFrame, group: list[str], fold: str, sets: dict[str, list[tuple[int, int]]], dim: int, penalties: tuple[float, ...] = PENALTIES) -> DataFrame:
    """group, fold, set, w, tuned: the weights that each fold's rows are predicted with, fitted on the other folds.

    sums: a row per group and fold (see `moments`). sets: slices (from 1, length)
    of v by name. Of the penalties the one with the least error over inner folds is
    taken if it is better than the first, the default. A group's folds are its
    unit of work: a few rows of fixed size, however many rows of data.
    """
    kinds = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in group)
    places = {name: np.concatenate([np.arange(a + 1, a + 1 + n) for a, n in slices]) for name, slices in sets.items()}

    def fit(t: pa.Table) -> pa.Table:
        folds = t.column(fold).to_pylist()
        gs = [np.frombuffer(b).reshape(dim + 2, dim + 2) for b in t.column("g").to_pylist()]
        total, out = sum(gs), ([], [], [], [])
        for f, g in zip(folds, gs):
            train = total - g
            inner = [h for e, h in zip(folds, gs) if e != f]
            for name, columns in places.items():
                error = []
                for p in penalties if len(inner) > 1 else penalties[:1]:
                    ws = [ridge(train - h, columns, p) for h in inner]
                    error.append(sum(_score(w, h, columns) for w, h in zip(ws, inner)) if len(inner) > 1 and all(w is not None for w in ws) else np.inf)
                best = int(np.argmin(error)) if np.isfinite(error).any() else 0
                w = ridge(train, columns, penalties[best])
                if w is None:
                    continue
                full = np.zeros(dim + 1)
                full[np.concatenate([[0], columns - 1])] = w
                for o, v in zip(out, (f, name, full, best > 0)):
                    o.append(v)
        n = len(out[0])
        first = [pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in group]
        return pa.table([*first, pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.bool_())], names=[*group, fold, "set", "w", "tuned"])

    return sums.withColumn(fold, F.col(fold).cast("int")).groupBy(*group).applyInArrow(fit, f"{kinds}, `{fold}` int, set string, w array<double>, tuned boolean")


def predicted(rows: DataFrame, models: DataFrame, on: list[str], v: str) -> DataFrame:
    """rows with set, tuned, score and predicted (score of 0.5 or more), by the models of their keys."""
    w = F.col("w")
    score = F.aggregate(F.zip_with(v, F.slice(w, 2, F.size(w)), lambda a, b: a * b), F.get(w, F.lit(0)), lambda s, x: s + x)
    return rows.join(models, on).withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("w", v)


def group_metrics(predictions: DataFrame, by: list[str], label: str) -> DataFrame:
    """Accuracy, macro and weighted metrics and AUC of each evaluation."""
    return evaluation.summary(predictions, label, "predicted", by).join(evaluation.auc(predictions, label, "score", by), by)
