"""Classifiers under noise: the noisy signals are made batch by batch, where they are used, and never written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.operators import evaluation, grouped, noise
from cortigraph.session import cut_lineage

#: Pieces of a unit of score and of either side of 0.5 that are sorted apart; scores that are no number have a piece of their own.
FINE, SIDE = 64, 512
PROTOCOLS = ("noisy_to_noisy", "clean_to_noisy")


def by_window(rows: DataFrame, row: str) -> DataFrame:
    """The rows with those of a window side by side, so that its bursts are made once."""
    return rows.repartition(noise.window_and_channel(F.col(row))[0]).sortWithinPartitions(row)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    """id (null ones masked), label, fold, v and _blinks of each batch, by fold."""
    for b in batches:
        if b.num_rows:
            order = np.argsort(fold := b.column(2).to_numpy(zero_copy_only=False), kind="stable")
            ids = np.ma.array(b.column(0).fill_null(0).to_numpy(zero_copy_only=False), mask=b.column(0).is_null().to_numpy(zero_copy_only=False))
            yield ids[order], b.column(1).to_numpy(zero_copy_only=False)[order], fold[order], *(b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] for k in (3, 4))


def moments(rows: DataFrame, conditions: list[tuple[str, str]], rate: float, dim: int) -> DataFrame:
    """condition, fold and g as of grouped.moments. rows: id, label, fold, v (dim numbers), _blinks."""
    names = [":".join(c).rstrip(":") for c in conditions]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for ids, label, fold, x, blinks in _batches(batches, dim):
            for name, y in zip(names, noise.variants(x, ids, blinks, conditions, rate)):
                z = np.column_stack([np.ones(len(y)), label, y])
                fine = np.isfinite(y).all(axis=1)
                for f in np.unique(fold):
                    part = z[(fold == f) & fine]
                    if len(part):
                        held[name, int(f)] = held.get((name, int(f)), 0) + part.T @ part
        if held:
            yield pa.record_batch({"condition": pa.array([k[0] for k in held]), "fold": pa.array([k[1] for k in held], pa.int32()), "g": pa.array([g.tobytes() for g in held.values()], pa.binary())})

    parts = rows.select("id", "label", "fold", "v", "_blinks").mapInArrow(add, "condition string, fold int, g binary")
    return grouped.added(parts, ["condition", "fold"])


def _scores(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights of (1, columns) times each row, added up from the first to the last, whatever rows stand beside it."""
    s = np.full(len(y), w[0])
    for column, k in zip(y.T, w[1:]):
        s += column * k
    return s


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p, q, their parts with a score of 0.5 or more, and u of each (g, piece); rows come in order of g, piece, score.

    u: pairs of a positive and a lower negative, equal scores as half. The rows of
    the last score wait for the next batch, which may have more of them.
    """
    totals: dict[tuple[int, int], list] = {}

    def add(g, piece, score, p, q) -> None:
        first = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(piece) != 0)]))
        for a, b in zip(first, [*first[1:], len(g)]):
            t = totals.setdefault((int(g[a]), int(piece[a])), [0, 0, 0, 0, 0.0])
            ps, qs, s = p[a:b], q[a:b], score[a:b]
            if piece[a] < SIDE:
                at = np.flatnonzero(np.concatenate([[True], np.diff(s) != 0]))
                pt, qt = np.add.reduceat(ps, at), np.add.reduceat(qs, at)
                t[4] += float((pt * (t[1] + np.cumsum(qt) - qt + qt / 2)).sum())
            high = ~(s < 0.5)
            for k, n in enumerate((ps.sum(), qs.sum(), ps[high].sum(), qs[high].sum())):
                t[k] += int(n)

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        rows = rows if held is None else [np.concatenate(c) for c in zip(held, rows)]
        wait = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
        cut = wait[-1] + 1 if len(wait) else 0
        if cut and np.isnan(rows[2][-1]):
            cut = len(rows[0]) - 1
        if cut:
            add(*(c[:cut] for c in rows))
        held = [c[cut:] for c in rows]
    if held is not None:
        add(*held)
    if totals:
        keys, sums = np.array([*totals], np.int32), list(zip(*totals.values()))
        yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array(s, pa.int64()) for s in sums[:4]), pa.array(sums[4], pa.float64())], names=["g", "piece", "p", "q", "p1", "q1", "u"])


def metrics(rows: DataFrame, models: DataFrame, conditions: list[tuple[str, str]], rate: float, dim: int) -> DataFrame:
    """grouped.group_metrics by protocol and condition: predicted by the models of the condition, or of the clean rows; always of the row's fold.

    models: condition, fold, w, one row each, whose number the parameters bound.
    """
    names = [":".join(c).rstrip(":") for c in conditions]
    weights = {(r["condition"], r["fold"]): np.array(r["w"]) for r in models.select("condition", "fold", "w").collect()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, label, fold, x, blinks in _batches(batches, dim):
            ends = np.flatnonzero(np.diff(fold, append=fold[-1] + 1)) + 1
            for c, y in enumerate(noise.variants(x, ids, blinks, conditions, rate)):
                y = np.asfortranarray(y)
                for protocol, by in enumerate((names[c], "clean")):
                    parts = [(a, b, w) for a, b in zip([0, *ends], ends) if (w := weights.get((by, int(fold[a])))) is not None]
                    if not parts:
                        continue
                    s = np.concatenate([_scores(y[a:b], w) for a, b, w in parts])
                    truth = np.concatenate([label[a:b] for a, b, _ in parts])
                    s, at = np.unique(s, return_inverse=True)
                    p = np.bincount(at[truth == 1], minlength=len(s))
                    q = np.bincount(at[truth == 0], minlength=len(s))
                    nan = np.isnan(s)
                    piece = np.where(nan, SIDE, np.clip(np.floor((np.where(nan, 0, s) - 0.5) * FINE), -SIDE, SIDE - 1)).astype(np.int32)
                    yield pa.record_batch([pa.array(np.full(len(s), protocol * len(names) + c, np.int32)), pa.array(piece), pa.array(s), pa.array(p), pa.array(q)], names=["g", "piece", "score", "p", "q"])

    scores = rows.select("id", "label", "fold", "v", "_blinks").mapInArrow(score, "g int, piece int, score double, p bigint, q bigint")
    t = cut_lineage(scores.repartition("g", "piece").sortWithinPartitions("g", "piece", "score").mapInArrow(_pieces, "g int, piece int, p bigint, q bigint, p1 bigint, q1 bigint, u double"))
    name = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    by = [name(PROTOCOLS, F.floor(F.col("g") / len(names))).alias("protocol"), name(names, F.pmod("g", F.lit(len(names)))).alias("condition")]
    cells = [(1, 1, F.col("p1")), (1, 0, F.col("p") - F.col("p1")), (0, 1, F.col("q1")), (0, 0, F.col("q") - F.col("q1"))]
    cell = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), n.alias("n")) for a, b, n in cells]))
    counts = t.select(*by, cell.alias("c")).select("protocol", "condition", "c.*").where("n > 0")
    # A row per group and piece.
    below = F.coalesce(F.sum("q").over(Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = t.withColumn("u", F.col("u") + F.col("p") * below).where(F.col("piece") < SIDE)
    auc = ranked.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")).alias("auc"))
    return evaluation.summary(counts, "label", "predicted", ["protocol", "condition"], "n").join(auc, ["protocol", "condition"])
