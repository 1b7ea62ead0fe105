"""Sample similarity: against a fixed set of vectors, and all pairs in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A

#: Rows of a block of the all-pairs product.
BLOCK = 1024
#: Vectors that a side joined by broadcast may hold.
FEW = 4096


def centred_unit(v: Column, eps: float = 1e-12) -> Column:
    """The vector minus its mean, at length 1; constant vectors become zeros."""
    scaled = lambda c, n: F.transform(c, lambda x: F.when(n < eps, F.lit(0.0)).otherwise(F.try_divide(x, n)))
    centred = lambda x: A.let(A.mean(x), lambda m: F.transform(x, lambda y: y - m))
    return A.let(v, lambda x: A.let(centred(x), lambda c: A.let(F.sqrt(A.dot(c, c)), lambda n: scaled(c, n))))


def unit(v: Column, floor: float = 1e-8) -> Column:
    divisor = lambda x: A.let(F.sqrt(A.dot(x, x)), lambda n: F.when(n == 0, F.lit(floor)).otherwise(n))
    return A.let(v, lambda x: A.let(divisor(x), lambda n: F.transform(x, lambda y: y / n)))


def average_ranks(v: Column) -> Column:
    """Ranks from 1 with ties at their mean, by counting smaller and equal values."""
    rank = lambda x, y: F.size(F.filter(x, lambda z: z < y)) + (F.size(F.filter(x, lambda z: z == y)) + F.lit(1)) / F.lit(2.0)
    return A.let(v, lambda x: F.transform(x, lambda y: rank(x, y)))


def clipped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def pearson(a: Column, b: Column) -> Column:
    """Correlation, 0 where a side is constant, clipped to [-1, 1]."""
    return clipped(A.dot(centred_unit(a), centred_unit(b)))


def spearman(a: Column, b: Column) -> Column:
    return pearson(average_ranks(a), average_ranks(b))


def cosine(a: Column, b: Column) -> Column:
    return A.dot(unit(a), unit(b))


def squared_distance(a: Column, b: Column) -> Column:
    return A.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def rbf(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def laplacian_kernel(a: Column, b: Column, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * A.total(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


#: Per-vector preparation and pair function by method; unknown methods raise KeyError.
METHODS = {
    "pearson": (centred_unit, lambda a, b, gamma: clipped(A.dot(a, b))),
    "spearman": (lambda v: centred_unit(average_ranks(v)), lambda a, b, gamma: clipped(A.dot(a, b))),
    "cosine": (unit, lambda a, b, gamma: A.dot(a, b)),
    "rbf": (lambda v: v, rbf),
    "laplacian": (lambda v: v, laplacian_kernel),
    "dot": (lambda v: v, lambda a, b, gamma: A.dot(a, b)),
}


def against(df: DataFrame, v: str, few: DataFrame, few_id: str, few_v: str, method: str = "pearson", gamma: float = 1.0) -> DataFrame:
    """Similarity of every row to each of a small set of vectors: one row per pair.

    The set is broadcast after its size is checked (FEW). Each vector is prepared
    once, before the pairs are formed. Vectors of another length give null.
    """
    n = few.count()
    if n > FEW:
        raise ValueError(f"{n} vectors to compare with: use all_pairs or a block join")
    prepare, pair = METHODS[method]
    side = few.select(F.col(few_id).alias("_few_id"), prepare(A.doubles(F.col(few_v))).alias("_b"))
    left = df.withColumn("_a", prepare(A.doubles(F.col(v))))
    both = left.crossJoin(F.broadcast(side))
    return both.withColumn("similarity", F.when(F.size("_a") == F.size("_b"), pair(F.col("_a"), F.col("_b"), gamma))).withColumnRenamed("_few_id", few_id).drop("_a", "_b")


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def _products(x: np.ndarray, y: np.ndarray, method: str, gamma: float) -> np.ndarray:
    if method in ("pearson", "spearman", "cosine"):
        return np.clip(x @ y.T, -1, 1)
    if method == "dot":
        return x @ y.T
    if method == "channels_rbf":  # gamma: one number for each channel
        parts = zip(np.split(x, len(gamma), axis=1), np.split(y, len(gamma), axis=1), gamma)
        return sum(_products(a, b, "rbf", g) for a, b, g in parts) / len(gamma)
    if method == "rbf":
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))
    return np.exp(-gamma * np.stack([np.abs(x - r).sum(axis=1) for r in y], axis=1))


def correlations(units: pa.ChunkedArray, least: float, out: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Symmetric matrix of the positive correlations of at least `least`, else 0 and 0 on the diagonal; units: of centred_unit, out: takes it."""
    u = _rows(units)
    for a in range(0, len(u), block):
        for b in range(a, len(u), block):
            w = _products(u[a : a + block], u[b : b + block], "pearson", 1.0)
            w[(w < least) | (w <= 0)] = 0
            if a == b:
                w = np.triu(w, 1)
                w += w.T
            out[a : a + block, b : b + block] = w
            out[b : b + block, a : a + block] = w.T
    return out


def _blocks(vectors: DataFrame, method: str, block: int) -> tuple[DataFrame, int]:
    """Rows with their block, replicated to the unordered block pairs they take part in."""
    n = max(1, vectors.count())
    nb = -(-n // block)
    prepared = vectors.select("id", METHODS["dot" if method == "channels_rbf" else method][0](A.doubles(F.col("v"))).alias("v"), F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("own"))
    replicated = prepared.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    return replicated.select("id", "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")), nb


def all_pairs(vectors: DataFrame, method: str = "pearson", least: float = 0.0, strict: bool = True, gamma: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Edges i < j, w of all pairs with w above `least` (at least `least` if not strict).

    vectors: id (bigint, unique), v (arrays of one length). The upper half of the
    product is cut into block pairs of about block x block; each is one task's
    matrix product, and pairs below the limit never leave it.
    """
    tiles, _ = _blocks(vectors, method, block)

    def product(t: pa.Table) -> pa.Table:
        ids, own, v = t.column("id").to_numpy(), t.column("own").to_numpy(), _rows(t.column("v"))
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        m, o = own == a, own == b
        w = _products(v[m], v[o], method, gamma)
        keep = (w > least) if strict else (w >= least)
        if a == b:
            keep &= ids[m][:, None] < ids[o][None, :]
        r, c = np.nonzero(keep)
        x, y = ids[m][r], ids[o][c]
        return pa.table({"i": np.minimum(x, y), "j": np.maximum(x, y), "w": w[r, c]})

    return tiles.groupBy("a", "b").applyInArrow(product, "i bigint, j bigint, w double")


def pair_summary(vectors: DataFrame, thresholds: list[float], method: str = "pearson", block: int = BLOCK, weight=None) -> DataFrame:
    """Per threshold and node: degree, edges and squared weights, without writing the pairs.

    Each block pair returns sums by (threshold, node), so the output is nodes
    times thresholds times blocks, not pairs. `weight` maps similarities to
    weights; pairs with weight 0 are no edges.
    """
    tiles, _ = _blocks(vectors, method, block)

    def product(t: pa.Table) -> pa.Table:
        ids, own, v = t.column("id").to_numpy(), t.column("own").to_numpy(), _rows(t.column("v"))
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        m, o = own == a, own == b
        w = _products(v[m], v[o], method, 1.0)
        w = weight(w) if weight else np.maximum(w, 0)
        if a == b:
            np.fill_diagonal(w, 0)
        parts = []
        for k, limit in enumerate(thresholds):
            kept = np.where((w >= limit) & (w > 0), w, 0)
            for x, axis in ((ids[m], 1), (ids[o], 0)):
                if a == b and axis == 0:
                    continue
                parts.append((np.full(len(x), k), x, kept.sum(axis=axis), (kept > 0).sum(axis=axis), (kept**2).sum(axis=axis)))
        cat = [np.concatenate(c) for c in zip(*parts)]
        return pa.table({"scale": cat[0].astype(np.int32), "node": cat[1], "degree": cat[2], "edges": cat[3].astype(np.int64), "squares": cat[4]})

    sums = tiles.groupBy("a", "b").applyInArrow(product, "scale int, node bigint, degree double, edges bigint, squares double")
    return sums.groupBy("scale", "node").agg(F.sum("degree").alias("degree"), F.sum("edges").alias("edges"), F.sum("squares").alias("squares"))


def pair_shift(vectors: DataFrame, changed: DataFrame, method: str = "pearson", block: int = BLOCK) -> DataFrame:
    """Mean |d| over the full matrix, Frobenius norm and largest |d|; d: changed minus old similarity of a pair, of either sign.

    changed: the same ids with other vectors. Both vectors of a row travel side by
    side, so each block pair returns three sums and no pairs.
    """
    prepare = METHODS[method][0]
    both = vectors.select("id", prepare(A.doubles(F.col("v"))).alias("_v")).join(changed.select("id", prepare(A.doubles(F.col("v"))).alias("_w")), "id")
    # They are prepared, so that the tiles take them as they are.
    tiles, _ = _blocks(both.select("id", F.concat("_v", "_w").alias("v")), "rbf", block)

    def product(t: pa.Table) -> pa.Table:
        own, v = t.column("own").to_numpy(), _rows(t.column("v"))
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        m, o, half = own == a, own == b, v.shape[1] // 2
        d = np.abs(_products(v[m, half:], v[o, half:], method, 1.0) - _products(v[m, :half], v[o, :half], method, 1.0))
        if a == b:
            d = np.triu(d, 1)
        return pa.table({"own": [float(m.sum()) if a == b else 0.0], "d": [float(d.sum())], "squares": [float((d * d).sum())], "most": [float(d.max(initial=0.0))]})

    s = tiles.groupBy("a", "b").applyInArrow(product, "own double, d double, squares double, most double")
    return s.agg(
        (2 * F.coalesce(F.sum("d"), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("own"), F.lit(0.0)), F.lit(1.0)) ** 2).alias("mean_abs"),
        F.sqrt(2 * F.coalesce(F.sum("squares"), F.lit(0.0))).alias("frobenius"),
        F.coalesce(F.max("most"), F.lit(0.0)).alias("max_abs"),
    )


def positive_range(vectors: DataFrame, method: str = "pearson", block: int = BLOCK, weight=None) -> tuple[float, float] | None:
    """Least and largest positive weight of all pairs; None where there is none."""
    tiles, _ = _blocks(vectors, method, block)

    def product(t: pa.Table) -> pa.Table:
        own, v = t.column("own").to_numpy(), _rows(t.column("v"))
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        w = _products(v[own == a], v[own == b], method, 1.0)
        w = weight(w) if weight else np.maximum(w, 0)
        if a == b:
            np.fill_diagonal(w, 0)
        w = w[w > 0]
        return pa.table({"lo": [w.min() if len(w) else None], "hi": [w.max() if len(w) else None]}, schema=pa.schema([("lo", pa.float64()), ("hi", pa.float64())]))

    r = tiles.groupBy("a", "b").applyInArrow(product, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
    return None if r[0] is None else (r[0], r[1])


def pair_range(vectors: DataFrame, method: str = "pearson", block: int = BLOCK, weight=None) -> tuple[float, float]:
    """Least and largest positive weight of all pairs."""
    r = positive_range(vectors, method, block, weight)
    if r is None:
        raise ValueError("no positive edge")
    return r


def block_topk(queries: DataFrame, vectors: DataFrame, k: int, method: str = "pearson", block: int = BLOCK, group: bool = False) -> DataFrame:
    """The k most similar vectors of each query: id, other, w, rank; ties by other.

    Queries meet every vector in block pairs that each keep k per query; the
    winners are ranked. With group=True both sides carry `fold`, and pairs of the
    same fold are left out.
    """
    prepare = METHODS[method][0]
    extra = ["fold"] if group else []
    q = queries.select("id", prepare(A.doubles(F.col("v"))).alias("v"), *extra)
    # Other names on this side: both may come from one table, and cogroup resolves columns by name.
    x = vectors.select(F.col("id").alias("other"), prepare(A.doubles(F.col("v"))).alias("u"), *[F.col(c).alias("fold_of_other") for c in extra])
    nq, nv = -(-max(1, q.count()) // block), -(-max(1, x.count()) // block)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.withColumn("a", at("id", nq)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    right = x.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("d", at("other", nv))

    def best(s: pa.Table, t: pa.Table) -> pa.Table:
        if not s.num_rows or not t.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        si, ti = s.column("id").to_numpy(), t.column("other").to_numpy()
        order = np.argsort(ti, kind="stable")
        w = _products(_rows(s.column("v")), _rows(t.column("u"))[order], method, 1.0)
        ti = ti[order]
        out = (s.column("fold").to_numpy()[:, None] == t.column("fold_of_other").to_numpy()[order][None, :]) if group else si[:, None] == ti[None, :]
        w[out] = -np.inf
        top = np.argsort(-np.round(w, 12), axis=1, kind="stable")[:, :k]
        r = np.repeat(np.arange(len(si)), top.shape[1])
        c = top.ravel()
        keep = np.isfinite(w[r, c])
        return pa.table({"id": si[r[keep]], "other": ti[c[keep]], "w": w[r[keep], c[keep]]})

    winners = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(best, "id bigint, other bigint, w double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("w", 12).desc(), F.col("other")))
    return winners.withColumn("rank", rank).where(F.col("rank") <= k)


def _channel(v: Column, c, length: Column) -> Column:
    return F.slice(v, (c * length + 1).cast("int"), length.cast("int"))


def multichannel_pearson(vectors: DataFrame, channels: int, least: float = 0.0, live_only: bool = False, block: int = BLOCK) -> DataFrame:
    """Edges i < j, w of recordings of several channels: the mean of the channels' correlations.

    v holds the channels one behind the other. A channel that is constant in a
    recording counts as 0. The mean is over all channels, or with live_only over
    those that are not constant in every recording. Centred channels of length 1,
    side by side, turn the mean into one product.
    """
    length = F.size("v") / F.lit(channels)
    units = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: centred_unit(_channel(F.col("v"), c, length))))
    rows = vectors.withColumn("v", A.doubles(F.col("v"))).select("id", units.alias("v"))
    n = channels
    if live_only:
        live = rows.agg(*[F.max(F.exists(_channel(F.col("v"), F.lit(c), length), lambda x: x != 0)).alias(f"c{c}") for c in range(channels)]).first()
        n = max(1, sum(bool(x) for x in live))
    return all_pairs(rows.select("id", F.transform("v", lambda x: x / F.lit(n**0.5)).alias("v")), "dot", least, block=block)


def multichannel_rbf(vectors: DataFrame, channels: int, least: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Edges i < j, w: the mean of the channels' RBF kernels, gamma of a channel 1 / (its length * its variance over all recordings)."""
    rows = vectors.select("id", A.doubles(F.col("v")).alias("v"))
    long = rows.select(F.posexplode("v").alias("p", "x"), F.size("v").alias("n"))
    by = long.groupBy(F.floor(F.col("p") * channels / F.col("n")).cast("int").alias("c")).agg(F.var_pop("x").alias("s"), F.max("n").alias("n"))
    scale = {r["c"]: channels / (r["n"] * r["s"]) if r["s"] > 0 else 1.0 for r in by.collect()}  # a row per channel
    return all_pairs(rows, "channels_rbf", least, gamma=[scale.get(c, 1.0) for c in range(channels)], block=block)
