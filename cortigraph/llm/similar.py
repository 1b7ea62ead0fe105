"""Most similar vectors by block products of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortigraph.session import cut_lineage

#: Rows of one side of a tile.
BLOCK = 2048
#: Blocks of exact=True, unless they would have more than LARGEST rows; a block of the product that stays in the cache, and the components its first bound is made of.
BLOCKS, LARGEST = 12, 262_144
PIECE, PREFIX = (256, 1024), 23
#: Heavy blocks are listed for a broadcast up to this count; beyond it the list is joined by shuffle.
HEAVY_BROADCAST = 200_000


def usable(df: DataFrame, id_column: str, vector: str, dim: int) -> DataFrame:
    """id and v (array<double>) of the rows with `dim` finite components, not all 0."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(id_column).isNotNull() & (F.size(x) == dim) & finite & F.exists(x, lambda c: c != 0)).select(F.col(id_column).alias("id"), x.alias("v"))


def _unit(column: pa.Array, dim: int, centre: bool) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if centre:
        x = x - x.mean(axis=1, keepdims=True)
    n = np.linalg.norm(x / (s := np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)), axis=1, keepdims=True) * s
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what the rounding left out."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.linalg.norm(x - q * scale[:, None], axis=1)
    return q, scale.astype(np.float32), (rest * 1.0001 + 1e-7).astype(np.float32)


def tile(q1, s1, e1, q2, s2, e2) -> tuple[np.ndarray, np.ndarray]:
    """Products of all rows and the most by which each can be off.

    Sums of int8 products stay below 2**24 up to 1024 dimensions, so the float32
    product is the exact integer. With x = s q + r and unit x, |xy - ss'qq'| is at
    most e'(1 + e) + e(1 + e') + ee'.
    """
    dots = (q1.astype(np.float32) @ q2.astype(np.float32).T) * s1[:, None] * s2[None, :]
    bound = e1[:, None] + e2[None, :] + 3 * e1[:, None] * e2[None, :] + 1e-6
    return dots, bound


def hash_plan(n: int, dim: int, occupancy: int) -> list[int]:
    """Dimensions of the chained cross-polytope hashes: about n / occupancy cells."""
    cells, plan = n / occupancy, []
    while cells > 1.5:
        d = int(min(dim, max(1, round(cells / 2))))
        plan.append(d)
        cells /= 2 * d
    return plan


@cache
def collision(d: int, dim: int, cosine: float, draws: int = 20_000) -> float:
    """Probability that two vectors at this cosine have the same nearest signed axis among d random ones.

    It depends on the angle alone, as the axes are rotated at random, so it holds
    for every pair of any data; estimated from `draws` random pairs.
    """
    rng = np.random.default_rng(1)
    a = rng.normal(size=(draws, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(draws, dim))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b *= math.sqrt(max(0.0, 1 - cosine * cosine)) / np.linalg.norm(b, axis=1, keepdims=True)
    a, b, at = a[:, :d], cosine * a[:, :d] + b[:, :d], np.arange(draws)
    i, j = np.abs(a).argmax(axis=1), np.abs(b).argmax(axis=1)
    return float(((i == j) & ((a[at, i] > 0) == (b[at, j] > 0))).mean())


def tables_for(plan: list[int], dim: int, least: float, recall: float) -> int:
    """Tables in which a pair at the limit shares a cell at least once with probability `recall`."""
    p = math.prod(collision(d, dim, min(1.0, least)) for d in plan)
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _rotations(dim: int, plan: list[int], tables: int, seed: int) -> list[list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [[np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :d].astype(np.float32) for d in plan] for _ in range(tables)]


def _cells(x: np.ndarray, rotations: list[list[np.ndarray]]) -> np.ndarray:
    """Cell of each row in each table: the signed axis nearest to the rotated row."""
    out = np.zeros((len(x), len(rotations)), np.int64)
    x = x.astype(np.float32)
    at = np.arange(len(x))
    for t, chain in enumerate(rotations):
        code = np.zeros(len(x), np.int64)
        for r in chain:
            y = x @ r
            j = np.abs(y).argmax(axis=1)
            code = code * (2 * r.shape[1]) + 2 * j + (y[at, j] > 0)
        out[:, t] = code * len(rotations) + t
    return out


def _packed(x: np.ndarray) -> tuple[pa.Array, int]:
    q, s, e = quantise(x)
    width = q.shape[1] + 8
    raw = np.concatenate([q.view(np.uint8), s[:, None].view(np.uint8).reshape(len(q), 4), e[:, None].view(np.uint8).reshape(len(q), 4)], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary()), width


def _unpacked(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = dim + 8
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]) if len(column) else 0
    raw = np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, first).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)
    tail = np.ascontiguousarray(raw[:, dim:])
    return raw[:, :dim].view(np.int8), tail[:, :4].copy().view(np.float32)[:, 0], tail[:, 4:].copy().view(np.float32)[:, 0]


def similar_pairs(vectors: DataFrame, dim: int, least: float, recall: float = 0.97, occupancy: int = 1536, block: int = BLOCK, seed: int = 20310, centre: bool = False, exact: bool = False) -> DataFrame:
    """All pairs of different rows with a cosine of at least `least`: lo, hi, cosine.

    `vectors` has id (bigint, unique) and v (arrays of `dim` usable numbers, see
    `usable`); centre=True compares by Pearson correlation instead, where a
    constant vector matches nothing. Other columns are ignored; an empty table gives no pairs.

    Rows are put into cells of cross-polytope hashes, about `occupancy` rows to a
    cell whatever their number, in as many tables as a pair at exactly `least`
    needs to meet with probability `recall` (more similar pairs meet more often);
    the tables grow with about the sixth root of the rows at a limit of 0.9. A cell
    of more than `block` rows is cut into blocks and every pair of its blocks
    becomes a tile of its own, so no cell is one task's work and none is capped. A
    tile multiplies int8 rows; a pair whose upper bound stays below `least` is
    dropped for certain, the rest is recomputed in double from the original
    vectors. The only loss is a pair that shares no cell in any table; exact=True
    has none: every pair of rows is compared, see `_every_pair`.
    """
    spark = vectors.sparkSession
    # Read for the count, the cells, the tiles and the survivors: written once.
    vectors = cut_lineage(vectors.select("id", "v"))
    if exact:
        return _recomputed(_every_pair(vectors, dim, least, block, centre, seed), vectors, centre).where(F.col("cosine") >= least)
    plan = hash_plan(vectors.count(), dim, occupancy)
    tables = tables_for(plan, dim, least, recall)
    rotations = spark.sparkContext.broadcast(_rotations(dim, plan, tables, seed))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = _cells(_unit(b.column(0), dim, centre), rotations.value).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c)], names=["cell"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column(1), dim, centre)
            c = _cells(x, rotations.value)
            packed, _ = _packed(x)
            rep = pa.array(np.repeat(np.arange(len(x)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), b.column(0).take(rep), packed.take(rep)], names=["cell", "id", "q"])

    counts = vectors.select("v").mapInArrow(codes, "cell bigint").groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    heavy = counts.where(F.col("_n") > block).select(F.col("cell").alias("_cell"), F.ceil(F.col("_n") / block).cast("int").alias("_nb")).persist()
    small = heavy.count() <= HEAVY_BROADCAST
    rows = vectors.select("id", "v").mapInArrow(hashed, "cell bigint, id bigint, q binary")
    # Blocks a, b of a cell meet in tile (min, max); a light cell is the single tile (0, 0).
    own = F.pmod(F.xxhash64("id"), F.coalesce("_nb", F.lit(1))).cast("int")
    tiles = (
        rows.join(F.broadcast(heavy) if small else heavy, F.col("cell") == F.col("_cell"), "left")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_nb"), F.lit(1)) - 1)))
        .select("cell", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"), F.col("_own").alias("side"), "id", "q")
        .repartition("cell", "a", "b")
        .sortWithinPartitions("cell", "a", "b")
    )

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def found(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
            table = table.combine_chunks()
            ids = table.column("id").to_numpy()
            side = table.column("side").to_numpy()
            q, s, e = _unpacked(table.column("q").chunk(0), dim)
            lo, hi = [], []
            for x, y in zip(edges[:-1], edges[1:]):
                if y - x < 2:
                    continue
                k = side[x:y] == side[x]
                m, o = (slice(x, y), slice(x, y)) if k.all() else (np.flatnonzero(k) + x, np.flatnonzero(~k) + x)
                dots, bound = tile(q[m], s[m], e[m], q[o], s[o], e[o])
                r, c = np.nonzero(dots + bound >= least)
                i, j = ids[m][r], ids[o][c]
                if k.all():
                    up = i < j
                    i, j = i[up], j[up]
                lo.append(np.minimum(i, j))
                hi.append(np.maximum(i, j))
            cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([cat(lo), cat(hi)], names=["lo", "hi"])

        for b in batches:
            kept.append(b)
            if sum(x.num_rows for x in kept) < 8192:
                continue
            table = pa.Table.from_batches(kept)
            key = np.stack([table.column(c).to_numpy() for c in ("cell", "a", "b")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            if len(edges) > 1:  # the last tile may go on in the next batch; a tile has about 2 * block rows
                yield found(table.slice(0, edges[-1]), edges)
            kept = table.slice(edges[-1]).to_batches()
        if kept and sum(x.num_rows for x in kept):
            table = pa.Table.from_batches(kept)
            key = np.stack([table.column(c).to_numpy() for c in ("cell", "a", "b")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            yield found(table, edges)

    pairs = tiles.mapInArrow(products, "lo bigint, hi bigint").distinct()
    return _recomputed(pairs, vectors, centre).where(F.col("cosine") >= least)


def candidates(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (row of x, row of y) whose product may reach `least`, piece by piece; x and y are float32, lengths are about 1.

    A product is at most that of the first components plus that of the lengths of
    the others, which is one product of PREFIX + 1 columns. Where it leaves few pairs these
    are multiplied out one by one, else the piece is multiplied as a whole.
    """
    cut = lambda v: np.ascontiguousarray(np.column_stack([v[:, :PREFIX], np.linalg.norm(v[:, PREFIX:], axis=1) * np.float32(1 + 1e-5)]))
    short = x.shape[1] > PREFIX + 1
    u, w = (cut(x), cut(y)) if short else (x, y)
    limit = np.float32(least - 1e-5)
    for a in range(0, len(x), PIECE[0]):
        for b in range(0, len(y), PIECE[1]):
            over = u[a : a + PIECE[0]] @ w[b : b + PIECE[1]].T >= limit
            at = np.flatnonzero(over.ravel())
            if short and len(at) > 0.05 * over.size:
                at = np.flatnonzero((x[a : a + PIECE[0]] @ y[b : b + PIECE[1]].T >= limit).ravel())
            r, c = np.divmod(at, over.shape[1])
            r, c = r + a, c + b
            if short and len(at):
                kept = np.einsum("ij,ij->i", x[r], y[c]) >= limit
                r, c = r[kept], c[kept]
            if len(r):
                yield r, c


def _every_pair(vectors: DataFrame, dim: int, least: float, block: int, centre: bool, seed: int) -> DataFrame:
    """lo, hi of all pairs whose cosine may reach `least`, each once, and no pair that does is missing.

    The rows are spread over blocks and each pair of blocks is a tile of its own. The
    number of blocks is fixed up to BLOCKS * LARGEST rows, so that a row travels
    BLOCKS times at most however many rows there are; the products are quadratic.
    Rows are rotated at random first, so that no arrangement of the components makes
    the bound of their first ones useless.
    """
    n = vectors.count()
    nb = max(1, min(-(-n // block), max(BLOCKS, -(-n // LARGEST))))
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(_unit(b.column(1), dim, centre) @ turn)[0]], names=["id", "q"])

    def products(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, ids = t.column("side").to_numpy(), t.column("id").to_numpy()
        q, s, e = _unpacked(t.column("q").chunk(0), dim) if t.num_rows else _unpacked(pa.array([], pa.binary()), dim)
        x = q.astype(np.float32) * s[:, None]
        one, two = np.flatnonzero(side == t.column("a")[0].as_py()), np.flatnonzero(side == t.column("b")[0].as_py())
        if not len(one) or not len(two):
            return pa.table({"lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        f, g = float(e[one].max()), float(e[two].max())
        own, lo, hi = t.column("a")[0].as_py() == t.column("b")[0].as_py(), [], []
        for r, c in candidates(x[one], x[two], least - (f + g + 3 * f * g + 1e-6)):
            i, j = ids[one[r]], ids[two[c]]
            if own:
                i, j = i[i < j], j[i < j]
            lo.append(np.minimum(i, j))
            hi.append(np.maximum(i, j))
        cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64))
        return pa.table({"lo": cat(lo), "hi": cat(hi)})

    rows = vectors.mapInArrow(packed, "id bigint, q binary").withColumn("side", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int"))
    tiles = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).select(F.least("side", "_other").alias("a"), F.greatest("side", "_other").alias("b"), "side", "id", "q")
    # More partitions than tiles, so that a task seldom gets two of them.
    return tiles.repartition(2 * nb * (nb + 1), "a", "b").groupBy("a", "b").applyInArrow(products, "lo bigint, hi bigint")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _recomputed(pairs: DataFrame, vectors: DataFrame, centre: bool) -> DataFrame:
    """lo, hi, cosine in double from the original vectors; survivors only. Few pairs are sent to the vectors, not these to them."""
    pairs = cut_lineage(pairs)
    if pairs.count() <= HEAVY_BROADCAST:
        pairs = F.broadcast(pairs)
        first = vectors.select(F.col("id").alias("lo"), F.col("v").alias("v1")).join(pairs, "lo").select("lo", "hi", "v1")
        both = first.join(vectors.select(F.col("id").alias("hi"), F.col("v").alias("v2")).join(pairs, "hi").select("lo", "hi", "v2"), ["lo", "hi"])
        return _cosines(both, centre)
    one = vectors.select(F.col("id").alias("lo"), F.col("v").alias("v1"))
    two = vectors.select(F.col("id").alias("hi"), F.col("v").alias("v2"))
    return _cosines(pairs.join(one, "lo").join(two, "hi"), centre)


def _cosines(both: DataFrame, centre: bool) -> DataFrame:
    for c in ("v1", "v2"):
        if centre:
            mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(c)
            both = both.withColumn("_m", mean).withColumn(c, F.transform(c, lambda x: x.cast("double") - F.col("_m"))).drop("_m")
    norm = F.sqrt(_dot("v1", "v1")) * F.sqrt(_dot("v2", "v2"))
    return both.select("lo", "hi", F.try_divide(_dot("v1", "v2"), norm).alias("cosine"))


def nearest(queries: DataFrame, vectors: DataFrame, dim: int, k: int, centre: bool = False, block: int = 8192) -> DataFrame:
    """The k most similar rows of `vectors` for each query: id, other, cosine, rank.

    Every query meets every row, in tiles of two blocks: int8 products give each
    pair a lower and an upper bound, a query keeps the rows of a tile whose upper
    bound reaches the k-th best lower bound there, and these are recomputed in
    double and merged by a heap into the tile's first k. The tiles' winners are
    ranked by (cosine desc, other asc). Exact. A query doesn't match its own id;
    fewer than k rows come out where fewer exist; empty tables give no rows and
    other columns are ignored.
    """
    n = max(1, vectors.count())
    nb = -(-n // block)
    m = -(-max(1, queries.count()) // block)
    spread = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    left = queries.select("id", "v").withColumn("qb", spread(m)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = vectors.select("id", "v").withColumn("vb", spread(nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            x = _unit(a.column("v").combine_chunks(), dim, centre)
            y = _unit(b.column("v").combine_chunks(), dim, centre)
            qi, vi = a.column("id").to_numpy(), b.column("id").to_numpy()
            q2 = quantise(y)
            for at in range(0, len(x), 512):
                xs = x[at : at + 512]
                dots, bound = tile(*quantise(xs), *q2)
                same = qi[at : at + 512, None] == vi[None, :]
                low = np.where(same, -9, dots - bound)
                kth = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, min(k, low.shape[1]) - 1]
                for r in range(len(xs)):
                    c = np.flatnonzero((dots[r] + bound[r] >= kth[r]) & ~same[r])
                    exact = y[c] @ xs[r]
                    for cosine, other in heapq.nsmallest(k, zip(-exact, vi[c])):
                        out[0].append(qi[at + r])
                        out[1].append(other)
                        out[2].append(-cosine)
        return pa.table({"id": pa.array(out[0], pa.int64()), "other": pa.array(out[1], pa.int64()), "cosine": pa.array(out[2], pa.float64())})

    winners = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(best, "id bigint, other bigint, cosine double")
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("other"))
    return winners.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
