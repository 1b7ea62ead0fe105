"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cortigraph.session import cut_lineage, shuffle_partitions


def partition_salts(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions an integer that Spark's hash puts there."""
    found: dict[int, int] = {}
    first, step = 0, 64 * n
    while len(found) < n:
        part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")
        for r in spark.range(first, first + step).select(F.col("id").cast("int").alias("v"), part).groupBy("p").agg(F.min("v").alias("v")).collect():
            found.setdefault(r.p, r.v)
        first += step
    return [found[p] for p in range(n)]


def pack(loads: list[tuple[object, int]], n: int) -> dict[object, int]:
    """Longest-first packing of items on n tasks: item to task."""
    heap = [(0, t) for t in range(n)]
    placed = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        total, t = heapq.heappop(heap)
        placed[item] = t
        heapq.heappush(heap, (total + load, t))
    return placed


class LoadPlan:
    """Where the rows of each key go.

    cells: hash cell of light keys to task salt. heavy: one row per shard of a
    heavy key (_key, _shard, _shards, _salt). loads: planned rows of each task.
    """

    def __init__(self, cells: DataFrame, heavy: DataFrame, n_cells: int, loads: list[int]):
        self.cells, self.heavy, self.n_cells, self.loads, self.tasks = cells, heavy, n_cells, loads, len(loads)


def plan_loads(df: DataFrame, key: str, tasks: int | None = None, pieces_per_task: int = 4, n_cells: int = 2048) -> LoadPlan:
    """Estimate the load of each key by its rows and pack the keys on tasks.

    A key above total / (tasks * pieces_per_task) rows is heavy and is split into
    shards of at most that load: there are at most tasks * pieces_per_task heavy
    keys, whatever the data. All other keys are packed by hash cell (n_cells of
    them). Only these two bounded lists reach the driver.
    """
    spark = df.sparkSession
    tasks = tasks or shuffle_partitions(spark)
    loads = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    cell = F.pmod(F.xxhash64("_key"), F.lit(n_cells)).cast("int")
    loads = loads.withColumn("_cell", cell).persist()
    try:
        total = loads.agg(F.sum("_n")).first()[0] or 0
        most = max(1, -(-total // (tasks * pieces_per_task)))
        big = loads.where(F.col("_n") > most).select("_key", "_n").collect()
        light = loads.where(F.col("_n") <= most).groupBy("_cell").agg(F.sum("_n").alias("_n")).collect()
    finally:
        loads.unpersist()
    items: list[tuple[object, int]] = [(("cell", r["_cell"]), r["_n"]) for r in light]
    shards = {r["_key"]: -(-r["_n"] // most) for r in big}
    for r in big:
        items += [(("key", r["_key"], s), -(-r["_n"] // shards[r["_key"]])) for s in range(shards[r["_key"]])]
    placed = pack(items, tasks)
    planned = [0] * tasks
    for item, load in items:
        planned[placed[item]] += load
    salt = partition_salts(spark, tasks)
    kind = df.schema[key].dataType.simpleString()
    cells = spark.createDataFrame([(k[1], salt[t]) for k, t in placed.items() if k[0] == "cell"], "_cell int, _salt int")
    heavy = spark.createDataFrame([(k[1], k[2], shards[k[1]], salt[t]) for k, t in placed.items() if k[0] == "key"], f"_key {kind}, _shard int, _shards int, _salt int")
    return LoadPlan(cells, heavy, n_cells, planned)


def _placed(df: DataFrame, key: str, shard: Column, plan: LoadPlan) -> DataFrame:
    """df with _shard and _salt; `shard` may use _shards, the shards of the row's key (null for light keys).

    Both lists are bounded by the plan's parameters (n_cells, tasks * pieces_per_task).
    """
    counts = F.broadcast(plan.heavy.groupBy("_key").agg(F.first("_shards").alias("_shards")))
    heavy = F.broadcast(plan.heavy.select(F.col("_key").alias("_hk"), F.col("_shard").alias("_hs"), F.col("_salt").alias("_hsalt")))
    cell = F.when(F.col("_shards").isNull(), F.pmod(F.xxhash64(key), F.lit(plan.n_cells)).cast("int"))
    rows = df.where(F.col(key).isNotNull()).join(counts, F.col(key) == F.col("_key"), "left").drop("_key")
    rows = rows.withColumn("_shard", shard).withColumn("_cell", cell)
    rows = rows.join(F.broadcast(plan.cells), "_cell", "left").join(heavy, (F.col(key) == F.col("_hk")) & (F.col("_shard") == F.col("_hs")), "left")
    return rows.withColumn("_salt", F.coalesce("_hsalt", "_salt")).drop("_hk", "_hs", "_hsalt", "_cell", "_shards")


def fragment_replicate(df: DataFrame, key: str, spread: list[str], side: DataFrame, side_key: str, plan: LoadPlan) -> DataFrame:
    """Rows and their matching side on the plan's tasks: _key, _shard, _salt, _row, _side.

    Rows of a heavy key are dealt over its shards by the hash of `spread` and the
    matching side is replicated to those shards only; what belongs to light keys
    goes where their cell was packed. Both travel in one exchange by _salt alone,
    whose partitions are the plan's tasks: of _row and _side (structs) one is
    null. A grouping or window by (_salt, _shard, _key) needs no further shuffle.
    Rows with a null key match nothing and are left out, and so are sides that no
    row needs.
    """
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shards"), F.lit(1)) - 1))
    one = df.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *[F.col(c).alias(f"_sp{i}") for i, c in enumerate(spread)])
    dealt = F.coalesce(F.pmod(F.xxhash64(*[f"_sp{i}" for i in range(len(spread))]), F.col("_shards")), F.lit(0)).cast("int")
    two = side.select(F.col(side_key).alias("_k"), F.struct(*[F.col(c) for c in side.columns]).alias("_side"))
    left = _placed(one, "_k", dealt, plan).select(F.col("_k").alias("_key"), "_shard", "_salt", "_row")
    right = _placed(two, "_k", copies, plan).where("_salt is not null").select(F.col("_k").alias("_key"), "_shard", "_salt", "_side")
    return left.unionByName(right, allowMissingColumns=True).repartition(plan.tasks, "_salt")


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int, spread: list[str], side: DataFrame, side_key: str, tasks: int | None = None) -> DataFrame:
    """The first k rows of each key by `order`, joined to the matching side.

    Each shard keeps its own first k on the task the plan packed it to, with the
    side that was replicated there; then the shards' winners of a key are merged:
    at most k rows per shard reach the merge. `order` must be total for ties to be
    defined, and equal rows count each. Of several side rows of a key the first by
    value is taken. Rows with a null key are left out; rows without a side get nulls;
    an empty table gives an empty result. All columns of df come out, then those of
    side, with `side_` before a name that df has, too.
    """
    df = cut_lineage(df)  # read for the loads and for the shards
    plan = plan_loads(df, key, tasks)
    both = fragment_replicate(df, key, spread, side, side_key, plan)
    own = "_"  # begins no column of df
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    n = {c: own + c for c in ("key", "shard", "salt", "side", "is_row", "found", "at", "rank")}
    values = both.select(*[F.col(f"_{c}").alias(n[c]) for c in ("key", "shard", "salt", "side")], F.col("_row").isNotNull().alias(n["is_row"]), "_row.*")
    shard = Window.partitionBy(n["salt"], n["shard"], n["key"]).orderBy(n["is_row"], n["side"], *order)
    upto = shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The side comes before the rows; only rows are counted.
    placed = values.withColumn(n["found"], F.first(n["side"], ignorenulls=True).over(upto)).withColumn(n["at"], F.count_if(n["is_row"]).over(upto))
    winners = placed.where((F.col(n["at"]) <= k) & F.col(n["is_row"])).select(n["key"], n["found"], *df.columns)
    whole = Window.partitionBy(n["key"]).orderBy(*order)
    best = winners.withColumn(n["rank"], F.row_number().over(whole)).where(F.col(n["rank"]) <= k)
    taken = {c.lower() for c in df.columns}
    names = []
    for c in side.columns:
        name = c
        while name.lower() in taken:
            name = "side_" + name
        taken.add(name.lower())
        names.append(name)
    return best.select(*df.columns, *[F.col(f"{n['found']}.{c}").alias(name) for c, name in zip(side.columns, names)])
