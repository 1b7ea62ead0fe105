"""Splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortigraph.functions.ranking import spread_rank
from cortigraph.session import cut_lineage

#: Bits of a subset-sum set; totals above it are searched in larger units and filled up.
BITS = 1 << 20


def _key(c: str) -> F.Column:
    """Order of nodes: by hash, then id, so that it says nothing of the graph."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """u, v with u before v; loops and repeats left out."""
    first = _key(a) < _key(b)
    pairs = edges.where(F.col(a) != F.col(b)).select(F.when(first, F.col(a)).otherwise(F.col(b)).alias("u"), F.when(first, F.col(b)).otherwise(F.col(a)).alias("v"))
    return pairs.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of a graph: node, component (a number that all its nodes share).

    edges: u, v (bigint), any direction, repeats and loops allowed. A node appears
    if it is in an edge. Rows with a null end and other columns are ignored; no edges, no rows.

    Nodes are ordered by hash: in a random order every other node or so comes
    after a neighbour, whatever the shape of the graph, so rounds grow with the
    logarithm of its size. Each round hooks every such node to its first
    neighbour, jumps two steps along the new parents (shortcutting) and
    relabels the edges; edges within a tree disappear. The parents found are then followed to the root by
    pointer jumping. All of it is joins of tables; a round is written to the
    checkpoint folder, and only counts reach the driver.
    """
    given = edges.where("u is not null and v is not null").select("u", "v")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    live = cut_lineage(_oriented(given, "u", "v"))
    forest = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        hooks = live.groupBy(F.col("v").alias("node")).agg(F.min(_key("u")).alias("k")).select("node", F.col("k.id").alias("parent"))
        for _ in range(2):
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hooks = hooks.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"))
        hooks = cut_lineage(hooks)
        forest.append(hooks)
        one = hooks.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        two = hooks.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = live.join(one, "u", "left").join(two, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        live = cut_lineage(_oriented(moved, "a", "b"))
    else:
        raise RuntimeError(f"components: edges left after {max_rounds} rounds")
    parents = nodes.select("node", F.col("node").alias("parent"))
    for f in forest:
        parents = parents.unionAll(f)
    parents = cut_lineage(parents.groupBy("node").agg(F.min(_key("parent")).alias("k")).select("node", F.col("k.id").alias("parent")))
    for _ in range(max_rounds):
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = cut_lineage(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            break
    return parents.select("node", F.col("parent").alias("component"))


def number_names(names: DataFrame) -> DataFrame:
    """name, node: a distinct bigint for each distinct name, fixed once written."""
    return cut_lineage(names.where("name is not null").select("name").distinct().withColumn("node", F.monotonically_increasing_id()))


def closest_subset(sizes: dict[int, int], target: int, bits: int = BITS) -> dict[int, int]:
    """How many groups of each size to take for a total closest to target.

    Subset-sum over size multiplicities: bit t of a set says that total t can be
    made; a multiplicity m enters as 1, 2, 4, ... copies, and of each total only
    the item that first made it is kept, which leads back to the choice. Totals
    above `bits` are first searched in units, then filled up with what still fits,
    largest first: exact where there are enough groups of one record, else within
    half of the smallest group left.
    """
    if target <= 0:
        return {}
    unit = -(-target // bits)
    items = []
    for size, m in sorted(sizes.items(), reverse=True):
        if size // unit < 1:
            continue
        part = 1
        while m > 0:
            take = min(part, m)
            items.append((size, take))
            m -= take
            part *= 2
    goal = target // unit
    length = 2 * goal + 2
    limit = (1 << length) - 1
    weight = lambda size, copies: -(-size // unit) * copies
    first = np.full(length, -1, np.int32)
    reach = 1
    for i, (size, copies) in enumerate(items):
        w = weight(size, copies)
        if w < length and (fresh := reach << w & limit & ~reach):
            made = np.unpackbits(np.frombuffer(fresh.to_bytes(-(-length // 8), "little"), np.uint8), bitorder="little")[:length]
            first[made.astype(bool)] = i
            reach |= fresh
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> (goal + 1)
    t = below
    if above and unit == 1:
        up = goal + 1 + (above & -above).bit_length() - 1
        t = up if up - goal < goal - below else below
    taken: dict[int, int] = {}
    while t:
        size, copies = items[first[t]]
        t -= weight(size, copies)
        taken[size] = taken.get(size, 0) + copies
    left = target - sum(s * n for s, n in taken.items())
    for size in sorted(sizes, reverse=True):
        more = min(sizes[size] - taken.get(size, 0), max(0, left) // size)
        if more > 0:
            taken[size] = taken.get(size, 0) + more
            left -= more * size
    rest = [s for s in sizes if sizes[s] > taken.get(s, 0) and 0 < s < 2 * left]
    if rest:
        taken[min(rest)] = taken.get(min(rest), 0) + 1
    return taken


def split_sizes(sizes: dict[int, int], shares: dict[str, float], rest: str) -> dict[str, dict[int, int]]:
    """Groups of each size for every split but `rest`, the smallest share first."""
    total = sum(s * n for s, n in sizes.items())
    left, out = dict(sizes), {}
    for name, share in sorted(shares.items(), key=lambda x: (x[1], x[0])):
        if name == rest:
            continue
        out[name] = closest_subset(left, round(total * share))
        left = {s: n - out[name].get(s, 0) for s, n in left.items() if n > out[name].get(s, 0)}
    return out


def split_groups(groups: DataFrame, shares: dict[str, float] | None = None, rest: str = "train", seed: int = 5) -> DataFrame:
    """group, size to group, size, split, with split totals closest to the shares.

    Other columns are ignored, a null group is a group, an empty table gives no rows.

    Only the histogram of sizes reaches the driver: at most sqrt(2 * records)
    different sizes. Which groups of a size go where is a seeded shuffle.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    sizes = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts, at = [], {s: 0 for s in sizes}
    for name, taken in split_sizes(sizes, shares, rest).items():
        for size, n in taken.items():
            cuts.append((size, at[size] + 1, at[size] + n, name))
            at[size] += n
    table = groups.sparkSession.createDataFrame(cuts, "_size bigint, _from bigint, _to bigint, _split string")
    band = F.shiftrightunsigned(F.xxhash64("group", F.lit(seed)), 54).cast("int")
    ranked = spread_rank(groups, ["size"], band, [F.xxhash64("group", F.lit(seed)), F.col("group")], "_rank")
    on = (F.col("size") == F.col("_size")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    return ranked.join(table, on, "left").select("group", "size", F.coalesce("_split", F.lit(rest)).alias("split"))
