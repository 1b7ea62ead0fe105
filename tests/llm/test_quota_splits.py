import itertools
import random

from pyspark.sql import functions as F

from cortigraph.llm import quota, splits


def test_quota_counts_deficits_and_repeats(spark):
    items = spark.range(3000).select(F.col("id").cast("string").alias("w"), F.when(F.col("id") < 2500, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 9)).alias("p"), (F.col("id") % 2).cast("int").alias("label"))
    rows = [(1, "hot", 0, 400), (1, "hot", 1, 3), (2, "hot", 0, 1250), (2, "p1", 1, 999), (3, "none", 0, 5), (3, "p2", 0, 0), (4, None, 0, 5), (4, "p3", 1, None)]
    needs = spark.createDataFrame(rows, "plan bigint, p string, label int, needed bigint")
    sample, report = quota.quota_sample(items, "w", ["p", "label"], needs, "plan", "needed")
    have = {(r["p"], r["label"]): r["n"] for r in items.groupBy("p", "label").agg(F.count("*").alias("n")).collect()}
    for r in report.collect():
        want = min(r["needed"] or 0, have.get((r["p"], r["label"]), 0))
        assert r["drawn"] == want, r
        if r["needed"]:
            assert r["deficit"] == r["needed"] - want
    assert sample.count() == sample.distinct().count() == 400 + 3 + 1250 + have["p1", 1]
    assert sample.join(items.select("w", F.col("p").alias("q"), F.col("label").alias("l")), "w").where("p <> q or label <> l").count() == 0
    empty, none = quota.quota_sample(items.limit(0), "w", ["p", "label"], needs.limit(0), "plan", "needed")
    assert empty.count() == 0 and none.count() == 0


def test_short_acceptance_is_filled(spark):
    items = spark.range(2000).select(F.col("id").alias("w"), F.lit("a").alias("p"))
    needs = spark.createDataFrame([(i, "a", 100) for i in range(20)], "plan bigint, p string, needed bigint")
    sample, _ = quota.quota_sample(items, "w", ["p"], needs, "plan", "needed", sigmas=-3.0)
    assert {r["count"] for r in sample.groupBy("plan").count().collect()} == {100}


def test_needs_round_half_up(spark):
    plans = spark.createDataFrame([(1, 5, 1, 1, 0), (2, None, 1, 1, 0), (3, 4, 0, 0, 2), (4, 10, 3, 1, None)], "plan_id bigint, n_requested int, preictal_count int, interictal_count int, min_per_category int")
    targets = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (1, "b", -1.0), (1, None, 1.0), (3, "a", 1.0), (4, "a", 1.0), (4, "b", 3.0)], "plan_id bigint, patient_id string, weight double")
    got = {(r["plan_id"], r["patient_id"], r["label"]): r["needed"] for r in quota.needs_of_plans(plans, targets).collect()}
    assert got == {(1, "a", 0): 3, (1, "a", 1): 3, (3, "a", 0): 2, (3, "a", 1): 2, (4, "a", 0): 1, (4, "a", 1): 2, (4, "b", 0): 2, (4, "b", 1): 6}


def test_components_like_union_find(spark):
    rng = random.Random(8)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [(0, i) for i in range(1, 50)] + [(7, 7), (None, 3)]):
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None and b is not None:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
        assert set(got) == set(parent)
        assert len({(root(x), got[x]) for x in got}) == len({root(x) for x in got}) == len(set(got.values()))
    assert splits.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_closest_totals():
    rng = random.Random(1)
    for _ in range(40):
        sizes = {rng.randint(1, 30): rng.randint(1, 2) for _ in range(5)}
        flat = [s for s, n in sizes.items() for _ in range(n)]
        target = rng.randint(1, sum(flat))
        best = min(abs(sum(c) - target) for k in range(len(flat) + 1) for c in itertools.combinations(flat, k))
        taken = splits.closest_subset(sizes, target)
        assert all(taken[s] <= sizes[s] for s in taken)
        assert abs(sum(s * n for s, n in taken.items()) - target) == best
    big = splits.closest_subset({1: 10**7, 999_983: 40}, 12_345_678, bits=1 << 16)
    assert sum(s * n for s, n in big.items()) == 12_345_678


def test_split_totals(spark):
    groups = spark.range(500).select(F.col("id").alias("group"), (F.col("id") % 13 + 1).alias("size"))
    by = {r["split"]: r["n"] for r in splits.split_groups(groups).groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(by.values())
    assert by["test"] == by["validation"] == round(total * 0.1)
    assert splits.split_groups(groups.limit(0)).count() == 0
