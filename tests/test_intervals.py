import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cortigraph.operators.intervals import periods_and_gaps

SCHEMA = "k string, s bigint, e bigint, start_ms string"


def brute(rows):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s)
        merged = []
        for s, e in iv:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, block):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", block).collect())


def test_overlap_nest_touch_gap_null_reversed_repeat(spark):
    rows = [("a", 0, 10), ("a", 5, 8), ("a", 10, 12), ("a", 20, 30), ("a", 20, 30), ("a", 40, 35), ("a", 50, 50), (None, 1, 2), ("a", None, 9), ("a", 3, None), ("b", -70, -5)]
    assert run(spark, rows, 16) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 16) == []


def test_one_entity_over_many_blocks(spark):
    rng = random.Random(1)
    rows = [("hot", s := rng.randrange(-4000, 4000), s + rng.choice([1, 5, 40, 900])) for _ in range(400)] + [("cold", 1, 2)]
    assert run(spark, rows, 50) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-60, 60), st.integers(-60, 60)), max_size=25))
def test_like_brute_force(spark, rows):
    assert run(spark, rows, 7) == brute(rows)


def test_clashing_extra_columns(spark):
    rows = [("a", 0, 10), ("a", 5, 20), ("a", 30, 40), ("a", None, 50), (None, 1, 2)]
    df = spark.createDataFrame(rows, "f string, s bigint, e bigint")
    clash = df
    for c in ("kind", "start_ms", "end_ms", "_k0", "_s", "_e", "session_window", "_block"):
        clash = clash.withColumn(c, F.lit("extra"))
    got = lambda d: sorted(periods_and_gaps(d, ["f"], "s", "e").collect())
    assert got(clash) == got(df) == [("a", "gap", 20, 30), ("a", "period", 0, 20), ("a", "period", 30, 40)]
