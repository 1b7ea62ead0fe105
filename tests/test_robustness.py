import numpy as np
import pytest
from pyspark.sql import functions as F

from cortigraph.functions import arrays as A
from cortigraph.functions import iir, xxhash
from cortigraph.operators import grouped, noise, robustness
from cortigraph.plans import pipeline
from cortigraph.plans.pipeline import CONDITIONS, conditions_of


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(i * 7, i % 2, i % 5, (rng.normal(size=64) + (i % 2) * np.linspace(0, 0.4, 64)).tolist()) for i in range(400)]
    data += [(7 * i, y, f, v) for i, (_, y, f, v) in enumerate(data[:40], 400)]  # equal signals
    return spark.createDataFrame(data, "id bigint, label int, fold int, v array<double>").repartition(5)


def test_normal_numbers_like_the_expression(spark):
    ids = np.array([0, 5, -3, 1 << 40])
    df = spark.createDataFrame([(int(i), [0.0] * 9) for i in ids], "id bigint, v array<double>")
    got = {r["id"]: r["z"] for r in df.select("id", F.transform("v", lambda x, i: A.normal_hash(F.lit(42), F.col("id"), i)).alias("z")).collect()}
    assert np.allclose(xxhash.normal(42, ids, 9), [got[i] for i in ids], rtol=1e-12, atol=1e-14)


def test_variants_like_the_operators(spark, rows):
    rows = rows.unionAll(spark.createDataFrame([(None, 1, 0, np.linspace(-2, 1, 64).tolist())], rows.schema))
    x = {r["id"]: r for r in noise.places(rows, "id", 64, 64.0).collect()}
    ids = sorted(x, key=lambda i: -1 if i is None else i)
    made = noise.variants(np.array([x[i]["v"] for i in ids]), np.ma.masked_values([-1 if i is None else i for i in ids], -1), np.array([x[i]["_blinks"] for i in ids]), conditions_of(CONDITIONS), 64.0)
    for (kind, level), got in zip(conditions_of(CONDITIONS), made):
        want = {r["id"]: r["v"] for r in noise.apply(rows, "v", "id", kind, level or None, 64.0).collect()}
        assert np.allclose(got, [want[i] for i in ids], rtol=1e-10, atol=1e-12), (kind, level)


def test_light_rows_like_all_rows(spark, tmp_path):
    """Rows without an id keep their own signals; the type of the signals stays."""
    rng = np.random.default_rng(1)
    data = [(None if i > 290 else i // 2, f"P {i % 3}", i % 2, rng.normal(size=64).tolist(), i) for i in range(300)]
    spark.createDataFrame(data, "sample_id bigint, patient_id string, label int, features array<float>, built_at int").write.parquet(f"{tmp_path}/feature_bundle.parquet")
    light, rows = pipeline._light_rows(spark, str(tmp_path)), pipeline._rows(spark, str(tmp_path))
    got, want = ({(r["id"], r["label"], tuple(r["v"])): r["fold"] for r in d.collect()} for d in (light, rows))
    assert light.schema["v"].dataType.simpleString() == "array<float>" and got.keys() == want.keys() and len(got) == 155
    assert all(got[k] == want[k] for k in got if k[0] is not None) and pipeline.noise_robustness(spark, str(tmp_path)).count() == 22


def test_metrics_like_those_of_written_rows(rows):
    conditions = conditions_of(CONDITIONS, "clean, awgn:5, emg_burst:severe")
    noisy = None
    for kind, level in conditions:
        part = noise.apply(rows, "v", "id", kind, level or None, 64.0).select(F.lit(f"{kind}:{level}".rstrip(":")).alias("condition"), "id", "label", "fold", "v")
        noisy = part if noisy is None else noisy.unionByName(part)
    models = grouped.fold_models(grouped.moments(noisy, ["condition", "fold"], "v", "label", 64), ["condition"], "fold", {"all": [(1, 64)]}, 64).localCheckpoint()
    same = grouped.predicted(noisy, models, ["condition", "fold"], "v").withColumn("protocol", F.lit("noisy_to_noisy"))
    moved = grouped.predicted(noisy, models.where("condition = 'clean'").drop("condition"), ["fold"], "v").withColumn("protocol", F.lit("clean_to_noisy"))
    want = {(r["protocol"], r["condition"]): r.asDict() for r in grouped.group_metrics(same.unionByName(moved), ["protocol", "condition"], "label").collect()}
    ready = robustness.by_window(noise.places(rows, "id", 64, 64.0), "id")
    mine = grouped.fold_models(robustness.moments(ready, conditions, 64.0, 64), ["condition"], "fold", {"all": [(1, 64)]}, 64)
    got = {(r["protocol"], r["condition"]): r.asDict() for r in robustness.metrics(ready, mine, conditions, 64.0, 64).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k, r in want.items():
        assert list(got[k]) == list(r) and all(got[k][c] == pytest.approx(r[c], abs=1e-9) for c in r if c not in ("protocol", "condition"))
    none = ready.limit(0)
    assert robustness.metrics(none, mine, conditions, 64.0, 64).count() == 0 == robustness.moments(none, conditions, 64.0, 64).count()


def test_sums_of_pieces_across_batches():
    """Equal scores that stand in two batches, a constant score and scores that are no number."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 9, 300) / 10
    order = np.argsort(s, kind="stable")
    row = [np.zeros(300, np.int32), np.zeros(300, np.int32), s[order], y[order], 1 - y[order]]
    row = [np.concatenate([c, e]) for c, e in zip(row, ([0, 0], [robustness.SIDE] * 2, [np.nan] * 2, [1, 0], [0, 1]))]
    batches = [pa.record_batch([pa.array(c[a : a + 7]) for c in row], names=list("abcde")) for a in range(0, 302, 7)]
    got = {r["piece"]: r for b in robustness._pieces(iter(batches)) for r in b.to_pylist()}
    pos, neg = s[y == 1], s[y == 0]
    assert got[0]["u"] == sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) and (got[0]["p"], got[0]["q1"]) == (len(pos), (neg >= 0.5).sum())
    assert [got[robustness.SIDE][k] for k in ("p", "q", "p1", "q1", "u")] == [1, 1, 1, 1, 0.0]


def test_bursts_of_many_windows_run_through_the_filter_by_length(monkeypatch):
    """A filter run of its own for each burst took most of the time of noise_robustness."""
    one = {w: noise.bursts(42, w, 64, 64.0) for w in range(50)}
    runs, both_ways = [], iir.both_ways
    monkeypatch.setattr(iir, "both_ways", lambda *a: runs.append(1) or both_ways(*a))
    many = noise.bursts_of(42, range(2000), 64, 64.0)
    assert len(runs) <= 27 and len(many) == 2000
    for w, found in one.items():
        assert [(a[0], *a[2:]) for a in found] == [(b[0], *b[2:]) for b in many[w]] and all(np.array_equal(a[1], b[1]) for a, b in zip(found, many[w]))
