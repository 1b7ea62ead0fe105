import numpy as np
import pytest

from cortigraph.llm import similar


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<float>")


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 64))
    for i in range(0, 300, 3):
        x[i + 1] = x[i] * rng.choice([1e-3, 1, 50]) + rng.normal(size=64) * np.linalg.norm(x[i]) * 0.02 * rng.choice([0, 1]) / 8
    return x


def brute(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    r, c = np.nonzero(np.triu(u @ u.T, 1) >= least)
    return set(zip(r.tolist(), c.tolist()))


@pytest.mark.parametrize("block", [2048, 40])
def test_pairs_at_recall(spark, planted, block):
    got = {(r["lo"], r["hi"]) for r in similar.similar_pairs(frame(spark, planted), 64, 0.9, block=block).collect()}
    want = brute(planted, 0.9)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 60


def test_recall_at_the_limit(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(600, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.905 * a + np.sqrt(1 - 0.905**2) * b])
    for occupancy in (600, 60, 6):
        assert similar.similar_pairs(frame(spark, x), 64, 0.9, occupancy=occupancy).count() >= 0.95 * 600
    assert similar.similar_pairs(frame(spark, x), 64, 0.9, exact=True, block=100).count() == 600


@pytest.mark.parametrize("n", [20_000, 200_000, 2_000_000, 1_000_000_000])
def test_tables_hold_the_recall_at_any_size(n):
    plan = similar.hash_plan(n, 64, 1536)
    tables = similar.tables_for(plan, 64, 0.9, 0.97)
    rng = np.random.default_rng(5)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(4000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rotations = similar._rotations(64, plan, tables, 9)
    met = (similar._cells(a, rotations) == similar._cells(b, rotations)).any(axis=1).mean()
    assert met >= 0.955 and tables < 40


def test_every_pair_at_the_limit_is_found(spark, tmp_path):
    # Pairs a hair above 0.9, spread over all components, in one and in few; plain cells lose some of them.
    rng = np.random.default_rng(11)
    a = rng.normal(size=(1500, 64))
    a[:300, 2:] *= 1e-3
    a[300:600, :60] *= 1e-3
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([a, 0.9002 * a + np.sqrt(1 - 0.9002**2) * b]).astype(np.float32).astype(float)
    want = brute(x, 0.9)
    assert len(want) > 1500
    for block in (2048, 70):
        rows = similar.similar_pairs(frame(spark, x), 64, 0.9, block=block, exact=True).collect()
        assert {(r["lo"], r["hi"]) for r in rows} == want and len(rows) == len(want)
    from cortigraph.llm import queries

    frame(spark, x).selectExpr("id AS sample_id", "v AS features", "timestamp_micros(0) AS built_at").write.parquet(f"{tmp_path}/feature_bundle.parquet")
    assert {tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()} == want


def test_candidates_lose_nothing():
    rng = np.random.default_rng(12)
    for x in (rng.normal(size=(700, 64)), np.eye(64)[rng.integers(0, 64, 700)], rng.normal(size=(700, 16)), np.outer(rng.normal(size=700), np.ones(30))):
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        got = {p for r, c in similar.candidates(x, x[:600], 0.5) for p in zip(r.tolist(), c.tolist())}
        assert got >= set(zip(*(i.tolist() for i in np.nonzero(x.astype(float) @ x[:600].T.astype(float) >= 0.5))))


def test_copies_fill_one_cell(spark):
    x = np.tile(np.random.default_rng(0).normal(size=64), (150, 1))
    assert similar.similar_pairs(frame(spark, x), 64, 0.9, block=20).count() == 150 * 149 // 2


def test_error_bound():
    rng = np.random.default_rng(1)
    x = similar._unit(__import__("pyarrow").array(list(rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-3, 4, (50, 1)))), 64, False)
    dots, bound = similar.tile(*similar.quantise(x), *similar.quantise(x))
    assert (np.abs(dots - x @ x.T) <= bound).all() and bound.max() < 0.05


def test_nearest_is_exact_with_ties(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (120, 16)).astype(float) + np.eye(16)[rng.integers(0, 16, 120)]
    df = frame(spark, x)
    got = similar.nearest(df.where("id % 10 = 0"), df, 16, 4, centre=True, block=32)
    c = x - x.mean(1, keepdims=True)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    s = c @ c.T
    np.fill_diagonal(s, -2)
    for r in got.collect():
        assert abs(np.sort(s[r["id"]])[::-1][r["rank"] - 1] - r["cosine"]) < 1e-9
    assert got.count() == 48


def test_dirty_and_empty(spark):
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [float("inf")] * 64), (None, [1.0] * 64), (7, [1.0] * 64), (8, [2.0] * 64)]
    df = similar.usable(spark.createDataFrame(bad, "id bigint, v array<float>"), "id", "v", 64)
    assert sorted(r["id"] for r in df.collect()) == [7, 8]
    assert [(r["lo"], r["hi"]) for r in similar.similar_pairs(df, 64, 0.9).collect()] == [(7, 8)]
    assert similar.similar_pairs(df.limit(0), 64, 0.9).count() == 0
    assert similar.nearest(df.limit(0), df, 64, 3).count() == 0
