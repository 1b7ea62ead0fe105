from pyspark.sql import functions as F

from cortigraph.operators import windows
from cortigraph.plans import timing


def test_windows_before_every_onset(spark, tmp_path):
    files = [("P 1", "a.edf", 3600), ("p1", "b.edf", 3600)]
    marks = [(1, "b.edf", 100, 130, 1), (2, "b.edf", 2000, 2040, 1), (3, "x/B.edf", 2000, 2050, 1), (4, "b.edf", 3590, 3700, 1)]
    spark.createDataFrame(files, "patient_id string, file_name string, duration_sec int").write.parquet(f"{tmp_path}/file_info.parquet")
    spark.createDataFrame(marks, "event_id int, file_name string, start_sec int, end_sec int, loaded_at int").write.parquet(f"{tmp_path}/seizure_events.parquet")
    found = timing.preictal_windows(spark, str(tmp_path)).collect()
    assert len(found) == len(set(found))
    # Before 2,000 s all 19 windows; before 100 s those with an end after 0, two of them with a piece of the file before.
    assert sorted(r["start_sec"] for r in found if r["onset"] == 2000) == [1400.0 + 30 * k for k in range(19)]
    assert sorted((r["start_sec"], r["n_segments"]) for r in found if r["onset"] == 100) == [(-50.0, 2), (-20.0, 2), (10.0, 1), (40.0, 1)]
    assert len(found) == 23


def test_draw_falls_back_to_the_whole_file(spark):
    files = spark.createDataFrame([("p", "a", 600), ("p", "b", 7200), ("q", "c", 90)], "patient_id string, file_name string, duration_sec int")
    events = spark.createDataFrame([("p", "a", 300, 320)], "patient_id string, file_name string, start_sec int, end_sec int")
    wanted = spark.createDataFrame([("p", "a", 3), ("p", "b", 5), ("q", "c", 4)], "patient_id string, file_name string, n bigint")
    rows = windows.interictal_draw(files, events, wanted, 60.0, 60.0, 600.0).collect()
    by = {f: [r for r in rows if r["file_name"] == f] for f in "abc"}
    assert [len(by[f]) for f in "abc"] == [3, 5, 1] and all(r["fallback"] for r in by["a"]) and not any(r["fallback"] for r in by["b"] + by["c"])
    assert len({r["start_sec"] for r in by["b"]}) == 5
    again = windows.interictal_draw(files.repartition(3), events, wanted, 60.0, 60.0, 600.0).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_windows_of_any_length_meet_spans(spark):
    w = spark.createDataFrame([("f", 1, -1e12, 1e12), ("f", 2, 0.0, 30.0), ("f", 3, 1e9, 1e9 + 5), ("g", 4, 0.0, 9.0)], "file_name string, id int, start_sec double, end_sec double")
    spans = windows.extended(spark.createDataFrame([("f", 30.0, 40.0)], "file_name string, lo double, hi double"), 20.0, 5.0)
    assert [tuple(r) for r in spans.collect()] == [("f", 10.0, 45.0)]
    met = windows.overlapping(w, spans, ["file_name"], how="left_semi")
    assert sorted(r["id"] for r in met.collect()) == [1, 2]
    assert sorted(r["id"] for r in windows.overlapping(w, spans, ["file_name"]).collect()) == [3, 4]
    assert [r["id"] for r in windows.majority_inside(w, spans, ["file_name"]).collect()] == [2]


def test_windows_away_are_those_that_meet_no_zone(spark):
    rng = __import__("random").Random(5)
    files = [(p, f"{p}{i:02d}", rng.choice([30, 59, 60, 61, 180, 601, 3600, 9001])) for p in "pqr" for i in range(12)]
    marks = [(p, f, s, s + rng.randint(1, 90)) for p, f, d in files if p != "r" for s in [rng.randint(0, d) for _ in range(rng.choice([0, 0, 1, 3]))]]
    marks += [("p", "p00", 0.1, 0.3), ("q", "q05", 7.7, 8.25)]
    schema = "patient_id string, file_name string"
    f, e = spark.createDataFrame(files, f"{schema}, duration_sec int"), spark.createDataFrame([(p, n, float(a), float(b)) for p, n, a, b in marks], f"{schema}, start_sec double, end_sec double")
    offset, clock = {}, {p: 0 for p in "pqr"}
    for p, n, d in sorted(files):
        offset[n] = (clock[p], d)
        clock[p] += d
    for length, step, gap in ((60.0, 60.0, 600.0), (60.0, 7.3, 33.3), (60.0, 0, 120.0)):
        zones = [(p, max(0.0, offset[n][0] + a - gap), offset[n][0] + min(b + gap, float(offset[n][1]))) for p, n, a, b in marks]
        want = set()
        for p, n, d in files:
            places = [max(0.0, d / 2 - length / 2)] if step == 0 else [k * step for k in range(int((d - length) / step + 1e-9) + 1 if d >= length else 0)]
            for s in places if d >= length else []:
                at = offset[n][0] + s
                if not any(q == p and lo < hi and at < hi and offset[n][0] + (s + length) > lo for q, lo, hi in zones):
                    want.add((p, n, s, s + length))
        made = windows.interictal(f, e, length, step, gap)
        assert sorted(map(tuple, made.collect())) == sorted(want) and want
        # Windows come last: no join or exchange of windows, which large tables sent to the driver.
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan.split("Generate")[0] and "Generate" in plan


def test_drawn_windows_are_picked_before_they_travel(spark):
    files = spark.createDataFrame([("p", "a", 12_000_000), ("p", "b", 600)], "patient_id string, file_name string, duration_sec int")
    events = spark.createDataFrame([("p", "a", 300, 320)], "patient_id string, file_name string, start_sec int, end_sec int")
    wanted = spark.createDataFrame([("p", "a", 50)], "patient_id string, file_name string, n bigint")
    drawn = windows.interictal_draw(files, events, wanted, 60.0, 60.0, 600.0)
    # The first 50 by hash of the whole grid, which has several pieces.
    h = F.xxhash64(F.lit(42), "patient_id", "file_name", "start_sec")
    away = windows.interictal(files, events, 60.0, 60.0, 600.0).where("file_name = 'a'")
    first = away.orderBy(F.shiftrightunsigned(h, 58), h, "start_sec").limit(50)
    assert away.count() > 2 * windows.PIECE
    assert sorted(r["start_sec"] for r in drawn.collect()) == sorted(r["start_sec"] for r in first.collect())
    # Between the making of windows and the first exchange of them stands the choice.
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    made = plan[: plan.index("explode(sequence(greatest(_k0")].splitlines()[::-1]
    assert any("Filter" in line and "_r#" in line for line in made[: next(i for i, line in enumerate(made) if "Exchange" in line)])
