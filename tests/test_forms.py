import json

import numpy as np

from pyspark.sql import functions as F

from cortigraph.operators import dynamics, evaluation, experiments
from cortigraph.sources import readers, writers


def test_result_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"my_knn_accuracy": 0.5, "knn_f1": "x", "alone": 1}))
    got = {(r["file_name"], r["name"], r["metric"], r["value"]) for r in readers.results_json(spark, str(tmp_path)).collect()}
    assert got == {("a.json", "my_knn", "accuracy", 0.5), ("a.json", "knn", "f1", None), ("a.json", "", "", 1.0)}


def test_manifest_matrix_and_trajectories(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (None,), (7,)], "label int")
    assert tuple(writers.window_manifest(df, "label").first()) == (5, 2, 1)
    e = spark.createDataFrame([(1, 2, 0.5)], "i bigint, j bigint, w double")
    assert sorted(map(tuple, writers.matrix_rows(e).collect())) == [(1, 2, 0.5), (2, 1, 0.5)]
    t = spark.createDataFrame([(0, 1.0, 5, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [0.0] * 3), (3, 1.0, 5, [9.0], [9.0], [9.0])], "scale int, coupling double, node bigint, x array<double>, y array<double>, z array<double>")
    out = writers.trajectories(t, "xy", 2, [0], single=True)
    assert [tuple(r) for r in out.collect()] == [(0, 1.0, 5, [1.0, 3.0], [4.0, 6.0])] and out.schema["x"].dataType.simpleString() == "array<float>"


def test_wide_features(spark):
    s = spark.createDataFrame([(0, 1.0, 5, 0.1, 0.2), (1, 1.0, 5, 0.3, 0.4), (0, 2.0, 5, 0.5, None)], "scale int, coupling double, node bigint, x_mean double, x_std double")
    got = {r["coupling"]: r["features"] for r in dynamics.wide_features(s).collect()}
    assert got[1.0] == {"x_mean_0": 0.1, "x_std_0": 0.2, "x_mean_1": 0.3, "x_std_1": 0.4} and got[2.0]["x_mean_0"] == 0.5


def test_models_of_several_classes_and_kernels(spark):
    rows = [(i, i % 3, [float(i % 3) + 0.01 * (i % 7), 1.0 - (i % 3)], i % 2) for i in range(90)]
    d = experiments.vectors(spark.createDataFrame(rows, "id bigint, label int, v array<double>, fold int"), "v", "label")
    small = lambda: experiments.OneVsRest(classifier=experiments.model("boosting", maxIter=2))
    assert isinstance(experiments.model("boosting_multiclass"), experiments.OneVsRest)
    s = evaluation.summary(experiments.cross_validate(d, small, 2), "label", "predicted").first()
    assert s["accuracy"] == 1.0
    ring = [(i, int(i % 2), [(1 + 2 * (i % 2)) * c for c in ((0.6, 0.8), (-0.8, 0.6), (0.0, -1.0), (-0.6, -0.8))[i % 8 // 2]], i % 3) for i in range(120)]
    k = experiments.fourier_features(spark.createDataFrame(ring, "id bigint, label int, v array<double>, fold int"), "v", 64, gamma=0.5)
    s = evaluation.summary(experiments.cross_validate(experiments.vectors(k, "v", "label"), lambda: experiments.model("svm", maxIter=20), 3), "label", "predicted").first()
    assert s["accuracy"] > 0.95


def test_patient_directories(spark, tmp_path):
    for p in ("p1", "p2", "p3"):
        (tmp_path / p).mkdir()
        np.save(tmp_path / p / "x_data.npy", np.arange(6.0).reshape(3, 2))
    np.save(tmp_path / "p1" / "y_labels.npy", np.array([0, 1, 1]))
    (tmp_path / "p3" / "x_data.npy").write_bytes(b"broken")
    (tmp_path / "notes").mkdir()
    np.save(tmp_path / "notes" / "other.npy", np.zeros(2))
    got = readers.patient_arrays(spark, str(tmp_path), without=["p3"]).collect()
    assert sorted((r["patient_id"], r["row"], r["label"]) for r in got) == [("p1", 0, 0), ("p1", 1, 1), ("p1", 2, 1), ("p2", 0, None), ("p2", 1, None), ("p2", 2, None)]
    assert {r["patient_id"] for r in readers.patient_arrays(spark, str(tmp_path), only=["p2"]).collect()} == {"p2"}
    assert [r["v"] for r in got if r["patient_id"] == "p1" and r["row"] == 1] == [[2.0, 3.0]]
