"""Fits inside of tasks against MLlib's: the same forests, the same perceptrons up to rounding, no jobs for each session."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigclass.operators import mllib_predict, mllib_train, registry, task_fits
from sigclass.operators.mllib_train import TrainConfig
from sigclass.plans import jobs
from sigclass.schemas import CALIBRATION_PACKETS, CALIBRATIONS, LABELS
from sigclass.session import fresh_path


def _case(n, kind):
    rng = np.random.default_rng(n)
    x, sizes = np.round(rng.random((n, 6)) * 50, 1), {4: 4}
    x[:, 2], x[:, 4] = rng.integers(0, 11, n), rng.integers(0, 4, n)
    y = (x[:, 0] > 20).astype(int) + ((x[:, 4] > 2) & (rng.random(n) > .3))
    if kind == "two classes":
        y = rng.integers(0, 2, n)
    if kind == "one class":
        y = np.zeros(n, int)
    if kind == "odd channels":  # six categories, two, one; a channel of zeros
        x[:, 4], x[:, 3], x[:, 0], y = rng.integers(0, 6, n), rng.integers(0, 2, n), 0.0, rng.integers(0, 3, n)
        sizes = {4: 6, 3: 2, 0: 1}
    return x, y, sizes


def _frame(spark, x, y, sizes):
    rows = [(float(a), [float(v) for v in b]) for a, b in zip(y, x)]
    return spark.createDataFrame(rows, "label_idx double, f array<double>").select(
        "label_idx", array_to_vector("f").alias("fv", metadata=mllib_train.feature_metadata(sizes, 6))).coalesce(1)


def _plain(tree, node):
    s = node["split"]
    return (tree, *[node[k] for k in ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")],
            s["featureIndex"], sorted(s["leftCategoriesOrThreshold"]), s["numCategories"])


@pytest.mark.parametrize("n, kind, trees", [(360, "three classes", 20), (300, "two classes", 20), (360, "odd channels", 20),
                                            (40, "one class", 20), (5, "two classes", 20), (200, "three classes", 3)])
def test_a_forest_is_mllibs_node_for_node(spark, n, kind, trees):
    x, y, sizes = _case(n, kind)
    est = mllib_train.estimator("rf", TrainConfig(rf_num_trees=trees)).setSeed(99)
    path = fresh_path(spark, "t-forest")
    est.fit(_frame(spark, x, y, sizes)).save(path)
    theirs = sorted(_plain(r["treeID"], r["nodeData"].asDict(True)) for r in spark.read.parquet(f"{path}/data").collect())
    plan = task_fits.forest_plan(mllib_train.bags(spark, 99, n, trees), 99, 6, est.getMaxDepth(), est.getMaxBins())
    ours = mllib_train._nodes(task_fits.fit_forest(x, y, sizes, plan))
    assert sorted(_plain(r["treeID"], r["nodeData"]) for r in ours) == theirs


def test_too_many_categories_fail_as_in_mllib(spark):
    x, y, sizes = _case(3, "three classes")
    plan = task_fits.forest_plan(mllib_train.bags(spark, 1, 3, 20), 1, 6, 5, 32)
    with pytest.raises(Exception, match="maxBins"):
        mllib_train.estimator("rf", TrainConfig()).fit(_frame(spark, x, y, sizes))
    with pytest.raises(ValueError, match="maxBins"):
        task_fits.fit_forest(x, y, sizes, plan)


@pytest.mark.parametrize("n, kind", [(360, "three classes"), (100, "two classes"), (40, "one class")])
def test_a_perceptron_is_mllibs(spark, n, kind):
    """Equal weights as long as rounding is not magnified, and as good a fit in the end."""
    x, y, sizes = _case(n, kind)
    cfg, frame = TrainConfig(), _frame(spark, x, y, sizes).persist()
    first = mllib_train.first_weights(spark, cfg.mlp_layers, cfg.mlp_seed)
    loss = task_fits.perceptron_loss(cfg.mlp_layers, x, y, cfg.mlp_block_size)
    for steps in (1, 3, 15, 100):
        est = mllib_train.estimator("mlp", cfg).setMaxIter(steps)
        theirs = np.array(est.fit(frame).weights.toArray())
        ours = task_fits.fit_perceptron(x, y, cfg.mlp_layers, first, cfg.mlp_block_size, steps, est.getTol())
        if steps <= 15:
            assert np.abs(ours - theirs).max() < 1e-7
        assert abs(loss(ours)[0] - loss(theirs)[0]) < 0.02
    frame.unpersist()


def test_the_line_search_survives_a_loss_that_is_not_finite():
    x, y = np.array([[1e6, -1e6], [-1e6, 1e6], [1e6, 1e6]]), np.array([0, 1, 1])
    w = task_fits.fit_perceptron(x, y, [2, 2], [5.0, -5.0, -5.0, 5.0, 0.0, 0.0], 128, 20, 1e-6)
    assert np.isfinite(w).all()


def _sessions(spark, n, rows=60):
    rng = np.random.default_rng(7)
    pk, cal = [], []
    for s in range(n):
        cal.append((f"s{s}", f"u{s % 3}", None, dt.datetime(2024, 1, 1), False))
        for i in range(rows):
            v = [rng.random() * 9 + 3 * (i % 3) for _ in range(5)] + [float(i % 4)]
            pk.append((f"s{s}|{i}", None, None, LABELS[i % (2 + s % 2)], f"u{s % 3}", f"s{s}", v))
    return spark.createDataFrame(cal, CALIBRATIONS), spark.createDataFrame(pk, CALIBRATION_PACKETS)


def _jobs(spark, run):
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    run()
    return count() - before


def test_more_small_sessions_are_not_more_jobs(spark):
    few, many = _sessions(spark, 3), _sessions(spark, 12)
    a = _jobs(spark, lambda: jobs.train_pending(spark, *few, model_types=["rf", "mlp"]))
    b = _jobs(spark, lambda: jobs.train_pending(spark, *many, model_types=["rf", "mlp"]))
    assert b <= a + 10


def test_a_run_in_tasks_equals_one_by_mllib(spark):
    """Registry, pairs, statuses and saved models of the same sessions, fitted both ways."""
    cal, pk = _sessions(spark, 4)
    ours = jobs.train_pending(spark, cal, pk, model_types=["rf", "mlp"])
    theirs = jobs.train_pending(spark, cal, pk, model_types=["rf", "mlp"], cfg=TrainConfig(task_fit_rows=0))
    # category masks: sets; an inner node has the same ones
    def forests(run):
        return sorted((r["calibrationid"], r["rf"].asDict(True)) for r in run.registry.where("model_type = 'rf'").collect())
    assert [c for c, _ in forests(ours)] == ["s0", "s1", "s2", "s3"] and forests(ours) == forests(theirs)
    def shape(run):
        return sorted((r["calibrationid"], r["userid"], r["model_type"], r["status"], r["fault"]) for r in run.statuses.collect())
    assert shape(ours) == shape(theirs) and len(shape(ours)) == 8
    def pairs(run, *more):
        return sorted((r["calibrationid"], r["model"], r["pk"], r["actual"], *[r[m] for m in more])
                      for r in jobs.read_pairs(spark, run.root).collect() if r["model"] == "rf" or not more)
    assert pairs(ours) == pairs(theirs) and pairs(ours, "predicted") == pairs(theirs, "predicted")
    weights = ours.registry.where("model_type = 'mlp'").select("calibrationid", "mlp_weights").collect()
    assert len(weights) == 4 and all(len(r["mlp_weights"]) == 74 for r in weights)

    # what is saved is MLlib's: it loads, one by one and joined, and predicts what the task did
    kinds = {"rf": RandomForestClassificationModel, "mlp": MultilayerPerceptronClassificationModel}
    paths = ours.registry.select("model_type", "calibrationid", "userid", "model_path", registry.session_key().alias("k"))
    test = spark.read.parquet(f"{ours.root}/rows").where("not is_train").withColumn("fv", array_to_vector("features_idx"))
    given = {(r["calibrationid"], r["model"], r["pk"]): r["predicted"] for r in jobs.read_pairs(spark, ours.root).collect()}
    assert given
    for run in (ours, theirs):
        for mt, kind in kinds.items():
            sessions = run.registry.where(F.col("model_type") == mt).select("calibrationid", "userid")
            found = mllib_predict.predictions(spark, f"{run.root}/rows", f"{run.models}/models", sessions.union(sessions), mt, at_once=2)
            found = sorted(map(tuple, found.collect()))
            assert found == sorted((r["pk"], r["calibrationid"], r["predicted"])
                                   for r in jobs.read_pairs(spark, run.root).collect() if r["model"] == mt)
    for r in paths.collect():
        model = kinds[r["model_type"]].load(r["model_path"])
        for p in model.transform(test.where(F.col("session_key") == r["k"])).select("pk", "prediction").collect():
            assert given[r["calibrationid"], r["model_type"], p["pk"]] == p["prediction"]
        if r["model_type"] == "rf":
            assert model.getNumTrees == 20 and model.numClasses == 2 + int(r["calibrationid"][1:]) % 2
            assert model.getMaxDepth() == 5 and len(model.trees) == 20


def test_one_bad_session_stops_no_other_and_one_listed_twice_is_fitted_once(spark):
    cal, pk = _sessions(spark, 3)
    few = pk.where("calibrationid <> 's1' or pk in ('s1|0', 's1|1', 's1|2', 's1|3', 's1|4', 's1|5')")
    run = jobs.train_pending(spark, cal.union(cal.where("calibrationid = 's2'")), few, model_types=["rf", "mlp"])
    st = [(r["calibrationid"], r["model_type"], r["status"], r["fault"]) for r in run.statuses.collect()]
    assert ("s0", "rf", "ok", None) in st and ("s0", "mlp", "ok", None) in st and st.count(("s2", "rf", "ok", None)) == 2
    bad = [s for s in st if s[0] == "s1" and s[1] == "rf"]
    assert bad in ([("s1", "rf", "failed", "input")], [("s1", "rf", "ok", None)])
    trees = spark.read.parquet(f"{run.models}/models/type=rf/session=*/treesMetadata").groupBy(
        F.regexp_extract(F.input_file_name(), "session=([0-9a-f]+)", 1)).count().collect()
    assert trees and all(r["count"] == 20 for r in trees)
