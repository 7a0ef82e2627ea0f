"""Differential tests: set-wise naive Bayes and exported scorers vs MLlib."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sigclass.operators import metrics as metrics_mod
from sigclass.operators import scorers
from sigclass.plans import jobs
from sigclass.plans.flow import Flow
from sigclass.sources import fixtures as fx
from tests.conftest import SF001


@pytest.fixture(scope="module")
def flow(spark):
    return Flow(fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001))


def test_nb_equals_mllib_every_session(spark, flow):
    params = {(r["calibrationid"], r["label_idx"]): r for r in flow.nb_params.collect()}
    ours = {r["pk"]: r["prediction"] for r in flow.nb_predictions.select("pk", "prediction").collect()}
    sessions = sorted({k[0] for k in params})
    assert sessions
    for cid in sessions:
        ix = flow.indexed.where(F.col("calibrationid") == cid)
        tr = ix.where("is_train").select(F.col("label_idx").alias("label"),
                                         array_to_vector("features_idx").alias("features"))
        m = NaiveBayes(smoothing=1.0).fit(tr)
        k = len(m.pi)
        for i in range(k):
            p = params[(cid, float(i))]
            assert abs(p["pi"] - m.pi[i]) < 1e-12
            assert np.allclose(p["theta"], m.theta.toArray()[i], rtol=0, atol=1e-12)
        te = ix.where("not is_train").select("pk", array_to_vector("features_idx").alias("features"))
        for r in m.transform(te).select("pk", "prediction").collect():
            assert ours[r["pk"]] == r["prediction"]


def test_nb_fails_on_negative_channels(spark):
    pk = fx.embedding_packets(spark, SF001)
    cal = pk.groupBy("calibrationid", "userid").agg(F.lit(None).cast("timestamp_ntz").alias("startdate")) \
        .withColumn("enddate", F.current_timestamp().cast("timestamp_ntz")) \
        .withColumn("modelsgenerated", F.lit(False))
    fl = Flow(cal, pk)
    st = fl.nb_models.collect()
    assert len(st) == 1 and st[0]["ok"] is False
    assert fl.nb_predictions.count() == 0  # a failed session gets no model


def test_exported_scorers_equal_transform(spark):
    """rf (with a categorical channel) and mlp: Arrow scorer == MLlib transform on every test row."""
    run = jobs.train_pending(spark, fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001),
                             model_types=["rf", "mlp"])
    st = run.statuses.collect()
    assert st and all(r["status"] == "ok" for r in st)
    ml = jobs.read_pairs(spark, run.root)
    test = run.flow.indexed.where("not is_train").select(
        "pk", "calibrationid", F.col("calibrationid").alias("userid"), "features")
    spec = run.flow.spec.select("calibrationid", "labels")
    for mt, col in (("rf", "rf_label"), ("mlp", "mlp_label")):
        reg = run.registry.where(F.col("model_type") == mt).withColumn("userid", F.col("calibrationid"))
        out = scorers.score(test, reg, rows_per_group=50)  # small groups: exercises salting
        ours = out.join(spec, "calibrationid").select(
            "pk", (F.array_position("labels", F.col(col)) - 1).cast("double").alias("p"))
        j = ours.join(ml.where(F.col("model") == mt), "pk")
        assert j.count() == test.count(), mt
        assert j.where("p <> predicted").count() == 0, mt
    # the forest used a categorical split on the re-coded channel 4
    nodes = run.registry.where("model_type = 'rf'").select(F.explode("rf.cats").alias("c")).where("c >= 0").count()
    assert nodes > 0
    # metrics table covers every session and both model types
    rep = run.metrics_report().groupBy("model").count().collect()
    assert {r["model"] for r in rep} == {"rf", "mlp"}


def test_mlp_predict_layout():
    """Weights per layer: (out x in) column-major then bias; sigmoid hidden, argmax output."""
    rng = np.random.default_rng(0)
    layers = [3, 2, 2]
    w = rng.normal(size=3 * 2 + 2 + 2 * 2 + 2)
    x = rng.normal(size=(5, 3))
    W1 = w[:6].reshape(3, 2, order="C")  # == (2x3) column-major
    b1 = w[6:8]
    W2 = w[8:12].reshape(2, 2)
    b2 = w[12:14]
    h = 1 / (1 + np.exp(-(x @ W1 + b1)))
    exp = np.argmax(h @ W2 + b2, axis=1)
    assert (scorers.mlp_predict(x, layers, w) == exp).all()


def test_matrix_total_equals_test_rows(spark, flow):
    """Invariant: per session, the confusion matrix counts every scored test row once."""
    cm = metrics_mod.confusion_matrix(flow.pairs()).groupBy("calibrationid").agg(F.sum("n").alias("t"))
    test = flow.indexed.where("not is_train").groupBy("calibrationid").agg(F.count("*").alias("t"))
    assert cm.exceptAll(test).count() == 0 and test.exceptAll(cm).count() == 0


def test_rf_predict_hand_built_tree():
    """Continuous split x0 <= 1.5; then categorical split on x1 in {0, 2}; unseen code 3 goes right."""
    rf = {"roots": [0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "feature": [0, 0, 1, 0, 0],
          "threshold": [1.5, 0, 0, 0, 0], "cats": [-1, -1, 0b101, -1, -1],
          "probs": [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0.8, 0.2, 0, 0.25, 0.75]}
    x = np.array([[1.0, 0.0], [2.0, 0.0], [2.0, 2.0], [2.0, 1.0], [2.0, 3.0], [np.nan, 0.0]])
    assert list(scorers.rf_predict(x, rf, 3)) == [0, 1, 1, 2, 2, 1]


def test_every_row_stays_when_scored(spark):
    """Rows without a user, a model or a whole vector keep the placeholder; none is lost."""
    run = jobs.train_pending(spark, fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001),
                             model_types=["nb", "mlp"])
    rows = fx.instruction_packets_some_without_user(spark, SF001).withColumn(
        "features", F.when(F.col("pk").cast("int") % 7 == 0, F.lit(None)).otherwise(F.col("features")))
    out = jobs.score_instructions(rows, run.registry, rows_per_group=100)
    assert out.count() == rows.count()
    assert out.where("userid is null and not predictedlabels['MLPerceptron'] = 'Generating Model'").count() == 0
    assert out.where("features is null and not predictedlabels['NaiveBayes'] = 'Generating Model'").count() == 0
    assert out.where("predictedlabels['MLPerceptron'] <> 'Generating Model'").count() > 0


def test_many_users_share_few_groups(spark):
    """100,000 users with a row each, every one with its own forest and perceptron: some hundred groups,
    each row scored by its own user's models."""
    from sigclass.operators.registry import REGISTRY
    n = 100_000
    users = spark.range(n).select(F.col("id"), F.concat(F.lit("u"), "id").alias("userid"))
    cut = (F.col("id") % 10).cast("double")
    none = F.lit(0).cast("long")
    forest = users.select(
        "userid", F.lit("rf").alias("model_type"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("labels"),
        # channel 1 is categorical for every third user: 7.0 -> 1, 9.0 -> 0, unseen -> 2
        F.when(F.col("id") % 3 == 0, F.create_map(F.lit(1), F.create_map(F.lit(9.0), F.lit(0.0), F.lit(7.0), F.lit(1.0)))).alias("cat_maps"),
        F.struct(F.array(F.lit(0)).alias("roots"), F.array(F.lit(1), F.lit(-1), F.lit(-1)).alias("left"),
                 F.array(F.lit(2), F.lit(-1), F.lit(-1)).alias("right"), F.array(F.lit(1), F.lit(0), F.lit(0)).alias("feature"),
                 F.array(F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(cut), F.lit(0.0), F.lit(0.0)).alias("threshold"),
                 F.array(none - 1, none - 1, none - 1).alias("cats"),
                 F.array(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("probs")).alias("rf"))
    # a perceptron without hidden layers: class 1 where x0 + bias > 0
    perceptron = users.where("id % 5 <> 0").select(
        "userid", F.lit("mlp").alias("model_type"), F.array(F.lit("no"), F.lit("yes")).alias("labels"),
        F.array(F.lit(2), F.lit(2)).alias("mlp_layers"),
        F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), -cut).alias("mlp_weights"))
    models = jobs.registry_rows(forest).unionByName(jobs.registry_rows(perceptron))
    assert models.columns == REGISTRY.fieldNames()
    x0, x1 = (F.col("id") % 13).cast("double"), F.when(F.col("id") % 4 == 0, F.lit(7.0)).otherwise((F.col("id") % 11).cast("double"))
    rows = users.select(F.col("userid").alias("pk"), "userid", "id", F.array(x0, x1).alias("features"))
    out = scorers.score(rows, models, n_classes=2, n_channels=2)
    code = F.when(F.col("id") % 3 == 0, F.when(x1 == 9.0, 0.0).when(x1 == 7.0, 1.0).otherwise(2.0)).otherwise(x1)
    right = F.when(code <= F.when(F.col("id") % 3 == 0, 0.5).otherwise(cut), 0).otherwise(1)
    rf = F.when((right == 1) == (F.col("id") % 2 == 0), "b").otherwise("a")
    mlp = F.when(F.col("id") % 5 != 0, F.when(x0 > cut, "yes").otherwise("no"))
    wrong = out.where(~rf.eqNullSafe(F.col("rf_label")) | ~mlp.eqNullSafe(F.col("mlp_label")))
    assert out.count() == n and wrong.count() == 0
    assert scorers.n_buckets(n, n, 100_000, 500) == 200
    assert scorers.n_buckets(10**10, 10, 100_000, 500) == 200_000 and scorers.n_buckets(0, 0, 100, 5) == 1


def test_a_saved_pipeline_goes_from_packets_to_labels(spark):
    """M4: indexers, classifier and decoder saved and loaded as one; an indexer fitted by itself agrees."""
    from pyspark.ml import Pipeline, PipelineModel
    from sigclass.operators import ml_stages as S
    from sigclass.operators.mllib_train import TrainConfig, estimator
    from sigclass.session import fresh_path
    packets = fx.calibration_packets(spark, SF001).where("calibrationid = '4'").persist()
    flow = Flow(fx.calibrations(spark, SF001), packets)
    cal = flow.calibrations.where("calibrationid = '4'").withColumns({"modelsgenerated": F.lit(False), "enddate": F.col("startdate")})
    flow = Flow(cal, packets)
    spec = flow.spec.first()
    fitted = S.SessionIndexer().fit(packets)
    assert fitted.getLabels() == list(spec.labels)
    assert {j: {v: float(c) for c, v in enumerate(m)} for j, m in fitted.codes().items()} == dict(spec.cat_maps or {}) != {}
    indexed = fitted.transform(packets)
    assert sorted((r.pk, r.label_idx, list(r.fv)) for r in indexed.select("pk", "label_idx", "fv").collect()) == \
        sorted((r.pk, r.label_idx, list(r.features_idx)) for r in flow.indexed.collect())
    whole = Pipeline(stages=[S.SessionIndexer(), estimator("rf", TrainConfig()), S.LabelDecoder(labels=fitted.getLabels())])
    path = fresh_path(spark, "t-pipeline")
    model = whole.fit(packets)
    model.save(path)
    raw = packets.select("pk", "features")
    loaded = PipelineModel.load(path).transform(raw).select("pk", "predicted_label")
    assert sorted(loaded.collect()) == sorted(model.transform(raw).select("pk", "predicted_label").collect())
    assert loaded.where("predicted_label is null").count() == 0
