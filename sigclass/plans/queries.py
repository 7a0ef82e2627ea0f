"""Named queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the fixture adapters (stand-in
sessions / packets / JSON messages) and runs the library's own operators over
the whole tables. Double columns are rounded to 6 places at the very end
(``present``) so that results compare across engines independent of
floating-point summation order; the same rounding is in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigclass.functions.packets import channel_values, parse_labelled, parse_unlabelled, vector_ok
from sigclass.functions.split import is_train
from sigclass.operators import classify, metrics, prepare, registry, upsert
from sigclass.plans import jobs
from sigclass.plans.flow import Flow
from sigclass.schemas import N_CHANNELS
from sigclass.session import fresh_path, materialize
from sigclass.sources import fixtures as fx
from sigclass.sources import tables

ROUND = 6


def present(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Round every double column (comparison convention shared with the oracle SQL)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def _channels(col: str = "features", prefix: str = "c", n: int = N_CHANNELS):
    return [F.element_at(F.col(col), i + 1).alias(f"{prefix}{i}") for i in range(n)]


def _flow(spark: SparkSession, sf: str) -> Flow:
    return Flow(fx.calibrations(spark, sf), fx.calibration_packets(spark, sf))


# ------------------------------------------------------------ scans / filters

def scan_calibrations(spark, sf):
    """S3: full scan of the session table."""
    return fx.calibrations(spark, sf)


def scan_ready_calibrations(spark, sf):
    """Sessions whose models exist (boolean filter)."""
    return prepare.ready_calibrations(fx.calibrations(spark, sf))


def scan_calibration_packets(spark, sf):
    """Stored labelled packets with their channels as doubles (whole table)."""
    p = fx.calibration_packets(spark, sf).withColumn("features", channel_values("eeg"))
    return present(p.select("pk", "date", "calibrationid", "userid", "label", *_channels()))


def eligible_calibrations(spark, sf):
    """finished sessions without models."""
    return prepare.eligible_calibrations(fx.calibrations(spark, sf))


def trainable_calibrations(spark, sf):
    """Eligible sessions with at least one packet."""
    return prepare.trainable_calibrations(fx.calibrations(spark, sf), fx.calibration_packets(spark, sf))


def packets_per_calibration(spark, sf):
    """A1: packet count per session."""
    return prepare.packets_per_calibration(fx.calibration_packets(spark, sf))


def training_frame(spark, sf):
    """J1 + P3: packets of eligible sessions with parsed channels."""
    f = _flow(spark, sf).frame
    return present(f.select("pk", "calibrationid", "userid", "label", *_channels(), "valid"))


# ------------------------------------------------------------- preparation

def parse_calibration_packets(spark, sf):
    """Parse labelled JSON messages (batch form of the ingest parser)."""
    p = parse_labelled(fx.labelled_json_lines(spark, sf))
    return present(p.select("calibrationid", "userid", "label", *_channels(), "reason"))


def parse_instruction_packets(spark, sf):
    """Parse unlabelled JSON messages; malformed lines get a reason."""
    p = parse_unlabelled(fx.unlabelled_json_lines(spark, sf))
    return present(p.select("userid", *_channels(), "reason"))


def packet_vectors(spark, sf):
    """array<string> channels -> doubles, with the six-finite-channels check."""
    p = fx.calibration_packets(spark, sf).withColumn("features", channel_values("eeg"))
    return present(p.select("pk", *_channels(), vector_ok("features").alias("valid")))


def label_index_fit(spark, sf):
    """A2: per-session label index (count desc, label asc)."""
    fl = _flow(spark, sf)
    return prepare.label_index_fit(None, fl.profile)


def label_index_apply(spark, sf):
    """Label -> fitted index on every training packet."""
    ix = _flow(spark, sf).indexed
    return ix.select("pk", "calibrationid", "label", "label_idx")


def channel_index_fit(spark, sf):
    """A3: categorical channels (<= 6 values) and their codes, per session."""
    fl = _flow(spark, sf)
    return present(prepare.channel_index_fit(fl.frame.where("valid"), profile=fl.profile,
                                             broadcast=fl.small_sessions))


def channel_index_apply(spark, sf):
    """Re-coded channel vectors of every training packet."""
    ix = _flow(spark, sf).indexed
    return present(ix.select("pk", "calibrationid", *_channels("features_idx", "f")))


def split_hash(spark, sf):
    """md5-of-pk 60/40 split of every training packet."""
    f = _flow(spark, sf).frame
    return f.select("pk", "calibrationid", is_train("pk").alias("is_train"))


def decode_predictions(spark, sf):
    """Naive Bayes test predictions decoded with each session's fitted label order."""
    p = _flow(spark, sf).nb_predictions
    return p.select("pk", "calibrationid", "label", "predicted_label")


# ---------------------------------------------------------- model & metrics

def nb_train(spark, sf):
    """M1: naive Bayes parameters for every eligible session in one aggregate."""
    par = _flow(spark, sf).nb_params
    return present(par.select("calibrationid", "label_idx", "n", "pi",
                              *_channels("theta", "theta_"), "ok"))


def nb_score(spark, sf):
    """M6: naive Bayes class index for every test packet."""
    p = _flow(spark, sf).nb_predictions
    return p.select("pk", "calibrationid", "label_idx", "prediction")


def nb_evaluate(spark, sf):
    """M5 + A5: per-session hold-out size, accuracy and test error of naive Bayes."""
    return present(metrics.accuracy_and_error(_flow(spark, sf).pairs("nb")))


def confusion_matrix(spark, sf):
    """A4: confusion matrices of every session (long form, zeros included)."""
    return metrics.confusion_matrix(_flow(spark, sf).pairs("nb"))


def accuracy_and_error(spark, sf):
    """A5 + P13: accuracy and 1 - accuracy per session and model (from the class table)."""
    w = metrics.weighted_metrics(_flow(spark, sf).pairs("nb"))
    return present(w.select("calibrationid", "model", "n", "accuracy", "test_error"))


def class_metrics(spark, sf):
    """Per-class precision, recall, F1, FPR, TPR for every session."""
    return present(metrics.class_metrics(_flow(spark, sf).pairs("nb")))


def weighted_metrics(spark, sf):
    """A10: weighted precision, recall, F1, FPR, TPR for every session."""
    return present(metrics.weighted_metrics(_flow(spark, sf).pairs("nb")))


def metrics_report(spark, sf):
    """K6: the report table — one row per (session, model, metric, class)."""
    return present(_flow(spark, sf).report())


def label_pair_metrics(spark, sf):
    """A6-A10 over given prediction pairs (labels: quality as actual, toxic as predicted)."""
    l = fx.table(spark, sf, "labels")
    pairs = l.select(F.lit("labels").alias("calibrationid"), F.lit("given").alias("model"),
                     F.col("quality").cast("double").alias("actual"),
                     F.col("toxic").cast("double").alias("predicted"))
    return present(metrics.class_metrics(pairs))


def prediction_sample(spark, sf):
    """L1/K8: first five decoded predictions by key (the preview, made deterministic)."""
    p = _flow(spark, sf).nb_predictions
    return p.select("pk", "predicted_label", "label").orderBy("pk").limit(5)


# -------------------------------------------------- registry / serving / upsert

def nb_registry(flow: Flow, calibrations: DataFrame) -> DataFrame:
    """Registry rows of the naive Bayes models trained in this run."""
    m = flow.nb_models.where("ok").join(flow.spec, "calibrationid")
    return registry.with_session(m.withColumn("model_type", F.lit("nb")), calibrations)


def current_model_per_user(spark, sf):
    """Newest trained session per user and model type."""
    cal = fx.calibrations(spark, sf)
    cur = registry.current_per_user(nb_registry(_flow(spark, sf), cal))
    return cur.select("userid", "model_type", "calibrationid", "enddate")


def mark_models_generated(spark, sf):
    """K3: session table after upserting modelsgenerated = true for sessions whose fit succeeded."""
    cal = fx.calibrations(spark, sf)
    fl = Flow(cal, fx.calibration_packets(spark, sf))
    ok = fl.nb_models.where("ok").select("calibrationid")
    return upsert.mark_models_generated(cal, ok)


def pending_instructions(spark, sf):
    """Stored instruction rows that still hold the placeholder (a third of them does not)."""
    p = classify.pending(fx.stored_instructions(spark, sf))
    return p.select("pk", "userid", "date")


def reclassify_pending(spark, sf):
    """Re-score pending rows with the users' current naive Bayes models and upsert those
    that changed; classified rows and rows of users without a model stay as they are."""
    cal = fx.calibrations(spark, sf)
    fl = Flow(cal, fx.calibration_packets(spark, sf))
    cur = registry.current_per_user(nb_registry(fl, cal))
    stored = fx.stored_instructions(spark, sf)
    todo = classify.pending(stored).withColumnRenamed("predictedlabels", "_old").drop("pending")
    todo = todo.join(cur.select("userid"), "userid", "left_semi")
    scored = classify.nb_labels(todo, cur, broadcast=fl.small_sessions)
    new = materialize(jobs.changed(classify.with_prediction_map(scored)).select(*stored.columns), "rescored")
    merged = stored.join(new.select("pk"), "pk", "left_anti").unionByName(new)
    return merged.select("pk", "userid", F.col("predictedlabels")["RandomForest"].alias("rf_label"),
                         F.col("predictedlabels")["NaiveBayes"].alias("nb_label"), "pending")


def scan_session_packets(spark, sf):
    """Packets of the eligible sessions from a stored table clustered by session (key-pruned read)."""
    path = fresh_path(spark, "session-packets")
    fx.calibration_packets(spark, sf).write.option("compression", "zstd").parquet(f"{path}/raw")
    tables.compact_packets(spark, f"{path}/raw", f"{path}/by_session")
    sessions = prepare.eligible_calibrations(fx.calibrations(spark, sf))
    p = tables.read_session_packets(spark, f"{path}/by_session", sessions)
    return present(p.select("pk", "date", "calibrationid", "userid", "label", *_channels()))


def _faulty_flow(spark, sf) -> Flow:
    return Flow(fx.calibrations(spark, sf), fx.faulty_calibration_packets(spark, sf))


def invalid_packets(spark, sf):
    """Packets of eligible sessions that cannot be used, by session and reason."""
    return prepare.invalid_packets(_faulty_flow(spark, sf).frame)


def nb_status(spark, sf):
    """M1: which sessions' naive Bayes fits succeed on input with unusable packets, and why others fail."""
    return _faulty_flow(spark, sf).nb_status()


ORACLE_QUERIES = {
    "scan_calibrations": scan_calibrations,
    "scan_ready_calibrations": scan_ready_calibrations,
    "scan_calibration_packets": scan_calibration_packets,
    "scan_session_packets": scan_session_packets,
    "invalid_packets": invalid_packets,
    "nb_status": nb_status,
    "pending_instructions": pending_instructions,
    "training_frame": training_frame,
    "eligible_calibrations": eligible_calibrations,
    "trainable_calibrations": trainable_calibrations,
    "packets_per_calibration": packets_per_calibration,
    "current_model_per_user": current_model_per_user,
    "mark_models_generated": mark_models_generated,
    "parse_calibration_packets": parse_calibration_packets,
    "parse_instruction_packets": parse_instruction_packets,
    "packet_vectors": packet_vectors,
    "label_index_fit": label_index_fit,
    "label_index_apply": label_index_apply,
    "channel_index_fit": channel_index_fit,
    "channel_index_apply": channel_index_apply,
    "split_hash": split_hash,
    "decode_predictions": decode_predictions,
    "nb_train": nb_train,
    "nb_score": nb_score,
    "nb_evaluate": nb_evaluate,
    "confusion_matrix": confusion_matrix,
    "accuracy_and_error": accuracy_and_error,
    "class_metrics": class_metrics,
    "weighted_metrics": weighted_metrics,
    "metrics_report": metrics_report,
    "label_pair_metrics": label_pair_metrics,
    "prediction_sample": prediction_sample,
    "reclassify_pending": reclassify_pending,
}

