"""Batch jobs (T6, M9, M11): train every pending session, then backfill.

``train_pending`` does in one call what the reference's minute timer did per
session in a driver loop:

1. naive Bayes for all eligible sessions at once (``Flow``);
2. random forest and perceptron per session in a bounded MLlib job pool, on
   rows staged once to the shared folder;
3. prediction pairs of every model, from which ``TrainRun.metrics_report``
   gives the metrics of all sessions and models in one plan (K6);
4. one registry row per (session, model type), published only for sessions
   whose fits all succeeded (K7), with exported parameters.

Its outputs go under one run directory in the shared checkpoint folder.
``score_instructions`` classifies rows with the current models (J2, P11);
``backfill`` re-scores the stored rows that still hold the placeholder
(M11, K4). ``run_cycle`` is the periodic pass over stored tables: it calls
``train_pending``, appends registry, metrics and status rows, upserts
``modelsgenerated = true`` (K3) and backfills; a re-run retrains only what
is still unmarked.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigclass.functions.packets import channel_values
from sigclass.operators import classify, metrics, mllib_train, prepare, registry, scorers
from sigclass.operators.mllib_train import STATUS_SCHEMA, TrainConfig
from sigclass.operators.registry import REGISTRY
from sigclass.operators.session_stats import SessionStatistics
from sigclass.operators.upsert import append_version
from sigclass.plans.flow import Flow
from sigclass.schemas import INSTRUCTION_PACKETS, MODEL_TYPES, PENDING_PACKETS
from sigclass.session import exists, fresh_path, materialize
from sigclass.sources import snapshots, tables

RUN_STATUS = T.StructType([*STATUS_SCHEMA.fields, T.StructField("run", T.StringType())])


@dataclass
class TrainRun:
    """Outputs of one ``train_pending`` call (paths in the shared folder, and frames over them)."""
    spark: SparkSession
    root: str
    flow: Flow
    model_types: list[str]
    models: str = ""
    statuses: DataFrame = None
    pairs: DataFrame = None
    registry: DataFrame = None
    published: DataFrame = None
    invalid: DataFrame = None
    rescored: int = 0
    timings: dict = field(default_factory=dict)

    def metrics_report(self) -> DataFrame:
        return metrics.report(self.pairs)


def train_pending(spark: SparkSession, calibrations: DataFrame, packets: DataFrame,
                  model_types: list[str] | None = None, cfg: TrainConfig | None = None,
                  root: str | None = None, models: str | None = None,
                  statistics: SessionStatistics | None = None) -> TrainRun:
    """Train and evaluate every eligible session; write models, pairs, statuses and registry.

    With ``statistics`` of the same packets, naive Bayes and the indexers are fitted without reading any.

    Everything goes under the run's folder but the saved models, which go under ``models`` if it is
    given, so that the run's folder may be removed."""
    model_types = list(model_types or MODEL_TYPES)
    cfg = cfg or TrainConfig()
    root = root or fresh_path(spark, "train-run")
    models = models or root
    fl = Flow(calibrations, packets, statistics=statistics)
    run = TrainRun(spark, root, fl, model_types, models)
    t0 = time.time()

    # 1. naive Bayes, set-wise: parameters written once, status from the fit.
    spec = fl.spec
    if "nb" in model_types:
        fl.nb_models.write.mode("overwrite").parquet(f"{models}/nb_models")
    run.timings["nb"] = time.time() - t0

    # 2. rf / mlp through the MLlib pool on staged rows.
    ml_types = [m for m in model_types if m in ("rf", "mlp")]
    statuses = spark.createDataFrame([], STATUS_SCHEMA)
    if ml_types:
        t1 = time.time()
        rows_path = f"{root}/rows"
        sessions = materialize(mllib_train.pending_sessions(spec, fl.profile, calibrations), "work-list")
        mllib_train.stage_rows(fl.indexed, sessions, rows_path)
        mllib_train.fit_all(spark, rows_path, sessions.orderBy(F.desc("n_rows"), "calibrationid"), ml_types,
                            f"{models}/models", f"{root}/pairs", f"{root}/ml_status", cfg)
        if exists(spark, f"{root}/ml_status"):
            statuses = spark.read.schema(STATUS_SCHEMA).parquet(f"{root}/ml_status")
        run.timings["mllib"] = time.time() - t1
    # every eligible session with packets has a status of each type, also one without usable packets
    owners = calibrations.select("calibrationid", "userid")
    if "nb" in model_types:
        nb_status = fl.nb_status().join(owners, "calibrationid").select(
            "calibrationid", "userid", F.lit("nb").alias("model_type"),
            F.when(F.col("ok"), "ok").otherwise("failed").alias("status"),
            F.when(~F.col("ok"), F.lit("input")).alias("fault"), "error",
            F.when(F.col("ok"), F.lit(f"{models}/nb_models")).alias("model_path"))
        statuses = statuses.unionByName(nb_status)
    unusable = fl.profile.where(F.size("label_counts") == 0).select("calibrationid").join(owners, "calibrationid")
    for mt in ml_types:
        statuses = statuses.unionByName(unusable.select(
            "calibrationid", "userid", F.lit(mt).alias("model_type"), F.lit("failed").alias("status"),
            F.lit("input").alias("fault"), F.lit("no training rows").alias("error"),
            F.lit(None).cast("string").alias("model_path")))
    statuses.write.mode("overwrite").parquet(f"{root}/status")
    run.statuses = spark.read.schema(STATUS_SCHEMA).parquet(f"{root}/status")
    run.invalid = materialize(fl.invalid, "invalid")

    # 3. prediction pairs of every model (nb from the set-wise flow, rf/mlp from the pool).
    pairs = spark.createDataFrame([], "calibrationid string, model string, actual double, predicted double")
    if "nb" in model_types:
        pairs = pairs.unionByName(fl.pairs("nb"))
    if ml_types and exists(spark, f"{root}/pairs"):
        pairs = pairs.unionByName(read_pairs(spark, root).select("calibrationid", "model", "actual", "predicted"))
    pairs.write.mode("overwrite").parquet(f"{root}/all_pairs")
    run.pairs = spark.read.parquet(f"{root}/all_pairs")

    # 4. registry: publish sessions whose requested fits all succeeded, and whose models are all there.
    ok_sessions = (run.statuses.groupBy("calibrationid")
                   .agg(F.min(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("all_ok"),
                        F.countDistinct("model_type").alias("n"))
                   .where((F.col("all_ok") == 1) & (F.col("n") == len(model_types)))
                   .select("calibrationid"))
    reg = build_registry(spark, run, spec, calibrations, ok_sessions, cfg)
    reg.write.mode("overwrite").parquet(f"{root}/registry_parts")
    parts = spark.read.schema(REGISTRY).parquet(f"{root}/registry_parts")
    whole = parts.groupBy("calibrationid").agg(F.countDistinct("model_type").alias("n")).where(
        F.col("n") == len(model_types)).select("calibrationid")
    run.published = materialize(whole, "published")
    parts.join(run.published, "calibrationid", "left_semi").write.mode("overwrite").parquet(f"{root}/registry")
    run.registry = spark.read.schema(REGISTRY).parquet(f"{root}/registry")
    run.timings["total"] = time.time() - t0
    return run


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The prediction pairs that the MLlib pool wrote (a folder for each session and model type)."""
    return spark.read.schema(mllib_train.PAIRS_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/pairs")


def build_registry(spark: SparkSession, run: TrainRun, spec: DataFrame, calibrations: DataFrame,
                   published: DataFrame, cfg: TrainConfig) -> DataFrame:
    """One registry row per (published session, model type) with the exported parameters."""
    base = spec.join(published, "calibrationid", "left_semi").join(
        calibrations.select("calibrationid", "userid", "enddate"), "calibrationid")
    ok = run.statuses.where("status = 'ok'").select("calibrationid", "model_type", "model_path")
    parts = []
    for mt in run.model_types:
        own = base.join(ok.where(F.col("model_type") == mt), "calibrationid")
        if mt == "nb":
            own = own.join(spark.read.parquet(f"{run.models}/nb_models").where("ok").select("calibrationid", "classes"),
                           "calibrationid")
        else:  # only types with a saved model have a folder to read
            if own.isEmpty():
                continue
            # every saved model of this type, listed by a glob (no path list through the driver)
            glob = f"{run.models}/models/type={mt}/session=*"
            saved = scorers.export_rf(spark, glob, cfg.n_classes) if mt == "rf" else scorers.export_mlp(spark, glob)
            own = own.withColumn("session_key", registry.session_key()).join(saved, "session_key")
            if mt == "mlp":
                own = own.withColumn("mlp_layers", F.array(*[F.lit(x) for x in cfg.mlp_layers]))
        parts.append(registry_rows(own.withColumn("trained_at", F.current_timestamp())))
    out = spark.createDataFrame([], REGISTRY)
    for p in parts:
        out = out.unionByName(p)
    return out


def registry_rows(df: DataFrame) -> DataFrame:
    """The REGISTRY columns of ``df``; those that it does not have are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in REGISTRY.fields])


def load_models(spark: SparkSession, calibrations: DataFrame, saved: DataFrame,
                cfg: TrainConfig | None = None) -> DataFrame:
    """Registry rows of the ready sessions (modelsgenerated) from saved models of earlier runs.

    ``saved``: calibrationid, model_type, labels, cat_maps, trained_at and model_path of the models
    (a registry without parameters will do). Naive Bayes parameters come from the table at the
    path, forests and perceptrons from MLlib's folders; folders are read set-wise by a glob of
    their common parents, of which there is one for each run."""
    cfg = cfg or TrainConfig()
    ready = calibrations.where(F.col("modelsgenerated")).select("calibrationid", "userid", "enddate")
    want = saved.select("calibrationid", "model_type", "labels", "cat_maps", "trained_at", "model_path").join(
        ready, "calibrationid").withColumn("session_key", registry.session_key())
    want = want.withColumn("parent", F.when(F.col("model_type") == "nb", F.col("model_path")).otherwise(
        F.regexp_replace("model_path", "/session=[0-9a-f]+$", "")))
    out = spark.createDataFrame([], REGISTRY)
    for r in want.select("model_type", "parent").distinct().toLocalIterator():
        own = want.where((F.col("model_type") == r.model_type) & (F.col("parent") == r.parent))
        if r.model_type == "nb":
            params = spark.read.parquet(r.parent).where("ok").select("calibrationid", "classes")
            own = own.join(params, "calibrationid")
        elif r.model_type == "rf":
            own = own.join(scorers.export_rf(spark, f"{r.parent}/session=*", cfg.n_classes), "session_key")
        else:
            own = own.join(scorers.export_mlp(spark, f"{r.parent}/session=*"), "session_key").withColumn(
                "mlp_layers", F.array(*[F.lit(x) for x in cfg.mlp_layers]))
        out = out.unionByName(registry_rows(own))
    return out


def score_instructions(rows: DataFrame, registry_rows: DataFrame, rows_per_group: int = 100_000,
                       cfg: TrainConfig | None = None, micro_batch: bool = False,
                       current: bool = False) -> DataFrame:
    """J2 + P11: rows (pk, userid, eeg, ...) -> with predictedlabels from the current models
    (``current``: the rows given are those already, one per user and model type).

    Every row stays: one without a user or a model gets the placeholder. Forest and perceptron
    are scored with vectorised NumPy behind a salted cogroup, naive Bayes in column expressions.
    """
    cfg = cfg or TrainConfig()
    cur = registry_rows if current else registry.current_per_user(registry_rows)
    if "features" not in rows.columns:
        rows = rows.withColumn("features", channel_values("eeg"))
    nb = cur.where("model_type = 'nb'")
    scored = classify.nb_labels(rows, nb)
    ml = cur.where("model_type in ('rf', 'mlp')")
    scored = scorers.score(scored, ml, rows_per_group=rows_per_group, n_classes=cfg.n_classes,
                           n_channels=cfg.n_channels, write_side_table=not micro_batch)
    return classify.with_prediction_map(scored).drop("rf_label", "mlp_label", "nb_label")


def rescored(todo: DataFrame, registry_rows: DataFrame, rows_per_group: int = 100_000) -> DataFrame:
    """The rows of ``todo`` whose prediction map the current models change, with the new map.

    Rows of users without any model are not scored at all; rows that come out as they are stored
    are left out, so that a cycle without new models writes nothing."""
    users = registry_rows.select("userid").distinct()
    old = todo.join(users, "userid", "left_semi").withColumnRenamed("predictedlabels", "_old").drop("pending")
    return changed(score_instructions(old, registry_rows, rows_per_group)).select(*todo.columns)


def changed(scored: DataFrame) -> DataFrame:
    """Rows whose map ``predictedlabels`` differs from ``_old``."""
    entries = lambda c: F.coalesce(F.array_sort(F.map_entries(c)), F.array())
    return scored.where(entries("_old") != entries("predictedlabels"))


def backfill(stored: DataFrame, registry_rows: DataFrame, rows_per_group: int = 100_000) -> DataFrame:
    """The stored table after re-scoring its pending rows (last write wins)."""
    new = materialize(rescored(classify.pending(stored), registry_rows, rows_per_group), "rescored")
    kept = stored.join(new.select("pk"), "pk", "left_anti")
    return kept.unionByName(new.select(*stored.columns))


def given_up(status: DataFrame, max_attempts: int) -> DataFrame:
    """Sessions not to try again: a failure of their own input, or ``max_attempts`` failed runs."""
    failed = status.where(F.col("status") == "failed")
    return failed.groupBy("calibrationid").agg(
        F.max(F.when(F.col("fault") == "input", 1).otherwise(0)).alias("input"),
        F.countDistinct("run").alias("runs")).where(
        (F.col("input") == 1) | (F.col("runs") >= max_attempts)).select("calibrationid")


def run_cycle(spark: SparkSession, paths, model_types: list[str] | None = None,
              cfg: TrainConfig | None = None) -> TrainRun:
    """One pass of the periodic job over stored tables.

    fold arrival-order packet folders if there are many → train every eligible session
    on the files that may hold it → append registry rows, the metrics table, the
    statuses and the unusable packets, merge the current models → upsert the session
    table (K3) → score the waiting instruction rows that have not met the newest
    models and append those that changed as a newer version (K4). Each write is one
    commit of its table's snapshots, so readers never see a part of it.

    A session whose own input made a fit fail is not tried again; one that failed
    for another reason (a lost executor, a full disk) is, up to
    ``cfg.max_attempts`` times. A crash before the session table is upserted only
    means the next cycle trains those sessions again; registry readers take the
    newest row per user, so the repeat is harmless. Nothing is written where
    there is nothing new (F5). The run's own folder may be removed afterwards:
    models are kept beside the registry.
    """
    cfg = cfg or TrainConfig()
    version = int(time.time() * 1000)
    cal = tables.read_calibrations(spark, paths.calibrations)
    candidates = cal
    if exists(spark, paths.status):
        status = tables.read_parquet(spark, paths.status, RUN_STATUS)
        candidates = cal.join(given_up(status, cfg.max_attempts), "calibrationid", "left_anti")
    # one snapshot of the packets for the whole run; of its files those that may hold a session to train
    tables.compact_packets_table(spark, paths.packets, cfg.compact_after)
    stored = snapshots.read_snapshot(spark, paths.packets)
    wanted = materialize(prepare.eligible_calibrations(candidates).select("calibrationid"), "wanted")
    pk = tables.read_packets_of(spark, paths.packets, wanted, stored)
    run = train_pending(spark, candidates, pk, model_types, cfg, models=f"{paths.registry}_models/v_{version:015d}",
                        statistics=tables.packet_statistics(spark, stored))
    name = f"v_{version:015d}"
    if not run.statuses.isEmpty():
        snapshots.append(spark, run.statuses.withColumn("run", F.lit(run.root)), paths.status, name)
    if not run.invalid.isEmpty():
        snapshots.append(spark, run.invalid.withColumn("run", F.lit(run.root)), invalid_path(paths.status), name)
    if not run.pairs.isEmpty():
        report = run.metrics_report().join(cal.select("calibrationid", "userid"), "calibrationid") \
            .withColumns({"trained_at": F.current_timestamp(), "run": F.lit(run.root)})
        snapshots.append(spark, report, paths.metrics, name)
    current = registry.current_path(paths.registry)
    if not run.published.isEmpty():
        snapshots.append(spark, run.registry, paths.registry, name)
        registry.publish_current(spark, current, run.registry)
        upd = cal.join(run.published, "calibrationid", "left_semi").withColumn("modelsgenerated", F.lit(True))
        append_version(upd, paths.calibrations, version)
    elif exists(spark, paths.registry) and not snapshots.newest_version(spark, current):
        registry.publish_current(spark, current, tables.read_parquet(spark, paths.registry, REGISTRY))
    if exists(spark, paths.instructions) and snapshots.newest_version(spark, current):
        run.rescored = backfill_waiting(spark, paths.instructions, current, version)
    return run


def invalid_path(status: str) -> str:
    """The table of unusable packets (calibrationid, reason, n, run) beside the statuses."""
    return f"{status.rstrip('/')}_invalid"


def backfill_waiting(spark: SparkSession, instructions: str, current: str, version: int,
                     rows_per_group: int = 100_000) -> int:
    """Score the waiting rows that have not met their user's newest models; returns how many.

    A waiting row carries the version of the current models that it was scored with, and a current
    model the version that brought it, so rows without news are neither scored nor written, and
    the scored rows are never read. Rows that change are appended as a newer version; then the
    waiting rows' table gets what still waits. After a crash between the two they are scored
    again, to the same labels."""
    tables.queue_pending(spark, instructions)
    waiting = snapshots.read_snapshot(spark, tables.pending_path(instructions))
    now = snapshots.newest_version(spark, current)
    models = registry.read_current(spark, current, now)
    if models is None or not waiting.entries:
        return 0
    news = models.groupBy("userid").agg(F.max("published").alias("news"))
    rows = spark.read.schema(PENDING_PACKETS).parquet(*waiting.data_paths())
    split = rows.join(news, "userid", "left").withColumn("due", F.coalesce(F.col("news") > F.col("scored_with"), F.lit(False)))
    due = materialize(split.where("due").drop("due", "news"), "due")
    n = due.count()
    if not n:
        return 0
    old = due.withColumnRenamed("predictedlabels", "_old").drop("pending", "scored_with")
    scored = materialize(score_instructions(old, models, rows_per_group, current=True), "rescored")
    new = changed(scored)
    if not new.isEmpty():
        append_version(new.select(*INSTRUCTION_PACKETS.fieldNames()), instructions, version)
    still = scored.where("pending").withColumn("scored_with", F.lit(now).cast("long"))
    rest = split.where(~F.col("due")).select(*PENDING_PACKETS.fieldNames())
    tables.replace_pending(spark, instructions, waiting, rest.unionByName(still.select(*PENDING_PACKETS.fieldNames())),
                           f"v_{version:015d}")
    return n
