"""Queries over stored state: snapshots, file index, session statistics, waiting rows, current models.

Each writes the driver's rows as the jobs and streams do, in several commits, and reads
them back through that state; the results must equal those of the plain scans, so the SQL
is that of the queries in ``queries``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.functions.labels import decode, fixed_label_name, fixed_label_number
from sigclass.functions.packets import packet_key
from sigclass.operators import prepare, registry
from sigclass.operators.joins import join_small
from sigclass.operators.ml_stages import save_whole_models
from sigclass.plans import jobs
from sigclass.plans.flow import Flow
from sigclass.plans.queries import _channels, nb_registry, present
from sigclass.session import fresh_path
from sigclass.sources import fixtures as fx
from sigclass.sources import snapshots, tables
from sigclass.sources.streams import archive, archived_topic, file_topic
from sigclass.streaming.accounts import read_accounts
from sigclass.streaming.ingest import start_calibration_ingest

#: Commits into which a query's input is cut.
PARTS = 3


def _in_parts(rows: DataFrame, parts: int = PARTS) -> list[DataFrame]:
    return [rows.where(F.pmod(F.xxhash64("pk", F.lit("part")), F.lit(parts)) == i) for i in range(parts)]


def stored_packets(spark: SparkSession, sf: str, faulty: bool = False) -> str:
    """The packets stored in several commits, two of which are folded and one of which comes twice."""
    path = fresh_path(spark, "packet-table")
    rows = fx.faulty_calibration_packets(spark, sf) if faulty else fx.calibration_packets(spark, sf)
    first, second, third = _in_parts(rows)
    tables.write_packets(first, path, "batch_000000000000")
    tables.write_packets(second, path, "batch_000000000001")
    tables.compact_packets_table(spark, path, rows_per_file=5_000)
    tables.write_packets(third, path, "batch_000000000002")
    tables.write_packets(third, path, "batch_000000000002")  # a micro-batch that is run again
    return path


def _statistics_flow(spark: SparkSession, sf: str, faulty: bool = False) -> Flow:
    path = stored_packets(spark, sf, faulty)
    snapshot = snapshots.read_snapshot(spark, path)
    return Flow(fx.calibrations(spark, sf), tables.read_packets(spark, path),
                statistics=tables.packet_statistics(spark, snapshot))


def nb_train_incremental(spark, sf):
    """M1 from statistics kept at ingest: the packets are not read."""
    par = _statistics_flow(spark, sf).nb_params
    return present(par.select("calibrationid", "label_idx", "n", "pi", *_channels("theta", "theta_"), "ok"))


def label_index_incremental(spark, sf):
    """A2 from statistics kept at ingest."""
    return prepare.label_index_fit(None, _statistics_flow(spark, sf).profile)


def channel_index_incremental(spark, sf):
    """A3 from statistics kept at ingest: sketches and the values of channels that may be categorical."""
    return present(_statistics_flow(spark, sf).codes)


def invalid_packets_stored(spark, sf):
    """Unusable packets by session and reason, from statistics kept at ingest."""
    return _statistics_flow(spark, sf, faulty=True).invalid


def session_packets_pruned(spark, sf):
    """Packets of the eligible sessions, from the files that the index gives."""
    path = stored_packets(spark, sf)
    sessions = prepare.eligible_calibrations(fx.calibrations(spark, sf)).select("calibrationid")
    p = join_small(tables.read_packets_of(spark, path, sessions), sessions, "calibrationid", "left_semi")
    return present(p.select("pk", "date", "calibrationid", "userid", "label", *_channels()))


def _stored_instructions(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "instruction-table")
    for i, part in enumerate(_in_parts(fx.stored_instructions(spark, sf))):
        tables.write_scored(part, path, f"batch_{i:012d}", 0)
    return path


def waiting_instructions(spark, sf):
    """Rows that wait for a model, from the table that is kept of them."""
    return tables.read_pending_instructions(spark, _stored_instructions(spark, sf)).select("pk", "userid", "date")


def _publish_current(spark: SparkSession, sf: str) -> str:
    """The naive Bayes models of all sessions, merged into the current ones in several commits."""
    cal = fx.calibrations(spark, sf)
    models = jobs.registry_rows(nb_registry(Flow(cal, fx.calibration_packets(spark, sf)), cal))
    path = fresh_path(spark, "current-models")
    for i in range(PARTS):
        registry.publish_current(spark, path, models.where(F.pmod(F.xxhash64("calibrationid"), F.lit(PARTS)) == i))
    return path


def current_models_merged(spark, sf):
    """The current model of each user and type, from the table that is merged on publishing."""
    return registry.read_current(spark, _publish_current(spark, sf)).select(
        "userid", "model_type", "calibrationid", "enddate")


def reclassify_waiting(spark, sf):
    """The stored rows after the backfill of the table of waiting rows."""
    path, current = _stored_instructions(spark, sf), _publish_current(spark, sf)
    jobs.backfill_waiting(spark, path, current, 1)
    return tables.read_instructions(spark, path).select(
        "pk", "userid", F.col("predictedlabels")["RandomForest"].alias("rf_label"),
        F.col("predictedlabels")["NaiveBayes"].alias("nb_label"), "pending")


def stream_accounts(spark, sf):
    """What the ingest stream made of every message, in three micro-batches, by outcome."""
    base = fresh_path(spark, "accounts")
    lines = fx.faulty_json_lines(spark, sf)
    # as many files as the input has parts, a third of them a micro-batch: no file holds a third of all lines
    files = PARTS * max(1, -(-lines.rdd.getNumPartitions() // PARTS))
    lines.repartition(files).write.text(f"{base}/topic")
    query = start_calibration_ingest(spark, file_topic(spark, f"{base}/topic", files // PARTS), f"{base}/table", f"{base}/quarantine",
                                     f"{base}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination()
    return read_accounts(spark, f"{base}/table").groupBy("source", "outcome").agg(F.sum("n").alias("n"))


def archived_topic_ingest(spark, sf):
    """A topic's archive through the ingest stream, some segments a micro-batch: keys and labels of the
    stored packets. Keys follow from topic, partition and offset alone."""
    base = fresh_path(spark, "archive")
    archive(fx.archived_messages(spark, sf), f"{base}/topic", 100_000)
    query = start_calibration_ingest(spark, archived_topic(spark, f"{base}/topic", 4), f"{base}/table", f"{base}/quarantine",
                                     f"{base}/checkpoint", trigger={"availableNow": True})
    query.awaitTermination()
    return tables.read_packets(spark, f"{base}/table").select("pk", "calibrationid", "userid", "label")


def cycle_reports(spark, sf):
    """The metrics table that a cycle over stored tables leaves, with the report's user, time and run; and
    what the session table says after it."""
    base = fresh_path(spark, "cycle")
    paths = tables.TablePaths(**{k: f"{base}/{k}" for k in (
        "calibrations", "packets", "instructions", "registry", "metrics", "status")})
    fx.calibrations(spark, sf).write.parquet(paths.calibrations)
    for i, part in enumerate(_in_parts(fx.calibration_packets(spark, sf), 2)):
        tables.write_packets(part, paths.packets, f"batch_{i:012d}")
    jobs.run_cycle(spark, paths, model_types=["nb"])
    report = tables.read_parquet(spark, paths.metrics)
    ready = tables.read_calibrations(spark, paths.calibrations).select("calibrationid", "modelsgenerated")
    rows = report.join(ready, "calibrationid").withColumns(
        {"has_time": F.col("trained_at").isNotNull(), "has_run": F.col("run").isNotNull()})
    return present(rows.select("calibrationid", "userid", "model", "metric", "class", "value", "modelsgenerated",
                               "has_time", "has_run"))


def packet_keys(spark, sf):
    """Keys of packets from their source coordinates (topic, partition and offset, as text)."""
    p = fx.calibration_packets(spark, sf).select("pk", F.split("pk", "-").alias("part"))
    coords = F.array(F.lit("kafka"), F.lit("calibration"), (F.col("part")[0].cast("bigint") % 4).cast("string"),
                     F.concat(F.col("part")[0], F.col("part")[1]))
    return p.select("pk", packet_key(coords).alias("packet_key"))


def label_numbers(spark, sf):
    """The fixed class number of every packet's label (an unknown one is 0), and back."""
    p = fx.faulty_calibration_packets(spark, sf).select("pk", "label", fixed_label_number("label").alias("number"))
    return p.select("pk", "label", "number", fixed_label_name("number").alias("name"))


def whole_pipeline(spark, sf):
    """M4/K5: a perceptron trained on all packets as one session, saved as a whole pipeline, loaded and applied to
    raw packets: for each test packet, whether its label name is the one that the training run predicted."""
    cal, packets = fx.single_session(spark, sf)
    run = jobs.train_pending(spark, cal, packets, model_types=["mlp"])
    path = fresh_path(spark, "whole-models")
    save_whole_models(spark, run.registry, path)
    folder = run.registry.first()["model_path"].rsplit("/", 2)[1:]
    loaded = PipelineModel.load("/".join([path, *folder]))
    ours = loaded.transform(packets.select("pk", "features")).select("pk", "predicted_label")
    labels = run.registry.select("calibrationid", "labels")
    given = jobs.read_pairs(spark, run.root).join(labels, "calibrationid").select("pk", decode("predicted").alias("given"))
    return given.join(ours, "pk", "left").select("pk", F.col("given").eqNullSafe(F.col("predicted_label")).alias("same"))


STATE_QUERIES = {f.__name__: f for f in (
    nb_train_incremental, label_index_incremental, channel_index_incremental, invalid_packets_stored, session_packets_pruned,
    waiting_instructions, current_models_merged, reclassify_waiting, stream_accounts, archived_topic_ingest, cycle_reports, packet_keys,
    label_numbers, whole_pipeline)}
