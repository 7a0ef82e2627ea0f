"""T4: both streams in one application, sharing one session.

The ingest stream feeds the packet table the batch job trains on; the
scoring stream reads the registry the batch job publishes. Both are
checkpointed, so a restart resumes where each left off.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sigclass.sources.streams import file_topic, kafka_topic
from sigclass.sources.tables import TablePaths
from sigclass.streaming.ingest import start_calibration_ingest
from sigclass.streaming.scoring import start_instruction_scoring


def start_both(spark: SparkSession, paths: TablePaths, checkpoint_root: str, *,
               kafka_bootstrap: str | None = None, calibration_topic: str = "calibration",
               instruction_topic: str = "instruction", calibration_dir: str | None = None,
               instruction_dir: str | None = None, trigger: dict | None = None,
               max_offsets_per_trigger: int | None = None, max_files_per_trigger: int | None = None):
    """Start the two queries (Kafka topics, or JSON-line directories when no broker is given).

    The two limits bound a micro-batch, also the first one over a backlog.
    """
    if kafka_bootstrap:
        cal_src = kafka_topic(spark, kafka_bootstrap, calibration_topic, max_offsets_per_trigger)
        ins_src = kafka_topic(spark, kafka_bootstrap, instruction_topic, max_offsets_per_trigger)
    else:
        cal_src = file_topic(spark, calibration_dir, max_files_per_trigger)
        ins_src = file_topic(spark, instruction_dir, max_files_per_trigger)
    root = checkpoint_root.rstrip("/")
    q1 = start_calibration_ingest(spark, cal_src, paths.packets, f"{paths.packets}_quarantine",
                                  f"{root}/ingest", trigger, name="calibration_ingest")
    q2 = start_instruction_scoring(spark, ins_src, paths.instructions, f"{paths.instructions}_quarantine",
                                   f"{root}/scoring", paths.registry, trigger, name="instruction_scoring")
    return q1, q2


def run_forever(spark: SparkSession, *args, **kwargs) -> None:
    """Start both and block until either stops (its error is raised)."""
    start_both(spark, *args, **kwargs)
    spark.streams.awaitAnyTermination()
