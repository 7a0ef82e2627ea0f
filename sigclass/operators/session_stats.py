"""Statistics of sessions that are kept up as packets arrive, and merged instead of scanning packets.

Each micro-batch (and each compaction) leaves three small tables beside its packets:

- ``profile``: what ``prepare.session_profile`` gives for the part: per session the rows by label, the packets
  that cannot be used, and an estimate of each channel's number of values;
- ``values``: what ``prepare.fit_pass`` gives for it: per session, label and side of the split the rows, sums
  and minima, and the counts of each value of the channels that may be categorical;
- ``invalid``: the packets that cannot be used, by session and reason.

They merge by addition, so the merged tables equal those of one scan over all packets. A channel with at most
``MAX_CATEGORIES`` values in a session has no more in any part of it, so no part's estimate rules it out and its
values are in every part's table; the merged values are then counted exactly. A channel that one part rules
out is dropped. So sets of at most six values stand where sketches would have to be merged: they are
exact, smaller, and the aggregates stay compiled hash aggregates.

A part has a few rows for each session that occurs in it, whatever its number of packets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.operators import prepare
from sigclass.schemas import LABELS, MAX_CATEGORIES, N_CHANNELS, TRAIN_PERCENT

def write_part(frame: DataFrame, path: str, n_channels: int = N_CHANNELS, train_percent: int = TRAIN_PERCENT) -> None:
    """The statistics of one part of the packets (a frame of ``prepare.packet_frame``)."""
    spark = frame.sparkSession
    prepare.session_profile(frame, n_channels).write.mode("overwrite").parquet(f"{path}/profile")
    profile = spark.read.parquet(f"{path}/profile")
    prepare.fit_pass(frame, profile, MAX_CATEGORIES, n_channels, train_percent).write.mode("overwrite").parquet(f"{path}/values")
    # the ingest stores usable packets only: then there is nothing to look for
    some = bool(profile.agg(F.sum("n_invalid")).first()[0])
    prepare.invalid_packets(frame if some else frame.limit(0)).write.mode("overwrite").parquet(f"{path}/invalid")


@dataclass
class SessionStatistics:
    """The parts' statistics, merged for some sessions."""
    spark: SparkSession
    paths: list[str]
    n_channels: int = N_CHANNELS

    def _parts(self, kind: str, sessions: DataFrame) -> DataFrame:
        parts = self.spark.read.parquet(*[f"{p}/{kind}" for p in self.paths])
        return parts.join(sessions.select("calibrationid"), "calibrationid", "left_semi")

    def profile(self, sessions: DataFrame) -> DataFrame:
        """What ``prepare.session_profile`` gives for the sessions' packets; of a channel's estimates the largest."""
        of = lambda lab: F.get(F.filter("label_counts", lambda e: e["label"] == lab), F.lit(0))["n"]
        merged = self._parts("profile", sessions).groupBy("calibrationid").agg(
            *[F.coalesce(F.sum(of(lab)), F.lit(0)).alias(f"l{i}") for i, lab in enumerate(LABELS)],
            *[F.max(F.get("approx_distinct", F.lit(j))).alias(f"d{j}") for j in range(self.n_channels)],
            F.sum("n_invalid").alias("n_invalid"), F.sum("n_not_finite").alias("n_not_finite"))
        counts = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"l{i}").alias("n")) for i, lab in enumerate(LABELS)])
        return merged.select("calibrationid", F.filter(counts, lambda e: e["n"] > 0).alias("label_counts"),
                             F.array(*[F.col(f"d{j}") for j in range(self.n_channels)]).alias("approx_distinct"),
                             "n_invalid", "n_not_finite")

    def merged_values(self, sessions: DataFrame) -> DataFrame:
        aggs = [F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(self.n_channels)],
                *[F.min(f"m{i}").alias(f"m{i}") for i in range(self.n_channels)]]
        return self._parts("values", sessions).groupBy("calibrationid", "label", "is_train", "channel", "value").agg(*aggs)

    def fit_summary(self, sessions: DataFrame, profile: DataFrame, max_categories: int = MAX_CATEGORIES) -> DataFrame:
        """What ``prepare.fit_pass`` gives for the sessions' packets."""
        may_be = prepare.channel_candidates(profile, max_categories)
        return self.merged_values(sessions).join(may_be, "calibrationid").where(
            (F.col("channel") < 0) | F.array_contains("cand", F.col("channel"))).drop("cand")

    def invalid(self, sessions: DataFrame) -> DataFrame:
        """What ``prepare.invalid_packets`` gives for the sessions' packets."""
        return self._parts("invalid", sessions).groupBy("calibrationid", "reason").agg(F.sum("n").alias("n"))

    def write_merged(self, path: str) -> None:
        """All parts as one (for compaction)."""
        everyone = self.spark.read.parquet(*[f"{p}/profile" for p in self.paths]).select("calibrationid").distinct()
        self.profile(everyone).write.mode("overwrite").parquet(f"{path}/profile")
        self.merged_values(everyone).write.mode("overwrite").parquet(f"{path}/values")
        self.invalid(everyone).write.mode("overwrite").parquet(f"{path}/invalid")
