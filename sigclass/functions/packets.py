"""Packet parsing, vectors and keys — column expressions only (no UDFs).

P1/P2 parse the topic payloads with ``from_json`` against a fixed schema;
P3 turns the stored ``array<string>`` channels into ``array<double>``; P4
stamps a replay-stable key and the ingest clock. A row that cannot become a
valid packet gets a non-null ``reason`` and is routed to quarantine by the
caller; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.schemas import LABELLED_MESSAGE, LABELS, N_CHANNELS, UNLABELLED_MESSAGE

NOT_FINITE = "channel value is not a finite number"
_JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def channel_values(eeg: Column | str = "eeg") -> Column:
    """array<string> -> array<double>; an unparseable element becomes NULL."""
    c = F.col(eeg) if isinstance(eeg, str) else eeg
    return F.transform(c, lambda x: x.try_cast("double"))


def stored_vector(packets: DataFrame) -> Column:
    """The vector of stored packets, parsed from the strings where it is NULL. Vectors that cannot be NULL,
    and those of a table without strings, are taken as they are."""
    if "features" not in packets.columns:
        return channel_values("eeg")
    if "eeg" not in packets.columns or not packets.schema["features"].nullable:
        return F.col("features")
    return F.coalesce(F.col("features"), channel_values("eeg"))


def vector_ok(values: Column | str = "features", width: int = N_CHANNELS) -> Column:
    """True when the vector has ``width`` finite numbers.

    Zero times a number is zero, or NaN if it is not finite, and NULL if there is none: one sum tests all
    of them (unrolled, as lambdas are interpreted) in code that is short enough for a compiled method."""
    v = F.col(values) if isinstance(values, str) else values
    zero = F.get(v, F.lit(0)) * F.lit(0.0)
    for j in range(1, width):
        zero = zero + F.get(v, F.lit(j)) * F.lit(0.0)
    return F.coalesce(v.isNotNull() & (F.size(v) == width) & (zero == 0.0), F.lit(False))


def vector_reason(values: Column | str = "features", width: int = N_CHANNELS) -> Column:
    """Why a channel vector is unusable (NULL when it is fine)."""
    v = F.col(values) if isinstance(values, str) else values
    return (F.when(v.isNull(), F.lit("missing DataPacketValue"))
            .when(F.size(v) != width, F.lit("channel count is not %d" % width))
            .when(~vector_ok(v, width), F.lit(NOT_FINITE)))


def packet_reason(features: Column | str = "features", label: Column | str = "label") -> Column:
    """Why a labelled packet cannot be used (NULL when it can)."""
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(vector_reason(features), F.when(label.isNull(), F.lit("missing Label"))
                      .when(~label.isin(*LABELS), F.lit("unknown Label")))


def with_features(df: DataFrame, eeg: str = "eeg", out: str = "features") -> DataFrame:
    """Add the parsed channel vector."""
    return df.withColumn(out, channel_values(eeg))


def packet_key(coords: Column | str = "coords") -> Column:
    """Replay-stable key from the source coordinates array (topic, partition, offset, ...)."""
    c = F.col(coords) if isinstance(coords, str) else coords
    return F.sha2(F.array_join(c, "|"), 256)


def parse_labelled(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON payload -> (eeg, label, userid, calibrationid, features, reason, raw)."""
    m = F.from_json(F.col(value).cast("string"), LABELLED_MESSAGE, _JSON_OPTS)
    p = df.withColumn("_m", m).withColumn("raw", F.col(value).cast("string"))
    p = p.select(
        "*",
        F.col("_m.DataPacketValue").alias("eeg"),
        F.col("_m.Label").alias("label"),
        F.col("_m.userId").alias("userid"),
        F.col("_m.calibrationId").alias("calibrationid"),
        F.col("_m._corrupt_record").alias("_corrupt"),
    ).drop("_m")
    p = with_features(p)
    reason = (F.when(F.col("_corrupt").isNotNull(), F.lit("malformed json"))
              .otherwise(packet_reason("features", "label")))
    reason = (F.when(reason.isNotNull(), reason)
              .when(F.col("userid").isNull(), F.lit("missing userId"))
              .when(F.col("calibrationid").isNull(), F.lit("missing calibrationId")))
    return p.withColumn("reason", reason).drop("_corrupt")


def parse_unlabelled(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON payload -> (eeg, userid, features, reason, raw)."""
    m = F.from_json(F.col(value).cast("string"), UNLABELLED_MESSAGE, _JSON_OPTS)
    p = df.withColumn("_m", m).withColumn("raw", F.col(value).cast("string"))
    p = p.select(
        "*",
        F.col("_m.DataPacketValue").alias("eeg"),
        F.col("_m.userId").alias("userid"),
        F.col("_m._corrupt_record").alias("_corrupt"),
    ).drop("_m")
    p = with_features(p)
    reason = (F.when(F.col("_corrupt").isNotNull(), F.lit("malformed json"))
              .otherwise(vector_reason("features")))
    reason = F.when(reason.isNotNull(), reason).when(F.col("userid").isNull(),
                                                     F.lit("missing userId"))
    return p.withColumn("reason", reason).drop("_corrupt")
