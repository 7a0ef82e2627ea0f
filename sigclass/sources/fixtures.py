"""Stand-in inputs built from the driver's read-only tables.

These adapters only reshape rows of the given tables into the schemas the
jobs expect (sessions, labelled packets, unlabelled packets, JSON lines).
They do none of the jobs' work; every job must be right on any data of the
same schema. The mapping rules are the ones written down in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _channels_as_strings(*cols: Column) -> Column:
    """Six double columns -> array<string>, the stored packet form."""
    return F.array(*[c.cast("double").cast("string") for c in cols])


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per supplier; every tenth still running, every third ready."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = spread(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate"))
    # the dates of a supplier first, so that the lines themselves are neither shuffled nor sorted
    dates = li.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("startdate"), F.max("l_shipdate").alias("maxdate"))
    g = s.distinct().join(dates, s.s_suppkey == dates.l_suppkey, "left")
    return g.select(
        F.col("s_suppkey").cast("string").alias("calibrationid"),
        F.col("s_nationkey").cast("string").alias("userid"),
        F.col("startdate"),
        F.when(F.col("s_suppkey") % 10 == 0, F.lit(None)).otherwise(F.col("maxdate"))
        .alias("enddate"),
        (F.col("s_suppkey") % 3 == 0).alias("modelsgenerated"),
    )


def calibration_packet_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled packets with the six channels still as doubles c0..c5."""
    li = spread(table(spark, sf_dir, "lineitem"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    pk = F.concat_ws("-", *[F.col(c).cast("string") for c in
                            ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                     F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return j.select(
        pk.alias("pk"),
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("string").alias("calibrationid"),
        F.col("s_nationkey").cast("string").alias("userid"),
        F.when(F.col("l_returnflag") == "N", "Shallow")
        .when(F.col("l_returnflag") == "A", "Medium").otherwise("Deep").alias("label"),
        F.col("l_quantity").alias("c0"),
        (F.col("l_extendedprice") / 1000).alias("c1"),
        F.round(F.col("l_discount") * 100).alias("c2"),
        F.round(F.col("l_tax") * 100).alias("c3"),
        ((F.col("l_linenumber") % 4) * 10).cast("double").alias("c4"),
        (F.col("l_partkey") % 97).cast("double").alias("c5"),
    )


def calibration_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored labelled packet table: pk, date, eeg array<string>, label, userid, calibrationid,
    features array<double> (the parsed vector the ingest stores beside the strings)."""
    c = calibration_packet_channels(spark, sf_dir)
    return c.select("pk", "date",
                    _channels_as_strings(*[F.col(f"c{i}") for i in range(6)]).alias("eeg"),
                    "label", "userid", "calibrationid",
                    F.array(*[F.col(f"c{i}") for i in range(6)]).alias("features"))


def instruction_packet_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled packets from events (users 0-24), channels as doubles c0..c5."""
    e = spread(table(spark, sf_dir, "events"))
    return e.select(
        F.col("event_id").cast("string").alias("pk"),
        F.col("ts").alias("date"),
        (F.col("user_id") % 25).cast("string").alias("userid"),
        (F.col("event_id") % 50 + 1).cast("double").alias("c0"),
        F.col("value").alias("c1"),
        (F.col("event_id") % 11).cast("double").alias("c2"),
        (F.col("event_id") % 9).cast("double").alias("c3"),
        ((F.col("event_id") % 4) * 10).cast("double").alias("c4"),
        (F.col("user_id") % 97).cast("double").alias("c5"),
        (F.col("event_type") == "error").alias("malformed"),
    )


def instruction_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled packets as ingested: pk, date, eeg array<string>, userid, features array<double>."""
    c = instruction_packet_channels(spark, sf_dir)
    return c.select("pk", "date",
                    _channels_as_strings(*[F.col(f"c{i}") for i in range(6)]).alias("eeg"),
                    "userid", F.array(*[F.col(f"c{i}") for i in range(6)]).alias("features"))


def faulty_calibration_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled packets of which some cannot be used: by order number and session, a value that is not
    a number, five channels, an unknown label or none."""
    p = calibration_packets(spark, sf_dir)
    order = F.split("pk", "-")[0].cast("bigint") % 50
    bad = (F.col("calibrationid").cast("bigint") % 4 == 1) & (order == 0)
    features = (F.when(bad, F.concat(F.slice("features", 1, 5), F.array(F.lit(float("nan")))))
                .when(order == 1, F.slice("features", 1, 5)).otherwise(F.col("features")))
    label = F.when(order == 2, F.lit("Asleep")).when(order != 3, F.col("label"))
    return p.withColumns({"features": features, "label": label}).withColumn(
        "eeg", F.transform("features", lambda x: x.cast("string")))


def sessions_with_a_negative_one(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All sessions and packets, and one finished session more whose channels are negative."""
    e = embedding_packets(spark, sf_dir)
    c = e.select("calibrationid", "userid").distinct().select(
        "calibrationid", "userid", F.lit(None).cast("timestamp_ntz").alias("startdate"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("enddate"), F.lit(False).alias("modelsgenerated"))
    cal = calibrations(spark, sf_dir)
    c = c.select(*[F.col(x).cast(t).alias(x) for x, t in cal.dtypes])
    pk = calibration_packets(spark, sf_dir)
    e = e.select(*[F.col(x).cast(t).alias(x) for x, t in pk.dtypes])
    return cal.unionByName(c), pk.unionByName(e)


def instruction_packets_some_without_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled packets, of which every tenth has no user."""
    p = instruction_packets(spark, sf_dir)
    return p.withColumn("userid", F.when(F.col("pk").cast("bigint") % 10 != 3, F.col("userid")))


def stored_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored instruction rows: a third classified, a third with one entry and the rest with none."""
    from sigclass.schemas import MAP_KEYS, PLACEHOLDER
    p = instruction_packets(spark, sf_dir)
    turn = F.col("pk").cast("bigint") % 3

    def entry(known):
        return F.when(known, F.lit("Deep")).otherwise(F.lit(PLACEHOLDER))
    labels = F.create_map(F.lit(MAP_KEYS["rf"]), entry(turn < 2), F.lit(MAP_KEYS["mlp"]), entry(turn == 0),
                          F.lit(MAP_KEYS["nb"]), entry(turn == 0))
    return p.withColumns({"predictedlabels": labels, "pending": turn != 0})


def labelled_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled packets as the JSON messages of the calibration topic (column ``value``)."""
    p = calibration_packets(spark, sf_dir)
    return p.select(F.to_json(F.struct(
        F.col("eeg").alias("DataPacketValue"), F.col("label").alias("Label"),
        F.col("userid").alias("userId"), F.col("calibrationid").alias("calibrationId")))
        .alias("value"))


def archived_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration topic's messages as an archive has them: partition and offset from order and line."""
    p = calibration_packets(spark, sf_dir).withColumn("part", F.split("pk", "-"))
    order, line = F.col("part")[0].cast("bigint"), F.col("part")[1].cast("bigint")
    return p.select(F.lit("calibration").alias("topic"), (order % 4).cast("int").alias("partition"),
                    (order * 10 + line).alias("offset"), F.to_json(F.struct(
                        F.col("eeg").alias("DataPacketValue"), F.col("label").alias("Label"),
                        F.col("userid").alias("userId"), F.col("calibrationid").alias("calibrationId"))).alias("value"))


def faulty_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets of ``faulty_calibration_packets`` as messages; those of every 50th order are cut short."""
    p = faulty_calibration_packets(spark, sf_dir)
    js = F.to_json(F.struct(F.col("eeg").alias("DataPacketValue"), F.col("label").alias("Label"),
                            F.col("userid").alias("userId"), F.col("calibrationid").alias("calibrationId")))
    cut = F.split("pk", "-")[0].cast("bigint") % 50 == 7
    return p.select(js.alias("js"), cut.alias("cut")).select(
        F.when(F.col("cut"), F.expr("substring(js, 1, length(js) - 7)")).otherwise(F.col("js")).alias("value"))


def unlabelled_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled packets as JSON messages; rows of error events are cut short (malformed)."""
    c = instruction_packet_channels(spark, sf_dir)
    js = F.to_json(F.struct(
        _channels_as_strings(*[F.col(f"c{i}") for i in range(6)]).alias("DataPacketValue"),
        F.col("userid").alias("userId")))
    return c.select(js.alias("js"), "malformed").select(
        F.when(F.col("malformed"), F.expr("substring(js, 1, length(js) - 7)"))
        .otherwise(F.col("js")).alias("value"))


def embedding_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with negative channels: first six embedding floats, label index label % 3."""
    from sigclass.schemas import LABELS
    e = table(spark, sf_dir, "embeddings")
    labels = F.array(*[F.lit(x) for x in LABELS])
    return e.select(
        F.concat(F.lit("emb-"), F.col("vec_id").cast("string")).alias("pk"),
        F.lit(None).cast("timestamp_ntz").alias("date"),
        F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double").cast("string")).alias("eeg"),
        F.element_at(labels, (F.col("label") % 3 + 1).cast("int")).alias("label"),
        F.lit("emb").alias("userid"),
        F.lit("emb").alias("calibrationid"),
        F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("features"),
    )


def single_session(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All labelled packets as one finished session (the published reports' workload shape:
    one user, one large session). Returns (calibrations, packets)."""
    p = calibration_packets(spark, sf_dir).withColumn("calibrationid", F.lit("all")) \
        .withColumn("userid", F.lit("u0"))
    c = p.groupBy("calibrationid", "userid").agg(
        F.min("date").alias("startdate"), F.max("date").alias("enddate")) \
        .withColumn("modelsgenerated", F.lit(False))
    return c, p
