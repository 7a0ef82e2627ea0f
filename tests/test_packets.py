"""JSON parsing, quarantine reasons, vectors and keys."""

from pyspark.sql import functions as F

from sigclass.functions.packets import channel_values, packet_key, parse_labelled, parse_unlabelled, vector_ok


def _lines(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_labelled_good_and_bad(spark):
    good = '{"DataPacketValue":["1.5","2","3","4","5","6"],"Label":"Deep","userId":"u","calibrationId":"c"}'
    nums = '{"DataPacketValue":[1.5,2,3,4,5,6],"Label":"Deep","userId":"u","calibrationId":"c"}'
    rows = parse_labelled(_lines(
        spark, good, nums,
        '{"DataPacketValue":["1","2"',                                             # malformed
        '{"DataPacketValue":["1","2","3"],"Label":"Deep","userId":"u","calibrationId":"c"}',
        '{"DataPacketValue":["1","x","3","4","5","6"],"Label":"Deep","userId":"u","calibrationId":"c"}',
        '{"DataPacketValue":["1","NaN","3","4","5","6"],"Label":"Deep","userId":"u","calibrationId":"c"}',
        '{"DataPacketValue":["1","2","3","4","5","6"],"userId":"u","calibrationId":"c"}',
        '{"DataPacketValue":["1","2","3","4","5","6"],"Label":"Sleepy","userId":"u","calibrationId":"c"}',
        '{"DataPacketValue":["1","2","3","4","5","6"],"Label":"Deep","calibrationId":"c"}',
    )).select("reason", "features").collect()
    reasons = [r["reason"] for r in rows]
    assert reasons == [None, None, "malformed json", "channel count is not 6",
                       "channel value is not a finite number", "channel value is not a finite number",
                       "missing Label", "unknown Label", "missing userId"]
    assert rows[0]["features"] == [1.5, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert rows[1]["features"] == rows[0]["features"]  # numbers accepted like strings


def test_unlabelled_counts_add_up(spark):
    from sigclass.sources import fixtures as fx
    from tests.conftest import SF001
    lines = fx.unlabelled_json_lines(spark, SF001)
    p = parse_unlabelled(lines)
    n = lines.count()
    good = p.where("reason is null").count()
    bad = p.where("reason is not null").count()
    errors = fx.table(spark, SF001, "events").where("event_type = 'error'").count()
    assert good + bad == n and bad == errors


def test_vectors_and_keys(spark):
    df = spark.createDataFrame([(["1", "2", "3", "4", "5", "6"],), (["1", "inf", "3", "4", "5", "6"],),
                                (None,)], "eeg array<string>")
    out = df.select(vector_ok(channel_values("eeg")).alias("ok")).collect()
    assert [r["ok"] for r in out] == [True, False, False]
    k = spark.createDataFrame([(["kafka", "t", "0", "17"],)], "coords array<string>") \
        .select(packet_key("coords").alias("k")).collect()[0]["k"]
    k2 = spark.createDataFrame([(["kafka", "t", "0", "17"],)], "coords array<string>") \
        .select(packet_key(F.col("coords")).alias("k")).collect()[0]["k"]
    assert k == k2 and len(k) == 64


def test_fixed_label_forms(spark):
    """P9/P10 in the application's fixed form (index into Shallow, Medium, Deep; unknown -> 0)."""
    from sigclass.functions.labels import fixed_label_name, fixed_label_number
    df = spark.createDataFrame([("Shallow",), ("Medium",), ("Deep",), ("Other",)], "l string")
    nums = [r[0] for r in df.select(fixed_label_number("l")).collect()]
    assert nums == [0.0, 1.0, 2.0, 0.0]
    names = [r[0] for r in df.select(fixed_label_name(fixed_label_number("l"))).collect()]
    assert names == ["Shallow", "Medium", "Deep", "Shallow"]
