"""F1-F2, J1, J3, A1-A3, P7-P8 edge cases."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigclass.operators import prepare

TS = dt.datetime(2024, 1, 1)


def _frame(spark, rows):
    """rows: (calibrationid, label, [6 doubles])"""
    df = spark.createDataFrame([(f"p{i}", c, "u", lab, [str(x) for x in v], [float(x) for x in v])
                                for i, (c, lab, v) in enumerate(rows)],
                               "pk string, calibrationid string, userid string, label string, "
                               "eeg array<string>, features array<double>")
    return df.withColumn("valid", F.lit(True))


def test_eligibility_and_semi_join(spark):
    cal = spark.createDataFrame(
        [("a", "u", TS, TS, False), ("b", "u", TS, None, False), ("c", "u", TS, TS, True),
         ("d", "u", TS, TS, None), ("e", "u", TS, TS, False)],
        "calibrationid string, userid string, startdate timestamp, enddate timestamp, modelsgenerated boolean")
    assert sorted(r[0] for r in prepare.eligible_calibrations(cal).select("calibrationid").collect()) \
        == ["a", "d", "e"]
    packets = spark.createDataFrame([("p1", "a"), ("p2", "d"), ("p3", "b")], "pk string, calibrationid string")
    assert sorted(r[0] for r in prepare.trainable_calibrations(cal, packets).select("calibrationid")
                  .collect()) == ["a", "d"]


def test_label_index_ties_alphabetical(spark):
    rows = [("s", "Medium", [1] * 6), ("s", "Deep", [1] * 6), ("s", "Shallow", [1] * 6),
            ("s", "Shallow", [1] * 6)]
    li = {r["label"]: r["label_idx"] for r in prepare.label_index_fit(_frame(spark, rows)).collect()}
    assert li == {"Shallow": 0.0, "Deep": 1.0, "Medium": 2.0}


def test_channel_index_zero_first_and_threshold(spark):
    six = [-3.0, 0.0, 2.0, 5.0, 7.0, 9.0]
    seven = six + [11.0]
    rows = [("s", "Deep", [v, seven[i], -0.0 if i == 0 else 0.0, 1, 2, 3]) for i, v in enumerate(six)]
    rows += [("s", "Deep", [9.0, 11.0, 0.0, 1, 2, 3])]
    ci = prepare.channel_index_fit(_frame(spark, rows)).collect()
    by = {}
    for r in ci:
        by.setdefault(r["channel"], {})[r["value"]] = r["code"]
    assert by[0] == {0.0: 0.0, -3.0: 1.0, 2.0: 2.0, 5.0: 3.0, 7.0: 4.0, 9.0: 5.0}
    assert 1 not in by  # seven distinct values -> continuous
    assert by[2] == {0.0: 0.0}  # -0.0 and 0.0 are one value
    assert by[3] == {1.0: 0.0} and by[4] == {2.0: 0.0}


def test_apply_categories_unseen_gets_k(spark):
    df = spark.createDataFrame([([0.0, 10.0, 99.0],)], "f array<double>").withColumn(
        "m", F.create_map(F.lit(1), F.create_map(F.lit(10.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)),
                          F.lit(2), F.create_map(F.lit(5.0), F.lit(0.0))))
    out = df.select(prepare.apply_categories("f", "m", n_channels=3).alias("x")).collect()[0]["x"]
    assert out == [0.0, 1.0, 1.0]  # channel 0 continuous; channel 2 unseen -> k = 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=6,
                unique=True))
def test_hll_never_rules_out_a_categorical_channel(spark, values):
    """approx_count_distinct <= MAX_CATEGORIES whenever the true count is (the prefilter is exact)."""
    df = spark.createDataFrame([(float(v),) for v in values * 3], "x double")
    est = df.agg(F.approx_count_distinct(F.col("x") + F.lit(0.0)).alias("e")).collect()[0]["e"]
    assert est <= 6


def test_training_frame_marks_invalid(spark):
    cal = spark.createDataFrame([("s", "u", TS, TS, False)],
                                "calibrationid string, userid string, startdate timestamp, "
                                "enddate timestamp, modelsgenerated boolean")
    pk = spark.createDataFrame([("p1", "s", "u", "Deep", ["1", "2", "3", "4", "5", "6"]),
                                ("p2", "s", "u", "Deep", ["1", "2", "3"]),
                                ("p3", "s", "u", "Other", ["1", "2", "3", "4", "5", "6"])],
                               "pk string, calibrationid string, userid string, label string, eeg array<string>")
    v = {r["pk"]: r["valid"] for r in prepare.training_frame(cal, pk).collect()}
    assert v == {"p1": True, "p2": False, "p3": False}


def test_stored_table_without_vectors_is_parsed(spark):
    """Packets stored with the strings only are parsed when they are read, whatever their neighbours have."""
    from sigclass.session import fresh_path
    from sigclass.sources import tables
    base = fresh_path(spark, "t-legacy")
    rows = [("p1", TS, ["1", "2", "3", "4", "5", "6"], "Deep", "u", "s", None),
            ("p2", TS, ["1", "2", "3"], "Deep", "u", "s", None), ("p3", TS, ["1", "2", "x", "4", "5", "6"], "Deep", "u", "s", None),
            ("p4", TS, ["1", "2", "3", "4", "5", "6"], "Deep", "u", "s", [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]),
            ("p5", TS, None, "Deep", "u", "s", None)]
    columns = "pk string, date timestamp_ntz, eeg array<string>, label string, userid string, calibrationid string"
    spark.createDataFrame([r[:6] for r in rows[:3]], columns).write.parquet(f"{base}/pk/old")
    spark.createDataFrame(rows[3:], columns + ", features array<double>").write.parquet(f"{base}/pk/new")
    cal = spark.createDataFrame([("s", "u", TS, TS, False)],
                                "calibrationid string, userid string, startdate timestamp_ntz, "
                                "enddate timestamp_ntz, modelsgenerated boolean")
    got = {r["pk"]: (r["features"], r["reason"]) for r in prepare.training_frame(
        cal, tables.read_packets(spark, f"{base}/pk")).collect()}
    assert got["p1"] == ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None) and got["p4"] == ([6.0, 5.0, 4.0, 3.0, 2.0, 1.0], None)
    assert got["p2"][1] == "channel count is not 6" and got["p3"][1] == "channel value is not a finite number"
    assert got["p5"][1] == "missing DataPacketValue"
    tables.compact_packets(spark, f"{base}/pk", f"{base}/compact")
    fr = prepare.training_frame(cal, tables.read_session_packets(spark, f"{base}/compact", cal)).collect()
    assert {r["pk"]: r["reason"] for r in fr} == {k: v[1] for k, v in got.items()}


def test_random_split_forms(spark):
    """R1 (seeded) and R2 (fresh seed): every row on one side, however it is partitioned; seeded repeats."""
    from sigclass.functions.split import random_split
    df = spark.range(2000).withColumnRenamed("id", "pk")
    for seed in (1234, None):
        split = random_split(df, seed=seed)
        assert split.count() == 2000
        assert 0.5 < split.where("is_train").count() / 2000 < 0.7
    a, b = random_split(df, seed=1234), random_split(df.repartition(7), seed=1234)
    assert a.exceptAll(b).count() == 0
    assert random_split(df, seed=1).exceptAll(a).count() > 0


def test_invalid_packets_are_counted_and_fail_naive_bayes(spark):
    from sigclass.plans.flow import Flow
    good = [float(x) for x in range(1, 7)]
    rows = [("a", "Deep", good), ("a", "Shallow", good)] * 20 + [("a", "Deep", good[:5] + [float("nan")]), ("a", "Other", good)]
    rows += [("b", "Deep", good), ("b", "Medium", good)] * 20 + [("b", None, good), ("b", "Deep", good[:5])]
    rows += [("c", "Deep", good[:3])] * 4
    pk = spark.createDataFrame([(f"p{i}", c, "u", lab, v) for i, (c, lab, v) in enumerate(rows)],
                               "pk string, calibrationid string, userid string, label string, features array<double>")
    cal = spark.createDataFrame([(c, "u", TS, TS, False) for c in "abcd"],
                                "calibrationid string, userid string, startdate timestamp_ntz, "
                                "enddate timestamp_ntz, modelsgenerated boolean")
    fl = Flow(cal, pk)
    bad = {(r["calibrationid"], r["reason"]): r["n"] for r in prepare.invalid_packets(fl.frame).collect()}
    assert bad == {("a", "channel value is not a finite number"): 1, ("a", "unknown Label"): 1,
                   ("b", "missing Label"): 1, ("b", "channel count is not 6"): 1, ("c", "channel count is not 6"): 4}
    status = {r["calibrationid"]: (r["ok"], r["error"]) for r in fl.nb_status().collect()}
    assert status == {"a": (False, "feature that is not finite"), "b": (True, None), "c": (False, "no training rows")}


def test_compacted_table_is_read_by_bucket(spark):
    from sigclass.session import fresh_path
    from sigclass.sources import fixtures as fx
    from sigclass.sources import tables
    from tests.conftest import SF001
    base = fresh_path(spark, "t-compact-packets")
    packets = fx.calibration_packets(spark, SF001)
    packets.write.parquet(f"{base}/raw")
    tables.compact_packets(spark, f"{base}/raw", f"{base}/by_session")
    one = spark.createDataFrame([("7",)], "calibrationid string")
    got = tables.read_session_packets(spark, f"{base}/by_session", one, broadcast=True)
    plan = got.select("pk", "features")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "eeg" not in plan
    assert sorted(r[0] for r in got.select("pk").collect()) == sorted(
        r[0] for r in packets.where("calibrationid = '7'").select("pk").collect())
