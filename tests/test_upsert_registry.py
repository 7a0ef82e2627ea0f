"""K3/K4 upserts, M10 current model per user."""

import datetime as dt

from sigclass.operators import registry, upsert


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    upd = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    out = {r["k"]: r["v"] for r in upsert.upsert(cur, upd, "k").collect()}
    assert out == {"a": 1, "b": 20, "c": 30}


def test_mark_models_generated(spark):
    t = dt.datetime(2024, 1, 1)
    cal = spark.createDataFrame([("a", "u", t, t, False), ("b", "u", t, t, None)],
                                "calibrationid string, userid string, startdate timestamp, "
                                "enddate timestamp, modelsgenerated boolean")
    ok = spark.createDataFrame([("b",)], "calibrationid string")
    out = {r["calibrationid"]: r["modelsgenerated"] for r in upsert.mark_models_generated(cal, ok).collect()}
    assert out == {"a": False, "b": True}


def test_current_per_user_newest_then_highest_id(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    reg = spark.createDataFrame([("u1", "1", t1, "nb"), ("u1", "2", t2, "nb"), ("u2", "8", t1, "nb"),
                                 ("u2", "9", t1, "nb"), ("u3", "5", t1, "rf")],
                                "userid string, calibrationid string, enddate timestamp, model_type string")
    cur = {(r["userid"], r["model_type"]): r["calibrationid"]
           for r in registry.current_per_user(reg).collect()}
    assert cur == {("u1", "nb"): "2", ("u2", "nb"): "9", ("u3", "rf"): "5"}


def test_versioned_table_and_compaction(spark):
    """Appended versions are read as last-write-wins; compact() rewrites exactly that view."""
    from sigclass.operators.upsert import append_version, compact
    from sigclass.session import fresh_path
    from sigclass.sources.tables import read_parquet
    base = fresh_path(spark, "t-compact")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(f"{base}/t")
    append_version(spark.createDataFrame([("b", 20)], "k string, v int"), f"{base}/t", 5)
    append_version(spark.createDataFrame([("b", 200), ("c", 3)], "k string, v int"), f"{base}/t", 7)
    append_version(spark.createDataFrame([("b", 200), ("c", 3)], "k string, v int"), f"{base}/t", 7)  # re-run
    compact(spark, f"{base}/t", "k", f"{base}/c")
    got = {r["k"]: r["v"] for r in read_parquet(spark, f"{base}/c").collect()}
    assert got == {"a": 1, "b": 200, "c": 3}
