"""Snapshots, file index, session statistics, waiting rows and current models."""

import threading

import pytest
from pyspark.sql import functions as F

from sigclass.operators import prepare, registry
from sigclass.operators.upsert import append_version
from sigclass.plans import jobs
from sigclass.plans.flow import Flow
from sigclass.plans.queries import nb_registry
from sigclass.schemas import CALIBRATION_PACKETS, INSTRUCTION_PACKETS
from sigclass.session import fresh_path
from sigclass.sources import fixtures as fx
from sigclass.sources import snapshots, tables
from tests.conftest import SF001
from tests.test_cycle import _paths, _sessions


def _rows(spark, low, high):
    return spark.range(low, high).select("id")


# ------------------------------------------------------------------ snapshots

def test_a_commit_is_seen_whole_or_not_at_all(spark):
    path = fresh_path(spark, "t-snap")
    _rows(spark, 0, 10).write.parquet(path)  # a table that was written without snapshots is taken in
    assert snapshots.read_snapshot(spark, path) is None and tables.read_parquet(spark, path).count() == 10
    snapshots.append(spark, _rows(spark, 10, 20), path, "a")
    before = snapshots.read_snapshot(spark, path)
    assert tables.read_parquet(spark, path).count() == 20
    # files that lie there but are not committed belong to no reader
    _rows(spark, 20, 30).write.parquet(f"{path}/unfinished")
    assert tables.read_parquet(spark, path).count() == 20
    snapshots.commit(spark, path, {"unfinished": {"data": ["unfinished"]}}, ["a"])
    assert tables.read_parquet(spark, path).count() == 20 and tables.read_parquet(spark, path).agg(F.max("id")).first()[0] == 29
    # an older version goes on being readable
    assert spark.read.parquet(*before.data_paths()).count() == 20
    assert spark.read.parquet(*snapshots.read_snapshot(spark, path, before.version).data_paths()).agg(F.max("id")).first()[0] == 19


def test_the_same_commit_twice_adds_nothing(spark):
    path = fresh_path(spark, "t-replay")
    for _ in range(2):
        append_version(_rows(spark, 0, 5), path, 7)
    assert tables.read_parquet(spark, path).count() == 5
    assert list(snapshots.read_snapshot(spark, path).entries) == ["v_000000000000007"]


def test_conflicts_are_found(spark):
    path = fresh_path(spark, "t-conflict")
    snapshots.append(spark, _rows(spark, 0, 5), path, "a")
    seen = snapshots.read_snapshot(spark, path)
    snapshots.commit(spark, path, {"b": {"data": ["b"]}}, ["a"])
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, {"c": {"data": ["c"]}}, ["a"])
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, {"c": {"data": ["c"]}}, expected=seen.version)
    assert list(snapshots.read_snapshot(spark, path).entries) == ["b"]


def test_writers_at_once_lose_nothing(spark):
    path = fresh_path(spark, "t-race")
    errors = []

    def write(i):
        try:
            snapshots.commit(spark, path, {f"e{i}": {"data": [f"e{i}"]}})
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = snapshots.read_snapshot(spark, path)
    assert not errors and now.version == 8 and sorted(now.entries) == [f"e{i}" for i in range(8)]


# ------------------------------------------------- file index and statistics

def _packet_table(spark, parts=4):
    """Packets of 40 sessions in arrival order: each part holds ten sessions and all of one hot one."""
    path = fresh_path(spark, "t-packets")
    _, pk = _sessions(spark, [(f"s{i:02d}", f"u{i}") for i in range(40)] + [("hot", "u")])
    n = F.substring("calibrationid", 2, 2).try_cast("int")
    for i in range(parts):
        part = pk.where((n % parts == i) | (F.col("calibrationid") == "hot") & (F.pmod(F.xxhash64("pk"), F.lit(parts)) == i))
        tables.write_packets(part.coalesce(2), path, f"batch_{i:012d}")
    return path, pk


def test_only_files_that_may_hold_the_sessions_are_read(spark):
    path, pk = _packet_table(spark)
    wanted = spark.createDataFrame([("s01",), ("s05",), ("nowhere",)], "calibrationid string")
    got = tables.read_packets_of(spark, path, wanted)
    every = set(tables.read_packets(spark, path).inputFiles())
    assert 0 < len(got.inputFiles()) < len(every) and {f.split("/")[-2][:18] for f in got.inputFiles()} == {"batch_000000000001"}
    assert got.where("calibrationid in ('s01', 's05')").count() == 120
    none = tables.read_packets_of(spark, path, wanted.where("calibrationid = 'nowhere'"))
    assert none.count() == 0
    # a session in every part: every part is read
    hot = tables.read_packets_of(spark, path, spark.createDataFrame([("hot",)], "calibrationid string"))
    assert hot.where("calibrationid = 'hot'").count() == 60
    # after compaction a session's files are few, and the old parts are no longer named
    tables.compact_packets_table(spark, path, rows_per_file=300)
    got = tables.read_packets_of(spark, path, wanted)
    assert got.where("calibrationid in ('s01', 's05')").count() == 120
    assert len(got.inputFiles()) < len(tables.read_packets(spark, path).inputFiles())
    assert tables.read_packets(spark, path).count() == pk.count()
    assert tables.compact_packets_table(spark, path) is None  # nothing to fold


def test_statistics_equal_a_scan(spark):
    path, pk = _packet_table(spark)
    bad = pk.limit(30).select(F.concat(F.lit("x"), "pk").alias("pk"), "date", "eeg", F.lit("Other").alias("label"), "userid",
                              "calibrationid", "features")
    flat = spark.createDataFrame([(f"f{i}", None, None, ["Deep", "Medium"][i % 2], "u", "flat", [float(i % 3), 0.0, -0.0, 1.0, 5.0, float(i)])
                                  for i in range(50)], CALIBRATION_PACKETS)
    extra = bad.unionByName(flat)
    for _ in range(2):  # a batch that is run again
        tables.write_packets(extra, path, "batch_000000000009")
    tables.compact_packets_table(spark, path)
    tables.write_packets(flat.withColumn("pk", F.concat(F.lit("g"), "pk")), path, "batch_000000000010")
    stored = pk.unionByName(extra).unionByName(flat.withColumn("pk", F.concat(F.lit("g"), "pk")))
    cal, _ = _sessions(spark, [(f"s{i:02d}", f"u{i}") for i in range(40)] + [("hot", "u"), ("flat", "u"), ("empty", "u")])
    statistics = tables.packet_statistics(spark, snapshots.read_snapshot(spark, path))
    ours, scan = Flow(cal, spark.createDataFrame([], CALIBRATION_PACKETS), statistics=statistics), Flow(cal, stored)
    rounded = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rounded(ours.profile.drop("approx_distinct")) == rounded(scan.profile.drop("approx_distinct"))
    assert rounded(ours.codes) == rounded(scan.codes) and len(rounded(ours.codes)) > 5
    assert sorted(map(str, ours.nb_params.select("calibrationid", "label_idx", "n", F.round("pi", 9), F.transform(
        "theta", lambda x: F.round(x, 9)), "ok").collect())) == sorted(map(str, scan.nb_params.select(
            "calibrationid", "label_idx", "n", F.round("pi", 9), F.transform("theta", lambda x: F.round(x, 9)), "ok").collect()))
    assert rounded(ours.invalid) == rounded(scan.invalid) and len(rounded(ours.invalid)) > 0


def test_a_cycle_reads_the_files_of_the_sessions_it_trains(spark):
    paths = _paths(spark, "t-pruned")
    cal, pk = _sessions(spark, [("new", "u1"), ("done", "u2")])
    cal.withColumn("modelsgenerated", F.col("calibrationid") == "done").write.parquet(paths.calibrations)
    for i, c in enumerate(("new", "done")):
        part = pk.where(F.col("calibrationid") == c)
        tables.write_packets(part.unionByName(part.limit(2).withColumns({"pk": F.lit(f"bad{i}"), "label": F.lit("?")})),
                             paths.packets, f"batch_{i:012d}")
    run = jobs.run_cycle(spark, paths, model_types=["nb"])
    read = run.flow.packets.inputFiles()
    assert read and all("batch_000000000000" in f for f in read) and "eeg" not in run.flow.packets.columns
    assert [r[0] for r in run.published.collect()] == ["new"]
    # what could not be used is kept beside the statuses
    bad = tables.read_parquet(spark, jobs.invalid_path(paths.status)).collect()
    assert [(r.calibrationid, r.reason, r.n) for r in bad] == [("new", "unknown Label", 2)]


# ------------------------------------------- waiting rows and current models

def _models(spark):
    cal = fx.calibrations(spark, SF001)
    return jobs.registry_rows(nb_registry(Flow(cal, fx.calibration_packets(spark, SF001)), cal))


def test_rows_meet_each_model_once(spark):
    base = fresh_path(spark, "t-waiting")
    path, current = f"{base}/ins", f"{base}/current"
    models = _models(spark).persist()
    first = [r[0] for r in models.select("userid").distinct().orderBy("userid").limit(3).collect()]
    stored = fx.stored_instructions(spark, SF001).persist()
    tables.write_scored(stored.where("pk % 2 = 0"), path, "batch_000000000000", 0)
    registry.publish_current(spark, current, models.where(F.col("userid").isin(first)))
    due = stored.where("pending and pk % 2 = 0").where(F.col("userid").isin(first)).count()
    assert jobs.backfill_waiting(spark, path, current, 1) == due > 0
    rows = tables.read_parquet(spark, path).count()
    waiting = snapshots.newest_version(spark, tables.pending_path(path))
    # without new models nothing is scored and nothing written
    assert jobs.backfill_waiting(spark, path, current, 2) == 0
    assert tables.read_parquet(spark, path).count() == rows
    assert snapshots.newest_version(spark, tables.pending_path(path)) == waiting
    # a later batch, scored with that version, and models of other users: only theirs are scored
    tables.write_scored(stored.where("pk % 2 = 1"), path, "batch_000000000001", 1)
    registry.publish_current(spark, current, models.where(~F.col("userid").isin(first)))
    others = [r[0] for r in models.where(~F.col("userid").isin(first)).select("userid").distinct().collect()]
    assert jobs.backfill_waiting(spark, path, current, 3) == stored.where("pending").where(F.col("userid").isin(others)).count()
    # waiting rows are read from their own table alone
    read = tables.read_pending_instructions(spark, path)
    assert all("/ins_pending/" in f for f in read.inputFiles())
    assert read.count() == tables.read_instructions(spark, path).where("pending").count()
    assert read.select("pk").distinct().count() == read.count()


def test_rows_stored_without_the_table_are_queued(spark):
    path = fresh_path(spark, "t-queue")
    stored = fx.stored_instructions(spark, SF001).select(*INSTRUCTION_PACKETS.fieldNames())
    stored.write.parquet(path)
    append_version(stored.where("pending and pk % 2 = 0").withColumn("pending", F.lit(False)), path, 5)
    want = stored.where("pending and pk % 2 = 1").count()
    assert tables.read_pending_instructions(spark, path).count() == want
    tables.queue_pending(spark, path)
    tables.queue_pending(spark, path)
    read = tables.read_pending_instructions(spark, path)
    assert read.count() == want and all("_pending/" in f for f in read.inputFiles())


def test_current_models_are_merged_and_read_on_change_only(spark):
    base = fresh_path(spark, "t-current")
    models = _models(spark).persist()
    current = registry.current_path(f"{base}/registry")
    cache = registry.CurrentModels(spark, f"{base}/registry")
    assert cache.get() == (None, 0)
    old = models.where("userid is not null").withColumn("enddate", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"))
    assert registry.publish_current(spark, current, old.where("calibrationid % 2 = 0")) == 1
    rows, version = cache.get()
    assert version == 1 and cache.loads == 1 and cache.get()[0] is rows and cache.loads == 1
    assert registry.publish_current(spark, current, models) == 2
    rows, version = cache.get()
    assert version == 2 and cache.loads == 2
    key = lambda df: sorted(map(str, df.select("userid", "model_type", "calibrationid", "enddate").collect()))
    assert key(rows) == key(registry.current_per_user(models)) and rows.where("published <> 2").count() == 0
    # an older model does not replace a newer one, and a row that stays keeps its version
    assert registry.publish_current(spark, current, old) == 3
    assert key(cache.get()[0]) == key(registry.current_per_user(models)) and cache.get()[0].where("published <> 2").count() == 0
