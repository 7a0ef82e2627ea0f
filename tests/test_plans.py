"""Plan checks: pushed filters, broadcast of bounded sides, no Python in the set-wise flow."""

from sigclass.operators import metrics, prepare
from sigclass.plans.flow import Flow
from sigclass.session import fresh_path
from sigclass.sources import fixtures as fx
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushed_filters_on_stored_tables(spark):
    base = fresh_path(spark, "t-plans")
    fx.calibrations(spark, SF001).write.parquet(f"{base}/cal")
    fx.calibration_packets(spark, SF001).write.parquet(f"{base}/pk")
    cal = spark.read.parquet(f"{base}/cal")
    pk = spark.read.parquet(f"{base}/pk")
    p1 = _plan(prepare.ready_calibrations(cal))
    assert "PushedFilters: [IsNotNull(modelsgenerated), EqualTo(modelsgenerated,true)]" in p1
    p2 = _plan(prepare.session_packets(pk, "7").select("pk"))
    assert "EqualTo(calibrationid,7)" in p2
    assert "ReadSchema: struct<pk:string,calibrationid:string>" in p2  # column pruning


def test_flow_is_jvm_only_and_broadcasts_sessions(spark):
    fl = Flow(fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001))
    plan = _plan(metrics.report(fl.pairs()))
    assert "BroadcastHashJoin" in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # the packet table is scanned once per pass, not once per consumer
    assert plan.count("lineitem.parquet") <= 2


def test_shuffle_join_path_gives_same_results(spark):
    """Beyond the broadcast bound the flow joins by shuffle; results must not change."""
    cal, pk = fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001)
    small = Flow(cal, pk)
    big = Flow(cal, pk, max_broadcast_rows=0)
    assert small.small_sessions and not big.small_sessions
    a = small.nb_predictions.select("pk", "prediction", "predicted_label")
    b = big.nb_predictions.select("pk", "prediction", "predicted_label")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_training_reads_vectors_only(spark):
    """Of packets stored by the library, which all have vectors, the passes never read the channel strings; of a table
    that may lack some they do, as rows without a vector would be lost otherwise."""
    from sigclass.sources import tables
    base = fresh_path(spark, "t-vectors")
    tables.write_packets(fx.calibration_packets(spark, SF001), f"{base}/table", "batch_0")
    cal = fx.calibrations(spark, SF001)
    fl = Flow(cal, tables.read_packets_of(spark, f"{base}/table", cal.select("calibrationid")))
    plan = _plan(prepare.session_profile(fl.frame))
    scans = [x for x in plan.split("\n") if "ReadSchema" in x and "features" in x]
    assert scans and "eeg" not in plan
    fx.calibration_packets(spark, SF001).write.parquet(f"{base}/raw")
    assert "eeg" in _plan(prepare.session_profile(Flow(cal, spark.read.parquet(f"{base}/raw")).frame))


def test_packet_passes_pre_aggregate_and_never_window_packets(spark):
    """The passes over packets combine map-side before the shuffle; windows see only summaries."""
    from sigclass.operators import prepare as prep
    fl = Flow(fx.calibrations(spark, SF001), fx.calibration_packets(spark, SF001))
    for df in (prep.session_profile(fl.frame.where("valid")),
               prep.fit_pass(fl.frame, fl.profile, broadcast=fl.small_sessions)):
        plan = _plan(df)
        assert "partial_" in plan          # map-side partial aggregation
        assert "Window" not in plan        # no window over packets
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
