"""T6 end to end on stored tables: train, publish, mark, backfill; a second cycle is a no-op."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sigclass.functions.split import is_train
from sigclass.operators import mllib_train
from sigclass.plans import jobs
from sigclass.schemas import CALIBRATION_PACKETS, CALIBRATIONS
from sigclass.session import fresh_path
from sigclass.sources import fixtures as fx
from sigclass.sources import tables
from sigclass.sources.streams import file_topic
from sigclass.streaming.scoring import start_instruction_scoring
from tests.conftest import SF001


def test_cycle(spark):
    base = fresh_path(spark, "t-cycle")
    paths = tables.TablePaths(calibrations=f"{base}/cal", packets=f"{base}/pk", instructions=f"{base}/ins",
                              registry=f"{base}/registry", metrics=f"{base}/metrics", status=f"{base}/status")
    # plus one session with negative channels (from embeddings): naive Bayes must fail for it
    emb = fx.embedding_packets(spark, SF001)
    emb_cal = emb.groupBy("calibrationid", "userid").agg(
        F.lit(None).cast("timestamp_ntz").alias("startdate"),
        F.max(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("enddate")) \
        .withColumn("modelsgenerated", F.lit(False))
    fx.calibrations(spark, SF001).unionByName(emb_cal).write.parquet(paths.calibrations)
    fx.calibration_packets(spark, SF001).unionByName(emb).write.parquet(paths.packets)
    # instructions arrive before any model: stored with placeholders
    fx.unlabelled_json_lines(spark, SF001).write.text(f"{base}/topic")
    q = start_instruction_scoring(spark, file_topic(spark, f"{base}/topic"), paths.instructions,
                                  f"{base}/quarantine", f"{base}/ckpt", paths.registry,
                                  trigger={"availableNow": True})
    q.awaitTermination()
    physical = lambda: tables.read_parquet(spark, paths.instructions).count()
    n_ins = tables.read_instructions(spark, paths.instructions).count()
    assert tables.read_pending_instructions(spark, paths.instructions).count() == n_ins

    eligible = {r[0] for r in fx.calibrations(spark, SF001)
                .where("enddate is not null and not modelsgenerated").select("calibrationid").collect()}
    run = jobs.run_cycle(spark, paths)
    published = {r[0] for r in run.published.collect()}
    assert published == eligible  # every lineitem session, and not the negative-channel one
    st = {(r["calibrationid"], r["model_type"]): r["status"] for r in run.statuses.collect()}
    assert st[("emb", "nb")] == "failed"
    cal = tables.read_calibrations(spark, paths.calibrations)
    assert cal.count() == fx.calibrations(spark, SF001).count() + 1
    assert cal.where("calibrationid = 'emb'").collect()[0]["modelsgenerated"] is False
    marked = {r[0] for r in cal.where("modelsgenerated").select("calibrationid").collect()}
    assert published <= marked
    # registry holds three model types per published session; metrics table got rows for each
    reg = spark.read.parquet(paths.registry)
    assert reg.count() == 3 * len(published)
    m = spark.read.parquet(paths.metrics)
    assert {r[0] for r in m.select("model").distinct().collect()} == {"rf", "mlp", "nb"}
    # backfill: users with a model now have labels from all three models
    ins = tables.read_instructions(spark, paths.instructions)
    assert ins.count() == n_ins
    users = {r[0] for r in reg.select("userid").distinct().collect()}
    scored = ins.where(F.col("userid").isin(*users))
    assert scored.where("pending").count() == 0
    assert ins.where(~F.col("userid").isin(*users)).where("not pending").count() == 0
    assert tables.read_pending_instructions(spark, paths.instructions).count() == \
        ins.where("pending").count()

    # second cycle: nothing eligible any more (the failed session is not retried), nothing changes
    rows = physical()
    assert n_ins < rows <= 2 * n_ins
    run2 = jobs.run_cycle(spark, paths)
    assert run2.published.count() == 0
    assert run2.statuses.count() == 0
    assert spark.read.parquet(paths.registry).count() == reg.count()
    assert tables.read_instructions(spark, paths.instructions).where("pending").count() == \
        ins.where("pending").count()
    assert physical() == rows  # nothing new: nothing written


def _sessions(spark, ids):
    """A small finished session for each (calibrationid, userid), with three labels."""
    rng = random.Random(5)
    labels = ["Shallow", "Medium", "Deep"]
    pk = [(f"{c}|{u}|{i}", None, None, labels[i % 3], u, c, [rng.random() * 9 + 3 * (i % 3) for _ in range(6)])
          for c, u in ids for i in range(60)]
    cal = [(c, u, None, dt.datetime(2024, 1, 1), False) for c, u in ids]
    return spark.createDataFrame(cal, CALIBRATIONS), spark.createDataFrame(pk, CALIBRATION_PACKETS)


def test_models_of_odd_ids_stay_apart(spark):
    ids = [("a b", "u"), ("x/y", "u"), ("1-2", "3"), ("1", "2-3"), ("%41", "A=b")]
    run = jobs.train_pending(spark, *_sessions(spark, ids))
    got = sorted((r["calibrationid"], r["userid"], r["model_type"]) for r in run.registry.collect())
    assert got == sorted((c, u, m) for c, u in ids for m in ("nb", "rf", "mlp"))
    assert sorted(r[0] for r in run.published.collect()) == sorted(c for c, _ in ids)
    paths = {r["model_path"] for r in run.registry.where("model_type <> 'nb'").select("model_path").collect()}
    assert len(paths) == 2 * len(ids)
    assert run.pairs.select("calibrationid", "model").distinct().count() == 3 * len(ids)


def _paths(spark, name):
    base = fresh_path(spark, name)
    return tables.TablePaths(**{k: f"{base}/{k}" for k in
                                ("calibrations", "packets", "instructions", "registry", "metrics", "status")})


def test_a_failing_type_neither_ends_the_run_nor_is_it_forgotten(spark, monkeypatch):
    paths = _paths(spark, "t-retry")
    cal, pk = _sessions(spark, [("s1", "u1"), ("s2", "u2")])
    cal.write.parquet(paths.calibrations)
    pk.write.parquet(paths.packets)
    real = mllib_train.estimator

    def broken(mt, cfg):
        if mt == "rf":
            raise RuntimeError("executor lost")
        return real(mt, cfg)
    monkeypatch.setattr(mllib_train, "estimator", broken)
    cfg = mllib_train.TrainConfig(max_attempts=3)
    run = jobs.run_cycle(spark, paths, cfg=cfg)
    assert run.published.count() == 0
    st = {(r["calibrationid"], r["model_type"]): (r["status"], r["fault"]) for r in run.statuses.collect()}
    assert st["s1", "rf"] == ("failed", "run") and st["s1", "mlp"] == ("ok", None) and st["s2", "nb"] == ("ok", None)
    monkeypatch.setattr(mllib_train, "estimator", real)
    assert {r[0] for r in jobs.run_cycle(spark, paths, cfg=cfg).published.collect()} == {"s1", "s2"}  # tried again
    assert jobs.run_cycle(spark, paths, cfg=cfg).statuses.count() == 0


def test_attempts_are_bounded_and_input_faults_are_final(spark):
    run = lambda c, f, r: (c, "u", "rf", "failed", f, "e", None, r)
    st = spark.createDataFrame([run("a", "run", "1"), run("a", "run", "2"), run("b", "input", "1"),
                                run("c", "run", "1"), run("c", "run", "1")], jobs.RUN_STATUS)
    assert sorted(r[0] for r in jobs.given_up(st, 2).collect()) == ["a", "b"]


def test_session_without_training_rows_has_a_status(spark):
    cal, pk = _sessions(spark, [("s", "u")])
    pk = pk.where(~is_train("pk"))
    run = jobs.train_pending(spark, cal, pk)
    st = {r["model_type"]: (r["status"], r["fault"], r["error"]) for r in run.statuses.collect()}
    assert set(st) == {"nb", "rf", "mlp"}
    assert all(s == "failed" and f == "input" and "no training rows" in e for s, f, e in st.values())


def test_staged_files_follow_the_rows(spark):
    cal, pk = _sessions(spark, [(f"s{i}", "u") for i in range(6)])
    run = jobs.train_pending(spark, cal, pk, model_types=["mlp"])
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{run.root}/rows").select(
        F.col("_metadata.file_path")).distinct().count()
    assert files == 6


def test_ready_models_are_loaded_from_where_they_were_saved(spark):
    cal, pk = _sessions(spark, [("s1", "u1"), ("s2", "u2")])
    run = jobs.train_pending(spark, cal, pk)
    ready = cal.withColumn("modelsgenerated", F.col("calibrationid") == "s1")
    loaded = jobs.load_models(spark, ready, run.registry)
    same = run.registry.where("calibrationid = 's1'").drop("cat_maps")
    a = sorted(map(str, (r.asDict(True) for r in loaded.drop("cat_maps").collect())))
    assert a == sorted(map(str, (r.asDict(True) for r in same.collect()))) and len(a) == 3
