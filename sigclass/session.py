"""Session construction and shared-storage paths.

Scratch output (stream checkpoints, sinks, model directories, lineage cuts)
always lives under the cluster's shared checkpoint folder, read from the
session (``spark.checkpoint.dir``). Only a local master may fall back to a
directory of its own; on a cluster an unset setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Many small groups per task in applyInPandas; keep Arrow batches bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "sigclass",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults this package relies on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One JVM with the driver; a ``local-cluster`` has executors of its own."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running sigclass jobs on a cluster")
        conf = tempfile.mkdtemp(prefix="sigclass-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return "/".join([base.rstrip("/")] + [p.strip("/") for p in parts])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder (one per run)."""
    return shared_path(spark, "sigclass", f"{name}-{uuid.uuid4().hex[:12]}")


def exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sigclass`` importable in Python workers on a local master (tests, development).

    Zips the package once per application and adds it with ``addPyFile``;
    Python UDFs (the Arrow scorers) import their helpers from it. On a cluster
    the package is shipped at submit time (``--py-files``), so nothing is done
    and no machine-local folder is used.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or not _is_local(spark):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="sigclass-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def materialize(df, name: str):
    """Cut lineage: write ``df`` as a table under the shared folder and read it back.

    One computation (unlike an eager ``checkpoint()``, which evaluates its input
    twice), and the result survives executor loss.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df, min_partitions: int | None = None):
    """Round-robin an under-split input over the cluster; a no-op for a well-split one.

    A Parquet file with a single row group is read by one task however big it
    is, and every operator pipelined on that scan (parsing, hashing, partial
    aggregation) then runs on one core. Inputs already split into at least
    ``min_partitions`` (default: the cluster's parallelism) are left as they are.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
