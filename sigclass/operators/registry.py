"""Model registry: one row per (session, model type) and the current model per user.

Replaces an in-memory map of JVM model objects (which executors cannot see)
with a table that scoring joins to (S7, M10, J4). Rows carry everything
scoring needs: the session's fitted label order and category maps, and the
model parameters (naive Bayes classes; perceptron layers/weights; forest
arrays), and the path of the saved model.

Beside the registry, which keeps every model, stands the table of the current
ones: one row per user and model type, with the table's version at which the row
came in (``published``). It is merged when models are published, so neither a
micro-batch nor a cycle ranks the registry.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigclass.operators.scorers import FOREST
from sigclass.session import exists
from sigclass.sources import snapshots

NB_CLASSES = T.ArrayType(T.StructType([
    T.StructField("label_idx", T.DoubleType()), T.StructField("pi", T.DoubleType()),
    T.StructField("theta", T.ArrayType(T.DoubleType()))]))

REGISTRY = T.StructType([
    T.StructField("userid", T.StringType()), T.StructField("calibrationid", T.StringType()),
    T.StructField("enddate", T.TimestampNTZType()), T.StructField("model_type", T.StringType()),
    T.StructField("trained_at", T.TimestampType()), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("cat_maps", T.MapType(T.IntegerType(), T.MapType(T.DoubleType(), T.DoubleType()))),
    T.StructField("classes", NB_CLASSES), T.StructField("mlp_layers", T.ArrayType(T.IntegerType())),
    T.StructField("mlp_weights", T.ArrayType(T.DoubleType())), T.StructField("rf", FOREST),
    T.StructField("model_path", T.StringType()),
])


#: A current model, and the version of the table of current models that brought it.
CURRENT = T.StructType([*REGISTRY.fields, T.StructField("published", T.LongType())])


def current_path(registry: str) -> str:
    """The table of current models of a registry."""
    return f"{registry.rstrip('/')}_current"


def session_key(calibrationid: Column | str = "calibrationid", userid: Column | str = "userid") -> Column:
    """A folder name for a session: unique, whatever characters its ids have."""
    return F.sha2(F.to_json(F.struct(F.col(calibrationid).alias("c") if isinstance(calibrationid, str) else calibrationid,
                                     F.col(userid).alias("u") if isinstance(userid, str) else userid)), 256)


def with_session(models: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Attach userid and enddate of each model's session (one row per session on the right)."""
    return models.join(calibrations.select("calibrationid", "userid", "enddate"), "calibrationid")


def current_per_user(registry: DataFrame, model_col: str = "model_type") -> DataFrame:
    """Newest session per (userid, model type): enddate desc, then calibrationid desc
    (then the latest training of that session, when the registry has ``trained_at``).

    Only narrow columns are ranked; the parameters join the winners afterwards."""
    versions = ["trained_at"] if "trained_at" in registry.columns else []
    key = ["calibrationid", model_col, *versions]
    order = [F.col("enddate").desc_nulls_last(), F.col("calibrationid").desc(),
             *[F.col(v).desc_nulls_last() for v in versions]]
    w = Window.partitionBy("userid", model_col).orderBy(*order)
    key = ["userid", "enddate", *key]
    newest = (registry.select(*key).withColumn("_rn", F.row_number().over(w))
              .where("_rn = 1").select(*[F.col(c).alias(f"_{c}") for c in key]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return registry.join(newest, reduce(and_, same), "left_semi")


def read_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table of current models at a version (the newest one); None if there is none yet."""
    snapshot = snapshots.read_snapshot(spark, path, version)
    return None if snapshot is None else spark.read.schema(CURRENT).parquet(*snapshot.data_paths())


def publish_current(spark: SparkSession, path: str, new: DataFrame, attempts: int = 10) -> int:
    """Merge newly trained models (registry rows) into the table of current models, as one commit.

    A row that stays keeps the version that brought it. If another writer merged meanwhile, the
    merge is done again on its result. Returns the table's version."""
    for _ in range(attempts):
        seen = snapshots.read_snapshot(spark, path)
        version = (seen.version if seen else 0) + 1
        rows = new.withColumn("published", F.lit(version).cast("long")).select(*CURRENT.fieldNames())
        if seen:
            rows = read_current(spark, path, seen.version).unionByName(rows)
        name = f"current_{version:012d}_{uuid.uuid4().hex[:8]}"
        # a session that was published twice has the same models
        current_per_user(rows).dropDuplicates(["userid", "model_type"]).write.parquet(f"{path}/{name}")
        try:
            done = snapshots.commit(spark, path, {name: {"data": [name]}}, tuple(seen.entries) if seen else (),
                                    expected=seen.version if seen else 0)
            return done.version
        except snapshots.Conflict:
            continue
    raise snapshots.Conflict(f"{path}: {attempts} merges were overtaken")


class CurrentModels:
    """The current models for a stream: read and kept when their table has a new version, and only then.

    Asking costs one listing of the versions. The rows are persisted on the executors; lost ones
    are read again from the table's files."""

    def __init__(self, spark: SparkSession, registry_path: str | None):
        self.spark, self.registry_path = spark, registry_path
        self.version, self.rows, self.loads = 0, None, 0

    def get(self) -> tuple[DataFrame | None, int]:
        """(one row per user and model type or None, the table's version)."""
        if not self.registry_path:
            return None, 0
        path = current_path(self.registry_path)
        version = snapshots.newest_version(self.spark, path)
        if version and version != self.version:
            if self.rows is not None:
                self.rows.unpersist()
            self.rows, self.version = read_current(self.spark, path, version).persist(), version
            self.loads += 1
        elif not version and exists(self.spark, self.registry_path):  # a registry without that table
            return current_per_user(self.spark.read.schema(REGISTRY).parquet(self.registry_path)), 0
        return self.rows, self.version
