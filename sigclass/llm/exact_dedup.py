"""Exact deduplication against a persistent digest index.

The index is a table of SHA-256 digests, bucketed and sorted by digest; the number of
buckets is kept beside it, so it is the same whatever session opens it. A batch
is reduced to one row per digest (with a map-side step, so a text that a third
of all rows share is no hot group), anti-joined with the index by a sort-merge
join that does not move the index, and its new digests are appended. ``compact`` leaves one
file in each bucket, whose order the join then uses. One writer at a time may append to an
index. Only DataFrame functions are used.

Defined results: a null text counts as empty. Texts are equal when their bytes
are identical. Of equal texts in a batch the row with the largest doc_id stays;
of equal texts in different batches the one of the earlier batch stays. A null
doc_id is below every other; where all are null, keep_id is null and each of
these rows counts as kept. Rows that repeat both doc_id and text are kept or
dropped together (the pipeline keeps one). An empty batch appends nothing.
Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.llm.common import one_row_each
from sigclass.session import exists, fresh_path, materialize
from sigclass.sources.snapshots import publish_text, read_text

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, first_rows BIGINT"


class DigestIndex:
    """A bucketed, sorted digest table at a path; opened again by any later session.

    ``buckets`` counts for a new index only (default: the session's shuffle partitions); an index
    that exists is opened with its own number, and another one is refused."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, name: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._stored_buckets(buckets)
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_COLUMNS}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _stored_buckets(self, wanted: int | None) -> int:
        about = f"{self.path}/_index.json"
        if not exists(self.spark, about):
            if exists(self.spark, self.path) and wanted is None:
                raise ValueError(f"{self.path} does not say how many buckets it has; give their number")
            number = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            publish_text(self.spark, about, json.dumps({"buckets": number}))
        stored = json.loads(read_text(self.spark, about))["buckets"]
        if wanted not in (None, stored):
            raise ValueError(f"{self.path} has {stored} buckets, not {wanted}")
        return stored

    def close(self) -> None:
        """Drop the catalog entry; the index stays where it is."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def new_in(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch (with ``digest``) that the index does not have; the index is not moved."""
        return batch.repartition(self.buckets, "digest").join(
            self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append_new(self, groups: DataFrame) -> None:
        """Append the digests that the index does not have. Running it again appends nothing."""
        with _ordered_buckets(self.spark):
            (self.new_in(groups).select("digest", "keep_id", F.col("rows").alias("first_rows"))
                .repartition(self.buckets, "digest").sortWithinPartitions("digest")
                .write.insertInto(self.name))

    def compact(self, path: str) -> DigestIndex:
        """The same index at another path, with one sorted file in each bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        # the files as they are: a bucketed scan's own partitioning would stand in for the shuffle
        rows = self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(out.name)
        return out


@contextmanager
def _ordered_buckets(spark: SparkSession):
    """Let a scan of a bucketed table use the order of its files, where a bucket has one."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def digest(text="text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def deduplicate(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Append a batch to the index and return, for each digest of the batch, what stays of it:
    digest, keep_id, group_size (rows of the batch), keep_rows (rows of the batch with keep_id)."""
    # two levels: the second needs the count of the rows that repeat the largest doc_id
    rows = (docs.select(digest(text).alias("digest"), F.col(id_col).alias("doc_id"))
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    groups = rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("rows"),
        F.max(F.struct(F.col("doc_id"), F.col("n")))["n"].alias("keep_rows"))
    groups = materialize(groups, "digest-groups")
    index.append_new(groups)
    resolved = (groups.select("digest", F.col("rows").alias("group_size"), "keep_rows")
                .repartition(index.buckets, "digest")
                .join(index.rows().select("digest", "keep_id").hint("merge"), "digest"))
    with _ordered_buckets(docs.sparkSession):
        return materialize(resolved, "digest-resolved")


def decisions(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = deduplicate(docs, index, text, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_of_equal(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; exactly one for each new text."""
    groups = deduplicate(docs, index)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), digest().alias("digest"))
    kept = rows.join(groups, "digest").where(F.col("id").eqNullSafe(F.col("keep_id")))
    return one_row_each(kept, ["digest"], "keep_rows").select("row.*")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"))
