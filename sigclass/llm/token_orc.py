"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id.

The texts are range-sorted by doc_id once (rows that repeat one, by a hash of the text and
their place in the input, so that no doc_id is a hot range); each range is tokenised in that order
and written as one file, so the files, their stripes and their row groups all
cover disjoint ascending ranges of doc_id. A reader that wants some documents
skips files, stripes and row groups by their minima and maxima and by the Bloom
filters; a reader of everything takes the stripes in parallel.

Defined results: a null or empty text is a document of its end id alone. Null
doc_ids come first. Rows that repeat a doc_id are written each; ``place`` says where
a row stands in the files, and starts count the rows in that order. An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigclass.llm.common import sums_in_order
from sigclass.llm.tokens import encoder, slices
from sigclass.session import fresh_path, materialize, ship_package

#: Stripes of 16 MB, an index entry every 1,000 documents, 1 false positive in 100.
ORC_OPTIONS = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
               "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
FILE_SCHEMA = "doc_id long, ids array<int>, place long"


def _encode(vocabulary: str | None, end_id: int):
    def encode(batches):
        ids_of = encoder(vocabulary).batch
        for batch in (part for whole in batches for part in slices(whole)):
            ids, ends = ids_of(batch.column("text"))
            # each text's ids move on by the end ids before them
            values = np.insert(ids, ends, np.uint32(end_id)).astype("<i4", copy=False)
            offsets = np.append(0, ends + np.arange(1, len(ends) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))],
                ["doc_id", "ids"])
    return encode


def write_ids(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None) -> None:
    """Tokenise every document and write its ids, ending with ``end_id``, in ascending doc_id order."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ids = ranged.mapInArrow(_encode(vocabulary, end_id), "doc_id long, ids array<int>")
    ids.withColumn("place", F.monotonically_increasing_id()).write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids: doc_id, ids. Filters on doc_id reach the files' indexes."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        data = memoryview(values.tobytes())
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()),
             batch.column("place")], ["doc_id", "n_tokens", "ids_crc32", "place"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files, one row per document: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32."""
    ship_package(spark)
    rows = read_ids(spark, path).mapInArrow(_checksums, "doc_id long, n_tokens long, ids_crc32 long, place long")
    # a place is the number of its range, shifted by 33 bits, and the row's number in it
    rows = materialize(rows.withColumns({"_part": F.shiftright("place", 33), "_pos": F.col("place")}), "orc-digests")
    return sums_in_order(rows, {"n_tokens": "start"}).select("doc_id", "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Write the documents to ORC files in the shared folder and read ``digests`` back."""
    path = fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, end_id, vocabulary)
    return digests(docs.sparkSession, path)
