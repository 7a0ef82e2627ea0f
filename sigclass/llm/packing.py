"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's character 4-grams are hashed into a vector, which is projected to
a few dimensions; the cell of that point on a Hilbert curve is its
key. The texts are written once with their keys, so that the range sort samples only
keys; they are range-sorted by (key, doc_id), and each range is tokenised in that order
and packed: its ids are laid end to end and cut every ``length`` ids, so similar
documents share sequences and only the last sequence of a range is short. The only
shuffle is that of the texts.

Defined results: a null or empty text is a document of its end id alone. Copies
have one key and lie next to each other in the order of their doc_id, so a group
of copies of any size is spread over ranges by doc_id. Repeated rows are packed
each for itself. An empty table gives no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.llm.tokens import encoder, slices
from sigclass.session import materialize, ship_package

#: Dimensions of the projection and bits of each on the curve: 4 x 15 bits fit a long.
DIMENSIONS, BITS = 4, 15
#: Length of the hashed document vectors.
VECTOR_BITS = 10
VECTOR = 1 << VECTOR_BITS
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
#: Bytes of text that are encoded at once, and words that a worker remembers: with 8 MB and a million words, packing
#: in the pipeline outgrew an executor's memory, most of which earlier stages hold.
SLICE_BYTES, MAX_PIECES = 2 << 20, 200_000
#: Sequences of one range are numbered from its number times this.
RANGE_SPAN = 1 << 32


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits.

    Skilling's transform (2004): undo the excess work of each bit level, then Gray-encode;
    the transposed coordinates are then read bit by bit, highest first.
    """
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            inverted = (x[:, i] & level) != 0
            swap = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(inverted, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    carry = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        carry ^= np.where((x[:, n - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= carry[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.RandomState(11).standard_normal((VECTOR, DIMENSIONS))


def _project(text: bytes, projection: np.ndarray) -> np.ndarray:
    """The projection of the document's vector: its hashed character 4-grams, square roots of
    their counts, scaled to length 1."""
    if not text:
        return np.zeros(DIMENSIONS)
    c = np.frombuffer(text + b"\0\0\0", np.uint8).astype(np.uint32)
    grams = c[:-3] | (c[1:-2] << np.uint32(8)) | (c[2:-1] << np.uint32(16)) | (c[3:] << np.uint32(24))
    cells = (grams * np.uint32(2654435761)) >> np.uint32(32 - VECTOR_BITS)
    counts = np.bincount(cells, minlength=VECTOR)
    return (np.sqrt(counts) @ projection) / np.sqrt(len(grams))


def _keys(batches):
    projection = _projection()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        points = np.array([_project(t, projection) for t in texts]).reshape(-1, DIMENSIONS)
        # a projection is about normal: squash it into (0, 1)
        cells = ((np.tanh(points) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(hilbert_index(cells, BITS), pa.int64())],
            ["doc_id", "text", "curve"])


def _pack(vocabulary: str | None, length: int, end_id: int):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def pack(batches):
        encode = encoder(vocabulary, MAX_PIECES).batch
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() * RANGE_SPAN
        at = 0  # ids of this range so far
        for batch in (part for whole in batches for part in slices(whole, SLICE_BYTES)):
            out = []
            ids, ends = encode(batch.column("text"))
            ids, before = memoryview(ids.tobytes()), 0
            for doc_id, upto in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own = bytes(ids[4 * before:4 * upto]) + end
                n, start, before = upto - before + 1, 0, upto
                while start < n:
                    offset = at % length
                    take = min(length - offset, n - start)
                    out.append((doc_id, start, take, zlib.crc32(own[4 * start:4 * (start + take)]), n,
                                first + at // length, offset))
                    start, at = start + take, at + take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
    return pack


def pack_along_curve(docs: DataFrame, length: int = 1024, end_id: int = 0,
                     vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizer file as the executors see it; None takes the
    installed public byte-level vocabulary there.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    keyed = rows.mapInArrow(_keys, "doc_id long, text binary, curve long")
    keyed = materialize(keyed.withColumn("place", F.monotonically_increasing_id()), "curve-keys")
    order = ["curve", "doc_id", "place"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(_pack(vocabulary, length, end_id), SCHEMA)
