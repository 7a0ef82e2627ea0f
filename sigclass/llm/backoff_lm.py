"""Stupid-backoff scores of whole documents, each against the counts of all the others.

Relationally: n-grams of documents, counts by n-gram, joined back, summed by
document. To keep the shuffles near the size of the texts, the rows that move are
blocks: the documents are dealt into chunks, a chunk's distinct n-grams (with their
counts: the map-side step) are split by hash into parts, and a block is what a
chunk has in a part. A part's task sums its blocks into that part of the count
table and answers every block with the counts of its n-grams. A chunk's task joins
the answers with its documents' n-grams and sums each document's score. No n-gram,
however frequent, is more than one entry of each chunk.

Score of a word w after u v, with counts that leave the document itself out:
count(u v w) / count(u v) if the triple occurs elsewhere, else BACKOFF times the score of
w after v: count(v w) / count(v) if the pair occurs elsewhere, else BACKOFF times
count(w) / N, and 1 / N for an unseen word. The first words of a document have no u or v
and start at the order that they have. Other orders back off in the same way.

N-grams are counted by hashes (47 bits or more within a part, so a wrong match has a
probability of about the part's n-grams in 2**47). Parts are ranges of hashes: a chunk's
sorted n-grams are in the order of the parts, and a block holds the steps between them.

Defined results: words are runs of characters other than ASCII white space, A-Z in
lower case; n-grams do not cross documents. A text without words, or a null one, has
no words, score 0 and a null mean. Rows that repeat a doc_id are documents of their
own; only the row itself is left out of its counts, so copies score high. An empty
table gives no rows. Extra columns are not read. Rows equal in doc_id and text are
counted first and scored once, with their number; the score is then given to each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.llm.common import checked_broadcast, n_words
from sigclass.session import materialize, ship_package

BACKOFF = 0.4
#: Longest n-gram, unless the caller gives another; the registered query takes 3.
ORDER = 2
#: Bytes of text in a chunk and distinct n-grams in a part, about.
CHUNK_BYTES, PART_GRAMS = 8 << 20, 3_000_000
#: Repeated rows are given their score in blocks of this many.
COPIES = 10_000
SCHEMA = "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long, n_unseen long"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words; holds a bounded number at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, one after another, and the number of words of each."""
    found = [(t or b"").lower().split() for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    hashes = np.fromiter((_WORDS[w] for words in found for w in words), np.uint64, int(sizes.sum()))
    return hashes, sizes


def _grams(hashes: np.ndarray, sizes: np.ndarray, order: int) -> list:
    """For n = 1..order: the n-gram that ends at each word, 0 where the document has none."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams, last = [], np.zeros(len(hashes), np.uint64)
    for n in range(1, order + 1):
        if n == 1:
            last = _mixed(hashes + _STEP)
        else:  # the (n-1)-gram that ends one word earlier, and this word
            earlier = np.concatenate([last[:1] * np.uint64(0), last[:-1]])
            last = _mixed(earlier * _STEP + hashes + np.uint64(n))
        last = np.where(place >= n - 1, last | np.uint64(1), np.uint64(0))
        grams.append(last)
    return grams


def _dealt(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each hash and its place within the part, both in the order of the hashes."""
    part = ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)
    shift = max(((-(-(1 << 32) // parts) << 32) - 1).bit_length() - 48, 0)
    within = (values - starts[part.astype(np.int64)]) >> np.uint64(shift)
    return part.astype(np.int64), within


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(data: bytes, width: int) -> bytes:
    """Numbers of ``width`` bytes, compressed: their first bytes, then their second ones, and so on."""
    planes = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, width).T)
    return len(data).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes, width: int) -> bytes:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).tobytes()


def _emit(order: int, parts: int):
    def run(key, table):
        hashes, sizes = _tokens(table.column("text").to_pylist())
        every = np.concatenate(_grams(hashes, sizes, order))
        values, counts = np.unique(every[every != 0], return_counts=True)
        more = np.tile(np.repeat(table.column("copies").to_numpy() - 1, sizes), order)
        again = (more > 0) & (every != 0)
        if again.any():
            counts = counts + np.bincount(np.searchsorted(values, every[again]), more[again], len(values)).astype(np.int64)
        part, within = _dealt(values, parts)
        ids, starts = np.unique(part, return_index=True)
        ends = [*starts[1:], len(part)]
        return pa.table({
            "part": pa.array(ids, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(ids), pa.int64()),
            "grams": pa.array([_packed(_six(np.diff(within[a:b], prepend=np.uint64(0))), 6) for a, b in zip(starts, ends)], pa.binary()),
            "counts": pa.array([_packed(counts[a:b].astype("<u8").tobytes(), 8) for a, b in zip(starts, ends)], pa.binary())})
    return run


def _sum(key, table):
    blocks = [np.cumsum(_from_six(_unpacked(x, 6)), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([np.frombuffer(_unpacked(x, 8), "<u8") for x in table.column("counts").to_pylist()])
    _, index = np.unique(np.concatenate(blocks), return_inverse=True)
    totals = np.bincount(index, counts)[index].astype("<u8")
    ends = np.cumsum([len(b) for b in blocks])
    return pa.table({
        "chunk": table.column("chunk"), "part": table.column("part"),
        "totals": pa.array([_packed(totals[e - len(b):e].tobytes(), 8) for e, b in zip(ends, blocks)], pa.binary())})


def _score(order: int, all_words: int, backoff: float):
    def run(key, docs, answers):
        hashes, sizes = _tokens(docs.column("text").to_pylist())
        n, of = len(hashes), np.repeat(np.arange(len(sizes)), sizes)
        every = np.concatenate(_grams(hashes, sizes, order))
        real = every != 0
        values, index = np.unique(every[real], return_inverse=True)
        where = np.full(len(every), -1, np.int64)
        where[real] = index
        where = where.reshape(order, -1)
        by_part = dict(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()))
        totals = np.frombuffer(b"".join(_unpacked(by_part[p], 8) for p in sorted(by_part)), "<u8").astype(np.int64)
        if len(totals) != len(values):
            raise ValueError(f"chunk {key[0]}: {len(values)} n-grams, but {len(totals)} counts")

        def others(index: np.ndarray) -> np.ndarray:
            """Count of an n-gram at each word in all documents but the word's own; 0 for none."""
            has = index >= 0
            pair, inverse, own = np.unique(of[has] * (len(values) + 1) + index[has], return_inverse=True,
                                           return_counts=True)
            out = np.zeros(len(index), np.int64)
            out[has] = totals[index[has]] - own[inverse]
            return out

        seen = [others(w) for w in where]
        rest = np.maximum(all_words - sizes, 1)[of]  # N without the document
        score = np.log(np.maximum(seen[0], 1) / rest)
        level = np.zeros(n, np.int64)
        for k in range(1, order):
            context = np.concatenate([[0], seen[k - 1][:-1]]) if n else seen[k - 1]
            found = (seen[k] > 0) & (where[k] >= 0)
            # a word that could have had this order and has not pays the backoff
            paid = (where[k] >= 0) & ~found
            score = np.where(found, np.log(np.maximum(seen[k], 1) / np.maximum(context, 1)),
                             score + np.where(paid, np.log(backoff), 0.0))
            level += paid
        total = np.bincount(of, score, len(sizes))
        count = lambda mask: np.bincount(of, mask, len(sizes)).astype(np.int64)
        return pa.table({
            "doc_id": docs.column("doc_id"), "copies": docs.column("copies"), "n_words": pa.array(sizes, pa.int64()),
            "log_score": pa.array(total, pa.float64()),
            "mean_log_score": pa.array(np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0), pa.float64(), mask=sizes == 0),
            "n_backed_off": pa.array(count(level > 0), pa.int64()), "n_unseen": pa.array(count(seen[0] == 0), pa.int64())})
    return run


def _counted(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The distinct rows of (doc_id, text) with their number, copies; and whether any row repeats. Only
    rows whose hash repeats are grouped, after a map-side step."""
    key = F.xxhash64("doc_id", "text")
    repeated = materialize(rows.groupBy(key.alias("_key")).count().where("count > 1").select("_key"), "repeated-rows")
    if repeated.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long")), False
    repeated = checked_broadcast(repeated, 1_000_000)  # a long each
    keyed = rows.withColumn("_key", key)
    alone = keyed.join(repeated, "_key", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    grouped = keyed.join(repeated, "_key", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return alone.unionByName(grouped), True


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES,
          part_grams: int = PART_GRAMS) -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural), mean_log_score, n_backed_off (words
    that paid a backoff) and n_unseen (words that no other document has)."""
    ship_package(docs.sparkSession)
    size, words = docs.agg(F.sum(F.octet_length("text")), F.sum(n_words("text"))).first()
    size, words = size or 0, words or 0
    chunks, parts = size // chunk_bytes + 1, order * words // part_grams + 1
    rows, repeats = _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                         F.col("text").cast("binary").alias("text")))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    blocks = dealt.groupBy("chunk").applyInArrow(
        _emit(order, parts), "part long, chunk long, grams binary, counts binary")
    answers = blocks.groupBy("part").applyInArrow(_sum, "chunk long, part long, totals binary")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(order, words, backoff), SCHEMA.replace("doc_id long", "doc_id long, copies long"))
    if repeats:  # in blocks, so that no array is long
        blocks_of = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))
        scored = scored.withColumn("_block", F.explode(blocks_of))
        left = F.least(F.col("copies") - F.col("_block") * COPIES, F.lit(COPIES)).cast("int")
        scored = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_block", "_copy")
    return scored.drop("copies")
