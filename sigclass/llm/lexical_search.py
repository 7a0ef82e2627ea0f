"""Ranked lexical search with range-maximum tables over posting lists.

Queries are a stated set, searched in blocks of bounded vocabulary. One pass over the
documents counts the words of whole texts and keeps, for each document, the block's terms
that it holds; document frequencies are summed from per-batch counts. The second pass reads
those narrow rows. Each batch of documents is a shard: its posting lists stand one after
another, with a sparse table of range maxima over their impacts. A query's best-first search
starts with the shard's whole interval of documents; an interval's bound is the sum over the
terms of their maximum impact in it. The intervals with the highest bounds are split at their
maximum-impact documents, which are scored exactly, until no bound reaches the lowest score
still wanted. The best scores of earlier shards of a task are kept as that threshold, so later
shards are cut off soon. Nothing is shuffled but the tasks' best documents.

Results are exact: bounds never understate, and an interval whose bound equals the
threshold is still opened, as ties go to the smaller doc_id.

Defined results: a null text has no terms. Repeated doc_ids and rows are ranked each; a null
doc_id comes after all others among equal scores. A query without a known term, and any query
over an empty table, has no results. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigclass.llm.tokens import slices
from sigclass.session import materialize, ship_package

#: Terms of one block of queries at most (a query with more is a block of its own).
MAX_TERMS = 100_000
#: Documents of a shard, and intervals opened at once.
SHARD, OPENED = 4096, 64
#: Intervals of at most this many documents are scored whole.
SMALL = 12
NO_ID = np.iinfo(np.int64).max

#: Byte by byte: letters and digits of ASCII and all bytes beyond it are parts of a term (fixed rule).
_TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

ROWS = "kind int, doc_id long, n long, terms array<int>, counts array<int>"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of an Arrow array of texts (UTF-8), one after another, and each text's number of terms."""
    data = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(data):
        return data, np.array([], np.int64)
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    raw = (data.buffers()[2].slice(first, size).to_pybytes() if size else b"").translate(_TERM_BYTES)
    clean = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(data), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw)])
    words = pc.split_pattern(clean, b" ")
    flat, ends = words.flatten(), np.diff(words.offsets.to_numpy()).cumsum()
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[ends]
    return flat.filter(real), np.diff(upto, prepend=0)


def _index(terms: list[bytes]):
    """Documents as rows of kind 0 (doc_id, n, their known terms and counts), and for each batch a row
    of kind 1 (documents with a term, all their terms, and the documents that hold each known one)."""
    def index(batches):
        known = pa.array(terms, pa.large_binary())
        for batch in (part for whole in batches for part in slices(whole, 4 << 20)):
            flat, n = terms_of(batch.column("text"))
            found = pc.index_in(flat, value_set=known)
            mask = found.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), n)[mask]
            pairs, counts = np.unique(doc * len(terms) + found.drop_null().to_numpy().astype(np.int64), return_counts=True)
            docs, ids = np.divmod(pairs, len(terms))
            offsets = np.searchsorted(docs, np.arange(len(n) + 1))
            held, df = np.unique(ids, return_counts=True)
            starts = pa.array(np.append(offsets, offsets[-1] + len(held)), pa.int32())
            doc_id = pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([int((n > 0).sum())], pa.int64())])
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(n) + [1], pa.int32()), doc_id, pa.array([*n.tolist(), int(n.sum())], pa.int64()),
                pa.ListArray.from_arrays(starts, pa.array(np.concatenate([ids, held]), pa.int32())),
                pa.ListArray.from_arrays(starts, pa.array(np.concatenate([counts, df]), pa.int32()))],
                ["kind", "doc_id", "n", "terms", "counts"])
    return index


class Shard:
    """Posting lists of some documents, in the order of the documents, with a table of range maxima."""

    def __init__(self, doc, term, impact, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.doc, self.impact = doc[order], impact[order]
        self.keys = term[order] * n_docs + self.doc  # ascending: a list's interval is found by two searches
        # level k has the place of the maximum of 2**k postings; lists are searched within their own ends
        levels = [np.arange(len(self.keys), dtype=np.int32)]
        longest = int(np.bincount(term).max()) if len(term) else 0
        while 2 << (len(levels) - 1) <= longest:
            step = 1 << (len(levels) - 1)
            a, b = levels[-1][:-step], levels[-1][step:]
            levels.append(levels[-1].copy())
            levels[-1][:-step] = np.where(self.impact[a] >= self.impact[b], a, b)
        self.levels = np.stack(levels)

    def maxima(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray):
        """For each interval [low, high) of documents and each term: the highest impact in it and its document."""
        base = (terms * self.n_docs)[:, None]
        a = np.searchsorted(self.keys, (base + low).ravel())
        b = np.searchsorted(self.keys, (base + high).ravel())
        some = b > a
        a, b = a[some], b[some]
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        x, y = self.levels[k, a], self.levels[k, b - (1 << k.astype(np.int64))]
        best = np.where(self.impact[x] >= self.impact[y], x, y)
        value, where = np.zeros(some.shape, np.int64), np.full(some.shape, -1)
        value[some], where[some] = self.impact[best], self.doc[best]
        return value.reshape(len(terms), -1), where.reshape(len(terms), -1)

    def scores(self, terms: np.ndarray, repeats: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The exact scores of some documents."""
        want = (terms * self.n_docs)[:, None] + docs
        at = np.minimum(np.searchsorted(self.keys, want.ravel()), len(self.keys) - 1)
        found = np.where(self.keys[at] == want.ravel(), self.impact[at], 0).reshape(want.shape)
        return repeats @ found

    def search(self, terms: np.ndarray, repeats: np.ndarray, least: int, k: int):
        """Documents and scores: all that can be among the k best with a score of ``least`` or more."""
        docs, scores, best = [], [], []  # best: a heap of the k highest scores
        low, high = np.array([0]), np.array([self.n_docs])
        value, where = self.maxima(terms, low, high)
        bound, at = repeats @ value, where[np.argmax(repeats[:, None] * value, axis=0), np.arange(1)]
        while len(low):
            enough = np.maximum(best[0] if len(best) == k else 0, max(least, 1))
            alive = bound >= enough
            low, high, bound, at = low[alive], high[alive], bound[alive], at[alive]
            if not len(low):
                break
            now = np.argsort(-bound, kind="stable")[:OPENED]
            rest = np.ones(len(low), bool)
            rest[now] = False
            whole = high[now] - low[now] <= SMALL
            small = [np.arange(a, b) for a, b in zip(low[now][whole], high[now][whole])]
            split = now[~whole]
            scored = np.concatenate([at[split], *small]).astype(np.int64)
            got = self.scores(terms, repeats, scored)
            for s in got[got >= enough].tolist():
                if len(best) < k:
                    heapq.heappush(best, s)
                else:
                    heapq.heappushpop(best, s)
            docs.append(scored)
            scores.append(got)
            left, right = np.concatenate([low[split], at[split] + 1]), np.concatenate([at[split], high[split]])
            left, right = left[left < right], right[left < right]
            value, where = self.maxima(terms, left, right)
            new_bound = repeats @ value
            new_at = where[np.argmax(repeats[:, None] * value, axis=0), np.arange(len(left))]
            low, high = np.concatenate([low[rest], left]), np.concatenate([high[rest], right])
            bound, at = np.concatenate([bound[rest], new_bound]), np.concatenate([at[rest], new_at])
        docs, scores = np.concatenate(docs or [np.array([], np.int64)]), np.concatenate(scores or [np.array([], np.int64)])
        enough = max(best[0] if len(best) == k else 0, least, 1)
        return docs[scores >= enough], scores[scores >= enough]


def _search(queries: list, weights: np.ndarray, n_docs: int, all_terms: int, k: int,
            shard_docs: int):
    def search(batches):
        best: list = [[] for _ in queries]  # for each query its k best: (-score, doc_id)
        for batch in batches:
            for start in range(0, batch.num_rows, shard_docs):
                part = batch.slice(start, shard_docs)
                ids = pc.fill_null(part.column("doc_id"), NO_ID).to_numpy()
                nulls = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                size = pc.list_value_length(part.column("terms")).to_numpy()
                term = part.column("terms").flatten().to_numpy().astype(np.int64)
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                if not len(term):
                    continue
                m = np.array([75 + 25 * n * n_docs // all_terms for n in part.column("n").to_pylist()], np.int64)
                doc = np.repeat(np.arange(part.num_rows), size)
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                shard = Shard(doc, term, impact, part.num_rows)
                for q, (_, terms, repeats) in enumerate(queries):
                    least = -best[q][-1][0] if len(best[q]) == k else 1
                    docs, scores = shard.search(terms, repeats, least, k)
                    if len(docs):
                        best[q] = sorted(best[q] + list(zip((-scores).tolist(), nulls[docs].tolist(), ids[docs].tolist())))[:k]
        out = [(queries[q][0], None if null else doc_id, -score)
               for q, rows in enumerate(best) for score, null, doc_id in rows]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                          pa.array([r[2] for r in out], pa.int64()), pa.array([part] * len(out), pa.int32())],
                                         ["query", "doc_id", "score", "part"])
    return search


def _blocks(items: DataFrame, max_terms: int):
    """The queries in blocks of at most ``max_terms`` terms in all: lists of (number, [(term, repeats)])."""
    block, size = [], 0
    rows = items.mapInArrow(_item_terms, "number long, terms array<binary>, counts array<int>")
    for r in rows.toLocalIterator():
        if block and size + len(r.terms) > max_terms:
            yield block
            block, size = [], 0
        block.append((r.number, list(zip(map(bytes, r.terms), r.counts))))
        size += len(r.terms)
    if block:
        yield block


def _item_terms(batches):
    for batch in batches:
        flat, n = terms_of(batch.column("text"))
        at, terms, counts = 0, [], []
        for size in n.tolist():
            found = flat.slice(at, size).value_counts()
            terms.append(found.field("values").to_pylist())
            counts.append(found.field("counts").to_pylist())
            at += size
        yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(terms, pa.list_(pa.binary())),
                                          pa.array(counts, pa.list_(pa.int32()))], ["number", "terms", "counts"])


def _top(rows: DataFrame, keys: list, k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, max_terms: int = MAX_TERMS,
           shard_docs: int = SHARD) -> DataFrame:
    """The k best documents for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship_package(spark)
    numbered = materialize(items.select("item_id", F.col("text").cast("binary").alias("text"))
                           .withColumn("number", F.monotonically_increasing_id()), "search-items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = spark.createDataFrame([], "query long, doc_id long, score long, rank int")
    for block in _blocks(numbered, max_terms):
        terms = sorted({t for _, own in block for t, _ in own})
        if not terms:
            continue
        place = {t: i for i, t in enumerate(terms)}
        index = materialize(rows.mapInArrow(_index(terms), ROWS), "search-index")
        totals = index.where("kind = 1")
        n_docs, all_terms = totals.agg(F.sum("doc_id"), F.sum("n")).first()
        if not all_terms:
            continue
        df = np.zeros(len(terms), np.int64)  # one number for each term of the block
        held = totals.select(F.inline(F.arrays_zip("terms", "counts"))).groupBy("terms").agg(F.sum("counts").alias("df"))
        for r in held.toLocalIterator():
            df[r.terms] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = [(number, np.array([place[t] for t, _ in own], np.int64), np.array([c for _, c in own], np.int64))
                   for number, own in block if own]
        found = index.where("kind = 0 and size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(
            _search(queries, weights, n_docs, all_terms, k, shard_docs), "query long, doc_id long, score long, part int")
        # many tasks each have k rows of a query: first by groups of tasks
        first = _top(found.withColumn("part", F.col("part") % 64), ["query", "part"], k).drop("rank", "part")
        out = out.unionByName(materialize(_top(first, ["query"], k), "search-best"))
    return out.join(numbered.select("item_id", F.col("number").alias("query")), "query").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
