"""MinHash near-duplicates with HyperMinHash registers.

A document's set is its distinct 5-word shingles (64-bit hashes). The hashes are
dealt into buckets by their first bits; a bucket's register keeps, of its smallest
hash, the count of leading zeros and the mantissa bits after them (16 bits in
all). An empty bucket repeats the register of the first filled one in an order of
its own. Documents with equal sets form one class, and everything below is done
once for a class, so exact copies cost nothing.

1. Bands of registers give buckets of classes. In each bucket every member is
   paired with its smallest (a star, so a group of n copies gives n pairs).
2. A pair is estimated by its equal registers, less those expected to be equal by
   collision; pairs far below the threshold go. The others are confirmed on the
   full shingle sets, recomputed from the texts.
3. Components of the links. Only members of different components of a bucket can
   add anything: in buckets with few members all such pairs follow. In larger ones
   (a passage that many texts share, copies of copies) the members are compared
   inside the tasks, in blocks, by registers and then by their sets of shingles:
   no pair leaves a task but the links that it finds. No partner is dropped.

A pair at the threshold shares no band with a probability below 1e-6.

Defined results: texts without words, and null texts, have no shingles and are
linked with nothing, so each keeps itself. Fewer than five words are one shingle.
A component's id is its smallest doc_id, nulls aside; if it has none, component_id
is null and its rows count as kept. Rows that repeat a doc_id are kept or dropped
with it (``keep_one`` leaves one). An empty table gives no rows. Extra columns are
kept by ``keep_one`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.llm.common import checked_broadcast
from sigclass.llm.components import components, joined_with
from sigclass.session import materialize, ship_package

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bands and registers of each.
BANDS, ROWS = 52, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Buckets with more members than this are compared inside the tasks, in blocks of about BLOCK.
LARGE_BUCKET, BLOCK = 16, 1000
#: Expected collisions of a register of unequal sets, times 2**MANTISSA (HyperMinHash, 2017).
COLLISION = 0.169919487159739
#: Below the threshold by this much, an estimate of 260 registers is over five deviations off.
MARGIN = 0.15
#: Pairs with a set below this are not estimated.
SMALL_SET = 40

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                   0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Distinct shingle hashes of texts; remembers the hashes of words, of which it holds a
    bounded number at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, n)
        width = min(n, SHINGLE)
        total = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            total += h[i:n - width + 1 + i] * _STEP[i]
        return np.unique(_mixed(total))


class Sketcher:
    """REGISTERS 16-bit registers of a sorted set of hashes: (leading zeros, mantissa)."""

    def __init__(self):
        rng = np.random.RandomState(5)
        self.orders = np.argsort(rng.random_sample((REGISTERS, REGISTERS)), 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        filled, first = np.unique(bucket.astype(np.int64), return_index=True)  # hashes are sorted
        # the bits within a bucket: a second hash, of which each bucket wants the smallest
        inner = _mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        least = np.minimum.reduceat(inner, first)
        zeros = (64 - np.frexp(least.astype(np.float64))[1]).clip(0, 62)
        body = least << (zeros.astype(np.uint64) + np.uint64(1))  # without the leading one
        packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | (body >> np.uint64(64 - MANTISSA))
        out = np.zeros(REGISTERS, np.uint16)
        out[filled] = packed
        if len(filled) < REGISTERS:
            has = np.zeros(REGISTERS, bool)
            has[filled] = True
            empty = np.flatnonzero(~has)
            order = self.orders[empty]
            out[empty] = out[order[np.arange(len(empty)), has[order].argmax(1)]]
        return out


def _signatures(batches):
    shingle, sketch = Shingler(), Sketcher()
    for batch in batches:
        sets = [shingle(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"),
             pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            ["doc_id", "text_hash", "set_id", "n_shingles", "registers"])


def _band_keys(regs: np.ndarray) -> np.ndarray:
    """The key of each band of each row of registers."""
    keys = np.repeat(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[0])[None, :], len(regs), 0)
    parts = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys + (parts[:, :, r] + np.uint64(1)) * _STEP[r % 5])
    return keys.view(np.int64)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _banded(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            keys = _band_keys(_registers(batch.column("registers")))
            nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _jaccard(equal: np.ndarray) -> np.ndarray:
    """Estimate from the share of equal registers, less the collisions expected among the others."""
    by_chance = COLLISION / (1 << MANTISSA)
    return (equal - by_chance) / (1 - by_chance)


def _is_link(both: int, na: int, nb: int) -> bool:
    return 100 * both >= PERCENT * (na + nb - both)


def _sets(batches):
    """Shingle sets as sorted hashes, for the comparison inside large buckets: the sets that confirm a pair."""
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t).astype("<u8") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in sets], pa.binary())],
                                         ["node", "members"])


def _links_in_block(key, rows):
    """Links between members of a large bucket that are in different components, for one pair of
    blocks. A pair that shares an earlier band is left to that band's bucket, and once two
    components are linked here their other pairs are not looked at."""
    (bucket, first, second), found = (k.as_py() for k in key), []
    nodes, comps, blocks = (rows.column(c).to_numpy() for c in ("node", "comp", "block"))
    regs = _registers(rows.column("registers"))
    members = [np.frombuffer(x, "<u8") for x in rows.column("members").to_pylist()]
    sizes = np.array([len(m) for m in members])
    band = int(np.flatnonzero(_band_keys(regs[:1])[0] == bucket)[0])
    roots = comps.copy()
    left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
    for place, a in enumerate(left):
        others = right[place + 1:] if first == second else right
        others = others[(roots[others] != roots[a])
                        & (100 * np.minimum(sizes[others], sizes[a]) >= PERCENT * np.maximum(sizes[others], sizes[a]))]
        if not len(others):
            continue
        equal = regs[others] == regs[a]
        here = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        likely = here & ((np.minimum(sizes[others], sizes[a]) < SMALL_SET)
                         | (_jaccard(equal.mean(1)) >= PERCENT / 100 - MARGIN))
        for b in others[likely]:
            if roots[a] != roots[b]:
                both = len(np.intersect1d(members[a], members[b], assume_unique=True))
                if _is_link(both, sizes[a], sizes[b]):
                    found.append(sorted((int(nodes[a]), int(nodes[b]))))
                    roots[roots == roots[b]] = roots[a]
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _estimated(least: float):
    def run(batches):
        for batch in batches:
            jaccard = _jaccard((_registers(batch.column("ra")) == _registers(batch.column("rb"))).mean(1))
            # of very small sets a few that share a bucket move the estimate: they are confirmed at once
            small = np.minimum(*[batch.column(c).to_numpy() for c in ("na", "nb")]) < SMALL_SET
            keep = pa.array(small | (jaccard >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])
    return run


def _confirmed(batches):
    shingle, last = Shingler(), {}

    def known(node, text):
        if node not in last:
            if len(last) >= 32:
                last.clear()
            last[node] = shingle(text)
        return last[node]

    for batch in batches:
        linked = []
        for a, b, ta, tb in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]):
            sa, sb = known(a, ta), known(b, tb)
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            linked.append(_is_link(both, len(sa), len(sb)))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


class _Linker:
    """Confirms candidate pairs of the classes of some documents."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.tried = None

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b), a < b; pairs that were tried before are left out."""
        pairs = pairs.distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return pairs
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"),
                                             F.col("registers").alias(f"r{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
            100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        likely = materialize(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(
            _estimated(PERCENT / 100 - MARGIN), "a long, b long"), "likely")
        texts = self.texts(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct())
        both = (likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
        return materialize(both.mapInArrow(_confirmed, "a long, b long"), "links")

    def links_inside(self, members: DataFrame) -> DataFrame:
        """Links among the members (key, node, comp, n) of large buckets, compared in blocks."""
        sets = self.texts(members.select("node").distinct()).mapInArrow(_sets, "node long, members binary")
        payload = self.classes.select("node", "registers").join(sets, "node")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = members.select("key", "node", "comp", F.pmod(F.xxhash64("node", "key"), blocks).cast("int").alias("block"),
                               F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        found = dealt.join(payload, "node").groupBy("key", "first", "second").applyInArrow(_links_in_block, "a long, b long")
        return materialize(found.distinct(), "links")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """node and text of some classes, each from one of its documents."""
        wanted = self.classes.select("node", "pick").join(nodes, "node").select(
            "node", F.col("pick.doc_id").alias("_doc"), F.col("pick.text_hash").alias("_hash"))
        wanted = checked_broadcast(materialize(wanted, "wanted"), 1_000_000)  # three longs a row
        rows = self.docs.select("doc_id", "text_hash", "text").join(
            wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        return materialize(rows.dropDuplicates(["node"]).select("node", "text"), "texts")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, node and first (the bucket's smallest node) of all buckets with several nodes."""
    banded = classes.select("node", "registers").mapInArrow(_banded, "key long, node long")
    several = (banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
               .where("first < last").select("key", "first"))
    return materialize(banded.join(several, "key"), "buckets")


def _star(buckets: DataFrame) -> DataFrame:
    return buckets.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))


def _unresolved(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """key, node, comp and n (members) of the buckets whose nodes are not all in one component."""
    marked = buckets.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_ = (marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                       F.count(F.lit(1)).alias("n")).where("low < high").select("key", "n"))
    return materialize(marked.join(open_, "key"), "unresolved")


def _across(members: DataFrame) -> DataFrame:
    """Pairs of members of one bucket in different components."""
    other = members.select("key", F.col("node").alias("b"), F.col("comp").alias("other"))
    return (members.select("key", F.col("node").alias("a"), "comp").join(other, "key")
            .where("a < b and comp <> other").select("a", "b"))


def _linked(linker: _Linker, classes: DataFrame) -> DataFrame:
    """node and comp of every class that is linked with another."""
    buckets = _buckets(classes)
    comps = components(linker.links(_star(buckets)))
    members = _unresolved(buckets, comps)
    links = linker.links(_across(members.where(F.col("n") <= LARGE_BUCKET)))
    large = members.where(F.col("n") > LARGE_BUCKET)
    if not large.isEmpty():
        links = links.unionByName(linker.links(linker.links_inside(large)))
    return joined_with(comps, links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; and text_hash and comp, which
    tell rows and components apart where doc_ids repeat."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("binary").alias("text"))
    signed = materialize(rows.mapInArrow(_signatures, "doc_id long, text_hash long, set_id binary, n_shingles long, "
                                                      "registers binary"), "signatures")
    classes = (signed.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("least_doc"), F.min(F.struct("doc_id", "text_hash")).alias("pick"),
        F.any_value("n_shingles").alias("n_shingles"), F.any_value("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()))
    classes = materialize(classes, "classes")
    found = _linked(_Linker(rows, classes), classes)
    comps = classes.select("set_id", "least_doc", "node").join(found, "node", "left").select(
        "set_id", "least_doc", F.coalesce("comp", "node").alias("comp"))
    comps = materialize(comps, "class-components")
    ids = comps.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    by_set = comps.join(ids, "comp").select("set_id", "comp", "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(by_set, "set_id", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", own).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_hash", "comp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: of each component the row with its id."""
    marked = near_duplicates(docs).groupBy("doc_id", "text_hash", "comp", "kept", "n_shingles").agg(
        F.count(F.lit(1)).alias("rows"))
    marked = materialize(marked, "marked-rows")
    # where a doc_id repeats with several texts, one of them stays
    stays = marked.where("kept and n_shingles > 0").groupBy("comp").agg(F.min("text_hash").alias("_stay"))
    gone = (marked.where("n_shingles > 0").join(stays, "comp")
            .where(~F.col("kept") | (F.col("text_hash") != F.col("_stay"))))
    pairs = lambda x: checked_broadcast(materialize(x.select(  # noqa: E731  two longs a row
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), "rows"), 2_000_000)
    same = F.col("_doc").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("text_hash"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    left = rows.join(pairs(gone), same, "left_anti")
    repeated = pairs(marked.where("n_shingles > 0 and rows > 1"))
    once = left.join(repeated, same, "left_anti")
    many = left.join(repeated, same, "left_semi").dropDuplicates(["id", "text_hash"])
    return once.unionByName(many).select("row.*")
