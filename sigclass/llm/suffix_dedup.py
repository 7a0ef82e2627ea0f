"""Removing repeated passages with a sparse suffix array.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else.

1. Suffixes are taken at anchors: of every window of ``length`` bytes the gram of ``gram``
   bytes with the smallest hash (the leftmost of equal ones). Equal windows have the same
   anchor at the same place, so windows need only be compared with windows of anchors with an
   equal gram. Consecutive windows of one anchor form its block: about one in 75 bytes starts one.
2. Anchors whose gram occurs once are dropped. Equal blocks are counted, with a map-side step, so
   that a passage which a third of all documents share is one row. Windows of a block that
   occurs twice are repeated; so a block of a group of copies needs no more comparing.
3. Where a gram stands in different blocks, one suffix of each is fetched from its text: the bytes
   from the anchor on and, backwards, those before it. Sampled splitters range-partition the
   suffixes by their leading bytes. Each bucket is sorted by a multikey quicksort on 8-byte
   characters, once from the anchor to the right and once to the left. With the longest common
   prefixes of neighbours, windows that begin d bytes before their anchors are equal if their suffixes
   share length - d bytes to the right and d bytes to the left.
4. Windows that a bucket's first or last suffix might share with the next bucket are
   compared across boundaries by their digests, so a gram may fill any number of buckets.
5. Windows give spans of bytes, which are cut out of the texts.

Texts are known by their SHA-256. Of texts that occur more than once all bytes are repeated
(if there are ``length`` of them), without a look at their windows. Blocks are equal if 64-bit
hashes of their grams and of their bytes are.

Defined results: a null text is empty. Texts shorter than ``length`` keep all bytes. Repeated rows are
copies. Cutting can leave bytes that are not UTF-8; they are hashed as they are. A document
of any length is read in pieces that overlap by a window. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigclass.session import materialize, ship_package

#: Bytes of a repeated string, and of the grams that select its anchor.
LENGTH, GRAM = 200, 50
#: Starts of windows in one piece of text; positions in a piece fit POSITION_BITS.
PIECE, POSITION_BITS = 1 << 20, 22
#: Suffixes of one bucket, about.
BUCKET = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ANCHORS = ("digest binary, gram array<long>, block array<long>, at array<long>, "
           "back array<int>, windows array<int>")
EMPTY = hashlib.sha256().digest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """The anchors of many pieces of text at a time."""

    def __init__(self, length: int, gram: int, most: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.bytes = np.random.RandomState(5).randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _BASE)]), dtype=np.uint64)
        self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _INVERSE)]), dtype=np.uint64)

    def find(self, data: np.ndarray, piece: np.ndarray):
        """For bytes and the number of the piece that each belongs to: of each block its first and last
        window's start, its anchor, and the hashes of its gram and of its bytes."""
        n = len(data)
        if n < self.length:
            return tuple(np.array([], np.int64) for _ in range(5))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.bytes[data] * self.powers[:n], dtype=np.uint64)])
        grams = _mix((sums[self.gram:] - sums[:-self.gram]) * self.inverses[:n - self.gram + 1])
        low = np.uint64((1 << POSITION_BITS) - 1)
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        # the smallest key of each run of ``width`` keys: from the ends of blocks of that width
        w, windows = self.width, n - self.length + 1
        padded = np.full(-(-len(keys) // w) * w + w, ~np.uint64(0))
        padded[:len(keys)] = keys
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows]) & low).astype(np.int64)
        whole = piece[:windows] == piece[self.length - 1:]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]])
        first = np.flatnonzero(whole & new)
        last = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
        anchor = anchor[first]
        shape = ((anchor - first) << 20 | (anchor - last)).astype(np.uint64)
        blocks = _mix(_mix((sums[last + self.length] - sums[first]) * self.inverses[first]) ^ _mix(shape + _BASE))
        return first, last, anchor, grams[anchor].astype(np.int64), blocks.astype(np.int64)


def _anchors(length: int, gram: int, piece: int):
    def rows(pending, finder):
        data = np.concatenate([p[2] for p in pending])
        sizes = np.array([len(p[2]) for p in pending])
        starts = np.cumsum(sizes) - sizes
        first, last, anchor, grams, blocks = finder.find(data, np.repeat(np.arange(len(pending), dtype=np.int32), sizes))
        owner = np.searchsorted(starts, first, side="right") - 1
        at = anchor - starts[owner] + np.array([p[1] for p in pending], np.int64)[owner]
        offsets = pa.array(np.searchsorted(owner, np.arange(len(pending) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in (
            (grams, pa.int64()), (blocks, pa.int64()), (at, pa.int64()), (anchor - first, pa.int32()), (last - first + 1, pa.int32()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pending], pa.binary()), *lists],
            [x.split()[0] for x in ANCHORS.split(", ")])

    def anchors(batches):
        finder, pending, held = Anchors(length, gram, piece + length), [], 0
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                for start in range(0, max(0, len(text) - length + 1), piece - length):
                    part = np.frombuffer(text, np.uint8)[start:start + piece - 1]
                    if held + len(part) > piece and pending:
                        yield rows(pending, finder)
                        pending, held = [], 0
                    pending.append((digest, start, part))
                    held += len(part)
        if pending:
            yield rows(pending, finder)
    return anchors


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of equally many characters, by multikey quicksort (Bentley and Sedgewick, 1997).

    Each round partitions all open groups at once, by their own pivots, into smaller, equal and
    greater characters; equal ones go on with the next character."""
    n, most = words.shape
    order = np.arange(n)
    place, sizes, depth = np.arange(n), np.array([n]), np.zeros(1, np.int64)
    if n < 2:
        return order
    while len(sizes):
        group = np.repeat(np.arange(len(sizes)), sizes)
        chars = words[order[place], depth[group]]
        pivots = chars[np.cumsum(sizes) - sizes + sizes // 2][group]
        part = 3 * group + np.where(chars < pivots, 0, np.where(chars == pivots, 1, 2))
        order[place] = order[place][np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(sizes))
        depth = np.repeat(depth, 3) + np.tile([0, 1, 0], len(sizes))
        go_on = (counts > 1) & (depth < most)
        place = place[np.repeat(go_on, counts)]
        sizes, depth = counts[go_on], depth[go_on]
    return order


def _sorted(rows: list[bytes], size: int):
    """The order of byte strings of at most ``size`` bytes, and each one's common prefix with the one before it."""
    size = -(-size // 8) * 8
    table = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), np.uint8).reshape(len(rows), size)
    order = multikey_order(table.view(">u8").astype(np.uint64))
    common = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 10_000):
        b = min(a + 10_000, len(rows))
        differ = table[order[a:b]] != table[order[a - 1:b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
    return order, common


def _compare(length: int, gram: int, more: bool):
    """The windows of a bucket's suffixes that are repeated: kind 0 with the first and last start of a
    run; and kind 1, with a digest, those that must be compared across the bucket's boundaries."""
    def compare(batches):
        bucket = pa.Table.from_batches(batches, pa.schema(BUCKET_FIELDS))
        n = bucket.num_rows
        if not n:
            return
        ahead, behind = bucket.column("ahead").to_pylist(), bucket.column("behind").to_pylist()
        copies, place, at, back = [bucket.column(c).to_numpy() for c in ("n", "place", "at", "back")]
        right, right_common = _sorted(ahead, length)
        left, left_common = _sorted(behind, length - gram)
        least = back - bucket.column("windows").to_numpy() + 1
        repeated, edge = [], []
        to_right, to_left = np.empty(n, np.int64), np.empty(n, np.int64)
        for d in range(length - gram + 1):
            own = np.flatnonzero((least <= d) & (d <= back))
            if not len(own):
                continue
            to_right[right] = np.cumsum(right_common < length - d)
            to_left[left] = np.cumsum(left_common < d)
            _, same, counts = np.unique(to_right[own] * n + to_left[own], return_inverse=True, return_counts=True)
            repeated.append(np.stack([own, np.full(len(own), d)])[:, counts[same] > 1])
            if more:
                outer = (to_right[own] == to_right[right[0]]) | (to_right[own] == to_right[right[-1]])
                edge.append(np.stack([own, np.full(len(own), d)])[:, outer])
        out = []
        who, d = np.concatenate([np.empty((2, 0), np.int64), *repeated], axis=1)
        who, d = who[copies[who] == 1], d[copies[who] == 1]
        order = np.lexsort((-d, who))
        who, start = who[order], (at[who] - d)[order]
        if len(who):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(who) != 0) | (np.diff(start) != 1)]))
            end = np.append(new[1:], len(who)) - 1
            out += [(0, *r, None) for r in zip(place[who[new]].tolist(), start[new].tolist(), start[end].tolist())]
        for i, x in np.concatenate([np.empty((2, 0), np.int64), *edge], axis=1).T.tolist():
            window = behind[i][:x][::-1] + ahead[i][:length - x]
            low = int(at[i]) - x
            out.append((1, int(place[i]) if copies[i] == 1 else None, low, low,
                        hashlib.blake2b(window, digest_size=16).digest()))
        for a in range(0, len(out), 50_000):
            kind, place, low, high, digest = zip(*out[a:a + 50_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.array(digest, pa.binary())], ["kind", "place", "low", "high", "digest"])
    return compare


def _fetch(length: int):
    """The suffixes that a text is asked for, each with the bytes before its anchor, backwards."""
    names = ("gram", "block", "n", "place", "at", "back", "windows")

    def fetch(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                out = []
                for text, wanted in zip(*[whole.slice(at, 200).column(c).to_pylist() for c in ("text", "wanted")]):
                    for w in wanted:
                        p = w["at"]
                        least = w["back"] - w["windows"] + 1
                        out.append((*[w[c] for c in names], text[p:p + length - least], text[p - w["back"]:p][::-1]))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()] * 2)],
                    [*names, "ahead", "behind"])
    return fetch


BUCKET_FIELDS = [(c, pa.int64()) for c in ("gram", "block", "n", "place", "at")] + [
    ("back", pa.int32()), ("windows", pa.int32()), ("ahead", pa.binary()), ("behind", pa.binary())]
SUFFIXES = ("gram long, block long, n long, place long, at long, back int, windows int, ahead binary, behind binary")


def _cut(length: int):
    """What is left of a text without the union of its windows."""
    def cut(batches):
        for batch in batches:
            out = []
            for digest, text, spans in zip(*[batch.column(c).to_pylist() for c in ("digest", "text", "spans")]):
                kept, n_spans, upto = hashlib.sha256(), 0, 0
                removed, begin = 0, None
                for low, high in sorted((s["low"], s["high"] + length) for s in spans):
                    if begin is None or low > upto:
                        if begin is not None:
                            removed += upto - begin
                        kept.update(text[upto:low])
                        n_spans, begin = n_spans + 1, low
                    upto = max(upto, high)
                removed += upto - begin
                kept.update(text[upto:])
                out.append((digest, removed, n_spans, kept.digest()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                ["digest", "n_removed", "n_spans", "kept"])
    return cut


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn(
                           "digest", F.unhex(F.sha2("text", 256)))


def _semi_join(big: DataFrame, small: DataFrame, keys: list, rows: int) -> DataFrame:
    """The rows of ``big`` (``rows`` in all) whose keys are in ``small``, which has their number ``n`` in ``big``.

    Keys with more than a thousandth of the rows, of which there are less than a thousand, are
    broadcast, so that theirs are not dealt to one task; the others meet in a shuffle join."""
    heavy = F.broadcast(small.where(F.col("n") * 1000 > rows).select(*keys))
    rest = small.where(F.col("n") * 1000 <= rows).select(*keys)
    return big.join(heavy, keys, "left_semi").unionByName(
        big.join(heavy, keys, "left_anti").join(rest, keys, "left_semi"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET,
                     piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Runs of starts of repeated windows: place, low, high; and the pieces: place, digest."""
    texts = _texts(docs)
    pieces = texts.where(F.length("text") >= length).select("digest", "text").mapInArrow(
        _anchors(length, gram, piece), ANCHORS).withColumn("place", F.monotonically_increasing_id())
    pieces = materialize(pieces, "suffix-anchors")
    anchors = pieces.select("place", F.inline(F.arrays_zip("gram", "block", "at", "back", "windows")))
    n_anchors = pieces.agg(F.sum(F.size("gram"))).first()[0] or 0
    often = materialize(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-grams")
    anchors = materialize(_semi_join(anchors, often, ["gram"], n_anchors), "suffix-candidates")
    blocks = anchors.groupBy("gram", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "at", "back", "windows")).alias("one"))
    blocks = materialize(blocks.select("gram", "block", "n", "one.*"), "suffix-blocks")
    # equal blocks: all their windows are repeated
    equal = _semi_join(anchors, blocks.where("n > 1"), ["gram", "block"], n_anchors).select(
        "place", (F.col("at") - F.col("back")).alias("low"), (F.col("at") - F.col("back") + F.col("windows") - 1).alias("high"))
    # different blocks of one gram: their suffixes are sorted, if one of them occurs only once
    mixed = blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("blocks"), F.min("n").alias("least")).where(
        "blocks > 1 and least = 1").select("gram")
    wanted = materialize(blocks.join(mixed, "gram", "left_semi").join(
        pieces.select("place", "digest"), "place"), "suffix-wanted")
    n_wanted = wanted.count()
    runs = equal
    if n_wanted:
        asked = wanted.groupBy("digest").agg(F.collect_list(F.struct(
            "gram", "block", "n", "place", "at", "back", "windows")).alias("wanted"))
        # of copies one is asked; the rest go before the shuffle
        suffixes = texts.select("digest", "text").dropDuplicates(["digest"]).join(asked, "digest").select(
            "text", "wanted").mapInArrow(_fetch(length), SUFFIXES)
        suffixes = materialize(suffixes, "suffix-rows")
        buckets = -(-n_wanted // bucket)
        compared = materialize(
            suffixes.repartitionByRange(buckets, "ahead", "behind", "block")
            .mapInArrow(_compare(length, gram, buckets > 1), "kind int, place long, low long, high long, digest binary"), "suffix-compared")
        across = compared.where("kind = 1")
        twice = across.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        runs = runs.unionByName(compared.where("kind = 0").select("place", "low", "high")).unionByName(
            across.where("place is not null").join(twice, "digest", "left_semi").select("place", "low", "high"))
    return runs, pieces.select("place", "digest")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET,
                    piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ship_package(docs.sparkSession)
    texts = _texts(docs)
    counts = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "suffix-copies")
    runs, pieces = repeated_windows(docs, length, gram, bucket, piece)
    alone = pieces.join(counts.where("copies = 1"), "digest", "left_semi")
    spans = runs.join(alone, "place").groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = materialize(spans, "suffix-spans")
    cut = materialize(texts.select("digest", "text").join(spans, "digest").select("digest", "text", "spans").mapInArrow(
        _cut(length), "digest binary, n_removed long, n_spans long, kept binary"), "suffix-cut")
    rows = texts.select("doc_id", "digest", F.length("text").cast("long").alias("n_bytes")).join(counts, "digest").join(
        cut, "digest", "left")
    all_of_it = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes", F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_of_it, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(all_of_it, F.lit(EMPTY)).otherwise(F.coalesce("kept", "digest")))).alias("kept_sha256"))
