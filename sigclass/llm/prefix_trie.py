"""A prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation's turns are laid out in blocks of ``width`` columns, one row for each
block; ``GROUP BY block, prior, ROLLUP (t1, ..., tw)`` then aggregates all prefixes of a
block together, and ``grouping_id`` tells a row's depth. Longer conversations continue in
further blocks, whose rows carry the node at which the block before them ended
(``prior``), so one query has all blocks. A second ROLLUP sums what belongs to subtrees.

A turn's id is a hash of its place, role and text; a node's id is the sum of the ids on
its path, twice with independent hashes (118 bits), so it needs no walk along a
conversation and distributed prefix sums give it for conversations of any length. Places
come from a global sort and prefix sums too: a conversation that holds a third of all
turns is cut over many tasks. Aggregates over conversations have a map-side step, and the
conversations that end at a node are hashed as a stream of short pieces.

Defined results: a null role or text counts as empty; turns are ordered by turn (null
first), equal ones by role and then the MD5 of the text, and repeated rows are turns of
their own. Rows without conv_id belong to no conversation and are left out. Other columns
are not read. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.llm.common import n_words, prefix_sums
from sigclass.session import materialize, ship_package

#: Positional columns of a block.
WIDTH = 6
#: Ids of turns and nodes are sums modulo 2**59, so that a block's sum fits a long.
MASK = (1 << 59) - 1
#: Conversations of one family, of which the first one lends its beginning, and the most turns lent, plus 1.
FAMILY, MOST_LENT = 20, 4
#: Ids of conversations in one piece of text that is hashed.
PIECE = 256


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def turns_in_order(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, digest (of the text), words: one row per turn."""
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"), n_words("text").alias("words"), F.lit(1).alias("one"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", F.monotonically_increasing_id()]
    placed = materialize(prefix_sums(turns, order, {"one": "place"}, "trie-turns"), "trie-places")
    starts = placed.groupBy("conv_id").agg(F.min("place").alias("start"))
    return placed.join(starts, "conv_id").select(
        "conv_id", (F.col("place") - F.col("start")).alias("pos"), "role", "digest", "words")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with the beginnings that their family's first one lends them.

    Returns turns (conv_id, pos, role, digest, words) and conversations (conv_id, n_turns), turnless
    ones included: the first h turns of conversation c - c % 20, then c's own after its first h,
    with h the CRC-32 of c in decimal, modulo 4."""
    own = materialize(turns_in_order(rows), "trie-own")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"),
        (F.crc32(F.col("conv_id").cast("string")) % MOST_LENT).alias("lent"))
    lengths = convs.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = materialize(convs.join(lengths, "first", "left").select(
        "conv_id", "first", "lent", "n", F.least("lent", F.coalesce("n_first", F.lit(0))).alias("taken")), "trie-convs")
    # at most three turns of a family's first conversation, for each of its twenty
    beginnings = own.where(F.col("pos") < MOST_LENT - 1).withColumnRenamed("conv_id", "first").join(
        convs.select("conv_id", "first", "lent"), "first").where(F.col("pos") < F.col("lent"))
    rest = own.join(convs.select("conv_id", "lent", "taken"), "conv_id").where(F.col("pos") >= F.col("lent"))
    columns = ["role", "digest", "words"]
    turns = beginnings.select("conv_id", "pos", *columns).unionByName(
        rest.select("conv_id", (F.col("pos") - F.col("lent") + F.col("taken")).alias("pos"), *columns))
    return turns, convs.select(
        "conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("lent"), F.lit(0))).alias("n_turns"))


def blocks_of(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per conversation and block: conv_id, block, t1.. and u1.. (the two ids of its turns), w1..
    (their words), and p and q, the node at which the block before it ended. A conversation
    without turns has a first block of nulls."""
    place = F.col("pos") + 1
    ids = turns.select("conv_id", F.floor(F.col("pos") / width).cast("long").alias("block"),
                       (F.col("pos") % width).cast("int").alias("col"), "words",
                       _mask(F.xxhash64(place, "role", "digest")).alias("t"),
                       _mask(F.xxhash64("digest", F.lit("second"), "role", place)).alias("u"))
    at = lambda name, i: F.max(F.when(F.col("col") == i, F.col(name)))
    rows = ids.groupBy("conv_id", "block").agg(
        *[at(name, i).alias(f"{name[0]}{i + 1}") for name in ("t", "u", "words") for i in range(width)])
    turnless = convs.where("n_turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    rows = materialize(rows.unionByName(turnless, allowMissingColumns=True), "trie-blocks")
    # only conversations of several blocks need sums over blocks
    long = convs.where(F.col("n_turns") > width).select("conv_id")
    some = rows.join(long, "conv_id", "left_semi").select(
        "conv_id", "block", *[_mask(_total(x, width)).cast("decimal(38,0)").alias(f"sum_{x}") for x in "tu"])
    sums = prefix_sums(some, ["conv_id", "block"], {"sum_t": "before_t", "sum_u": "before_u"}, "trie-prior")
    sums = materialize(sums, "trie-prior-sums")
    starts = sums.where("block = 0").select("conv_id", F.col("before_t").alias("first_t"), F.col("before_u").alias("first_u"))
    modulo = lambda x: ((F.col(f"before_{x}") - F.col(f"first_{x}")) % F.lit(MASK + 1).cast("decimal(38,0)")).cast("long")
    prior = sums.where("block > 0").join(starts, "conv_id").select(
        "conv_id", "block", modulo("t").alias("p"), modulo("u").alias("q"))
    joined = rows.join(prior, ["conv_id", "block"], "left")
    return materialize(joined.fillna(0, ["p", "q"]), "trie-rows")


def _total(x: str, width: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(width):
        out = out + F.coalesce(F.col(f"{x}{i + 1}"), F.lit(0))
    return out


def _rollup(rows: DataFrame, aggregates: str, width: int) -> DataFrame:
    """One row per node: block, p, q, t1.., place (its column, 0 for the root) and the aggregates."""
    columns = ", ".join(f"t{i + 1}" for i in range(width))
    groups = rows.sparkSession.sql(
        f"SELECT block, p, q, {columns}, {width} - bit_count(grouping_id()) AS place, {aggregates} "
        f"FROM {{rows}} GROUP BY block, p, q, ROLLUP ({columns})", rows=rows)
    # a block's total is the node at the end of the block before it, which has its row there; and a
    # null in a prefix's last column says that some conversations are over
    last = _picked("t", width, 1)
    return groups.where(((F.col("place") == 0) & (F.col("block") == 0)) | ((F.col("place") > 0) & last.isNotNull()))


def _picked(prefix: str, width: int, start: int) -> Column:
    """What a row of ``_rollup`` has for the node's own column (null for a root without one)."""
    return F.get(F.array(*[F.col(f"{prefix}{i}") for i in range(start, width + 1)]), F.col("place") - start)


def _node_id(width: int) -> tuple[Column, Column]:
    """The node's two ids. In ``x`` a row has, as largest values, the second ids of all columns, of
    which those up to the node's own one are its prefix's."""
    second = F.lit(0).cast("long")
    for i in range(1, width + 1):
        second = second + F.when(F.col("place") >= i, F.coalesce(F.col(f"x{i}"), F.lit(0))).otherwise(F.lit(0))
    return _mask(F.col("p") + _total("t", width)), _mask(F.col("q") + second)


def nodes_of(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: depth, k and l (its id), pk and pl (its parent's), conv_id, n_convs, words."""
    sums = ", ".join(f"max(u{i}) AS x{i}, max(w{i}) AS y{i}" for i in range(1, width + 1))
    groups = _rollup(rows, f"count(1) AS n_convs, min(conv_id) AS conv_id, {sums}", width)
    k, l = _node_id(width)
    return groups.select(
        (F.col("block") * width + F.col("place")).alias("depth"), k.alias("k"), l.alias("l"), "conv_id", "n_convs",
        F.coalesce(_picked("y", width, 1), F.lit(0)).alias("words"),
        _mask(k - _picked("t", width, 1)).alias("pk"), _mask(l - _picked("x", width, 1)).alias("pl"))


def _subtrees(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """depth, k, l, n_leaves, saved_tokens: sums over each node's subtree.

    Each node's own figures are put to the conversation that names it (its smallest member). A
    conversation's figures from a depth on, summed over a node's members by ROLLUP, are those of
    the node's subtree."""
    # a node stands in the block of its own column; the root in the first block
    at = F.greatest(F.col("depth") - 1, F.lit(0))
    own = nodes.select("conv_id", F.floor(at / width).cast("long").alias("block"),
                       F.when(F.col("depth") == 0, F.lit(0)).otherwise(at % width + 1).cast("int").alias("col"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
                       (F.col("n_children") == 0).cast("long").alias("leaf"))
    own = own.groupBy("conv_id", "block").agg(*[
        F.sum(F.when(F.col("col") == i, F.col(name)).otherwise(F.lit(0))).alias(f"{short}{i}")
        for short, name in (("s", "saved"), ("f", "leaf")) for i in range(width + 1)])
    figures = [f"{short}{i}" for short in "sf" for i in range(width + 1)]
    both = rows.select("conv_id", "block", "p", "q", *[f"t{i + 1}" for i in range(width)],
                       *[f"u{i + 1}" for i in range(width)]).join(own, ["conv_id", "block"], "left").fillna(0, figures)
    both = materialize(both, "trie-figures")
    # what a conversation has in later blocks (conversations of one block have none)
    total = lambda short: sum((F.col(f"{short}{i}") for i in range(1, width + 1)), F.col(f"{short}0"))
    long = both.where("block > 0").select("conv_id").distinct()
    some = both.join(long, "conv_id", "left_semi").select(
        "conv_id", "block", *[total(x).cast("decimal(38,0)").alias(f"sum_{x}") for x in "sf"])
    order = ["conv_id", F.col("block").desc()]
    sums = materialize(prefix_sums(some, order, {"sum_s": "after_s", "sum_f": "after_f"}, "trie-later"), "trie-later-sums")
    starts = sums.groupBy("conv_id").agg(F.min("after_s").alias("first_s"), F.min("after_f").alias("first_f"))
    later = sums.join(starts, "conv_id").select(
        "conv_id", "block", *[(F.col(f"after_{x}") - F.col(f"first_{x}")).cast("long").alias(f"rest_{x}") for x in "sf"])
    both = both.join(later, ["conv_id", "block"], "left").fillna(0, ["rest_s", "rest_f"])
    parts = []
    for x in "sf":
        from_here = F.col(f"rest_{x}")
        for i in range(width, -1, -1):
            from_here = from_here + F.col(f"{x}{i}")
            parts.append(from_here.alias(f"{x}_from{i}"))
    both = both.select("block", "p", "q", *[f"t{i + 1}" for i in range(width)],
                       *[f"u{i + 1}" for i in range(width)], *parts)
    sums = ", ".join([*[f"sum({x}_from{i}) AS {x}{i}" for x in "sf" for i in range(width + 1)],
                      *[f"max(u{i}) AS x{i}" for i in range(1, width + 1)]])
    groups = _rollup(both, sums, width)
    k, l = _node_id(width)
    return groups.select((F.col("block") * width + F.col("place")).alias("depth"), k.alias("k"), l.alias("l"),
                         _picked("f", width, 0).alias("n_leaves"), _picked("s", width, 0).alias("saved_tokens"))


def _pieces(batches):
    """Runs of conversations that end at one node, as text: depth, k, l, text."""
    for batch in batches:
        out, last, ids = [], None, []
        for *node, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "k", "l", "conv_id")]):
            if node != last or len(ids) >= PIECE:
                if ids:
                    out.append((*last, ",".join(ids)))
                last, ids = node, []
            ids.append(str(conv))
        if ids:
            out.append((*last, ",".join(ids)))
        if out:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in list(zip(*out))[:3]], pa.array([r[3] for r in out], pa.string())],
                ["depth", "k", "l", "text"])


def _hashes(batches):
    """The SHA-256 of each node's pieces, joined by commas; the pieces come in order."""
    node, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([digest.hexdigest()])],
                                          ["depth", "k", "l", "ends_sha256"])
    for batch in batches:
        for *this, text in zip(*[batch.column(c).to_pylist() for c in ("depth", "k", "l", "text")]):
            if this != node:
                if node is not None:
                    yield row()
                node, digest = this, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if node is not None:
        yield row()


def _ends(rows: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """depth, k, l, ends_sha256 of the nodes at which conversations end. The ids are range-sorted and
    joined to pieces of text, so that a task that hashes a very common end reads few, short rows."""
    final = rows.join(convs, "conv_id").where(
        F.col("block") == F.greatest(F.ceil(F.col("n_turns") / width) - 1, F.lit(0)))
    ends = final.select(F.col("n_turns").cast("long").alias("depth"), _mask(F.col("p") + _total("t", width)).alias("k"),
                        _mask(F.col("q") + _total("u", width)).alias("l"), "conv_id")
    node = ["depth", "k", "l"]
    pieces = (ends.repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
              .mapInArrow(_pieces, "depth long, k long, l long, text string")
              .withColumn("place", F.monotonically_increasing_id()))
    pieces = materialize(pieces, "trie-ends")
    return (pieces.repartition(*node).sortWithinPartitions(*node, "place").select(*node, "text")
            .mapInArrow(_hashes, "depth long, k long, l long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_package(rows.sparkSession)
    turns, convs = rebuilt(rows)
    convs = materialize(convs, "trie-lengths")
    blocks = blocks_of(turns, convs, width)
    nodes = materialize(nodes_of(blocks, width), "trie-nodes")
    node = ["depth", "k", "l"]
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("pk").alias("k"), F.col("pl").alias("l")).agg(
            F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, node, "left").fillna(0, ["n_children"]), "trie-children")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k").alias("pk"),
                                                   F.col("l").alias("pl"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, ["depth", "pk", "pl"], "left")
            .join(_subtrees(blocks, nodes, width), node, "left")
            .join(_ends(blocks, convs, width), node, "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")))
