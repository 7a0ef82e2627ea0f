"""Mixing sources to target weights by words, cut exactly at each source's budget.

Each document gets a hash-random key. The documents are range-sorted by
(source, key); distributed prefix sums of their sizes say where each source's
budget ends. A budget above the source's size first takes whole epochs and then
cuts in the next one. What a document gives follows from its key, its size and
its source's cut, so the texts themselves are never shuffled.

Defined results: a null text has size 0. A null source is a source of its own,
the last one. A source without words has target 0 and gives nothing. Keys are
hashes of doc_id and text, so reruns agree. Repeated rows have equal keys and
are cut together: of the words that are left at the cut, each gives its share
(rounded down). Extra columns are ignored by ``sized`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.llm.common import checked_broadcast, n_words, prefix_sums
from sigclass.session import materialize

#: Weights of the sources in their order, repeated as long as there are sources.
WEIGHTS = (3, 1, 2)
#: The mix has this many times the words of all documents.
TOTAL = 1.5
#: No source gives more than this many times its own words.
MOST_EPOCHS = 2


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL,
                   most: float = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources (source, source_size) by water-filling.

    With weight w and cap c = most * size, the targets are min(level * w, c) for the
    one level at which they add up to the total: sources are ordered by c / w, and
    the level is that of the first source that the remaining words do not fill.
    Both orders use distributed prefix sums, so there may be very many sources.
    """
    first = prefix_sums(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()],
                        {"one": "place"}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    ranked = first.select("source", "source_size", weight.alias("weight"),
                          (F.col("source_size") * float(most)).alias("cap"))
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    ranked = prefix_sums(ranked, ["fill", F.col("source").asc_nulls_last()],
                         {"cap": "cap_before", "weight": "weight_before"}, "mix-levels")
    words, weights_sum = ranked.agg(F.sum("source_size"), F.sum("weight")).first()  # two numbers
    levels = ranked.select("fill", ((F.lit((words or 0) * float(total)) - F.col("cap_before"))
                                    / (F.lit(weights_sum or 1.0) - F.col("weight_before"))).alias("level"))
    level = levels.where("level <= fill").agg(F.min(F.struct("fill", "level"))["level"]).first()[0]
    level = float("inf") if level is None else level
    return ranked.select("source", "source_size",
                         F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size and key of each document, written once: the only pass over the texts."""
    return materialize(docs.select("doc_id", "source", n_words("text").alias("size"), _key(seed).alias("key")),
                       "mix-sizes")


def plan_mix(frame: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST_EPOCHS) -> DataFrame:
    """The cut of each source of ``sized(docs)``: source, source_size, target, epochs (whole ones),
    cut_key (the first key that is not taken whole in the last epoch), cut_words (words taken at
    that key) and cut_size (words that the key has)."""
    by_key = (frame.where(F.col("size") > 0).groupBy("source", "key").agg(F.sum("size").alias("size")))
    sums = materialize(prefix_sums(by_key, [F.col("source").asc_nulls_last(), F.col("key")],
                                   {"size": "before"}, "mix-keys"), "mix-prefix")
    # the sums run over all sources: a source's own begin at its smallest one
    sizes = frame.groupBy("source").agg(F.sum("size").alias("source_size"))
    starts = sums.groupBy("source").agg(F.min("before").alias("source_start"))
    targets = materialize(source_targets(sizes, weights, total, most), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    whole = F.floor(F.col("target"))
    budgets = (targets.join(starts, same(targets, starts), "left").drop(starts["source"])
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
               .withColumn("rest", (whole - F.col("epochs") * F.col("source_size")).cast("long")))
    small = checked_broadcast(budgets.select(F.col("source").alias("of"), "source_start", "rest"))
    cuts = (sums.join(small, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("own_before", F.col("before") - F.col("source_start"))
            .where((F.col("own_before") <= F.col("rest")) & (F.col("rest") < F.col("own_before") + F.col("size")))
            .select(F.col("of").alias("cut_of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
                    (F.col("rest") - F.col("own_before")).alias("cut_words")))
    plan = budgets.join(cuts, F.col("source").eqNullSafe(F.col("cut_of")), "left")
    return materialize(plan.select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size"),
                       "mix-plan")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    side = checked_broadcast(plan.withColumnRenamed("source", "_of"))
    last = (F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut_key"),
                  F.floor(F.col("cut_words") * F.col("size") / F.col("cut_size")))
            .otherwise(F.lit(0)))
    return rows.join(side, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn(
        "taken", (F.col("epochs") * F.col("size") + F.when(F.col("size") > 0, last).otherwise(F.lit(0))).cast("long"))


def taken_words(frame: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per document of ``sized(docs)``: doc_id, size, source_size, target, taken."""
    return _with_plan(frame, plan).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row for each epoch that takes
    words of the document. The document at a source's cut is not cut but taken whole, so a
    source exceeds its budget by less than that document; documents without words are left out."""
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source"),
                        n_words("text").alias("size"), _key(seed).alias("key"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return (_with_plan(inner, plan).where(F.col("taken") > 0)
            .select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_epoch")).select("_row.*"))
