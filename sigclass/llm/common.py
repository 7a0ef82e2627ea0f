"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigclass.session import materialize

#: A word: a run of characters other than ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def checked_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``broadcast(df)`` if a bounded probe proves it has at most ``max_rows`` rows, else ``df``.

    For narrow tables only (some tens of bytes a row), so that the row bound is a size bound.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """Add the running totals of columns before each row, in a global order, without one big task.

    The rows are range-partitioned and sorted by ``order`` and written once, with
    their partition's number and their place in it. Totals by partition (one row
    for each) give every partition its offset; a window within the partition
    gives the rest. ``sums`` maps a value column to the name of its new column
    (the sum over all earlier rows; 0 for the first). The result keeps the
    columns ``_part`` and ``_pos``, which order its rows. Pass narrow rows, and
    make ``order`` total where equal rows must come out in a fixed order.
    """
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    return sums_in_order(materialize(ranged, name), sums)


def sums_in_order(ranged: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Running totals of written rows that already have the columns ``_part`` and ``_pos`` of ``prefix_sums``."""
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_total_{v}") for v in sums])
    # one row per range partition, so this window is as small as the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_total_{v}").over(before), F.lit(0)).alias(f"_offset_{v}")
                                       for v in sums])
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_within_{v}") for v in sums])
    out = out.join(checked_broadcast(offsets), "_part")
    for v, new in sums.items():
        out = out.withColumn(new, F.col(f"_within_{v}") + F.col(f"_offset_{v}"))
    return out.drop(*[f"_within_{v}" for v in sums], *[f"_offset_{v}" for v in sums])


def one_row_each(df: DataFrame, keys: list[str], count: str) -> DataFrame:
    """One row for each key, where ``count`` holds how many rows the key has.

    Rows that are alone pass straight through; only repeated ones are shuffled,
    after a map-side step that leaves at most one row of a key for each task.
    """
    alone = df.where(F.col(count) <= 1)
    repeated = df.where(F.col(count) > 1).dropDuplicates(keys)
    return alone.unionByName(repeated)
