"""A corpus pipeline of five operators, each stage written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. What a stage drops is gone for the next ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigclass.llm import exact_dedup, hyperminhash, mixing, packing, quality_rules
from sigclass.llm.common import table
from sigclass.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: the documents that they keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact deduplication: of equal texts the row with the largest doc_id."""
    return exact_dedup.keep_first_of_equal(docs, exact_dedup.new_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-deduplication: of each group of near copies the row with its smallest doc_id."""
    return hyperminhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a row for each epoch that takes words of a document."""
    return mixing.mixed_rows(docs, mixing.plan_mix(mixing.sized(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_along_curve(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near),
          ("mixing", mix), ("packing", pack)]

#: The stages need a fitted model, similarity and a tokenizer: no SQL. tests/llm holds the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
