"""Train/test splits.

The default split is a pure function of the packet key: bucket = first 32
bits of md5(pk) mod 100, train when bucket < 60. It does not depend on
partitioning, so it is stable across retries, executor loss and engines.
``random_split`` is the seeded form: a hash of the key and the seed.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigclass.schemas import SPLIT_SEED, TRAIN_PERCENT


def hash_bucket(pk: Column | str = "pk") -> Column:
    c = F.col(pk) if isinstance(pk, str) else pk
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % 100


def is_train(pk: Column | str = "pk", train_percent: int = TRAIN_PERCENT) -> Column:
    return hash_bucket(pk) < train_percent


def random_split(df: DataFrame, seed: int | None = SPLIT_SEED, train_percent: int = TRAIN_PERCENT,
                 pk: str = "pk") -> DataFrame:
    """Add ``is_train``, seeded, or with a fresh seed when ``seed`` is None.

    Each key's side follows from the key and the seed alone, so every row is on
    exactly one side however the input is partitioned or re-evaluated.
    """
    seed = secrets.randbits(31) if seed is None else seed
    return df.withColumn("is_train", is_train(F.concat_ws(":", F.lit(str(seed)), F.col(pk)), train_percent))
