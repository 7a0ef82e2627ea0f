"""Join helpers: broadcast only behind a size check.

A side is broadcast only when a bounded probe proves that it has at most
``max_rows`` rows and at most ``MAX_BROADCAST_BYTES`` in all, as measured on its
values (texts, arrays and maps included). Otherwise the plan falls back to a shuffle
join and leaves skew to AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """A bounded probe: few enough rows, and few enough bytes of them (as JSON, which is
    longer than the rows themselves)."""
    probe = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return probe[0] <= max_rows and (probe[1] or 0) <= MAX_BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if the probe proves it small, else ``df`` unchanged."""
    if max_rows > 0 and small_enough(df, max_rows):
        return F.broadcast(df)
    return df


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
               broadcast: bool | None = None) -> DataFrame:
    """Join a large side to a keyed, narrow side; broadcast the latter when proven small.

    ``broadcast`` given by the caller means the bound was already proven on a
    table that bounds ``small`` (e.g. one row per session, checked once on the
    sessions table); None probes ``small`` itself.
    """
    if broadcast is None:
        side = maybe_broadcast(small, max_rows)
    else:
        side = F.broadcast(small) if broadcast else small
    return big.join(side, on, how)
