"""All registered queries (oracle-checked and rows-only), in inventory order."""

from __future__ import annotations


def all_queries() -> dict:
    from sigclass.plans import queries, queries_rows, queries_state
    out = dict(queries.ORACLE_QUERIES)
    out.update(queries_rows.ROWS_QUERIES)
    out.update(queries_state.STATE_QUERIES)
    return out
