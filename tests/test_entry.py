"""Driver contract: entry() runs; every oracle SQL has a query; queries run at sf0.001."""

import pytest

import __spark_entry__ as entry
from sigclass.plans.oracle import SQL as PACKET_SQL
from tests.conftest import SF001


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"calibrationid", "model", "metric", "class", "value"}


def test_oracle_keys_are_queries():
    q = entry.queries()
    sql = entry.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 40


@pytest.mark.parametrize("name", sorted(PACKET_SQL))
def test_oracle_matches_at_smoke_scale(spark, name):
    import duckdb
    import pandas as pd
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sp = entry.queries()[name](spark, SF001).toPandas()
    dk = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)

    def norm(df):
        df = df[cols].copy()
        for c in cols:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and pd.isna(v))
                              else (round(float(v), 9) if isinstance(v, float) else str(v)))
        return sorted(map(tuple, df.astype(str).values.tolist()))
    assert norm(sp) == norm(dk)
