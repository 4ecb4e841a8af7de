"""Driver contract: entry runs, every oracle has a query, oracle texts parse."""

import duckdb

import __spark_entry__ as E


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 55


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "tavg_interval_sum_corrected" in df.columns


def test_oracle_texts_bind():
    from conftest import SMALL
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "orders", "lineitem",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, text in E.oracle_sql().items():
        con.execute(f"DESCRIBE {text}")
