"""The SQL of the corpus queries against their results."""

import duckdb
import pytest

from tessera.llm.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf_dir), con.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    assert key(tuple(r[c] for c in columns) for r in df.collect()) == key(tuple(r[k] for k in at) for r in want.fetchall())
