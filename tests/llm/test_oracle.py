"""The SQL of the training-data operators against their Spark queries."""

import duckdb
import pytest

from tessel.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    r = con.sql(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(r.columns)
    assert sorted(map(str, (tuple(x[c] for c in r.columns) for x in df.collect()))) == sorted(map(str, r.fetchall()))
