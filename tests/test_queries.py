"""Every registered query of the library's own operators against its SQL, and a count of rows where SQL can't express it."""

import decimal

import duckdb
import pytest

from tessel.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    r = con.sql(sql)
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", ["c2_best_split", "c3_tree_fit", "c3_tree_fit_deep", "c4_tree_predict", "c6_grid_predict", "c7_label_change_split"])
def test_labels_of_half_prices(spark, tmp_path, name):
    """CAST rounds halves to the even neighbour: a price of 948.5 counts as 948, which at size 25 is no 'b'."""
    path = str(tmp_path)
    con = duckdb.connect()
    con.sql(f"copy (select i as p_partkey, cast(1 + i // 7 % 50 as integer) as p_size, 900 + i % 1000 / 10.0 as p_retailprice from range(7000) r(i) union all select 7000 + i, 25, 948.5 from range(40) r(i)) to '{path}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{path}/part.parquet'")
    df = catalog.queries()[name](spark, path)
    cols = sorted(df.columns)
    r = con.sql(catalog.oracle_sql()[name])
    at = [r.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
