"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from tessella.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    a = plans.queries()[name](spark, DATA).toPandas()
    b = con.sql(plans.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda df: sorted((tuple("null" if v != v or v is None else round(float(v), 3) if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)
    assert key(a) == key(b)
