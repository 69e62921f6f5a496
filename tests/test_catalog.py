"""Every catalogued query against its SQL in DuckDB, over the same tables."""

from collections import Counter

import duckdb
import pytest

from tesserae.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return 0.0 if x == 0 else round(x, 9)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(columns)
    assert got == want and want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    assert df.count() > 0 and df.columns
