"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from ashlar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_every_query_without_sql_runs(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).count() >= 0, name
