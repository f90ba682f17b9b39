"""Every query of the registry that has an oracle gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLE:
        assert df.columns
        return
    want = duck.sql(registry.ORACLE[name])
    names, cols = list(want.columns), sorted(df.columns)
    assert sorted(names) == cols
    got = sorted(tuple(str(r[c]) for c in cols) for r in rows)
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in want.fetchall())


def test_entry_needs_nothing_else():
    import __spark_entry__ as e

    assert set(registry.ORACLE) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
