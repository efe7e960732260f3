"""Every query of the catalogue with oracle SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    frame = catalog.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    found = duck.sql(ORACLES[name])
    names = list(found.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
