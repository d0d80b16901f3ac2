"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from pagewright.plans.oracles import ORACLES
from pagewright.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = QUERIES[name](spark, sf)
    expected = con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
