"""The queries whose rows SQL can express give the same rows as DuckDB."""

import duckdb
import pytest

from pagewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "clicks"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expected = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, sf).select(*expected.columns)
    plain = lambda r: tuple((x is not None, x) for x in r)  # noqa: E731  nulls first
    assert sorted(plain(r) for r in found.collect()) == sorted(plain(r) for r in expected.fetchall())


def test_all_queries_run_over_whole_tables(spark, sf):
    keys = {"page_id": "pages", "click_id": "clicks", "doc_id": "documents"}
    for name, query in QUERIES.items():
        rows = query(spark, sf)
        if "query_id" in rows.columns:
            assert rows.select("query_id").distinct().count() == spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count(), name
            continue
        key = next(k for k in keys if k in rows.columns)
        whole = spark.read.parquet(f"{sf}/{keys[key]}.parquet")
        whole = whole.where("ts IS NOT NULL") if key == "click_id" else whole
        assert rows.select(key).distinct().count() == whole.select(key).distinct().count(), name
