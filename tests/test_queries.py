"""Every registered query runs on the smallest tables and, where SQL can express it, equals DuckDB."""

import math

import duckdb
import pytest

from touchline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        cursor = tables.execute(registry.ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
        key = sorted(columns)
        assert sorted([plain(r[c]) for c in key] for r in rows) == sorted([plain(r[c]) for c in key] for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
