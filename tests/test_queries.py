"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from kairosight.plans import bank_queries, control_queries, etl_queries, model_queries, registry, residual_queries, run_queries, text_queries, time_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        return repr(round(float(v), 5) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE:
        return
    rel = duck.sql(registry.ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
