"""Queries that must answer for every row of their tables."""

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as P

from kairosight.operators import splits
from kairosight.plans import etl_queries, registry, text_queries, time_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


def same_as_sql(spark, name, *tables):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in tables:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    rows = sorted(tuple(map(str, r)) for r in registry.QUERIES[name](spark, FOLDER).collect())
    assert rows == sorted(tuple(map(str, r)) for r in con.sql(registry.ORACLE[name]).fetchall())
    return rows


def test_ops18_thins_every_user(spark):
    rows = same_as_sql(spark, "ops18_cadence_all_users", "events")
    users = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id").distinct().count()
    assert len({r[0] for r in rows}) == users == 150


def test_snk7_merges_every_page(spark):
    rows = same_as_sql(spark, "snk7_merge_all_pages", "pages")
    assert len(rows) == 250
    assert sum(v == "old" for _, v in rows) == 84
    assert {v for _, v in rows if v != "old"} == {f"new{i}" for i in range(250) if i % 3}


def test_ops15_places_every_article(spark):
    rows = same_as_sql(spark, "ops15_sorted_all", "documents")
    assert len(rows) == 1000


def test_placed_with_nulls_and_narrow_ranges(spark):
    rows = [(i, None if i % 5 == 0 else str(i % 3), None if i % 7 == 0 else str(i % 2)) for i in range(-20, 60)]
    df = spark.createDataFrame(rows, P.StructType().add("k", "long").add("a", "string").add("b", "string")).repartition(3)
    found = [r.k for r in splits.placed(df, "a", "b", "k", 4).orderBy("place").collect()]
    assert found == [r.k for r in df.orderBy(F.desc("a"), F.desc("b"), "k").collect()]
