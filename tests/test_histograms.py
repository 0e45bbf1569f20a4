"""The histogram query where its values leave no width, against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kairosight.plans import registry, residual_queries  # noqa: F401


@pytest.mark.parametrize("events", [20_000, 0])
def test_saturated_and_empty(spark, tmp_path, events):
    """4,320 signups a day of full horizon: lambda is saturated in every window."""
    e = spark.range(events).withColumnRenamed("id", "event_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 20).cast("timestamp_ntz").alias("ts")
    kept = e.select("event_id", ts, (F.col("event_id") % 7).alias("user_id"), F.lit("signup").alias("event_type"), (F.col("event_id") % 100 / 10).alias("value"), F.lit('{"k": 89}').alias("props"))
    kept.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    rows = sorted(tuple(r) for r in registry.QUERIES["ag17_histogram"](spark, str(tmp_path)).collect())
    assert rows == sorted(con.sql(registry.ORACLE["ag17_histogram"]).fetchall())
    assert [r[0] for r in rows] == list(range(8)) and (rows[7][3] > 0) == (events > 0)
    assert all(r[1] == r[2] for r in rows)
