"""Split windows, guards on small hand-made tables, and lenient dates."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kairosight.functions import text, times
from kairosight.operators import control
from kairosight.sources import connectors


def test_saturated_windows_are_split(spark):
    spark.dataSource.register(connectors.WindowedService)
    read = spark.read.format("windowed_service").option("url", "x").option("start", "2024-01-01").option("end", "2024-01-08").option("days", "4").option("limit", "10")
    hourly = read.option("transport", "kairosight.sources.testing.hourly")
    cut = hourly.option("least_minutes", "0").load().collect()
    assert len(cut) == 20 and all(r.saturated for r in cut)
    split = spark.read.format("windowed_service").option("url", "x").option("start", "2024-01-01").option("end", "2024-01-08").option("days", "4").option("limit", "10").option("transport", "kairosight.sources.testing.hourly")
    assert split.load().count() == 7 * 24  # by default nothing beyond the limit is lost
    whole = hourly.option("least_minutes", "60").load().collect()
    assert len(whole) == 7 * 24 == len({json.loads(r.row)["at"] for r in whole}) and not any(r.saturated for r in whole)
    short = hourly.option("least_minutes", "1000").load().collect()  # four days end in 24-hour windows, three in 18-hour ones; all stay cut off, and say so
    assert len(short) == (4 + 4) * 10 and all(r.saturated for r in short)


def test_notices_are_errors():
    assert connectors.rows_of({"articles": []}) == [] and connectors.rows_of([{"a": 1}]) == [{"a": 1}]
    for reply in ("Please try your request again", {"status": 1}, None):
        with pytest.raises(connectors.SoftLimit):
            connectors.rows_of(reply)
    calls = []
    assert connectors.attempt(lambda: connectors.rows_of("Please" if not calls.append(1) and len(calls) < 3 else []), 3, 0) == [] and len(calls) == 3


def test_permutation_p_edges(spark):
    seen = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", 2.0)], "k string, s double")
    null = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("a", 3.0), ("b", 1.0), ("x", 1.0)], "k string, s double")
    found = {r.k: (r.n_null, r.p_value) for r in control.permutation_p(seen, null, ["k"], "s").collect()}
    assert found == {"a": (3, 0.75), "b": (1, None), "c": (0, None), "d": (0, 1.0)}


def test_pages_read_edges(spark):
    rows = [("a", 1, 2025), ("a", 2, 2024), ("a", 2, 2023), ("a", 3, 2024), ("b", 1, None), ("b", 2, 2024), ("b", 3, 2022), ("b", 4, 2024), ("c", 1, 2025), ("c", 2, 2023), ("c", 3, 2024)]
    items = spark.createDataFrame(rows, "l string, p int, y int")
    found = {(r.l, r.p) for r in control.pages_read(items, "l", "p", F.col("y"), 2024).collect()}
    assert found == {("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("c", 2)}
    assert control.pages_read(items.limit(0), "l", "p", F.col("y"), 2024).count() == 0


def test_names():
    assert text.find_column(["a b", "A_B", "c"], ["x", "ab"]) == "A_B"
    assert text.find_column(["full text"], ["text"]) is None and text.find_column([], ["a"]) is None


def test_lenient_time(spark):
    cases = {"Tue, 3rd Sept 2024": None, "Tuesday 3 September 2024": datetime(2024, 9, 3), "3rd of Sep 2024, 08:05 UTC": datetime(2024, 9, 3, 8, 5), "25/12/2024": datetime(2024, 12, 25), "12/25/2024": datetime(2024, 12, 25), "1.2.2024 10:00": datetime(2024, 2, 1, 10), "": None, "31 February 2024": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", times.lenient_time(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases
    assert spark.createDataFrame([(None,)], "s string").select(times.lenient_time(F.col("s")).alias("t")).first().t is None


def test_services_without_windows(spark):
    spark.dataSource.register(connectors.WindowedService)
    spark.dataSource.register(connectors.MonthlyService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    o = {"transport": "kairosight.sources.testing.monthly", "url": "none", "start": "2024-02-01", "end": "2024-02-01", "keys": "a"}
    assert spark.read.format("windowed_service").options(**o).load().count() == 0
    assert spark.read.format("monthly_service").options(**o).load().count() == 0
