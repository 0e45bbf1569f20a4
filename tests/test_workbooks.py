"""Workbooks written by the test, and the plan of months."""

from datetime import datetime

import pytest

from kairosight.sources import connectors, testing, workbooks


def test_every_sheet_and_cell(spark):
    at = datetime(2024, 2, 29, 13, 45)
    tables = {"a": [["x", " y ", "x", None], [1, "t & <u>", 2.5, None], [], [None, None, True], [at, "", -3]], "b & c": [[None, "only"], ["z" * 40_000, " k "]], "empty": []}
    files = spark.createDataFrame([("one", testing.workbook(tables)), ("two", testing.workbook({"s": [["h"], [7]]}))], "path string, content binary")
    found = {(r.path, r.sheet, r.row): r.cells for r in workbooks.cells(files).collect()}
    assert found["one", "a", 1] == ["x", " y ", "x"]
    assert found["one", "a", 2] == ["1", "t & <u>", "2.5"]
    assert found["one", "a", 3] == [] and found["one", "a", 4] == [None, None, "TRUE"]
    assert found["one", "a", 5] == ["2024-02-29 13:45:00", "", "-3"]
    assert found["one", "b & c", 2] == ["z" * 40_000, " k "]
    assert not any(s == "empty" for _, s, _ in found)
    fields = {(r.path, r.sheet, r.row): r.fields for r in workbooks.records(workbooks.cells(files)).collect()}
    assert fields["one", "a", 2] == {"x": "1", "y": "t & <u>"} and ("one", "a", 3) not in fields
    assert fields["one", "b & c", 2] == {"only": " k "} and fields["two", "s", 2] == {"h": "7"}


def test_files_and_others(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(testing.workbook({"s": [["h"], ["v"]]}))
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"other")
    assert workbooks.read(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(Exception, match="zip"):
        workbooks.read(spark, str(tmp_path)).count()


def test_months_are_planned_once(spark):
    assert connectors.months("2023-11-15", "2024-02-01") == [(2023, 11), (2023, 12), (2024, 1)]
    assert connectors.months("2024-02-01", "2024-02-01") == []
    spark.dataSource.register(connectors.MonthlyService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    keys = [f"k{i}" for i in range(7)]
    o = {"transport": "kairosight.sources.testing.monthly", "url": "none", "start": "2022-11-10", "end": "2024-03-05", "keys": ",".join(keys), "chunk": "3"}
    df = spark.read.format("monthly_service").options(**o).load()
    rows = df.selectExpr("year", "month", "get_json_object(row, '$.key') as key", "get_json_object(row, '$.start') as start", "get_json_object(row, '$.end') as end").collect()
    assert sorted((r.year, r.month, r.key) for r in rows) == sorted((y, m, k) for y, m in connectors.months("2022-11-10", "2024-03-05") for k in keys)
    assert {(r.start, r.end) for r in rows if (r.year, r.month) == (2022, 11)} == {("2022-11-10T00:00:00", "2022-12-01T00:00:00")}
    assert {(r.start, r.end) for r in rows if (r.year, r.month) == (2024, 3)} == {("2024-03-01T00:00:00", "2024-03-05T00:00:00")}
    year = df.where("year = 2023 and month > 10")
    assert year.rdd.getNumPartitions() == 2 * 3 and year.count() == 2 * 7
