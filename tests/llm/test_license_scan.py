import duckdb
import pytest
from pyspark.sql import functions as F

from kairosight.llm import license_scan as L
from kairosight.llm import runtime


def test_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet'")
    expected = sorted(con.sql(L.oracle()).fetchall())
    found = sorted(tuple(r) for r in L.query(runtime.table(spark, d, "documents")).collect())
    assert found == expected
    assert any(r[2] for r in found)


def test_plan_is_native(spark):
    plan = L.query(runtime.table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_inheritance_and_cases(spark):
    prose = "Some words of a text that says nothing about it. " * 5
    files = [
        (1, "a/LICENSE", "Released under the MIT License.", 0),
        (2, "a/b/c/x.py", prose, 0),
        (3, "a/b/LICENSE.txt", "Intro\nLicensed under the Apache License, Version 2.0.\n" + prose, 0),
        (4, "a/y.py", None, 0),
        (5, "z/y.py", "", 0),
        (6, "a/b/h.py", "# SPDX-License-Identifier: GPL-3.0-only\n" + prose, 0),
        (7, None, prose, 0),
        (2, "a/b/c/x.py", prose, 0),
        (8, "ab/x.py", prose, 0),
        (9, "a/c/x.py", prose + "license", 0),
    ]
    found = {r.id: (r.license, r.licensed_by) for r in L.scan(spark.createDataFrame(files, "id long, path string, text string, dir int")).collect()}
    assert found == {1: ("MIT", "file"), 2: ("Apache-2.0", "a/b"), 3: ("Apache-2.0", "file"), 4: ("MIT", "a"), 5: (None, None), 6: ("GPL-3.0", "header"), 7: (None, None), 8: (None, None), 9: ("MIT", "a")}
    assert L.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


@pytest.mark.parametrize("n", [0, 10])
def test_anchors_bound_the_rest(n):
    idf = {t: 1 + n / (i + 1) for i, t in enumerate(sorted(set().union(*L._template_terms())))}
    chosen = set(L.anchors(idf, 0.75))
    for count in L._template_terms():
        square = {t: (c * idf[t]) ** 2 for t, c in count.items()}
        assert sum(v for t, v in square.items() if t not in chosen) < 0.75**2 * sum(square.values())


def test_wrapped_headers_and_whole_licences(spark):
    prose = "Nothing is said here about rights of any kind. " * 5
    wrapped = "# This Source Code Form is\n# subject to the terms of the\n# Mozilla Public License, v. 2.0.\n" + prose
    whole = {name: "Copyright (c) 2024 Some One\n\n" + text.replace(", ", ",\n") for name, text in L.WHOLE}
    files = [(1, "a/x.c", wrapped), *((10 + i, f"d{i}/LICENSE", t) for i, t in enumerate(whole.values())), *((20 + i, f"d{i}/s/y.c", prose) for i in range(len(whole)))]
    found = {r.id: (r.license, r.licensed_by) for r in L.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    names = list(whole)
    assert names == ["BSD-3-Clause", "ISC", "MIT"]
    assert found == {1: ("MPL-2.0", "header"), **{10 + i: (n, "file") for i, n in enumerate(names)}, **{20 + i: (n, f"d{i}") for i, n in enumerate(names)}}


def test_null_ids_shared_ids_ties_and_long_texts(spark):
    mit, gpl = "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-only"
    long = "some words that repeat\n" * 50_000
    rows = [(None, "n/x", mit, 1), (None, "n/y", gpl, 1), (None, "n/z", None, 1), (3, "s/x", mit, 1), (3, "s/y", gpl, 1), (3, "s/y", gpl, 1), (4, "t/x", gpl + "\n" + mit, 1), (5, "l/x", long + mit + "\n" + long, 1), (6, "l/y", long, 1), (7, "w/x", "y" * 300_000, 1)]
    found = sorted((r.path, r.license, r.own_score) for r in L.scan(spark.createDataFrame(rows, "id long, path string, text string, file int")).collect())
    assert [(p, x) for p, x, _ in found] == [("l/x", "MIT"), ("l/y", None), ("n/x", "MIT"), ("n/y", "GPL-3.0"), ("n/z", None), ("s/x", "MIT"), ("s/y", "GPL-3.0"), ("s/y", "GPL-3.0"), ("t/x", "GPL-3.0"), ("w/x", None)]
    assert all(s == 1.0 for _, x, s in found if x)
