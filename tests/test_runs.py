"""Folders of runs, their logs, the resolution of banks and linked pages, against plain forms."""

import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kairosight.functions import text
from kairosight.operators import control, runs
from kairosight.plans import registry, run_queries  # noqa: F401
from kairosight.sources import frontier

RULES = [("base", "best_base_", "weights.bin"), ("delta", "best_delta_", "model.bin")]


def put(folder, name, value="x"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value)


def test_runs_are_chosen_from_a_folder(spark, tmp_path):
    put(tmp_path, "a/best_base_1/weights.bin")
    put(tmp_path, "a/best_base_2/other.bin")  # lacks the file
    put(tmp_path, "a/best_delta_1/model.bin")
    put(tmp_path, "a/best_delta_2/model.bin")
    put(tmp_path, "best_base_3/weights.bin")  # a root that is itself a run, and holds another
    put(tmp_path, "best_base_3/best_base_4/weights.bin")
    put(tmp_path, "a/deep/best_base_9/weights.bin")  # not directly in the root
    files = runs.listing(spark, f"file://{tmp_path}").withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    roots = spark.createDataFrame([(f"{tmp_path}/a/",), (f"{tmp_path}/a",), (f"{tmp_path}/best_base_3",), (f"{tmp_path}/none",), (None,)], "root string")
    found = {(os.path.basename(r.root), r.role): (r.status, r.path and os.path.relpath(r.path, tmp_path), r.candidates) for r in runs.chosen(files, roots, RULES).collect()}
    assert found == {
        ("a", "base"): ("found", "a/best_base_1", 1), ("a", "delta"): ("ambiguous", None, 2),
        ("best_base_3", "base"): ("given", "best_base_3", 1), ("best_base_3", "delta"): ("missing", None, 0),
        ("none", "base"): ("missing", None, 0), ("none", "delta"): ("missing", None, 0),
    }
    assert runs.chosen(files.limit(0), roots.limit(0), RULES).count() == 0


def test_last_summaries_of_logs_read_in_many_blocks(spark, tmp_path):
    put(tmp_path, "r1/r1.log", "".join(f"epoch {i}\n[TEST][FINAL] mse={i}.5 mae=1e-{i % 9}\n" for i in range(400)) + "[TEST][BASE] nothing\nbye\n")
    put(tmp_path, "r2/r2.log", "no tags here\n[TEST] FINAL\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # many blocks a file
    try:
        log = runs.lines(spark, f"file://{tmp_path}")
        assert log.rdd.getNumPartitions() > 4
        rows = runs.summaries(log, F.regexp_extract("file", "([^/]*)/[^/]*$", 1), r"\[TEST\]\[(\w+)\]", 3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.run, r.nth, r.tag, r.metric or "", r.number or 0.0) for r in rows) == [
        ("r1", 1, "BASE", "", 0.0), ("r1", 2, "FINAL", "mae", 1e-3), ("r1", 2, "FINAL", "mse", 399.5), ("r1", 3, "FINAL", "mae", 1e-2), ("r1", 3, "FINAL", "mse", 398.5),
    ]
    names = spark.createDataFrame([("r1", "gas", "24"), ("r2", "gas", "9"), ("r3", "", "9"), ("r4", "load", "x"), ("r5", None, None)], "name string, d string, h string")
    matrix = runs.jobs(names, "name", F.col("d"), F.col("h"))
    assert sorted((r.run, r.place) for r in matrix.collect()) == [("r1", 1), ("r2", 0)]
    told = spark.createDataFrame(rows)
    assert {(r.run, r.status) for r in runs.report(matrix, told).collect()} == {("r1", "ok"), ("r2", "no_summary")}


def test_every_outcome_of_a_resolution(spark):
    rows = [
        ("p", "bank", 0, "p0", None, None), ("p", "bank", 1, "p1", True, True),
        ("o", "bank", 0, "o0", False, True), ("o", "bank", 2, "o2", True, True), ("o", "bank", 1, "o1", True, True),
        ("e", "bank", 0, "e0", True, False), ("e", "bank", 1, "e1", True, True),
        ("r", "refined", None, "r1", True, None), ("r", "bank", 0, "r0", False, True),
        ("s", "refined", 0, "s0", None, None),
        ("b", "bank", 0, "b0", True, True),
        (None, "bank", 0, "n0", True, True),
    ]
    manifests = spark.createDataFrame(rows, "k string, kind string, place int, path string, matches boolean, filled boolean")
    wanted = spark.createDataFrame([(k, k == "b", 1) for k in "poersbm"], "k string, again boolean, bank int")  # names that the operator uses too
    got = control.resolution(wanted, manifests, ["k"], F.col("again"))
    found = {r.k: (r.outcome, r.path) for r in got.collect()}
    assert found == {"p": ("preferred", "p0"), "o": ("older", "o1"), "e": ("empty", "e0"), "r": ("reuse", "r1"), "s": ("sync", None), "b": ("build", None), "m": ("missing", None)}
    makers = {"older": lambda path: spark.range(2).withColumn("path", F.lit(path)), "build": lambda path: spark.range(3)}
    assert control.opened(got.where("k = 'o'"), makers).first().path == "o1"
    assert control.opened(got.where("k = 'b'"), makers).count() == 3
    for k in "em":
        with pytest.raises(ValueError):
            control.opened(got.where(f"k = '{k}'"), makers)
    with pytest.raises(ValueError):
        control.opened(got, makers)


def test_resolution_query_meets_every_outcome(spark):
    found = registry.QUERIES["ct3_resolution"](spark, "/root/testdata/sf0.01").select("outcome").distinct().collect()
    assert {r.outcome for r in found} == {"preferred", "older", "empty", "reuse", "sync", "build", "missing"}


def breadth_first(graph, seeds):
    depth = {s: 0 for s in seeds}
    ahead = deque(depth)
    while ahead:
        u = ahead.popleft()
        for v in graph.get(u, []):
            if v not in depth:
                depth[v] = depth[u] + 1
                ahead.append(v)
    return depth


def test_crawl_equals_breadth_first_search(spark, tmp_path):
    dice = random.Random(5)
    name = lambda i: f"http://h{i % 3}.x/{i}"
    graph = {name(i): [name(dice.randrange(60)) for _ in range(2)] for i in range(45)}  # cycles, loops, addresses without a reply
    asked_at = str(tmp_path)

    def transport(url):
        with open(f"{asked_at}/{url.replace('/', '_')}", "a") as f:
            f.write("x")
        if url not in graph:
            return None
        return {"html": "".join(f'<a href="{v}?q=1#top">x</a><a href="mailto:x">y</a>' for v in graph[url])}

    seeds = spark.createDataFrame([(name(0),), (name(0) + "?again",), (name(7) + "/",), ("",), (None,)], "url string")
    links = text.page_links(F.col("html"), F.col("url"))
    found = frontier.crawl(seeds, frontier.asking(transport, "url string, html string"), links, F.rlike("url", F.lit("^http://h[0-2].x/[0-9]+$")))
    rows = found.collect()
    expected = breadth_first(graph, [name(0), name(7)])
    assert {r.url: r.depth for r in rows} == expected and len(rows) == len(expected)
    assert {r.url for r in rows if r.answered} == set(graph) & set(expected)
    assert sorted(os.listdir(tmp_path)) == sorted(u.replace("/", "_") for u in expected)
    assert all(os.path.getsize(tmp_path / f) == 1 for f in os.listdir(tmp_path))  # each asked for once


def test_crawl_stops_where_told(spark):
    replies = spark.createDataFrame([("http://a.x/1", ["http://a.x/2", None, "http://b.x/9"], True), ("http://a.x/2", ["http://a.x/3"], None), ("http://a.x/3", [], True)], "url string, out array<string>, go boolean")
    seeds = spark.createDataFrame([("http://a.x/1",)], "url string")
    fetch = lambda asked: replies.join(asked, "url")
    go = lambda **more: {(r.url[9:], r.depth) for r in frontier.crawl(seeds, fetch, F.col("out"), F.col("url").startswith("http://a"), **more).collect()}
    assert go() == {("x/1", 0), ("x/2", 1), ("x/3", 2)}
    assert go(follow=F.col("go")) == {("x/1", 0), ("x/2", 1)}
    assert go(rounds=1) == {("x/1", 0)}
    assert frontier.crawl(seeds.limit(0), fetch, F.col("out")).count() == 0
