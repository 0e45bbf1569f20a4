"""Invariants that hold whatever the data, and edge cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from kairosight.functions import text, times
from kairosight.operators import bank, etl, evaluate, information, models, news, residual, scale, splits, windows
from kairosight.plans import fixtures as X
from kairosight.sources import connectors
from kairosight.streaming import bank_stream

D = "/root/testdata/sf0.001"
SAMPLE = ["series_id", "start"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_parts_add_up(spark):
    steps = X.steps(spark, D)
    d = residual.detrended(steps, residual.profile(steps), SAMPLE)
    p = residual.parts(d, residual.thresholds(d, 0.1), SAMPLE)
    worst = p.agg(F.max(F.abs(F.col("slow") + F.col("shape") + F.col("spike") - F.col("r"))).alias("v")).first().v
    means = p.groupBy(*SAMPLE).agg(F.avg("shape").alias("m")).agg(F.max(F.abs("m")).alias("v")).first().v
    assert worst < 1e-9 and means < 1e-9


def test_nothing_published_later_counts(spark):
    grid = bank.Grid(X.START, X.END, 60)
    assert bank.in_force(X.news(spark, D), grid, 5.0).where("t < published_at or t > published_at + make_dt_interval(horizon_days)").count() == 0


def test_exploded_grid_is_the_range_join(spark):
    grid = bank.Grid(X.START, X.END, 60)
    n = bank.usable(X.news(spark, D))
    naive = grid.times(spark).join(n, (F.col("published_at") <= F.col("t")) & (F.col("t") <= F.col("published_at") + F.make_dt_interval("horizon_days")))
    assert naive.count() == bank.in_force(n, grid, 5.0).count()


def test_ema_with_alpha_one_is_the_input(spark):
    m = X.mass(spark, D).withColumn("k", F.lit(1))
    assert bank.ema(m, 1.0, ["k"], "t", "mass", "e").where("abs(e - mass) > 0").count() == 0


def test_weights_sum_to_one(spark):
    w = residual.hard_weights(residual.magnitudes(X.steps(spark, D), SAMPLE), 0.1, 0.3)
    assert w.agg(F.sum("weight").alias("v")).first().v == pytest.approx(1)
    none = residual.hard_weights(residual.magnitudes(X.steps(spark, D), SAMPLE), 0.0, 0.3)
    assert none.where("hard").count() == 0 and none.agg(F.sum("weight").alias("v")).first().v == pytest.approx(1)


def test_inactive_means_no_news(spark):
    m = evaluate.modulation(F.lit(0.0), F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(0.1), threshold=0.5)
    assert (one(spark, m["gain"]), one(spark, m["bias"])) == (1.0, 0.0)


def test_empty_bank_is_an_error(spark):
    grid = bank.Grid(X.START, X.END, 60)
    with pytest.raises(ValueError):
        bank.require_mass(bank.mass(X.news(spark, D).limit(0), grid, 5.0))


def test_scale_errors_and_fallbacks(spark):
    with pytest.raises(ValueError):
        scale.statistics(spark.createDataFrame([("x",)], "v string"), "v")
    assert scale.robust(spark.createDataFrame([(1.0,)] * 5, "v double"), "v").first().scale_global == 1e-6
    with pytest.raises(ValueError):
        windows.trend(F.array(F.lit(1.0)), 4)


def test_news_without_valid_duplicates_stays_whole(spark):
    rows = [(1, "", "bad", "u", "a"), (2, "", "bad", "u", "bb"), (3, "T", "2024-01-01", "v", "c")]
    n = spark.createDataFrame(rows, "pos int, title string, date string, url string, content string")
    assert news.deduplicated(n, "pos").count() == 3
    twice = n.union(spark.createDataFrame([(4, " t ", "2024-01-01 00:00:00", "v", "longer")], n.schema))
    assert [r.pos for r in news.deduplicated(twice, "pos").orderBy("pos").collect()] == [2, 4]


def test_split_shares_and_order(spark):
    df = spark.range(1000).select(F.col("id"), (1000 - F.col("id")).alias("o"))
    s = splits.by_ratio(df, ["o"], 0.7, 0.1, 0.2)
    got = {r.split: (r.n, r.lo) for r in s.groupBy("split").agg(F.count("*").alias("n"), F.min("o").alias("lo")).collect()}
    assert got == {"train": (700, 1), "val": (100, 701), "test": (200, 801)}


def test_article_times(spark):
    cases = {"2024-03-05T10:00:00+10:00": "2024-03-05T10:00:00", "05-03-2024 01:02:03 PM": "2024-03-05T13:02:03", "Mar 5, 2024": "2024-03-05T00:00:00", "": "", "soon": "", "5/3/2024 7:08": "2024-03-05T07:08:00"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", times.article_time_text(F.col("s")).alias("t"))
    assert {r.s: r.t for r in df.collect()} == cases


def test_text_edges(spark):
    assert one(spark, text.canonical_url(F.lit("https://Ab.c/x//?q#f"))) == "https://Ab.c/x"
    assert one(spark, text.canonical_url(F.lit(None))) == ""
    assert one(spark, text.domain(F.lit("//User@Ex.com:81/a"))) == "ex.com"
    assert one(spark, text.extract_summary(F.lit("A b. A b. C d! E f? G."))) == "A b. C d! E f?"
    assert one(spark, text.json_object(F.lit("```json\n{\"a\": 1}\n```"))) == '{"a": 1}'
    assert one(spark, text.json_object(F.lit("[1]"))) is None
    assert text.find_column(["Full Text", "pub_date"], ["fulltext"]) == "Full Text" and text.find_column(["x"], ["y"]) is None


def test_histogram_of_one_value(spark):
    h = evaluate.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [0, 0, 3, 0] and (h[0].low, h[-1].high) == (1.5, 2.5)


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    new = spark.createDataFrame([("b", 3, 9)], "k string, x int, y int")
    assert sorted(map(tuple, etl.upsert(old, new, "k").collect()), key=str) == [("a", 1, None), ("b", 3, 9)]


def test_ridge_finds_a_line(spark):
    df = spark.range(50).select(F.array(F.col("id") * 1.0, (F.col("id") % 7) * 1.0).alias("x"), F.array(2.0 * F.col("id") - F.col("id") % 7 + 5).alias("y"))
    w = models.ridge(*models.moments(df, F.col("x"), F.col("y"), 2, 1)[:2], penalty=1e-9)
    assert w.ravel() == pytest.approx([2, -1, 5], abs=1e-5)


def test_mutual_information_tells_dependence(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    pairs = {"joined": (x, x + 0.1 * rng.normal(size=300)), "apart": (x, rng.normal(size=300)), "few": (x[:5], x[:5])}
    rows = [(g, float(a), float(b)) for g, (xs, ys) in pairs.items() for a, b in zip(xs, ys, strict=True)]
    found = {r.g: r.mi for r in information.mutual(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    assert found["joined"] > 1 > 0.2 > found["apart"]
    assert np.isnan(found["few"])


def replies(url, parameters):
    """A stand-in for a web service."""
    if url == "broken":
        raise OSError("no route")
    return [{"id": i, "from": parameters["start"]} for i in range(3)]


def test_windowed_service(spark):
    spark.dataSource.register(connectors.WindowedService)
    read = spark.read.format("windowed_service").option("start", "2024-01-01").option("end", "2024-01-10").option("days", "4").option("limit", "3").option("least_minutes", "0").option("transport", "kairosight.sources.testing.replies")
    rows = read.option("url", "ok").load().collect()
    assert len(rows) == 9 and all(r.saturated for r in rows) and {r.window_end for r in rows} == {"2024-01-05T00:00:00", "2024-01-09T00:00:00", "2024-01-10T00:00:00"}
    assert json.loads(rows[0].row)["id"] == 0
    calls = []
    with pytest.raises(OSError):
        connectors.attempt(lambda: calls.append(1) or replies("broken", {}), 2, 0)
    assert len(calls) == 3


def test_streams(spark, tmp_path):
    """The stream of records gives the batch's masses for final times; the first of equal articles passes."""
    X.news(spark, D).select("doc_id", "published_at", "horizon_days", "confidence").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    grid = bank.Grid(X.START, X.END, 60)
    q = bank_stream.mass(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), grid, 5.0).writeStream.format("memory").queryName("masses").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {r.t: r.mass for r in bank.mass(X.news(spark, D), grid, 5.0).where("docs > 0").withColumn("t", F.col("t").cast("timestamp")).collect()}
    found = {r.t: r.mass for r in spark.sql("select * from masses").collect()}
    assert found.keys() == batch.keys() and all(found[t] == pytest.approx(batch[t]) for t in found)
