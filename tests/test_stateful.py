"""Streams with state against their batch forms: files in several triggers, late rows, restarts from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairosight.operators import bank, news
from kairosight.streaming import stateful

START = datetime(2024, 1, 1)


def arrive(df, folder, name):
    """Rows become one file of a source folder."""
    df.coalesce(1).write.parquet(f"{folder}-{name}")
    import os

    os.makedirs(folder, exist_ok=True)
    for f in os.listdir(f"{folder}-{name}"):
        if f.endswith(".parquet"):
            os.rename(f"{folder}-{name}/{f}", f"{folder}/{name}-{f}")


def run(frame, checkpoint, sink, mode):
    q = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_smoothing_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    schema = "k string, at timestamp, v double"
    points = [(k, START + timedelta(hours=h, microseconds=h % 3), rng.uniform(-5, 5)) for k in "ab" for h in range(0, 90)]
    rng.shuffle(points)
    # three triggers; inside two days rows may come in any order
    first = [p for p in points if p[1] < START + timedelta(hours=30)]
    third = [p for p in points if p[1] >= START + timedelta(hours=60)]
    second = [p for p in points if p not in first and p not in third]
    held_back = first[:7]
    too_late = [("a", START - timedelta(days=30), 99.0)]
    files = [first[7:], second + held_back, third + too_late, [(k, START + timedelta(days=60), 0.0) for k in "ab"], [(k, START + timedelta(days=90), 0.0) for k in "ab"]]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(files):
        arrive(spark.createDataFrame(rows, schema), source, str(i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(stateful.smoothed(stream, 0.3, "k", "at", "v", "2 days"), str(tmp_path / "state"), stateful.into(sink), "append")  # a restart for each file
    found = spark.read.parquet(f"{sink}/batch=*").where(F.col("t") < F.lit(START + timedelta(days=30))).collect()
    batch = bank.ema(spark.createDataFrame(points, schema), 0.3, ["k"], "at", "v", "smooth").collect()
    expected = {(r.k, r["at"]): r.smooth for r in batch}
    assert len(found) == len(expected) == len(points)
    assert {(r.key, r.t): pytest.approx(r.smooth, abs=1e-12) for r in found} == expected


def articles(rng, n, full=True):
    titles = ["Gas  price", "gas PRICE", "Wind", "", " "] if full else ["", " "]
    rows = []
    for i in range(n):
        t = rng.choice(titles)
        rows.append((i, t, rng.choice(["2024-01-02 10:00:00", "2024-01-02T10:00:00", "2024-01-03", ""]), "x" * rng.randint(0, 6), rng.choice(["http://s/a", "http://s/a-0", None])))
    return rows


SCHEMA = "pos long, title string, date string, content string, url string"


@pytest.mark.parametrize("full", [True, False])
def test_longest_equals_the_batch_form(spark, tmp_path, full):
    rng = random.Random(5)
    rows = articles(rng, 60, full)
    if not full:
        rows += [(100, "only once", "2024-01-05", "c", "http://u")]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        arrive(spark.createDataFrame(rows[i::3], SCHEMA), source, str(i))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        run(stateful.longest(stream, "pos"), str(tmp_path / "state"), stateful.into(sink), "update")  # goes on from the checkpoint
    df = spark.createDataFrame(rows, SCHEMA)
    found = stateful.current(spark, sink, df.schema)
    expected = news.deduplicated(df, "pos")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    if full:
        assert found.count() < len(rows)


def test_a_batch_written_twice_changes_nothing(spark, tmp_path):
    rows = articles(random.Random(9), 40)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark.createDataFrame(rows, SCHEMA), source, "0")
    write = stateful.into(sink)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    run(stateful.longest(spark.readStream.schema(SCHEMA).parquet(source), "pos"), str(tmp_path / "state"), twice, "update")
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, stateful.current(spark, sink, df.schema).collect()), key=str) == sorted(map(tuple, news.deduplicated(df, "pos").collect()), key=str)
