"""Operators that split a long key or column, against their plain forms."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kairosight.operators import bank, splits, windows
from kairosight.operators.quantiles import keyed_quantiles, quantiles
from kairosight.sources import stored

P = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "single", "integers"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(4)
    x = {
        "normal": rng.normal(0, 3, 2000), "ties": rng.integers(-2, 3, 999).astype(float), "wide": rng.normal(0, 1, 700) * 10.0 ** rng.integers(-200, 200, 700),
        "single": np.array([7.25]), "integers": 1e6 + np.arange(3001.0),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    assert quantiles(df, "v", P).first().q == pytest.approx(np.quantile(x, P).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q == [None]


def series(seed, n):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(hours=rng.choice([1, 1, 2, 30, 900]))
        rows.append(("a" if i % 3 else "b", at, float(rng.randint(0, 99))))
    return rows


def test_windows_across_blocks_and_spans(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 8)
    rows = series(1, 120)
    found = {(r.series_id, r.start): (r.history, r.target, r.target_times) for r in windows.sliding(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double"), 5, 2, 3).collect()}
    expected = {}
    for k in "ab":
        own = [(t, v) for s, t, v in rows if s == k]
        for i in range(0, len(own) - 6, 3):
            v = [v for _, v in own[i : i + 7]]
            expected[k, i] = (v[:5], v[5:], [t for t, _ in own[i + 5 : i + 7]])
    assert found == expected


def test_asof_across_spans(spark):
    rng = random.Random(3)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 400_000))
    left = [(i, rng.choice("xyz"), at()) for i in range(150)] + [(900, None, at()), (901, "x", None)]
    right = [(rng.choice("xy"), at(), i) for i in range(25)] + [(None, datetime(2023, 1, 1), 77)]
    a, b = spark.createDataFrame(left, "id long, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, t timestamp_ntz, v long")
    found = {r.id: r.v for r in bank.asof(a, b, ["k"], "t", ["v"]).collect()}
    for i, k, t in left:
        before = [(u, v) for q, u, v in right if q == k and t is not None and u <= t]
        assert found[i] == (max(before)[1] if before else None)


def test_ema_across_spans(spark):
    rows = series(5, 90)
    found = {(r.series_id, r.ts): r.e for r in bank.ema(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double"), 0.3, ["series_id"], "ts", "value", "e").collect()}
    assert len(found) == 90
    for k in "ab":
        e = None
        for t, v in ((t, v) for s, t, v in rows if s == k):
            e = v if e is None else 0.3 * v + 0.7 * e
            assert found[k, t] == pytest.approx(e, rel=1e-12)


def test_shared_folder_must_be_set_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        stored.folder(Cluster)


def test_quantile_plan_has_no_single_task_percentile(spark):
    plan = quantiles(spark.range(100).select(F.col("id").cast("double").alias("v")), "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_smoothing_a_long_span_of_minutes(spark):
    """More rows than a piece in one span, several keys; equals a loop."""
    n = 3000
    df = spark.range(n).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.pmod(F.col("id") * 37, F.lit(101)) - 50.0).alias("x"))
    found = {(r.k, r.t): r.e for r in bank.ema(df, 0.07, ["k"], "t", "x", "e").collect()}
    assert len(found) == n
    carry = {}
    for r in df.orderBy("t").collect():
        carry[r.k] = 0.07 * r.x + 0.93 * carry[r.k] if r.k in carry else r.x
        assert abs(found[r.k, r.t] - carry[r.k]) < 1e-9


def test_probe_takes_whole_counts_with_ties_and_nulls(spark):
    rows = [(i // 2 if i % 7 else None,) for i in range(100)]
    df = spark.createDataFrame(rows, "digest long").repartition(5)
    taken = splits.probe(df, F.col("digest"), 0.3, 10, 1).collect()
    assert len(taken) == 30 and set(taken) <= set(df.collect())
    assert splits.probe(df, F.col("digest"), 0.0, 200, 1).count() == 100
    assert splits.probe(df.limit(0), F.col("digest"), 0.5, 3, 1).count() == 0
    again = splits.probe(df.repartition(2), F.col("digest"), 0.3, 10, 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, taken))


def test_keyed_quantiles_with_null_keys_and_a_hot_one(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", None if i % 11 == 0 else float((i * 37) % 101) / 7) for i in range(2000)] + [(None, 2.0), (None, 4.0), ("none", None), ("one", -1.5)]
    df = spark.createDataFrame(rows, "key string, x double")
    got = {r.key: r.q for r in keyed_quantiles(df, ["key"], "x", P).collect()}
    assert set(got) == {"hot", "k0", "k1", "k2", "k3", "k4", None, "one"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([x for key, x in rows if key == k and x is not None], P))
    assert keyed_quantiles(df.limit(0), ["key"], "x", P).count() == 0


def test_frames_over_parts_equal_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "PART", 64)
    df = spark.range(1500).select((F.col("id") % 7 % 3).alias("k"), F.timestamp_seconds(F.col("id") * 7919 % 1_000_000 * 13).alias("t"), F.when(F.col("id") % 10 > 0, F.sin("id")).alias("part"))
    got = windows.rolling(df, "k", "t", 11, "part", F.sum, 9, "s")
    assert got.columns == ["k", "t", "part", "s"]
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-11, 0)
    whole = df.withColumn("s", F.when(F.count("part").over(w) >= 9, F.sum("part").over(w)))
    tell = lambda x: sorted((r.k, r.t, None if r.s is None else round(r.s, 9)) for r in x.collect())
    assert tell(got) == tell(whole) and got.count() == 1500
