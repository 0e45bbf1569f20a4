"""Running sums in a global order and draws with replacement."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kairosight.operators import ranges
from kairosight.operators.quantiles import quantiles


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") if rng.random() < 0.9 else None, i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i long, part long").repartition(7)
    found = {r.i: r.before for r in ranges.running(df, ["g"], ["i"], F.col("part"), "before").collect()}
    total, expected = Counter(), {}
    for g, i, w in rows:
        expected[i] = total[g]
        total[g] += w
    assert found == expected


def weights(n=400):
    rng = random.Random(2)
    rows = [(i, rng.random() ** 3, i * 2) for i in range(n)]
    return rows + [(n, sum(w for _, w, _ in rows), 1), (n + 1, 0.0, 1), (n + 2, None, 1), (n + 3, float("nan"), 1), (n + 4, -3.0, 1)]


def test_draws_follow_the_weights(spark):
    rows, n = weights(), 40_000
    df = spark.createDataFrame(rows, "id long, w double, draw long")
    found = ranges.drawn(df.repartition(3), "w", "id", n, 5)
    assert found.columns == ["draw_", "id", "w", "draw"]
    drawn = found.collect()
    assert sorted(r.draw_ for r in drawn) == list(range(n))
    good = {i: w for i, w, _ in rows if w is not None and w > 0}
    total, times = sum(good.values()), Counter(r.id for r in drawn)
    assert set(times) <= set(good) and max(times.values()) > n * 0.45
    for i, w in good.items():
        p = w / total
        assert abs(times[i] - n * p) <= 4 * math.sqrt(n * p * (1 - p)) + 1
    again = ranges.drawn(df.repartition(11), "w", "id", n, 5).select("draw_", "id").collect()
    assert sorted(map(tuple, again)) == sorted((r.draw_, r.id) for r in drawn)
    other = ranges.drawn(df, "w", "id", n, 6).select("draw_", "id").collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, again))


@pytest.mark.parametrize("rows", [[], [(1, 0.0)], [(1, None), (2, -1.0)]])
def test_nothing_to_draw(spark, rows):
    df = spark.createDataFrame(rows, "id long, w double")
    assert ranges.drawn(df, "w", "id", 10, 1).count() == 0


def test_one_row_and_many_equal_ones(spark):
    one = spark.createDataFrame([(7, 0.3)], "id long, w double")
    assert [r.id for r in ranges.drawn(one, "w", "id", 5, 1).collect()] == [7] * 5
    equal = spark.range(20_000).select("id", F.lit(1.0).alias("w"))
    times = Counter(r.id for r in ranges.drawn(equal, "w", "id", 20_000, 3).select("id").collect())
    assert abs(len(times) - 20_000 * (1 - math.exp(-1))) < 300 and max(times.values()) < 12


def test_not_a_number_is_above_all_numbers(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "v double")
    low, median, high = quantiles(df, "v", [0.0, 0.5, 1.0]).first().q
    assert (low, median) == (1.0, 2.5) and math.isnan(high)
    assert quantiles(df.where("v < 4"), "v", [0.5]).first().q == [2.0]
