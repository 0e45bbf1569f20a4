"""Mutual information on a grid against all pairs of rows."""

import math
import random

import numpy as np
import pytest

from kairosight.operators import information as I


def brute(x, y, k=3):
    x, y = np.array(x, float), np.array(y, float)
    n = len(x)
    if n < 20:
        return math.nan
    if x.std() == 0 or y.std() == 0:
        return 0.0
    x, y = np.round(x / x.std() * I.GRAIN), np.round(y / y.std() * I.GRAIN)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    far = np.maximum(dx, dy)
    np.fill_diagonal(far, np.inf)
    d = np.sort(far, axis=1)[:, k - 1 : k]
    near = lambda v: np.where(d > 0, v < d, v <= 0).sum(1)
    digamma = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, m))
    return max(0.0, digamma(n) + digamma(k) - np.mean([digamma(a) + digamma(b) for a, b in zip(near(dx), near(dy), strict=True)]))


def samples():
    rng = random.Random(1)
    line = [(t := rng.gauss(0, 1), t + rng.gauss(0, 0.3)) for _ in range(500)]
    ties = [(rng.randint(0, 3), rng.randint(0, 2)) for _ in range(120)]
    dense = [(rng.gauss(0, 1e-6), rng.gauss(0, 1e-6)) for _ in range(150)] + [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(20)]
    zeros = [(0.0, 0.0)] * 90 + [(rng.random(), rng.random()) for _ in range(60)]
    flat = [(1.5, rng.random()) for _ in range(30)]
    few = [(rng.random(), rng.random()) for _ in range(19)]
    return {"line": line, "ties": ties, "dense": dense, "zeros": zeros, "flat": flat, "few": few}


def test_estimates_equal_all_pairs(spark):
    groups = samples()
    df = spark.createDataFrame([(g, float(a), float(b)) for g, rows in groups.items() for a, b in rows], "g string, x double, y double").repartition(5)
    found = {r.g: r for r in I.mutual(df, ["g"]).collect()}
    assert found.keys() == groups.keys()
    for g, rows in groups.items():
        a, b = zip(*rows, strict=True)
        expected = brute(a, b)
        assert found[g].n == len(rows)
        assert math.isnan(found[g].mi) if math.isnan(expected) else found[g].mi == pytest.approx(expected, abs=1e-9)
    assert found["line"].mi > 0.8


def test_permutation_test(spark):
    rng = random.Random(2)
    rows = [("joined", i, t := rng.random(), t + rng.random() / 9) for i in range(40)] + [("apart", i, rng.random(), rng.random()) for i in range(40)] + [("few", i, 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, day int, a double, b double")
    found = {r.g: r for r in I.tested(df.repartition(3), ["g"], "a", "b", "day", 19).collect()}
    assert found["joined"].p_value == pytest.approx(1 / 20) and found["apart"].p_value > 0.1
    assert math.isnan(found["few"].mi) and math.isnan(found["few"].p_value)
    again = {r.g: r.p_value for r in I.tested(df, ["g"], "a", "b", "day", 19).collect()}
    assert again["apart"] == found["apart"].p_value
    for g in ("joined", "apart"):
        a, b = zip(*[(r[2], r[3]) for r in rows if r[0] == g], strict=True)
        assert found[g].mi == pytest.approx(brute(a, b), abs=1e-9)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, day int, a double, b double")
    assert I.tested(df, ["g"], "a", "b", "day", 3).count() == 0
