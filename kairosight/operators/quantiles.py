"""Exact quantiles of a whole column without gathering its values in one task.

Values fall into buckets that keep their order: by sign, power of two and a 4096th of it, then by a 4096th of the bucket.
Counts of the buckets (a bounded number, combined before the shuffle) tell which one holds each wanted rank; only the
distinct values of that bucket are counted one by one.  The values alone are stored once in the shared folder, so that what
they come from is not evaluated for each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored

#: Cuts of a power of two, and of each of those.
CUTS = 4096


def _bucket(x: Column) -> Column:
    """A whole number that does not fall as x grows; zero for zero, the greatest for NaN, which counts as above all numbers."""
    size = F.floor(F.log2(F.greatest(F.abs(x), F.lit(5e-324))) * CUTS) + 1100 * CUTS
    return F.when(F.isnan(x), F.lit(1 << 40)).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def _finer(x: Column) -> Column:
    """Order inside a bucket; its width is about 1/6000 of the value."""
    size = F.floor(F.pmod(F.log2(F.greatest(F.abs(x), F.lit(5e-324))) * CUTS, F.lit(1.0)) * CUTS)
    return F.when(F.isnan(x) | (x == 0), F.lit(0)).when(x > 0, size).otherwise(-size).cast("bigint")


def _located(counts: DataFrame, by: list[str], order: str, targets: DataFrame, few: bool = True) -> DataFrame:
    """targets(rank, place, *by), few unless there are keys, with the value of `order` whose rows hold their place; place becomes that inside it."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    before = F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cut = counts.withColumn("before", before)
    sent = F.broadcast(targets) if few else targets  # two rows a quantile
    joined = cut.join(sent, by) if by else cut.crossJoin(sent)
    held = joined.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    return held.select("rank", (F.col("place") - F.col("before")).alias("place"), *by, order)


def _ranks(probabilities: list[float]) -> Column:
    """The ranks, from 0, of the values that n values' quantiles lie between."""
    ranks = [F.floor(F.lit(float(p)) * (F.col("n") - 1)) + up for p in probabilities for up in (0, 1)]
    return F.array_distinct(F.array(*(F.least(r, F.col("n") - 1).cast("bigint") for r in ranks)))


def _interpolated(probabilities: list[float]) -> Column:
    """The quantiles from n and `at`, the values by rank."""
    at = lambda r: F.element_at("at", r.cast("bigint"))

    def between(p: float) -> Column:
        exact = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(exact)
        high = F.least(low + 1, F.col("n") - 1)
        return F.when(low == high, at(low)).otherwise((low + 1 - exact) * at(low) + (exact - low) * at(high))

    return F.array(*(F.when(F.col("n") > 0, between(p)) for p in probabilities))


def quantiles(df: DataFrame, value: str | Column, probabilities: list[float]) -> DataFrame:
    """One row, q: the quantiles with linear interpolation between neighbouring ranks; nulls do not count, no value gives nulls."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = stored(df.select(x.alias("x")).where("x is not null"), "values")  # read three times
    rows = values.select("x", _bucket(F.col("x")).alias("b"), _finer(F.col("x")).alias("f"))
    buckets = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    total = buckets.agg(F.sum("n").alias("n"))
    wanted = total.where("n > 0").select(F.explode(_ranks(probabilities)).alias("rank"))
    first = _located(buckets, [], "b", wanted.withColumn("place", F.col("rank")))
    inside = rows.join(F.broadcast(first.select("b").distinct()), "b")
    second = _located(inside.groupBy("b", "f").agg(F.count(F.lit(1)).alias("n")), ["b"], "f", first)
    last = inside.join(F.broadcast(second.select("b", "f").distinct()), ["b", "f"])
    found = _located(last.groupBy("b", "f", "x").agg(F.count(F.lit(1)).alias("n")), ["b", "f"], "x", second).select("rank", "x")
    one = total.crossJoin(F.broadcast(found.agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))))  # two values a quantile
    return one.select(_interpolated(probabilities).alias("q"))


def keyed_quantiles(df: DataFrame, keys: list[str], value: str | Column, probabilities: list[float]) -> DataFrame:
    """keys, q: the quantiles of each key's values, as above; a key without values has no row.  Keys may be null.

    Buckets of a key are counted before the shuffle, so a key that holds most rows is no single task.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = stored(df.select(F.struct(*keys).alias("key"), x.alias("x")).where("x is not null"), "values")
    rows = values.select("key", "x", _bucket(F.col("x")).alias("b"), _finer(F.col("x")).alias("f"))
    count = F.count(F.lit(1)).alias("n")
    buckets = rows.groupBy("key", "b").agg(count)
    total = buckets.groupBy("key").agg(F.sum("n").alias("n"))
    first = _located(buckets, ["key"], "b", total.select("key", F.explode(_ranks(probabilities)).alias("rank")).withColumn("place", F.col("rank")), False)
    inside = rows.join(first.select("key", "b").distinct(), ["key", "b"])
    second = _located(inside.groupBy("key", "b", "f").agg(count), ["key", "b"], "f", first, False)
    last = inside.join(second.select("key", "b", "f").distinct(), ["key", "b", "f"])
    found = _located(last.groupBy("key", "b", "f", "x").agg(count), ["key", "b", "f"], "x", second, False)
    at = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # two values a quantile
    return total.join(at, "key").select("key.*", _interpolated(probabilities).alias("q"))
