"""Sliding windows over ordered series, and rolling statistics.  Order is always an explicit key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .ranges import free

#: Starts of windows that one task holds together, and days of a series that are numbered together.
BLOCK, SPAN_DAYS = 4096, 30


def sliding(series: DataFrame, history: int, horizon: int, stride: int = 1, key: str = "series_id", at: str = "ts", value: str = "value", least: Column | None = None) -> DataFrame:
    """series_id, start, history, target and their times of every complete window.

    Rows without a time or value are dropped first, so windows bridge gaps.  least: a condition on the first
    target row (its columns are visible), for splits whose history comes from the split before.
    """
    span = history + horizon
    rows = series.where(F.col(at).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.coalesce(key, F.lit("Not Specified")).alias(key), F.col(at), F.col(value), *([least.alias("ok")] if least is not None else []))
    placed = indexed(rows, key, at)
    # blocks of starts; the first rows of a block also end the windows of the block before
    width = max(BLOCK, span)
    block = F.floor(F.col("start") / width)
    shared = (F.col("start") % width < span - 1) & (block > 0)
    cut = placed.withColumn("block", F.explode(F.when(shared, F.array(block - 1, block)).otherwise(F.array(block))))
    w = Window.partitionBy(key, "block").orderBy("start")
    ahead = lambda c, a, b: F.collect_list(c).over(w.rowsBetween(a, b))
    wide = cut.select(
        key, "start", "block", ahead(value, 0, history - 1).alias("history"), ahead(value, history, span - 1).alias("target"),
        ahead(at, 0, history - 1).alias("history_times"), ahead(at, history, span - 1).alias("target_times"), *([F.lead("ok", history).over(w).alias("ok")] if least is not None else []),
    )
    found = wide.where((F.size("target") == horizon) & (F.col("start") % stride == 0) & (F.floor(F.col("start") / width) == F.col("block")))
    return (found.where("ok") if least is not None else found).select(key, "start", "history", "target", "history_times", "target_times")


def indexed(rows: DataFrame, key: str, at: str) -> DataFrame:
    """rows with start: their number from 0 in the order of the time `at` within each key.

    Spans of SPAN_DAYS are numbered by themselves and the counts of the spans before are added, so no task needs a whole series.
    """
    spans = rows.withColumn("span", F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (86400 * SPAN_DAYS)))
    counts = spans.groupBy(key, "span").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(key, "span", F.coalesce(ahead, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(key, "span").orderBy(at)) - 1
    numbered = spans.withColumn("nth", nth).join(before, [key, "span"])
    return numbered.withColumn("start", F.col("before") + F.col("nth")).drop("span", "nth", "before")


def fit_left(a: Column, n: int) -> Column:
    """The last n elements, padded with zeros on the left."""
    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(a), F.lit(0))), F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n))


def fit_right(a: Column, n: int) -> Column:
    """The first n elements, padded with zeros on the right."""
    return F.concat(F.slice(a, 1, n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(a), F.lit(0))))


def mask_right(a: Column, n: int) -> Column:
    """1 for each of n places that has an element, else 0."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.size(a), 1.0).otherwise(0.0))


def trend(a: Column, k: int) -> Column:
    """Centred moving average of k (odd) elements with the ends repeated."""
    if k % 2 == 0:
        raise ValueError("the window must be odd")
    side = k // 2
    at = lambda i: F.element_at(a, F.greatest(F.least(i, F.size(a)), F.lit(1)))
    total = lambda i: F.aggregate(F.sequence(i - side, i + side), F.lit(0.0), lambda s, j: s + at(j))
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: total(i) / k)


def residual_history(a: Column, k: int) -> Column:
    """x minus the sum of the last k values divided by k, also while fewer than k are there; k is capped by the length."""
    n = F.least(F.lit(k), F.size(a))
    total = lambda i: F.aggregate(F.slice(a, F.greatest(i - n + 1, F.lit(1)), F.least(n, i)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x, i: x - total(i + 1) / n)


def patches(a: Column, length: int, stride: int, pad: Column | None = None) -> Column:
    """Overlapping slices; a short array is padded with zeros on the right, a remainder is dropped.

    pad: a value that fills the last slice instead, so that no remainder is dropped.
    """
    size = F.size(a)
    if pad is None:
        full = F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - size, F.lit(0))))
    else:
        more = F.when(size < length, F.lit(length) - size).otherwise(F.pmod(F.lit(stride) - F.pmod(size - length, F.lit(stride)), F.lit(stride)))
        full = F.concat(a, F.array_repeat(pad, more))
    n = F.floor((F.greatest(size, F.lit(length)) - length) / stride).cast("int") if pad is None else F.floor((F.size(full) - length) / stride).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda p: F.slice(full, p * stride + 1, length))


#: Rows of a part of a series; frames that reach over its start meet copies of the rows before it.
PART = 8192


def over_parts(rows: DataFrame, key: str, at: str, reach: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows with columns over a window of each key in the order of `at` whose frames go back `reach` rows at most (PART is more).

    A series is cut into parts of PART rows, each with copies of the `reach` rows before it, so no task needs a whole one.
    Times of a key are distinct; rows with a null key or time go.  rows has no column `start`.
    """
    part, copied = free("part", rows), free("copied", rows)
    numbered = indexed(rows, key, at)
    own = F.floor(F.col("start") / PART)
    here, ahead = F.struct(own.alias(part), F.lit(False).alias(copied)), F.struct((own + 1).alias(part), F.lit(True).alias(copied))
    spots = F.when(F.pmod("start", F.lit(PART)) >= PART - reach, F.array(here, ahead)).otherwise(F.array(here))
    dealt = numbered.select(*rows.columns, F.inline(spots))
    w = Window.partitionBy(key, part).orderBy(at)
    return dealt.withColumns(columns(w)).where(~F.col(copied)).drop(part, copied)


def rolling(rows: DataFrame, key: str, at: str, back: int, value: str, fn: Callable, least: int, out: str) -> DataFrame:
    """rows with out: fn(value) over a row and the `back` rows before it where they have so many values, else null."""
    framed = lambda w: w.rowsBetween(-back, 0)
    return over_parts(rows, key, at, back, lambda w: {out: F.when(F.count(value).over(framed(w)) >= least, fn(value).over(framed(w)))})


def seasonal_naive(daily: DataFrame, value: str = "value", day: str = "day") -> DataFrame:
    """daily with resid: value minus the mean of the previous three same weekdays (two at least)."""
    w = Window.partitionBy(F.weekday(day)).orderBy(day).rowsBetween(-3, -1)
    return daily.withColumn("resid", F.when(F.count(value).over(w) >= 2, F.col(value) - F.avg(value).over(w)))


def volatility_labels(daily_sums: DataFrame) -> DataFrame:
    """day and vol_ratio from per-day n, s (sum), s2 (sum of squares) over all series, in their order.

    ln of the day's population deviation over that of up to five previous present days together; the first day has none.
    """
    w = Window.orderBy("day").rowsBetween(-5, -1)  # one row a day
    std = lambda n, s, s2: F.sqrt(F.greatest(s2 / n - F.pow(s / n, F.lit(2.0)), F.lit(0.0)))
    before = [F.sum(c).over(w) for c in ("n", "s", "s2")]
    found = daily_sums.select("day", std(F.col("n"), F.col("s"), F.col("s2")).alias("now"), std(*before).alias("past"), (before[1] / before[0]).alias("past_mean"), before[0].alias("past_n"))
    eps = F.lit(1e-6)
    return found.where("past_n > 0").select("day", F.ln(F.greatest("now", eps) / F.greatest("past", eps)).alias("vol_ratio"), "past", "past_mean")
