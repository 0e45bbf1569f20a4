"""Frequencies, chronological splits, their history prefixes and checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import times
from ..sources.shipping import ship
from ..sources.stored import stored
from .ranges import free, running


def inferred_minutes(df: DataFrame, at: str) -> DataFrame:
    """One row, minutes: the median gap of distinct times, rounded half to even, if it is under a day; else 0.

    Gaps of all times need one global order; times are made distinct first, so the row count is that of the time axis.
    """
    before = F.lag("t").over(Window.orderBy("t"))
    gap = df.select(F.unix_timestamp(F.col(at).cast("timestamp")).alias("t")).where("t is not null").distinct().select(((F.col("t") - before) / 60.0).alias("m")).where("m > 0")
    m = F.percentile("m", F.lit(0.5))
    return gap.agg(F.when((m > 0) & (m < 1440), F.greatest(F.bround(m).cast("int"), F.lit(1))).otherwise(0).alias("minutes"))


def flip_day_first(df: DataFrame, text: str, split: str, order: tuple[str, ...], day_first: bool) -> DataFrame:
    """One row: day_first as it should be used, and the unparsed rows and order issues under both readings.

    The reading flips when only the configured one has order issues and the other parses no less, or when neither
    has issues and the other parses more.
    """
    both = df.select(split, *(times.series_time(F.col(text), d).alias(n) for n, d in (("a", day_first), ("b", not day_first))))
    by = both.groupBy(split).agg(*(f(F.col(c)).alias(f"{c}_{n}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))), *(F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in "ab"))
    at = lambda s, c: F.max(F.when(F.col(split) == s, F.col(c)))
    issues = lambda c: sum((F.coalesce((at(p, f"{c}_hi") >= at(q, f"{c}_lo")).cast("int"), F.lit(0)) for p, q in zip(order, order[1:], strict=False)), F.lit(0))
    one = by.agg(issues("a").alias("issues"), issues("b").alias("other_issues"), F.sum("a_null").alias("nulls"), F.sum("b_null").alias("other_nulls"))
    flip = ((F.col("issues") > 0) & (F.col("other_issues") == 0) & (F.col("other_nulls") <= F.col("nulls"))) | ((F.col("issues") == 0) & (F.col("other_issues") == 0) & (F.col("other_nulls") < F.col("nulls")))
    return one.withColumn("day_first", F.when(flip, not day_first).otherwise(day_first))


def overlaps(df: DataFrame, at: str, split: str, order: tuple[str, ...]) -> DataFrame:
    """A row for each neighbouring pair of splits whose times overlap."""
    by = df.groupBy(split).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    pairs = df.sparkSession.createDataFrame(list(zip(order, order[1:], strict=False)), "earlier string, later string")
    a = by.select(F.col(split).alias("earlier"), F.col("hi"))
    b = by.select(F.col(split).alias("later"), F.col("lo"))
    return pairs.join(a, "earlier").join(b, "later").where("hi >= lo").select("earlier", "later", "hi", "lo")


def _position(df: DataFrame, order: list) -> DataFrame:
    """Rows numbered from 0 in a global order without a single-task sort: ranges are numbered by their counts before them.

    Ranges and counts come from one stored table, so no retry or new plan can cut them another way in between.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    inner = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1)
    before = inner.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inner.join(F.broadcast(before), "__p").withColumn("position", F.col("__i") + F.col("__before")).drop("__p", "__i", "__before")  # one row a partition


def placed(df: DataFrame, first: str, second: str, tie: str, width: int = 1 << 16) -> DataFrame:
    """df with place: every row numbered from 1 by first and second descending (nulls last), then by the whole number tie.

    Rows are numbered inside groups of equal keys and a range of ties; sums of the counts of the groups before are
    added.  Only the distinct values of first meet in one task.
    """
    keys = [first, second, "__b"]
    keyed = df.withColumn("__b", F.floor(F.col(tie) / width))
    groups = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = groups.groupBy(first).agg(F.sum("__n").alias("__n")).select(F.col(first).alias("__f"), ahead(Window.orderBy(F.desc(first))).alias("__outer"))
    inner = groups.withColumn("__inner", ahead(Window.partitionBy(first).orderBy(F.desc(second), "__b")))
    starts = inner.join(outer, F.col(first).eqNullSafe(F.col("__f"))).select(*(F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)), (F.col("__outer") + F.col("__inner")).alias("__start"))
    numbered = keyed.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)))
    same = [F.col(k).eqNullSafe(F.col(f"__s{i}")) for i, k in enumerate(keys)]
    return numbered.join(starts, same).withColumn("place", F.col("__start") + F.col("__i")).select(*df.columns, "place")


def by_ratio(df: DataFrame, order: list, train: float, val: float, test: float) -> DataFrame:
    """df with split: the first floor(n * train) rows in order, then floor(n * val), then the rest."""
    total = train + val + test
    if min(train, val, test) < 0 or total <= 0:
        raise ValueError("ratios must not be negative and not all zero")
    n = df.count()
    a, b = int(n * (train / total) + 1e-9), int(n * (val / total) + 1e-9)
    return by_sizes(df, order, a, b)


def by_sizes(df: DataFrame, order: list, train: int, val: int) -> DataFrame:
    return _position(df, order).withColumn("split", F.when(F.col("position") < train, "train").when(F.col("position") < train + val, "val").otherwise("test")).drop("position")


def by_time_keeping_sizes(df: DataFrame, split: str, at: str, tie: str) -> DataFrame:
    """Rows dealt to splits anew in time order (ties by another column), each split keeping its size."""
    n = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    return by_sizes(df.drop(split), [at, tie], n.get("train", 0), n.get("val", 0))


def _digest(key: Column, seed: int) -> Column:
    """md5 of seed and key, the same on any cluster; a null key counts as the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def shuffled(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """shuffle_key, a column to order by for a repeatable shuffle."""
    return df.withColumn("shuffle_key", _digest(key, seed))


def with_history(previous: DataFrame, current: DataFrame, key: str, at: str, history: int) -> DataFrame:
    """current with the last `history` rows of previous before it, for each key; equal times keep the current row.

    is_target marks rows that may be forecast: those of current.
    """
    first = current.groupBy(key).agg(F.min(at).alias("__first"))
    w = Window.partitionBy(key).orderBy(F.desc(at))
    prefix = previous.join(first, key).where(F.col(at) < F.col("__first")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= history).drop("__r", "__first").withColumn("is_target", F.lit(False))
    both = prefix.unionByName(current.withColumn("is_target", F.lit(True)))
    keep = F.row_number().over(Window.partitionBy(key, at).orderBy(F.desc("is_target")))
    return both.withColumn("__r", keep).where("__r = 1").drop("__r")


def probe(df: DataFrame, key: Column, fraction: float, least: int, seed: int) -> DataFrame:
    """max(least, floor(n * fraction)) rows, those of the smallest digests of seed and key: a sample without replacement.

    It is the same on any cluster.  Null keys have the digest of the empty text; fewer rows than least are all taken.
    """
    digest, place = free("digest", df), free("place", df)
    k = max(least, int(df.count() * fraction))
    marked = df.withColumn(digest, _digest(key, seed))
    return running(marked, [], [digest], F.lit(1), place).where(F.col(place) < k).select(*df.columns)


def slices(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Each row's [start, end) cut into slices of so many days: the row with lo and hi; none where a bound is null or start is not before end."""
    a, b = (F.col(x).cast("timestamp_ntz") for x in (start, end))
    step = F.make_dt_interval(F.lit(days))
    cut = df.where(a < b).withColumn("lo", F.explode(F.sequence(a, b, F.expr(f"interval {days} days"))))
    return cut.where(F.col("lo") < b).withColumn("hi", F.least(F.col("lo") + step, b))


def months(df: DataFrame, year: str) -> DataFrame:
    """Each row with month, first and last day of every month of its year."""
    m = df.withColumn("first", F.explode(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.make_date(F.col(year), i, F.lit(1)))))
    return m.select(*df.columns, F.month("first").alias("month"), "first", F.last_day("first").alias("last"))


def _chain(batches: Iterator[pa.RecordBatch], gap: float) -> Iterator[pa.RecordBatch]:
    """The times kept, of batches sorted by key columns and then by a last column of seconds: what is held is the last key and time kept."""
    before, last = None, 0.0
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, seconds = batch.columns
        at = seconds.to_numpy(zero_copy_only=False)
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)
        starts, kept = np.append(np.flatnonzero(new), len(at)), []
        i = 0
        for stop in starts:
            own = tuple(key[i].as_py() for key in keys)
            if own != before:
                before, last = own, -np.inf
            while (i := i + int(np.searchsorted(at[i:stop], last + gap))) < stop:
                kept.append(i)
                last = at[i]
        yield batch.take(pa.array(kept, pa.int64()))


def thinned(df: DataFrame, at: str, days: float, keys: list[str]) -> DataFrame:
    """Rows at least so many days after the last row kept, greedily in time order; rows of null keys or times are not kept.

    A key's distinct seconds are sorted, spilling where they must, and read in batches; the chain holds one time, so its memory
    does not grow with a key, and only distinct seconds of the time axis, not rows, meet in the task of a hot key.
    """
    gap, second = float(days) * 86400, free("second", df)
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    ship(df.sparkSession)
    known = df.select(*keys, seconds.alias(second)).dropna().distinct()
    ordered = (known.repartition(*keys) if keys else known.repartition(1)).sortWithinPartitions(*keys, second)
    chosen = ordered.mapInArrow(lambda batches: _chain(batches, gap), known.schema)
    return df.withColumn(second, seconds).join(chosen, [*keys, second], "left_semi").select(*df.columns)
