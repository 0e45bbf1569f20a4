"""The feature bank: time-decayed aggregation of dated records onto a regular grid, and its lookups.

A record is in force at t when published_at <= t <= published_at + horizon_days.  Instead of a range join,
each record is exploded to the grid points it covers (at most 14 days of them, whatever the table's size),
and the rest is a hash aggregation with partial sums.  Nothing published after t can influence t.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The topic vocabulary and the components of a record's state vector, in order.
TOPICS = (
    "supply_tight",
    "supply_surplus",
    "heatwave",
    "cold_snap",
    "holiday",
    "outage",
    "fuel_shock",
    "renewable_surge",
    "renewable_drought",
    "interconnector_limit",
    "policy_active",
    "market_intervention",
    "retrospective",
    "routine",
    "other",
)
COMPONENTS = ("tightness", "demand_outlook", "renewable_surplus", "volatility_tone", "policy_in_effect")
MAX_HORIZON = 14


@dataclass(frozen=True)
class Grid:
    """Regular times from start to end, both included; minutes of 0 or a day and more: daily."""

    start: str
    end: str
    minutes: int

    @property
    def daily(self) -> bool:
        return not 0 < self.minutes < 1440

    @property
    def step(self) -> Column:
        return F.expr("interval 1 day" if self.daily else f"interval {self.minutes} minutes")

    def bounds(self) -> tuple[Column, Column]:
        """Start rounded down and end rounded up to the step; a daily grid takes both midnights."""
        a, b = (F.lit(x).cast("timestamp_ntz") for x in (self.start, self.end))
        return self.rounded(a, b)

    def rounded(self, start: Column, end: Column) -> tuple[Column, Column]:
        """Any two times as bounds of a grid of this step."""
        return (floor_to(start, self.minutes), F.date_trunc("DAY", end).cast("timestamp_ntz") if self.daily else ceil_to(end, self.minutes))

    def times(self, spark) -> DataFrame:
        a, b = self.bounds()
        return spark.range(1).select(F.explode(F.sequence(a, b, self.step)).alias("t"))


def grids(df: DataFrame, keys: list[str], at: str, minutes: int) -> DataFrame:
    """keys and t: the regular grid of each key, from its first time to its last; null times count for nothing."""
    step, x = Grid("", "", minutes), F.col(at).cast("timestamp_ntz")
    lo, hi = step.rounded(F.min(x), F.max(x))
    return df.where(x.isNotNull()).groupBy(*keys).agg(F.struct(lo.alias("lo"), hi.alias("hi")).alias("t")).select(*keys, F.explode(F.sequence("t.lo", "t.hi", step.step)).alias("t"))


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def _from_seconds(s: Column) -> Column:
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def floor_to(ts: Column, minutes: int) -> Column:
    """ts rounded down to a multiple of the step (midnight for a daily grid)."""
    unit = 60 * (minutes if 0 < minutes < 1440 else 1440)
    return _from_seconds(F.floor(_seconds(ts) / unit) * unit)


def ceil_to(ts: Column, minutes: int) -> Column:
    unit = 60 * (minutes if 0 < minutes < 1440 else 1440)
    return _from_seconds(F.ceil(_seconds(ts) / unit) * unit)


def available(published: Column, has_time: Column, grid: Grid) -> Column:
    """When a record may be used: at its second; on a daily grid at its midnight; without a time of day, on a finer grid, at the next midnight."""
    day = F.date_trunc("DAY", published).cast("timestamp_ntz")
    if grid.daily:
        return day
    return F.when(has_time, F.date_trunc("SECOND", published).cast("timestamp_ntz")).otherwise(day + F.expr("interval 1 day"))


def usable(records: DataFrame) -> DataFrame:
    """Records with a date whose clamped horizon and confidence are positive."""
    return (
        records.withColumn("horizon_days", F.greatest(F.lit(0), F.least(F.lit(MAX_HORIZON), F.coalesce("horizon_days", F.lit(0)))))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
        .where("published_at is not null and horizon_days > 0 and confidence > 0")
    )


def in_force(records: DataFrame, grid: Grid, tau_days: float) -> DataFrame:
    """(t, w, record columns) for each grid time and record in force; w is confidence decayed by age."""
    a, b = grid.bounds()
    until = F.col("published_at") + F.make_dt_interval(F.col("horizon_days"))
    first = F.greatest(ceil_to(F.col("published_at"), grid.minutes), a)
    last = F.least(until, b)
    exploded = usable(records).where(first <= last).withColumn("t", F.explode(F.sequence(first, last, grid.step)))
    age = (_seconds(F.col("t")) - _seconds(F.col("published_at"))) / F.lit(86400.0)
    return exploded.withColumn("w", F.col("confidence") * F.exp(-age / F.lit(float(max(1e-3, tau_days)))))


def mass(records: DataFrame, grid: Grid, tau_days: float) -> DataFrame:
    """t, mass, docs at every grid time, zero where nothing is in force."""
    sums = in_force(records, grid, tau_days).groupBy("t").agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("docs"))
    return grid.times(records.sparkSession).join(sums, "t", "left").select("t", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("docs", F.lit(0)).alias("docs"))


def weighted_means(records: DataFrame, grid: Grid, tau_days: float, values: dict[str, Column]) -> DataFrame:
    """t and, for each named value, its mean weighted by decayed confidence; zero where nothing is in force."""
    norm = F.greatest(F.sum("w"), F.lit(1e-6))
    sums = in_force(records, grid, tau_days).groupBy("t").agg(*((F.sum(F.col("w") * v) / norm).alias(k) for k, v in values.items()))
    return grid.times(records.sparkSession).join(sums, "t", "left").select("t", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in values))


def topic_flags(topics: Column) -> dict[str, Column]:
    """One 0/1 column for each topic of the vocabulary."""
    return {t: F.array_contains(topics, t).cast("double") for t in TOPICS}


def array_means(records: DataFrame, grid: Grid, tau_days: float, array: str) -> DataFrame:
    """(t, pos, mean) of an array column's elements, for grid times with records in force."""
    sums = in_force(records, grid, tau_days).select("t", "w", F.posexplode(array).alias("pos", "x"))
    return sums.groupBy("t", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("mean"))


def _span(points: DataFrame, order: str) -> Column:
    """30 days of a time, or 4096 of a number."""
    kind = dict(points.dtypes)[order]
    if kind == "date" or kind.startswith("timestamp"):
        return F.floor(F.unix_timestamp(F.col(order).cast("timestamp")) / (86400 * 30))
    return F.floor(F.col(order) / 4096)


#: Rows of a piece of a span: about the root of the rows of a span of minutes.
PIECE = 256


def ema(points: DataFrame, alpha: float, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exponential moving average of value along order for each key: the first value, then a*x + (1-a)*previous.

    Each span of the axis is folded from zero by itself, in pieces, since a fold copies what it has gathered at each step; what a span leaves to the next is affine in what it got, so only
    one pair of numbers a span is folded along a whole axis.
    """
    a = float(max(0.0, min(1.0, alpha)))
    kinds = dict(points.dtypes)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    spans = points.select(*keys, order, value, _span(points, order).alias("span")).groupBy(*keys, "span").agg(rows.alias("rows"))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(size(rows) - 1) div {PIECE}").cast("int")), lambda i: F.slice("rows", i * PIECE + 1, PIECE))

    def along(piece: Column, e: Column) -> Column:
        """The averages along a piece that starts from e."""
        step = F.struct(e.alias("e"), F.array().cast("array<double>").alias("all"))
        return F.aggregate(piece, step, lambda s, r: F.struct((a * r.x + (1 - a) * s.e).alias("e"), F.concat(s.all, F.array(a * r.x + (1 - a) * s.e)).alias("all"))).all

    none = F.array().cast("array<array<double>>")
    last = lambda done: F.when(F.size(done) == 0, F.lit(0.0)).otherwise(F.element_at(F.element_at(done, -1), -1))
    folded = F.aggregate(pieces, none, lambda done, piece: F.concat(done, F.array(along(piece, last(done)))))
    own = spans.withColumn("own", F.flatten(folded)).withColumn("first", F.col("rows")[0].x.cast("double"))
    ends = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("span", F.size("own").alias("n"), F.element_at("own", -1).alias("e"), "first"))).alias("ends"))
    got = F.struct(F.lit(None).cast("double").alias("c"), F.array().cast("array<struct<span:bigint,c:double>>").alias("all"))

    def carry(s, r):
        c = F.coalesce(s.c, r["first"])  # the first value stands for what came before it
        return F.struct((r.e + F.pow(F.lit(1 - a), r.n) * c).alias("c"), F.concat(s.all, F.array(F.struct(r.span.alias("span"), c.alias("c")))).alias("all"))

    carried = ends.select(*keys, F.inline(F.aggregate("ends", got, carry).all))
    joined = own.join(carried, [*keys, "span"])
    smooth = F.transform("rows", lambda r, i: F.struct(r.o.alias(order), r.x.alias(value), (F.element_at("own", i + 1) + F.pow(F.lit(1 - a), i + 1) * F.col("c")).alias(out)))
    return joined.select(*keys, F.inline(smooth)).select(*keys, F.col(order).cast(kinds[order]).alias(order), F.col(value).cast(kinds[value]).alias(value), out)


def lookup(targets: DataFrame, bank: DataFrame, grid: Grid, at: str, fields: list[str]) -> DataFrame:
    """targets with the bank's fields at the latest grid time <= at; zeros before the start and for null times.

    A grid is regular, so inside it the latest point is the floor, an equi-join; beyond the end it is the last point.
    """
    last = F.date_trunc("DAY", F.col(at)).cast("timestamp_ntz") if grid.daily else F.least(floor_to(F.col(at), grid.minutes), grid.bounds()[1])
    found = targets.withColumn("__t", last).join(bank.select(F.col("t").alias("__t"), *fields), "__t", "left").drop("__t")
    return found.select(*targets.columns, *(F.coalesce(f, F.lit(0).cast(dict(bank.dtypes)[f])).alias(f) for f in fields))


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """left with right's fields at the latest right time <= left's, for irregular times.

    A union and a window over 30 days of each key; what the days before leave is one row a span, so no task needs a whole key.
    """
    taken = {c.lower() for c in [*left.columns, *right.columns]}
    free = lambda n: n if n not in taken else free(n + "_")
    side, found, span, last, carried = map(free, ("side", "found", "span", "last", "carried"))
    a = left.withColumn(side, F.lit(1))
    b = right.select(*keys, F.col(at), F.struct(*fields).alias(found)).withColumn(side, F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).withColumn(span, F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / (86400 * 30)))
    w = Window.partitionBy(*keys, span).orderBy(at, side).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn(last, F.last(found, ignorenulls=True).over(w)).where(F.col(side) == 1)
    ends = both.groupBy(*keys, span).agg(F.max_by(found, F.when(F.col(side) == 0, F.col(at))).alias(found))
    before = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*(F.col(k).alias(f"{k}{span}") for k in keys), F.col(span).alias(carried + span), F.last(found, ignorenulls=True).over(before).alias(carried))
    same = [F.col(k).eqNullSafe(F.col(f"{k}{span}")) for k in keys]
    joined = inside.join(ahead, [*same, F.col(span).eqNullSafe(F.col(carried + span))], "left").withColumn(last, F.coalesce(last, carried))
    return joined.select(*left.columns, *(F.col(f"{last}.{f}").alias(f) for f in fields))


def permuted(bank: DataFrame, fields: list[str], key: Column) -> DataFrame:
    """The bank with its payload rows dealt to other times: the i-th time gets the payload that is i-th by key.  The bank has one row a grid time."""
    by_time = bank.withColumn("__i", F.row_number().over(Window.orderBy("t"))).select("t", "__i")
    by_key = bank.withColumn("__i", F.row_number().over(Window.orderBy(key, "t"))).select("__i", *fields)
    return by_time.join(by_key, "__i").drop("__i")


def blanked(bank: DataFrame, fields: list[str], when: Column | None = None) -> DataFrame:
    """Fields set to zero, everywhere or where a condition holds."""
    kinds = dict(bank.dtypes)
    zero = lambda f: F.transform(f, lambda x: x * 0) if kinds[f].startswith("array") else F.lit(0).cast(kinds[f])
    return bank.withColumns({f: zero(f) if when is None else F.when(when, zero(f)).otherwise(F.col(f)) for f in fields})


def coverage(bank: DataFrame, theta: float) -> DataFrame:
    """One row: times, covered (docs > 0), active (mass > theta), shares in percent, mean, median, min and max mass."""
    n = F.count(F.lit(1))
    covered, active = F.count_if(F.col("docs") > 0), F.count_if(F.col("mass") > theta)
    share = lambda x: F.when(n > 0, 100.0 * x / n).otherwise(0.0)
    return bank.agg(n.alias("times"), covered.alias("covered"), active.alias("active"), share(covered).alias("covered_pct"), share(active).alias("active_pct"),
                    F.avg("mass").alias("mean_mass"), F.percentile("mass", F.lit(0.5)).alias("median_mass"), F.min("mass").alias("min_mass"), F.max("mass").alias("max_mass"))


def require_mass(bank: DataFrame) -> DataFrame:
    """The bank, or an error if it has no times or no mass."""
    n, some = bank.agg(F.count(F.lit(1)), F.count_if(F.col("mass") > 0)).first()
    if not n or not some:
        raise ValueError("the bank is empty")
    return bank


def blended(banks: DataFrame, parts: list[str], value: str, weight: str) -> Column:
    """Mean of value_part weighted by weight_part over the parts."""
    total = sum((F.col(f"{weight}_{p}") for p in parts), F.lit(0.0))
    return sum((F.col(f"{value}_{p}") * F.col(f"{weight}_{p}") for p in parts), F.lit(0.0)) / F.greatest(total, F.lit(1e-6))
