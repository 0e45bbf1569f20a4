"""Wide hourly counts, point rollups, upserts and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import scale
from .quantiles import keyed_quantiles

HOURS = [f"hour_{h:02d}" for h in range(24)]


def matching(df: DataFrame, year: int, **equal: str) -> DataFrame:
    """Rows of a year that equal the given texts in the given columns; empty texts filter nothing."""
    out = df.where(F.trim(text.or_empty(F.col("year"))) == str(int(year)))
    for c, v in equal.items():
        if v:
            out = out.where(F.trim(text.or_empty(F.col(c))) == v)
    return out


def hourly(df: DataFrame, date: str = "date") -> DataFrame:
    """One row an hour from hour_00..hour_23: time, traffic_count (null if no number) and the other columns."""
    keep = [c for c in df.columns if c not in (*HOURS, date)]
    day = F.substring(F.trim(text.or_empty(F.col(date))), 1, 10).try_cast("date")
    long = df.withColumn("__day", day).where("__day is not null").unpivot([*keep, "__day"], HOURS, "__h", "__v")
    at = F.col("__day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.substring("__h", 6, 2).cast("int"))
    return long.select(*keep, at.alias("time"), scale.number(F.col("__v")).alias("traffic_count"))


def aggregated(long: DataFrame, mode: str, order: list[str], year: int | None = None) -> DataFrame:
    """time, traffic_count by sum, mean or first (in order); hours without a value are null.  year: every hour of it."""
    v = F.col("traffic_count")
    how = {"sum": F.sum(v), "mean": F.avg(v), "first": F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))}
    if mode == "none":
        return long
    out = long.groupBy("time").agg(how[mode].alias("traffic_count"))
    if year is None:
        return out
    a, b = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    every = long.sparkSession.range(1).select(F.explode(F.sequence(a, b - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("time"))
    return every.join(out, "time", "left")


def rollup(rows: DataFrame, value: Column, period: list[str], points: list[str], year: Column, wanted: int) -> DataFrame:
    """Per period: the sum (six digits), records, distinct points and their sorted list; rows without a number are left out."""
    x = rows.withColumn("__v", scale.number(value)).where(F.col("__v").isNotNull() & (year == wanted)).withColumn("__p", F.concat(*(F.trim(text.or_empty(F.col(p))) for p in points)))
    return x.groupBy(*period).agg(F.round(F.sum("__v"), 6).alias("total_value"), F.count(F.lit(1)).alias("record_count"), F.count_distinct("__p").alias("point_count"), F.array_join(F.array_sort(F.collect_set("__p")), "|").alias("point_directions"))


def exit_points(items: DataFrame, point_type: str, country: str, order: str) -> DataFrame:
    """Valid exit points with data of a type and country; the last of each point counts."""
    t = lambda c: F.trim(text.or_empty(F.col(c)))
    keys = [t("operatorKey"), t("pointKey"), t("directionKey")]
    complete = F.lit(True)
    for k in keys:
        complete = complete & (k != "")
    ok = (t("pointType") == point_type) & (F.lower(t("directionKey")) == "exit") & (F.upper(t("tSOCountry")) == country) & text.truthy(F.col("hasData")) & ~text.truthy(F.col("isInvalid")) & complete
    found = items.where(ok).withColumn("pointDirection", F.concat(*keys))
    last = Window.partitionBy("pointDirection").orderBy(F.desc(order))
    return found.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with other keys, then the new ones; the new rows' columns, missing ones null."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    both = kept.unionByName(new, allowMissingColumns=True)
    return both.select(*new.columns)


def merged_by_url(existing: DataFrame, incoming: DataFrame, url: str, position: str) -> DataFrame:
    """Incoming rows replace the last row with the same canonical address in its place; others are appended.

    position orders each input; the result's positions order the merge.  Rows without an address are never replaced.
    """
    a = existing.withColumn("__u", text.canonical_url(F.col(url))).withColumn("__in", F.lit(0))
    b = incoming.withColumn("__u", text.canonical_url(F.col(url))).withColumn("__in", F.lit(1))
    n = existing.agg((F.coalesce(F.max(position), F.lit(0)) + 1).alias("__n"))  # one row
    both = a.unionByName(b).crossJoin(F.broadcast(n)).withColumn("__at", F.col(position) + F.col("__in") * F.col("__n"))
    own = F.when(F.col("__u") == "", F.concat(F.lit("#"), F.col("__at").cast("string"))).otherwise(F.col("__u"))
    w = Window.partitionBy(own)
    # the slot that incoming rows of an address land in: its last existing row, else its first incoming one
    slot = F.coalesce(F.max(F.when(F.col("__in") == 0, F.col("__at"))).over(w), F.min("__at").over(w))
    newest = F.max("__at").over(w)
    placed = both.withColumn("__slot", slot).withColumn("__last", newest).withColumn("__any", F.max("__in").over(w))
    stays = ((F.col("__in") == 0) & ((F.col("__any") == 0) | (F.col("__at") != F.col("__slot")))) | ((F.col("__in") == 1) & (F.col("__at") == F.col("__last")))
    return placed.where(stays).withColumn(position, F.when(F.col("__in") == 1, F.col("__slot")).otherwise(F.col("__at"))).drop("__u", "__in", "__n", "__at", "__slot", "__last", "__any")


def domain_counts(links: DataFrame, link: str) -> DataFrame:
    """One row: links, links with a domain, distinct domains."""
    d = F.nullif(text.domain(F.col(link)), F.lit(""))
    return links.agg(F.count(F.lit(1)).alias("links"), F.count(d).alias("valid"), F.count_distinct(d).alias("domains"))


def prompt_statistics(df: DataFrame, prompt: str, n_news: Column) -> DataFrame:
    """One row: prompts, most, least (zero counts as unset) and mean numbers of news, and the prompt with the most."""
    return df.agg(F.count(F.lit(1)).alias("prompts"), F.max(n_news).alias("most"), F.coalesce(F.min(F.when(n_news > 0, n_news)), F.lit(0)).alias("least"), F.avg(n_news).alias("mean"), F.max_by(prompt, F.struct(n_news, prompt)).alias("longest"))


def masked_mean(value: Column, weight: Column) -> Column:
    """Weighted mean as an aggregate; zero weight gives zero."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-6))


def lag_aligned(bank: DataFrame, target: DataFrame, lags: tuple[int, ...], least: int = 20) -> DataFrame:
    """bank(day, ...) joined to target(day, ...) `lag` days later for each lag that has so many pairs."""
    lagged = bank.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__d", F.date_add("day", F.col("lag"))).drop("day")
    pairs = lagged.join(target.withColumnRenamed("day", "__d"), "__d").withColumnRenamed("__d", "day")
    enough = pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return pairs.join(F.broadcast(enough.select("lag")), "lag", "left_semi")  # one row a lag


def normalised_scores(df: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """df with norm: the score less the keys' median, at least zero, over its peak (ones where nothing peaks)."""
    m = keyed_quantiles(df, keys, score, [0.5]).select(*keys, F.col("q")[0].alias("__m"))
    above = df.join(m, keys, "left").withColumn("__a", F.greatest(F.col(score) - F.col("__m"), F.lit(0.0)))
    peak = above.groupBy(*keys).agg(F.max("__a").alias("__p"))
    return above.join(peak, keys).withColumn("norm", F.when(F.col("__p") > 1e-12, F.col("__a") / F.col("__p")).otherwise(1.0)).drop("__m", "__a", "__p")
