"""Calendar profiles and the decomposition of forecast residuals into level, shape and spikes.

Everything works on long rows (sample keys, step, ts, r); windows are per sample, so they are small and parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles


def calendar_keys(ts: Column) -> dict[str, Column]:
    """dow (Monday 0) and hod (half hour of the day, 0 to 47)."""
    return {"dow": F.weekday(ts).cast("int"), "hod": (F.hour(ts) * 2 + (F.minute(ts) >= 30).cast("int")).cast("int")}


def profile(steps: DataFrame) -> DataFrame:
    """dow, hod, mean residual of the cells that occur; others count as zero."""
    return steps.where("ts is not null").withColumns(calendar_keys(F.col("ts"))).groupBy("dow", "hod").agg(F.avg("r").alias("mean"))


def dense(profile_: DataFrame) -> DataFrame:
    """All 7 x 48 cells."""
    spark = profile_.sparkSession
    cells = spark.range(336).select((F.col("id") / 48).cast("int").alias("dow"), (F.col("id") % 48).cast("int").alias("hod"))
    return cells.join(profile_, ["dow", "hod"], "left").select("dow", "hod", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def detrended(steps: DataFrame, profile_: DataFrame, sample: list[str]) -> DataFrame:
    """steps with slow (the sample's mean), calendar (profile centred on the sample's valid steps) and d = r - slow - calendar."""
    keyed = steps.withColumns(calendar_keys(F.col("ts"))).join(F.broadcast(profile_), ["dow", "hod"], "left")  # 336 rows at most
    w = Window.partitionBy(*sample)
    bias = F.when(F.col("ts").isNull(), 0.0).otherwise(F.coalesce("mean", F.lit(0.0)))
    centre = F.avg(F.when(F.col("ts").isNotNull(), bias)).over(w)
    out = keyed.withColumn("slow", F.avg("r").over(w)).withColumn("calendar", F.when(F.col("ts").isNull(), 0.0).otherwise(bias - centre))
    return out.withColumn("d", F.col("r") - F.col("slow") - F.col("calendar")).drop("dow", "hod", "mean")


def thresholds(d: DataFrame, share: float) -> DataFrame:
    """One row: sigma (population deviation of d, 1e-6 at least) and the quantile of |d| that leaves `share` above."""
    sigma = d.agg(F.greatest(F.stddev_pop("d"), F.lit(1e-6)).alias("sigma"))
    if not 0 < share < 1:
        return sigma.withColumn("threshold", F.lit(0.0))
    return sigma.crossJoin(F.broadcast(quantiles(d, F.abs("d"), [1.0 - share]).select(F.col("q")[0].alias("threshold"))))  # one row


def parts(d: DataFrame, limits: DataFrame, sample: list[str], share: float = 0.1, k_sigma: float = 3.0) -> DataFrame:
    """Steps with slow, shape, spike and spike_mask: slow + shape + spike = r, and the shapes of a sample average zero.

    A spike is one of the sample's ceil(steps * share) largest |d| (ties: the earlier step) above the threshold.
    """
    w = Window.partitionBy(*sample)
    rank = F.row_number().over(w.orderBy(F.desc(F.abs("d")), "step"))
    n = F.count(F.lit(1)).over(w)
    limit = F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(F.greatest(F.lit(0.0), F.lit(k_sigma) * F.col("sigma")))
    top = rank <= F.greatest(F.lit(1), F.ceil(n * F.lit(share))) if 0 < share < 1 else F.lit(True)
    marked = d.crossJoin(F.broadcast(limits)).withColumn("spike_mask", (F.abs("d") > limit) & top)  # one row of limits
    rest = marked.withColumn("spike", F.when(F.col("spike_mask"), F.col("d")).otherwise(0.0)).withColumn("shape", F.col("r") - F.col("slow") - F.col("spike"))
    mean = F.avg("shape").over(w)
    return rest.withColumn("__m", mean).withColumn("shape", F.col("shape") - F.col("__m")).withColumn("slow", F.col("slow") + F.col("__m")).drop("__m", "sigma", "threshold")


def magnitudes(steps: DataFrame, sample: list[str]) -> DataFrame:
    """Mean |r| of each sample."""
    return steps.groupBy(*sample).agg(F.avg(F.abs("r")).alias("magnitude"))


def hard_weights(m: DataFrame, top: float, hard_share: float) -> DataFrame:
    """m with hard (magnitude at or above the quantile 1 - top) and weight: hard ones share hard_share, the others the rest; weights sum to one."""
    top, hard_share = (max(0.0, min(1.0, x)) for x in (top, hard_share))
    q = quantiles(m, "magnitude", [1.0 - top]).select((F.col("q")[0] if top > 0 else F.lit(float("inf"))).alias("q"))
    marked = m.crossJoin(F.broadcast(q)).withColumn("hard", F.col("magnitude") >= F.col("q"))
    n = marked.agg(F.count_if("hard").alias("n_hard"), F.count_if(~F.col("hard")).alias("n_easy"))
    raw = F.when(F.col("hard"), hard_share / F.greatest("n_hard", F.lit(1))).otherwise((1 - hard_share) / F.greatest("n_easy", F.lit(1)))
    total = F.when(F.col("n_hard") > 0, F.lit(hard_share)).otherwise(0.0) + F.when(F.col("n_easy") > 0, F.lit(1 - hard_share)).otherwise(0.0)
    flat = 1.0 / F.greatest(F.col("n_hard") + F.col("n_easy"), F.lit(1))
    return marked.crossJoin(F.broadcast(n)).withColumn("weight", F.when(total > 0, raw / total).otherwise(flat)).drop("q", "n_hard", "n_easy")


def boosted_weights(m: DataFrame, top: float = 0.1, boost: float = 3.0) -> DataFrame:
    """m with weight: `boost` for magnitudes at or above the quantile 1 - top, else one, divided by their mean."""
    q = quantiles(m, "magnitude", [1.0 - top]).select(F.col("q")[0].alias("q"))
    raw = m.crossJoin(F.broadcast(q)).withColumn("raw", F.when(F.col("magnitude") >= F.col("q"), boost).otherwise(1.0))
    return raw.crossJoin(F.broadcast(raw.agg(F.greatest(F.avg("raw"), F.lit(1e-6)).alias("mean")))).withColumn("weight", F.col("raw") / F.col("mean")).drop("q", "raw", "mean")
