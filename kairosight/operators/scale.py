"""Scaling statistics, clipping and normalisation."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

EPS = 1e-6


def number(c: Column) -> Column:
    """A finite double, or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def finite(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, number(F.col(value))).where(F.col(value).isNotNull())


def without_spikes(df: DataFrame, value: str, clip: float) -> DataFrame:
    """Rows within +-clip (statistics drop spikes); clip <= 0: all."""
    return df.where(F.abs(value) <= clip) if clip > 0 else df


def clamped(c: Column, clip: float) -> Column:
    """Values clamped to +-clip (batches keep spikes, flattened); clip <= 0: unchanged."""
    return F.greatest(F.least(c, F.lit(clip)), F.lit(-clip)) if clip > 0 else c


def zscore(df: DataFrame, value: str) -> DataFrame:
    """center_global (mean), scale_global (population deviation, 1e-6 at least)."""
    return df.agg(F.avg(value).alias("center_global"), F.greatest(F.stddev_pop(value), F.lit(EPS)).alias("scale_global"))


def robust(df: DataFrame, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Median, and the quantile range in units of a normal's; falls back to 1.4826 MAD, the population deviation, 1e-6."""
    if not 0 < low < high < 1:
        raise ValueError("quantiles must satisfy 0 < low < high < 1")
    spread = NormalDist().inv_cdf(high) - NormalDist().inv_cdf(low)
    q = quantiles(df, value, [low, 0.5, high]).crossJoin(F.broadcast(df.agg(F.stddev_pop(value).alias("std"))))  # one row each
    center = q.select("std", F.col("q")[1].alias("center_global"), ((F.col("q")[2] - F.col("q")[0]) / spread).alias("by_quantiles"))
    away = df.crossJoin(F.broadcast(center.select("center_global")))  # one row
    mad = quantiles(away, F.abs(F.col(value) - F.col("center_global")), [0.5]).select((1.4826 * F.col("q")[0]).alias("mad"))
    first = F.when(F.col("by_quantiles") > EPS, F.col("by_quantiles")).when(F.col("mad") > EPS, F.col("mad")).when(F.col("std") > EPS, F.col("std")).otherwise(F.lit(EPS))
    return center.crossJoin(mad).select("center_global", first.alias("scale_global"))


def statistics(df: DataFrame, value: str, mode: str = "zscore", clip: float = 0.0, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Statistics of finite, unspiked training values in one of the modes; an error if none is left."""
    clean = without_spikes(finite(df, value), value, clip)
    if clean.isEmpty():
        raise ValueError("no finite training values are left")
    if mode == "zscore":
        return zscore(clean, value)
    if mode == "robust_quantile":
        return robust(clean, value, low, high)
    raise ValueError(f"unknown mode {mode}")


def normalise(a: Column, center: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: (x - center) / scale)


def denormalise(a: Column, center: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: x * scale + center)


def winsor_bounds(df: DataFrame, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """lower and upper quantiles of the training values."""
    return quantiles(df, value, [low, high]).select(F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))
