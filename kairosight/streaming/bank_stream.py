"""The bank and identity dedupe over streams of records.

A record contributes to grid times up to its horizon after it, so a grid time's mass is final once the watermark
has passed it: records are exploded to grid times on arrival and summed per time.  The watermark delay is how late
a record may come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bank, news


def mass(records: DataFrame, grid: bank.Grid, tau_days: float, late: str = "1 day") -> DataFrame:
    """t, mass, docs of a stream of records; with batch input the same as in_force summed by time."""
    zoned = bank.in_force(records, grid, tau_days).withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", late)
    return zoned.groupBy(F.window("t", f"{grid.minutes or 1440} minutes").alias("w")).agg(F.sum("w").alias("mass"), F.count(F.lit(1)).alias("docs")).select(F.col("w.start").alias("t"), "mass", "docs")


def first_arrivals(articles: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """One row an identity within the watermark: the first that arrives (the batch form keeps the longest instead)."""
    keyed = articles.withColumns(news.identity(F.col("date"), F.col("title"), F.col("url"))).withColumn("__w", F.col(at).cast("timestamp"))
    return keyed.withWatermark("__w", late).dropDuplicatesWithinWatermark(["__title", "__time", "__url"]).drop("__title", "__time", "__url", "__w")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key with their number of events."""
    e = events.withColumn("__t", F.col(at).cast("timestamp")).withWatermark("__t", late)
    s = e.groupBy(key, F.session_window("__t", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
