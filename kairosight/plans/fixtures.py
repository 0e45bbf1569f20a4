"""Series, articles and windows derived from the driver's tables, in Spark and as SQL prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank, windows
from .registry import table

HISTORY, HORIZON, STRIDE = 24, 6, 6


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean of events by type: series_id, ts, value."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


SERIES = "series AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("int")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated records from signup events: doc_id, published_at, horizon_days, confidence, five regime components, topics."""
    k = F.col("k")
    events = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("k", k_of())
    return events.select(
        F.col("event_id").alias("doc_id"), F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("published_at"), (k % 15).alias("horizon_days"), (k / 100.0).alias("confidence"),
        (k / 50.0 - 1).alias("tightness"), (1 - k / 50.0).alias("demand_outlook"), (((k * 7) % 100) / 50.0 - 1).alias("renewable_surplus"), (((k * 3) % 100) / 100.0).alias("volatility_tone"), (k % 2).cast("double").alias("policy_in_effect"),
        F.array(F.element_at(F.array(*map(F.lit, bank.TOPICS)), k % 15 + 1), F.element_at(F.array(*map(F.lit, bank.TOPICS)), (k * 7) % 15 + 1)).alias("topics"),
    )


_TOPICS = "[" + ", ".join(f"'{t}'" for t in bank.TOPICS) + "]"
NEWS = f"""news AS (SELECT event_id AS doc_id, date_trunc('second', ts) AS published_at, k % 15 AS horizon_days, k / 100.0 AS confidence,
  k / 50.0 - 1 AS tightness, 1 - k / 50.0 AS demand_outlook, ((k * 7) % 100) / 50.0 - 1 AS renewable_surplus, ((k * 3) % 100) / 100.0 AS volatility_tone,
  (k % 2)::DOUBLE AS policy_in_effect, [{_TOPICS}[k % 15 + 1], {_TOPICS}[(k * 7) % 15 + 1]] AS topics
  FROM (SELECT *, (props->>'k')::INT AS k FROM events WHERE event_type = 'signup'))"""
START, END = "2024-01-01 00:00:00", "2024-01-30 23:00:00"
GRID = f"grid AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 HOUR)) AS t)"
TAU = 5.0
FORCE = f"""{NEWS}, {GRID}, force AS (SELECT g.t, n.*, confidence * exp(-(epoch(g.t) - epoch(published_at)) / 86400.0 / {TAU}) AS w
  FROM grid g JOIN news n ON n.published_at <= g.t AND g.t <= n.published_at + to_days(n.horizon_days) WHERE horizon_days > 0 AND confidence > 0)"""
MASS = f"""{FORCE}, mass AS (SELECT g.t, coalesce(sum(w), 0) AS mass, count(w) AS docs FROM grid g LEFT JOIN force f ON g.t = f.t GROUP BY 1)"""


def mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly decayed relevance mass and document count: t, mass, docs."""
    return bank.mass(news(spark, sf_dir), bank.Grid(START, END, 60), TAU)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of the series: series_id, start, history, target, history_times, target_times."""
    return windows.sliding(series(spark, sf_dir), HISTORY, HORIZON, STRIDE)


NUMBERED = f"{SERIES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM series)"
#: One row a target step, with the last history value as the forecast.
STEPS = f"""{NUMBERED}, starts AS (SELECT series_id, i AS start, value AS v0 FROM numbered WHERE i % {STRIDE} = 0 AND i <= n - {HISTORY + HORIZON}),
steps AS (SELECT s.series_id, s.start, t.i - s.start - {HISTORY} + 1 AS step, t.ts, t.value AS y, h.value AS base, t.value - h.value AS r
  FROM starts s JOIN numbered t ON t.series_id = s.series_id AND t.i BETWEEN s.start + {HISTORY} AND s.start + {HISTORY + HORIZON - 1}
  JOIN numbered h ON h.series_id = s.series_id AND h.i = s.start + {HISTORY - 1})"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a target step: series_id, start, step (from 1), ts, y, base (the last history value), r (y - base)."""
    s = samples(spark, sf_dir).withColumn("base", F.element_at("history", -1))
    x = s.select("series_id", "start", "base", F.posexplode(F.arrays_zip("target", "target_times")).alias("pos", "x"))
    return x.select("series_id", "start", (F.col("pos") + 1).alias("step"), F.col("x.target_times").alias("ts"), F.col("x.target").alias("y"), "base", (F.col("x.target") - F.col("base")).alias("r"))
