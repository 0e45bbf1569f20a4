"""Queries over given weights, streams with state, workbooks and month plans."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bank, networks, windows
from ..operators.residual import calendar_keys
from ..sources import connectors, stored, testing, workbooks
from ..sources.shipping import ship
from ..streaming import stateful
from . import fixtures as X
from .bank_queries import _EMA, ALPHA, GRID, THETA, R, T
from .registry import query, table
from .text_queries import _IDENT, articles

WIDTH, HEADS, UP = 16, 4, 32
LONG = networks.Patching(length=16, stride=8, heads=HEADS, layers=2)
SHORT = networks.Patching(length=8, stride=4, heads=HEADS, layers=1, hidden="relu")


def _layer(out: int, given: int, name: str) -> dict[str, list[int]]:
    return {f"{name}.weight": [out, given], f"{name}.bias": [out]}


def _block(name: str) -> dict[str, list[int]]:
    sizes = _layer(3 * WIDTH, WIDTH, f"{name}.qkv") | _layer(WIDTH, WIDTH, f"{name}.out") | _layer(UP, WIDTH, f"{name}.up") | _layer(WIDTH, UP, f"{name}.down")
    return sizes | {f"{name}.{n}.{x}": [WIDTH] for n in ("norm1", "norm2") for x in ("weight", "bias")}


def _given(spark: SparkSession, sizes: dict[str, list[int]]) -> networks.Weights:
    """A weights table of these sizes, filled by a rule, and read as a trained one would be."""
    rows = spark.createDataFrame([(n, s, math.prod(s), i) for i, (n, s) in enumerate(sizes.items())], "name string, shape array<int>, size int, seed int")
    value = lambda i: 0.4 * F.sin(i * 12.9898 + F.col("seed") * 78.233)
    return networks.weights(rows.select("name", "shape", F.transform(F.sequence(F.lit(1), F.col("size")), value).alias("values")))


def _history(spark: SparkSession, d: str) -> DataFrame:
    s = X.samples(spark, d)
    return s.select("series_id", F.col("start").cast("bigint").alias("start"), F.transform("history", lambda x: (x - 50) / 25).alias("history"), "history_times", F.col("target_times")[0].alias("at"))


def _steps(found: DataFrame, forecast: str) -> DataFrame:
    return found.select("series_id", "start", F.posexplode(forecast).alias("step", "forecast")).select("series_id", "start", (F.col("step") + 1).cast("bigint").alias("step"), R("forecast").alias("forecast"))


@query("ma9_patch_forecast")
def ma9_patch(spark, d):
    """Forecasts of every sample by a patch transformer of two blocks."""
    count = (X.HISTORY - LONG.length) // LONG.stride + 1
    w = _given(spark, _layer(WIDTH, LONG.length, "embed") | {"position": [count, WIDTH]} | _block("block.0") | _block("block.1") | _layer(X.HORIZON, count * WIDTH, "head"))
    model = lambda h, given: {"forecast": networks.patch_forecast(h, given, LONG)[0]}
    return _steps(networks.scored(_history(spark, d), ["series_id", "start"], {"history": F.col("history")}, "forecast array<double>", model, w), "forecast")


_PERCEPTRON = _layer(WIDTH, X.HISTORY, "first") | _layer(WIDTH, WIDTH, "second") | _layer(X.HORIZON, WIDTH, "head")


@query("ma9_perceptron_forecast")
def ma9_perceptron(spark, d):
    model = lambda h, given: {"forecast": networks.perceptron_forecast(h, given)[0]}
    return _steps(networks.scored(_history(spark, d), ["series_id", "start"], {"history": F.col("history")}, "forecast array<double>", model, _given(spark, _PERCEPTRON)), "forecast")


@query("ma10_residual_forecast")
def ma10(spark, d):
    """The residual model over the perceptron: encoder, three heads and regime projector, then MA11 and MA12 on what they say."""
    count = (X.HISTORY - SHORT.length) // SHORT.stride + 1
    flat, regime = (count + 1) * WIDTH, len(bank.COMPONENTS)
    sizes = _layer(WIDTH, SHORT.length, "patch") | _layer(WIDTH, SHORT.length, "residual_patch") | {"weekday": [7, WIDTH], "half_hour": [48, WIDTH], "holiday": [2, WIDTH]} | _layer(WIDTH, WIDTH, "base")
    sizes |= _block("encoder.0") | {"encoded.weight": [WIDTH], "encoded.bias": [WIDTH]} | _layer(WIDTH, regime, "regime.in") | _layer(WIDTH, WIDTH, "regime.out") | {f"regime.{n}.{x}": [WIDTH] for n in ("norm1", "norm2") for x in ("weight", "bias")}
    for name, given, out in [("slow", WIDTH, 1), ("ts_trust", WIDTH, 1), ("trust", WIDTH, 1), ("gain", WIDTH, 1), ("bias", WIDTH, 1), *((n, flat, X.HORIZON) for n in ("shape", "spike", "gate"))]:
        sizes |= _layer(WIDTH, given, f"{name}.in") | _layer(out, WIDTH, f"{name}.out")
    news = X.news(spark, d)
    regimes = bank.weighted_means(news, GRID, X.TAU, {c: F.col(c) for c in bank.COMPONENTS}).join(X.mass(spark, d), "t")
    s = bank.lookup(_history(spark, d), regimes, GRID, "at", ["mass", *bank.COMPONENTS])
    ends = lambda f: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), f)
    key = lambda n: ends(lambda p: calendar_keys(F.element_at("history_times", p * SHORT.stride + SHORT.length))[n])
    inputs = {
        "history": F.col("history"), "residual": windows.residual_history(F.col("history"), 25), "calendar": F.transform(F.arrays_zip(key("dow").alias("a"), key("hod").alias("b")), lambda x: F.array(x["a"], x["b"])),
        "regime": F.array(*bank.COMPONENTS), "active": (F.col("mass") > THETA).cast("double"),
    }

    def model(history, residual, calendar, given, active, w):
        base, hidden = networks.perceptron_forecast(history, w["base_model"])
        return {"base": base} | networks.residual_parts(history, residual, calendar, hidden, given, active, w, SHORT)

    outputs = "base array<double>, slow double, shape array<double>, spike array<double>, gate array<double>, ts_logit double, trust double, gain_raw double, bias_raw double"
    parts = networks.scored(s, ["series_id", "start", "mass"], inputs, outputs, model, _given(spark, sizes) | {"base_model": _given(spark, _PERCEPTRON)})
    return _steps(networks.assembled(parts, "base", "mass", threshold=THETA), "forecast")


def _run(stream, path: str, mode: str) -> None:
    q = stream.writeStream.foreachBatch(stateful.into(path)).outputMode(mode).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start()
    q.awaitTermination()


@query("stream_wn4_smoothing", f"{_EMA} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS t, round(mass, 6) AS mass, round(ema, 6) AS ema FROM e")
def stream_wn4(spark, d):
    """WN4 over a stream of the bank's times; a last point far behind them lets the watermark pass all others."""
    points = X.mass(spark, d).select(F.lit("bank").alias("key"), F.col("t").cast("timestamp").alias("t"), F.col("mass").alias("x"))
    end = spark.createDataFrame([("bank", X.END, 0.0)], "key string, t string, x double").withColumn("t", F.col("t").cast("timestamp") + F.expr("interval 60 days"))
    source, sink = stored.place(spark, "points"), stored.place(spark, "smoothed")
    points.unionByName(end).write.parquet(source)
    _run(stateful.smoothed(spark.readStream.schema(points.schema).parquet(source), ALPHA, "key", "t", "x", "1 hour"), sink, "append")
    found = spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").where(F.col("t") <= F.lit(X.END).cast("timestamp"))
    return found.select(T("t").alias("t"), R("x").alias("mass"), R("smooth").alias("ema"))


@query("stream_ops12_longest", f"WITH {_IDENT} SELECT pos, title, url FROM idn QUALIFY row_number() OVER (PARTITION BY kt, kd, ku ORDER BY len DESC, sc DESC, pos) = 1")
def stream_ops12(spark, d):
    """OPS12 over a stream of articles: the longest of each identity, by all updates."""
    given = articles(spark, d).select("pos", "title", "date", "url", "content")
    source, sink = stored.place(spark, "articles"), stored.place(spark, "longest")
    given.write.parquet(source)
    _run(stateful.longest(spark.readStream.schema(given.schema).parquet(source), "pos"), sink, "update")
    return stateful.current(spark, sink, given.schema).select("pos", "title", "url")


@query("src8_workbook_sheets", """SELECT doc_id, 'w' || doc_id // 40 AS path, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'other & more' END AS sheet, lang, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n_chars,
strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT % 9999), '%Y-%m-%d %H:%M:%S') AS at FROM documents""")
def src8(spark, d):
    """Every 40 documents are a workbook of two sheets; all cells come back."""
    ship(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.expr("doc_id div 40").alias("book"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        tables: dict[str, list[list]] = {"first": [[" doc_id", "lang", "at", "n_chars", None]], "other & more": [["doc_id", "lang ", "at", "n_chars"]], "empty": []}
        for i, lang, n in zip(pdf["doc_id"].tolist(), pdf["lang"], pdf["n_chars"].tolist(), strict=True):
            at = testing.datetime(2024, 1, 1) + testing.timedelta(minutes=i % 9999)
            tables["first" if i % 3 == 0 else "other & more"] += [[i, lang, at, n if i % 5 else None], []]
        return pd.DataFrame([(f"w{pdf['book'].iloc[0]}", testing.workbook(tables))], columns=["path", "content"])

    files = docs.groupBy("book").applyInPandas(bound, "path string, content binary")  # 40 rows a group
    f = lambda k: F.col("fields")[k]
    return workbooks.records(workbooks.cells(files)).select(f("doc_id").cast("bigint").alias("doc_id"), "path", "sheet", f("lang").alias("lang"), f("n_chars").cast("bigint").alias("n_chars"), f("at").alias("at"))


@query("src11_month_plan", """WITH m AS (SELECT DISTINCT month(ts) AS month FROM events), k AS (SELECT DISTINCT event_type AS key FROM events), t AS (SELECT unnest(range(1, 13)) AS month)
SELECT t.month::INT AS month, key, 1 AS asked FROM t, k WHERE t.month >= (SELECT min(month) FROM m) AND t.month <= (SELECT max(month) FROM m) + 2""")
def src11(spark, d):
    """Each month from the first event on, two more than there are events, for each event type: asked for once."""
    ship(spark)
    spark.dataSource.register(connectors.MonthlyService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    e = table(spark, d, "events")
    keys = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a few types
    low, high = e.agg(F.min(F.month("ts")), F.max(F.month("ts"))).first()
    o = {"transport": "kairosight.sources.testing.monthly", "url": "none", "start": "2023-06-01", "end": "2025-02-01", "keys": ",".join(keys), "chunk": "2"}
    rows = spark.read.format("monthly_service").options(**o).load().where((F.col("year") == 2024) & (F.col("month") >= low) & (F.col("month") <= min(12, high + 2)))
    return rows.groupBy("month", F.get_json_object("row", "$.key").alias("key")).agg(F.count(F.lit(1)).alias("asked"))
