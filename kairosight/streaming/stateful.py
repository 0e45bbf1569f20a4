"""Streams that keep state of their own: smoothing in event time, and articles of which the longest stays.

Both run on transformWithState, whose state lives in RocksDB beside the executors and in the checkpoint, so a restart or a
lost executor goes on where the last committed batch ended.  `use_rocksdb` sets the provider that it needs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions import text
from ..operators import news

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = pd.Timestamp("1970-01-01")


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store; processors are sent as code, since Spark also starts them beside the driver, without its files."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _micros(t: pd.Series) -> pd.Series:
    plain = t.dt.tz_convert("UTC").dt.tz_localize(None) if t.dt.tz is not None else t
    return (plain - _EPOCH) // pd.Timedelta(microseconds=1)


class Smoothing(StatefulProcessor):
    """Points wait until the watermark has passed their time; then they are folded in time order, one by one.

    State of a key: the waiting points by time, and the last smoothed value.  A timer is set for the time of each waiting
    point, so nothing is folded before all points that may still come before it have come.
    """

    def __init__(self, alpha: float):
        self.alpha = float(max(0.0, min(1.0, alpha)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t bigint", "x double")
        self.last = handle.getValueState("last", "e double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for t, x in zip(_micros(part["t"]), part["x"], strict=True):
                if pd.isna(t):
                    continue
                self.waiting.updateValue((int(t),), (float(x),))
                self.handle.registerTimer(-(-int(t) // 1000))  # the first millisecond at or after the point
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted((t, x) for (t,), (x,) in self.waiting.iterator() if t <= until)
        e, out = (self.last.get()[0] if self.last.exists() else None), []
        for t, x in due:
            e = x if e is None else self.alpha * x + (1 - self.alpha) * e
            out.append((key[0], _EPOCH + pd.Timedelta(microseconds=t), x, e))
            self.waiting.removeKey((t,))
        if out:
            self.last.update((e,))
            yield pd.DataFrame(out, columns=["key", "t", "x", "smooth"])

    def close(self) -> None:
        pass


def smoothed(points: DataFrame, alpha: float, key: str, at: str, value: str, late: str = "1 day") -> DataFrame:
    """key, t, x, smooth of a stream of points, each once the watermark (as late as `late`) has passed it.

    The same rows as bank.ema gives for the points that came in time; of several points of a key and time the last that
    came counts, and points that come after their time was folded are dropped by the watermark.
    """
    use_rocksdb(points.sparkSession)
    rows = points.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("t"), F.col(value).cast("double").alias("x")).withWatermark("t", late)
    return rows.groupBy("key").transformWithStateInPandas(Smoothing(alpha), "key string, t timestamp, x double, smooth double", "Append", "EventTime")


RANK = ("length", "score", "arrival")


class Longest(StatefulProcessor):
    """The best article of an identity: the longest content, then the better address, then the earliest arrival number.

    State of an identity: the best rank so far and how many rows came.  A batch emits the identity again if its best changed or
    its number did; rows that lost, of identities without a title or a time, are emitted as well (`stays` 0), because as long as no
    full identity repeats they are kept.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "length bigint, score bigint, arrival bigint, n bigint")
        self.row = handle.getValueState("row", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, n = None, 0
        if self.best.exists():
            length, score, arrival, n = self.best.get()
            best = (length, score, -arrival, self.row.get()[0])
        full = key[0] != "" and key[1] != ""
        lost = []
        for part in rows:
            for length, score, arrival, payload in zip(part["length"], part["score"], part["arrival"], part["payload"], strict=True):
                new = (int(length), int(score), -int(arrival), payload)
                n += 1
                if best is not None and new[:3] == best[:3]:
                    n -= 1  # the same row again, after a restart of its source
                    continue
                worse = new if best is not None and new[:3] < best[:3] else best
                best = new if worse is not new else best
                if worse is not None and not full:
                    lost.append(worse)
        length, score, arrival, payload = best
        self.best.update((length, score, -arrival, n))
        self.row.update((payload,))
        out = [(*key, 1, n, length, score, -arrival, payload), *((*key, 0, 1, a, b, -c, d) for a, b, c, d in lost)]
        yield pd.DataFrame(out, columns=["title_key", "time_key", "url_key", "stays", "n", "length", "score", "arrival", "payload"])

    def close(self) -> None:
        pass


def longest(articles: DataFrame, arrival: str, date: str = "date", title: str = "title", url: str = "url", content: str = "content") -> DataFrame:
    """Updates of a stream of articles: the identity, the number of rows seen and the best one as JSON (`payload`).

    arrival: a number of each row that is the same whenever it is read again.  A newer update of an identity replaces the older.
    """
    use_rocksdb(articles.sparkSession)
    own = news.identity(F.col(date), F.col(title), F.col(url))
    keyed = articles.select(
        *(c.alias(n) for n, c in zip(("title_key", "time_key", "url_key"), own.values(), strict=True)), F.length(text.or_empty(F.col(content))).cast("bigint").alias("length"),
        text.canonical_score(F.col(url)).cast("bigint").alias("score"), F.col(arrival).cast("bigint").alias("arrival"), F.to_json(F.struct(*articles.columns)).alias("payload"),
    )
    schema = "title_key string, time_key string, url_key string, stays int, n bigint, length bigint, score bigint, arrival bigint, payload string"
    return keyed.groupBy("title_key", "time_key", "url_key").transformWithStateInPandas(Longest(articles.columns), schema, "Update", "None")


def into(path: str):
    """A foreachBatch sink of updates: each batch overwrites its own folder, so a batch that is run again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The articles that stay by all batches of the sink: the latest update of each identity; and, as long as no identity with a
    title and a time came twice, also the rows that lost, as news.deduplicated keeps them."""
    updates = spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")
    latest = Window.partitionBy("title_key", "time_key", "url_key").orderBy(F.desc("batch"))
    winners = updates.where("stays = 1").withColumn("place", F.row_number().over(latest)).where("place = 1")
    twice = winners.agg(F.coalesce(F.max(F.when((F.col("title_key") != "") & (F.col("time_key") != ""), F.col("n"))) > 1, F.lit(False)).alias("twice"))
    every = winners.drop("place").unionByName(updates.where("stays = 0").dropDuplicates(["title_key", "time_key", "url_key", "arrival"]))
    kept = every.crossJoin(F.broadcast(twice)).where("stays = 1 or not twice")  # one row
    return kept.select(F.from_json("payload", schema).alias("row")).select("row.*")
