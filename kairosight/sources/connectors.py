"""Paged web services as Python data sources: one partition a window, planned without a network.

The transport is a function (url, parameters) -> decoded JSON given by its import path, so that a cluster can
inject sessions, proxies and credentials, and tests a table of replies.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Rows at which a window's reply is taken as cut off.
SATURATED = 250


class Window(InputPartition):
    def __init__(self, start: str, end: str, chunk: str = ""):
        self.start, self.end, self.chunk = start, end, chunk


def windows(start: str, end: str, days: int, chunks: list[str] | None = None) -> list[Window]:
    """[start, end) in slices of so many days, for each chunk of keys."""
    at, last, out = datetime.fromisoformat(start), datetime.fromisoformat(end), []
    while at < last:
        to = min(at + timedelta(days=days), last)
        out += [Window(at.isoformat(), to.isoformat(), c) for c in chunks or [""]]
        at = to
    return out


def chunked(keys: list[str], size: int) -> list[str]:
    return [",".join(keys[i : i + size]) for i in range(0, len(keys), size)]


def attempt(call, retries: int, delay: float):
    """Call until it succeeds, waiting twice as long each time; the last error is raised."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if n == retries:
                raise
            time.sleep(delay * 2**n)


class SoftLimit(OSError):
    """A reply that is a notice, such as a request to try again, instead of rows."""


def rows_of(reply) -> list[dict]:
    """The rows of a decoded reply: a list, or an object with the list as its articles; a notice is an error."""
    if isinstance(reply, dict):
        reply = reply.get("articles")
    if not isinstance(reply, list):
        raise SoftLimit(str(reply)[:160])
    return reply


def halves(window: Window, least: timedelta) -> list[Window]:
    """The window cut in two at a whole second, or nothing if a half would be shorter than `least`."""
    start, end = datetime.fromisoformat(window.start), datetime.fromisoformat(window.end)
    middle = (start + (end - start) / 2).replace(microsecond=0)
    if min(middle - start, end - middle) < max(least, timedelta(seconds=1)):
        return []
    return [Window(start.isoformat(), middle.isoformat(), window.chunk), Window(middle.isoformat(), end.isoformat(), window.chunk)]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = options

    def partitions(self):
        keys = [k for k in self.o.get("keys", "").split(",") if k]
        return windows(self.o["start"], self.o["end"], int(self.o.get("days", "7")), chunked(keys, int(self.o.get("chunk", "25"))) or None)

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        module, name = self.o["transport"].rsplit(".", 1)
        fetch = getattr(importlib.import_module(module), name)
        limit, least = int(self.o.get("limit", str(SATURATED))), self.o.get("least_minutes", "1")
        waiting = [partition]
        while waiting:
            w = waiting.pop()
            parameters = {"start": w.start, "end": w.end, "keys": w.chunk, "query": self.o.get("query", "")}
            rows = attempt(lambda p=parameters: rows_of(fetch(self.o["url"], p)), int(self.o.get("retries", "3")), float(self.o.get("delay", "1")))
            full = len(rows) >= limit
            parts = halves(w, timedelta(minutes=float(least))) if full and float(least) > 0 else []
            waiting += reversed(parts)
            for r in [] if parts else rows:
                yield w.start, w.end, w.chunk, full, json.dumps(r)


class WindowedService(DataSource):
    """Rows: window_start, window_end, keys, saturated, row (JSON text).

    A window whose reply is cut off is asked for again in halves, down to halves of least_minutes (1 by default); at that
    length, and with least_minutes 0, its rows are marked as saturated.
    """

    @classmethod
    def name(cls):
        return "windowed_service"

    def schema(self):
        return "window_start string, window_end string, keys string, saturated boolean, row string"

    def reader(self, schema):
        return _Reader(self.options)


_HOLDS = {
    EqualTo: lambda have, v: have == v, In: lambda have, v: have in v, GreaterThan: lambda have, v: have > v, GreaterThanOrEqual: lambda have, v: have >= v,
    LessThan: lambda have, v: have < v, LessThanOrEqual: lambda have, v: have <= v,
}


class Month(InputPartition):
    def __init__(self, year: int, month: int, keys: str):
        self.year, self.month, self.keys = year, month, keys


def months(start: str, end: str) -> list[tuple[int, int]]:
    """Year and month of the calendar months that [start, end) meets."""
    a, b = datetime.fromisoformat(start), datetime.fromisoformat(end)
    first, last = a.year * 12 + a.month - 1, b.year * 12 + b.month - 1
    if b == datetime(b.year, b.month, 1):
        last -= 1
    return [(n // 12, n % 12 + 1) for n in range(first, last + 1)] if a < b else []


class _MonthReader(DataSourceReader):
    """Filters on year and month choose the partitions; Spark applies them again, so they are given back."""

    def __init__(self, options):
        self.o, self.filters = options, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _HOLDS and f.attribute in (("year",), ("month",)):
                self.filters.append((f.attribute[0], type(f), f.value))
            yield f

    def partitions(self):
        keys = [k for k in self.o.get("keys", "").split(",") if k]
        wanted = lambda y, m: all(_HOLDS[kind]({"year": y, "month": m}[c], v) for c, kind, v in self.filters)
        return [Month(y, m, c) for y, m in months(self.o["start"], self.o["end"]) if wanted(y, m) for c in chunked(keys, int(self.o.get("chunk", "25"))) or [""]]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        module, name = self.o["transport"].rsplit(".", 1)
        fetch = getattr(importlib.import_module(module), name)
        y, m = partition.year, partition.month
        start, end = datetime(y, m, 1), datetime(y + m // 12, m % 12 + 1, 1)
        start, end = max(start, datetime.fromisoformat(self.o["start"])), min(end, datetime.fromisoformat(self.o["end"]))
        parameters = {"start": start.isoformat(), "end": end.isoformat(), "keys": partition.keys, "query": self.o.get("query", "")}
        for r in attempt(lambda: rows_of(fetch(self.o["url"], parameters)), int(self.o.get("retries", "3")), float(self.o.get("delay", "1"))):
            yield y, m, partition.keys, json.dumps(r)


class MonthlyService(DataSource):
    """Rows: year, month, keys, row (JSON text): one partition for each calendar month of [start, end) and chunk of keys.

    Filters on year and month leave out the months that they rule out; spark.sql.python.filterPushdown.enabled must be true.
    """

    @classmethod
    def name(cls):
        return "monthly_service"

    def schema(self):
        return "year int, month int, keys string, row string"

    def reader(self, schema):
        return _MonthReader(self.options)
