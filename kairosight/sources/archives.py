"""Archived snapshots of a page or feed, thinned to a cadence, as a batch and as a stream.

A snapshot is kept if it is at least so many days after the last one kept.  The stream's offset holds the last snapshot
listed and the last one kept, so a restart goes on where the chain ended: nothing kept is read again and none is left out.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .connectors import attempt

STAMP = "%Y%m%d%H%M%S"


class Snapshot(InputPartition):
    def __init__(self, stamp: str, url: str):
        self.stamp, self.url = stamp, url


def thinned(stamps: list[str], days: float, kept: str = "") -> list[str]:
    """Of sorted stamps those that follow the last kept one, and each other, by so many days."""
    gap, out = timedelta(days=days), []
    last = datetime.strptime(kept, STAMP) if kept else None
    for s in stamps:
        at = datetime.strptime(s, STAMP)
        if last is None or at - last >= gap:
            last = at
            out.append(s)
    return out


class _Archive:
    """The listing and the bodies, through the transport."""

    def __init__(self, options):
        self.o = options
        self.days = float(options.get("days", "7"))

    def _ask(self, url: str, parameters: dict):
        module, name = self.o["transport"].rsplit(".", 1)
        fetch = getattr(importlib.import_module(module), name)
        return attempt(lambda: fetch(url, parameters), int(self.o.get("retries", "3")), float(self.o.get("delay", "1")))

    def listed(self, after: str, until: str = "") -> dict[str, str]:
        """Address by stamp, in order, of snapshots after one stamp and up to another ('' is no bound), inside [from, to)."""
        low, high = self.o.get("from", ""), self.o.get("to", "") or "9"
        rows = self._ask(self.o["url"], {"target": self.o.get("target", ""), "after": after, "until": until})
        found = {r["timestamp"]: r["url"] for r in rows}
        return {s: found[s] for s in sorted(found) if low <= s < high and s > after and (not until or s <= until)}

    def parts(self, after: str, until: str, kept: str) -> list[Snapshot]:
        found = self.listed(after, until)
        return [Snapshot(s, found[s]) for s in thinned(list(found), self.days, kept)]

    def body(self, partition: Snapshot | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        yield self.o.get("target", ""), partition.stamp, partition.url, self._ask(partition.url, {})


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.archive = _Archive(options)

    def partitions(self):
        return self.archive.parts("", "", "")

    def read(self, partition):
        return self.archive.body(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.archive = _Archive(options)
        self.at = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"until": "", "kept": ""}

    def latestOffset(self) -> dict:
        """After a restart the chain is followed from the first snapshot again: an archive only grows at its end, so it is the same."""
        found = list(self.archive.listed(self.at["until"]))
        kept = thinned(found, self.archive.days, self.at["kept"])
        self.at = {"until": found[-1] if found else self.at["until"], "kept": kept[-1] if kept else self.at["kept"]}
        return self.at

    def partitions(self, start: dict, end: dict):
        return self.archive.parts(start["until"], end["until"], start["kept"]) if end["until"] > start["until"] else []

    def read(self, partition):
        return self.archive.body(partition)


class ArchiveSnapshots(DataSource):
    """Rows: target, stamp (yyyyMMddHHmmss), url, body: one partition a kept snapshot.

    Options: transport (import path of a function of an address and parameters: for `url` it lists snapshots of `target` as
    objects with timestamp and url, for a snapshot it gives the body), days between snapshots (7), from and to (stamps or
    beginnings of them), retries, delay.  As a stream, a snapshot that the archive lists only after a later one is not read.
    """

    @classmethod
    def name(cls):
        return "archive_snapshots"

    def schema(self):
        return "target string, stamp string, url string, body string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)
