"""Reading linked pages from seeds, round by round: a breadth-first frontier kept in tables.

Each round is one table of addresses and one of replies in the shared folder, so a lost executor repeats part of a round
only, and the driver learns no more than whether a round is empty.  What was asked before is an anti-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .shipping import ship
from .stored import place

Fetch = Callable[[DataFrame], DataFrame]


def asking(transport: Callable[[str], dict | None], schema: str, spread: int = 4) -> Fetch:
    """A fetch that asks a transport for each address; schema is that of url and what the transport tells.

    Addresses of a host are dealt to `spread` tasks, so that a host which holds most of them is no single task.  None is no reply.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = ((u, transport(u)) for u in batch["url"])
            rows = [{"url": u, **r} for u, r in replies if r is not None]
            if rows:
                yield pd.DataFrame(rows)

    def fetch(asked: DataFrame) -> DataFrame:
        ship(asked.sparkSession)
        salt = F.pmod(F.xxhash64("url"), F.lit(spread))
        return asked.select("url").repartition(text.domain(F.col("url")), salt).mapInPandas(ask, schema)

    return fetch


def crawl(seeds: DataFrame, fetch: Fetch, links: Column, allowed: Column | None = None, follow: Column | None = None, rounds: int | None = None) -> DataFrame:
    """url, depth, answered and the columns of the replies, for every address that can be reached from the seeds.

    seeds has url.  fetch takes a table of url and gives at most one reply for each: url and columns of its own.  links is
    an array of addresses over a reply; allowed, over url, says which addresses are asked for at all; follow, over a reply,
    whether its links are taken: a stop rule of dated listings, for example (null: no).  Addresses are compared in canonical
    form, each is asked for once, at its least depth; null and empty ones count for nothing.  rounds bounds the depth if given.
    An address without a reply stays, with answered false.
    """
    spark = seeds.sparkSession
    base = place(spark, "crawl")
    asked_at, replies_at = f"{base}/asked", f"{base}/replies"
    permitted = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    taken = F.lit(True) if follow is None else F.coalesce(follow, F.lit(False))

    def asked() -> DataFrame:
        return spark.read.schema("url string, depth int").parquet(asked_at)

    def clean(urls: DataFrame) -> DataFrame:
        return urls.select(text.canonical_url(F.col("url")).alias("url")).where((F.col("url") != "") & permitted).distinct()

    clean(seeds).write.parquet(f"{asked_at}/depth=0")
    depth, schema = 0, None
    while True:
        ahead = spark.read.schema("url string").parquet(f"{asked_at}/depth={depth}")
        replies = fetch(ahead)
        schema = replies.schema
        replies.write.parquet(f"{replies_at}/depth={depth}")
        depth += 1
        if rounds is not None and depth >= rounds:
            break
        last = spark.read.schema(schema).parquet(f"{replies_at}/depth={depth - 1}")
        found = clean(last.where(taken).select(F.explode(links).alias("url")))
        found.join(asked(), "url", "left_anti").write.parquet(f"{asked_at}/depth={depth}")
        if spark.read.schema("url string").parquet(f"{asked_at}/depth={depth}").isEmpty():
            break
    told = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(replies_at).withColumn("answered", F.lit(True))
    rest = [c for c in told.columns if c not in ("url", "answered")]
    return asked().join(told, "url", "left").select("url", "depth", F.coalesce("answered", F.lit(False)).alias("answered"), *rest)
