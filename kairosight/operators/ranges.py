"""Running sums in a global order, and weighted draws with replacement, without a sort in one task.

Rows are cut into ranges of the order, stored once so that no retry cuts them another way; sums run inside a range, and
what the ranges before it add up to is one row a range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored

#: Whole-number weights add up to about so much.
SCALE = 1 << 52
#: A row with this share of all weight or more is drawn by itself; there are at most so many of them.
HEAVY = 512
#: Parts of the light rows, whatever their number: draws fall into them by weight.
PARTS = 256


def free(name: str, *frames: DataFrame) -> str:
    """The name with as many _ behind it as make it no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(df: DataFrame, by: list[str], order: list[str], weight: Column, out: str) -> DataFrame:
    """df with out: the sum of weight over the rows before each row, in order, of its group."""
    part, own, ahead = (free(n, df) for n in ("part", "own", "ahead"))
    ranged = stored(df.withColumn(own, weight).repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(*by, part).agg(F.sum(own).alias(ahead))
    sums = sums.withColumn(ahead, before(ahead, Window.partitionBy(*by).orderBy(part)))  # a row a range and group
    keys = [*by, part]
    right = sums.select(*(F.col(k).alias(f"{k}_{ahead}") for k in keys), ahead)
    same = [ranged[k].eqNullSafe(right[f"{k}_{ahead}"]) for k in keys]
    inner = ranged.withColumn(out, before(own, Window.partitionBy(*by, part).orderBy(*order)))
    same = [inner[k].eqNullSafe(right[f"{k}_{ahead}"]) for k in keys]
    return inner.join(right, same).withColumn(out, F.col(out) + F.col(ahead)).select(*df.columns, out)


def uniform(key: Column, seed: int) -> Column:
    """A whole number below 2^52 from the digest of a seed and a key, the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def drawn(df: DataFrame, weight: str, key: str, n: int, seed: int) -> DataFrame:
    """n draws from the rows of df, with replacement and in proportion to weight: draw (from 0) and the columns of the row.

    Weights become whole numbers that add up to about 2^52, so cumulative sums are exact.  The axis of weight starts with
    the few heavy rows, whose draws are found without a shuffle; then come parts of the others, dealt by a digest of the
    key.  A draw falls into a part by an equi-join on buckets of the axis and meets its row in a window over that part, so a
    task holds one part and its draws.  Rows that weigh nothing, or whose weight is null, negative or NaN, are never drawn;
    without any other row there are no draws.  The key tells rows apart; draws repeat on any cluster.
    """
    units, start, kind, at, part, draw = (free(x, df) for x in ("units", "start", "kind", "at", "part", "draw"))
    w = F.col(weight).cast("double")
    usable = df.where((w > 0) & ~F.isnan(w))
    total = usable.agg(F.sum(w).alias("s")).first()["s"]
    if not total:
        return df.limit(0).select(F.lit(0).cast("bigint").alias(draw), *df.columns)
    whole = usable.withColumn(units, F.round(w / F.lit(float(total)) * SCALE).cast("bigint")).where(F.col(units) > 0)
    whole = whole.withColumn(part, F.when(F.col(units) >= SCALE // HEAVY, F.lit(-1)).otherwise(F.pmod(uniform(F.col(key), seed), F.lit(PARTS))).cast("int"))
    before = F.coalesce(F.sum(units).over(Window.partitionBy(part).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored(whole.withColumn(start, before), "weights")
    sums = {r[part]: r["s"] for r in placed.groupBy(part).agg(F.sum(units).alias("s")).collect()}  # a row a part, PARTS + 1 at most
    ends, axis = 0, []
    for p in sorted(sums):
        axis.append((p, ends, ends + sums[p]))
        ends += sums[p]
    spark = df.sparkSession
    # where each draw falls; what lies in a bucket of the axis are a few parts
    width = max(1, -(-ends // (4 * PARTS)))
    spans = spark.createDataFrame(axis, f"{part} int, low bigint, high bigint")
    spans = spans.select("*", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("bucket"))
    point = F.floor(uniform(F.col("id"), seed) * F.lit(ends / SCALE)).cast("bigint")
    draws = spark.range(n).select(F.col("id").alias(draw), F.least(point, F.lit(ends - 1)).alias(at)).withColumn("bucket", F.expr(f"{at} div {width}"))
    fallen = draws.join(F.broadcast(spans), "bucket").where((F.col(at) >= F.col("low")) & (F.col(at) < F.col("high"))).select(draw, part, (F.col(at) - F.col("low")).alias(at))  # a few rows a part
    heavy = placed.where(F.col(part) == -1).withColumn("end", F.col(start) + F.col(units))
    of_heavy = fallen.where(F.col(part) == -1).drop(part).join(F.broadcast(heavy), (F.col(at) >= F.col(start)) & (F.col(at) < F.col("end")))  # HEAVY rows at most
    row = F.struct(*(F.col(c) for c in df.columns))
    light = placed.where(F.col(part) >= 0).select(part, F.col(start).alias(at), F.lit(0).alias(kind), F.lit(None).cast("bigint").alias(draw), row.alias("row"))
    both = light.unionByName(fallen.where(F.col(part) >= 0).withColumn(kind, F.lit(1)), allowMissingColumns=True)
    met = F.last("row", ignorenulls=True).over(Window.partitionBy(part).orderBy(at, kind).rowsBetween(Window.unboundedPreceding, 0))
    of_light = both.withColumn("row", met).where(F.col(kind) == 1).select(draw, "row.*")
    return of_heavy.select(draw, *df.columns).unionByName(of_light)
