"""Mutual information by nearest neighbours, and its permutation test, as joins on a grid.

The neighbours of a point in the greatest-coordinate distance are looked for in the cells around its own.  A point is done
when its k-th neighbour there is no farther than the outer edge of those cells can be; the others go on with cells twice as
wide.  Equal points are one row with a count, so ties make no pairs, and dense places are done while cells are small.  How
many values lie strictly within that distance in each coordinate is a difference of two running counts in a global order.
So no group is ever held by one task.

Coordinates are divided by their deviation and rounded to 2^-30: differences are then exact, and whether a neighbour lies on
the edge of a distance does not depend on rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored
from . import ranges

GRAIN = float(1 << 30)
#: Groups with fewer rows have no estimate.
FEWEST = 20


def _scaled(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """by, x, y in whole grains, and by, n, flat (whether a coordinate does not vary) of each group."""
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    whole = lambda c, s: F.round(F.col(c) / F.col(s) * GRAIN).cast("bigint").alias(c)
    good = sizes.where((F.col("n") >= FEWEST) & (F.col("sx") > 0) & (F.col("sy") > 0))
    return points.join(good, by).select(*by, whole("x", "sx"), whole("y", "sy")), sizes.select(*by, "n", ((F.col("sx") == 0) | (F.col("sy") == 0)).alias("flat"))


def distances(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, x, y, m (rows at that point) and d, the distance to the k-th nearest other row, of every distinct point of (by, x, y)."""
    distinct = stored(points.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("m")), "points")
    n = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("c"), (F.max("x") - F.min("x")).alias("wx"), (F.max("y") - F.min("y")).alias("wy"))
    # about four distinct points a cell if they were spread evenly; at most so wide that one cell holds all
    side = F.greatest(F.ceil(F.greatest("wx", "wy") / F.greatest(F.sqrt(F.col("c") / 4), F.lit(1.0))), F.lit(1)).cast("bigint")
    sides = n.select(*by, side.alias("side"), F.greatest("wx", "wy").alias("most"))
    open_ = distinct.join(sides, by).withColumn("side", F.greatest(F.floor(F.col("side") / 8), F.lit(1)).cast("bigint"))  # begin small, for dense places
    done, again = None, open_
    while True:
        at = lambda c: F.floor(F.col(c) / F.col("side"))
        near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        asks = again.withColumn("o", F.explode(near)).withColumn("cx", at("x") + F.col("o.i")).withColumn("cy", at("y") + F.col("o.j")).drop("o")
        widths = again.select(*by, "side").distinct()
        there = distinct.join(widths, by).select(*by, "side", at("x").alias("cx"), at("y").alias("cy"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("m").alias("m2"))
        d = F.greatest(F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2")))
        own = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
        pairs = asks.join(there, [*by, "side", "cx", "cy"]).select(*by, "x", "y", "m", "side", "most", d.alias("d"), (F.col("m2") - own.cast("bigint")).alias("m2"))
        steps = pairs.where("m2 > 0").groupBy(*by, "x", "y", "m", "side", "most", "d").agg(F.sum("m2").alias("m2"))
        so_far = F.sum("m2").over(Window.partitionBy(*by, "x", "y", "side").orderBy("d"))
        kth = steps.withColumn("s", so_far).where(F.col("s") >= k).groupBy(*by, "x", "y").agg(F.min("d").alias("d"))
        tried = stored(again.join(kth, [*by, "x", "y"], "left"), "tried")
        sure = (F.col("d") <= F.col("side")) | (F.col("side") > F.col("most"))
        found = tried.where(sure).select(*by, "x", "y", "m", "d")
        done = found if done is None else done.unionByName(found)
        again = tried.where(~F.coalesce(sure, F.lit(False))).drop("d").withColumn("side", F.col("side") * 2)
        if again.isEmpty():
            return done


def _within(done: DataFrame, by: list[str], c: str) -> DataFrame:
    """by, x, y, count: rows whose coordinate c differs by less than d, or by nothing where d is nothing."""
    reach = F.when(F.col("d") > 0, F.col("d") - 1).otherwise(0)  # coordinates are whole grains
    values = done.groupBy(*by, F.col(c).alias("v")).agg(F.sum("m").alias("w")).select(*by, "v", F.lit(1).alias("kind"), "w")
    nobody = F.lit(None).cast("bigint")
    values = values.select(*by, "v", "kind", "w", nobody.alias("x"), nobody.alias("y"))
    # an upper end comes after the values equal to it, a lower end before them; the lower one counts negatively
    edge = lambda v, kind: done.select(*by, v.alias("v"), F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("w"), "x", "y")
    axis = values.unionByName(edge(F.col(c) - reach, 0)).unionByName(edge(F.col(c) + reach, 2))
    counted = ranges.running(axis, by, ["v", "kind"], F.col("w"), "before").where("kind <> 1")
    return counted.groupBy(*by, "x", "y").agg(F.sum(F.when(F.col("kind") == 2, F.col("before")).otherwise(-F.col("before"))).alias(f"n_{c}"))


def mutual(points: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """by, n, mi: the estimate for each group of rows (by, x, y); NaN under 20 rows, 0 without variance, never negative."""
    scaled, sizes = _scaled(points, by)
    done = stored(distances(stored(scaled, "scaled"), by, k), "distances")
    each = done.join(_within(done, by, "x"), [*by, "x", "y"]).join(_within(done, by, "y"), [*by, "x", "y"])
    digamma = _digamma
    mean = F.sum(F.col("m") * (digamma(F.col("n_x")) + digamma(F.col("n_y")))) / F.sum("m")
    means = each.groupBy(*by).agg(mean.alias("mean"))
    own = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("mean")
    mi = F.when(F.col("n") < FEWEST, F.lit(float("nan"))).when(F.col("flat"), 0.0).otherwise(F.greatest(own, F.lit(0.0)))
    return sizes.join(means, by, "left").select(*by, "n", mi.alias("mi"))


def _digamma(n):
    """Of a whole number from 1: exact sums up to 16, then the asymptotic series, good to 1e-13."""
    n = n.cast("double")
    series = lambda x: F.ln(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0))) + 1 / (240 * F.pow(x, F.lit(8.0)))
    lower = sum((F.when(n + i < 16, 1 / (n + i)).otherwise(0.0) for i in range(15)), F.lit(0.0))
    return series(F.greatest(n, F.lit(16.0))) - lower


def tested(pairs: DataFrame, by: list[str], x: str, y: str, order: str, permutations: int = 200, seed: int = 7, k: int = 3) -> DataFrame:
    """by, n, mi, p_value of each group: how often the estimate of shuffled targets reaches the real one.

    A shuffle deals the i-th target in order to the row that is i-th by a digest of its place; places are running counts, so shuffles of a
    group are a join.  order: what tells the rows of a group apart.
    """
    one = F.lit(1)
    rows = pairs.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(order).alias("at")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    numbered = stored(ranges.running(rows, by, ["at"], one, "place"), "numbered")
    shuffles = numbered.withColumn("trial", F.explode(F.sequence(one, F.lit(permutations)))) if permutations else numbered.limit(0).withColumn("trial", F.lit(0))
    keyed = shuffles.withColumn("draw", ranges.uniform(F.concat_ws(":", "trial", "place"), seed))
    dealt = ranges.running(keyed, [*by, "trial"], ["draw", "place"], one, "target").select(*by, "trial", "x", "target")
    shuffled = dealt.join(numbered.select(*by, F.col("place").alias("target"), "y"), [*by, "target"]).select(*by, "trial", "x", "y")
    every = mutual(numbered.select(*by, F.lit(0).alias("trial"), "x", "y").unionByName(shuffled), [*by, "trial"], k)
    real, null = every.where("trial = 0").select(*by, "n", "mi"), every.where("trial > 0").select(*by, F.col("mi").alias("shuffled"))
    reached = null.join(real, by).groupBy(*by).agg(F.count_if(F.col("shuffled") >= F.col("mi")).alias("reached"))
    p = F.when(F.isnan("mi"), F.lit(float("nan"))).otherwise((F.coalesce("reached", F.lit(0)) + 1) / F.lit(permutations + 1.0))
    return real.join(reached, by, "left").select(*by, "n", "mi", p.alias("p_value"))
