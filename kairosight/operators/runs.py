"""Folders of trained runs: which one is meant, the matrix of jobs over them, and what their logs say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import free, running

Rule = tuple[str, str, str]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"))


def _above(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def chosen(files: DataFrame, roots: DataFrame, rules: list[Rule]) -> DataFrame:
    """root, role, status, path, candidates: the run folder that each root stands for, for each rule (role, prefix, required file).

    'given': the root itself has the prefix and holds the file; 'found': exactly one folder in it does; 'ambiguous': several
    do, and none is chosen; 'missing': none does.  files has path, roots has root; slashes at the end, repeated roots and
    null paths do not count.
    """
    rule = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("prefix"), F.lit(f).alias("required")) for r, p, f in rules)))
    folder = _above(F.col("path"))
    held = files.select(folder.alias("folder"), _name(F.col("path")).alias("file"), rule.alias("rule"))
    held = held.where((F.col("file") == F.col("rule.required")) & F.startswith(_name(F.col("folder")), F.col("rule.prefix"))).select("folder", "rule.role").distinct()
    spots = F.explode(F.array(F.struct(F.col("folder").alias("root"), F.lit(True).alias("own")), F.struct(_above(F.col("folder")).alias("root"), F.lit(False).alias("own"))))
    seen = held.select("folder", "role", spots.alias("spot")).groupBy("spot.root", "role")
    seen = seen.agg(F.bool_or("spot.own").alias("own"), F.count_if(~F.col("spot.own")).alias("n"), F.min(F.when(~F.col("spot.own"), F.col("folder"))).alias("one"))
    asked = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).where("root is not null").distinct()
    wanted = asked.select("root", rule.alias("rule")).select("root", "rule.role")
    x = wanted.join(seen, ["root", "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("own"), "given").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    path = F.when(F.col("own"), F.col("root")).when(F.col("n") == 1, F.col("one"))
    return x.select("root", "role", status.alias("status"), path.alias("path"), F.col("n").alias("candidates"))


def jobs(runs: DataFrame, run: str, dataset: Column, horizon: Column, datasets: list[str] | None = None, horizons: list[int] | None = None) -> DataFrame:
    """run, dataset, horizon, place (from 0, by dataset, horizon and run) of the runs whose name tells both, filtered where asked."""
    x = runs.select(F.col(run).alias("run"), F.nullif(dataset, F.lit("")).alias("dataset"), horizon.try_cast("int").alias("horizon"))
    x = x.where("dataset is not null and horizon is not null")
    if datasets is not None:
        x = x.where(F.col("dataset").isin(*datasets))
    if horizons is not None:
        x = x.where(F.col("horizon").isin(*horizons))
    return running(x, [], ["dataset", "horizon", "run"], F.lit(1).cast("bigint"), "place")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, value: the lines of all files below a folder; (block, at) is their order inside a file.

    Spark reads a file in blocks; their starts order them, and row numbers rise inside a block.
    """
    read = spark.read.option("recursiveFileLookup", "true").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def summaries(log: DataFrame, run: Column, tag: str, last: int) -> DataFrame:
    """run, nth, tag, metric, number: what the last so many lines with a tag say, latest first (nth from 1).

    tag is a regular expression whose first group is the tag; a metric is written name=number.  A line without metrics gives
    one row without them.  Only the last lines of a run leave a task.
    """
    newest = Window.partitionBy("run").orderBy(F.desc("file"), F.desc("block"), F.desc("at"))
    tagged = log.withColumn("run", run).where(F.rlike("value", F.lit(tag)))
    kept = tagged.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= last)
    pair = r"(\w+)=([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    told = F.arrays_zip(F.regexp_extract_all("value", F.lit(pair), 1).alias("metric"), F.regexp_extract_all("value", F.lit(pair), 2).alias("number"))
    told = kept.select("run", "nth", F.regexp_extract("value", tag, 1).alias("tag"), F.explode_outer(told).alias("x"))
    return told.select("run", "nth", "tag", F.col("x.metric").alias("metric"), F.col("x.number").try_cast("double").alias("number"))


def report(matrix: DataFrame, told: DataFrame) -> DataFrame:
    """The jobs with what their logs say; status is 'ok', or 'no_summary' for a job whose log says nothing."""
    status = free("status", matrix, told)
    found = told.withColumn(status, F.lit("ok"))
    return matrix.join(found, "run", "left").withColumn(status, F.coalesce(status, F.lit("no_summary")))
