"""Queries over manifests, folders of runs, their logs, and linked pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import control, runs
from ..sources import archives, feeds, frontier, stored
from ..sources.shipping import ship
from .model_queries import _run
from .registry import query, table

_MANIFESTS = """SELECT o_custkey, CASE WHEN o_orderkey % 16 < 2 THEN 'bank' WHEN o_orderkey % 16 < 4 THEN 'refined' ELSE 'news' END AS kind,
CASE WHEN o_orderpriority < '3' THEN 0 ELSE year(o_orderdate) - 1990 END AS place, concat('manifest-', o_orderkey) AS path,
CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS matches, o_totalprice > 100000 AS filled FROM orders"""


@query("ct3_resolution", f"""WITH m AS ({_MANIFESTS}),
b AS (SELECT * FROM m WHERE kind = 'bank' AND coalesce(matches, TRUE) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY place, path) = 1),
r AS (SELECT * FROM m WHERE kind = 'refined' AND matches QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY place, path) = 1),
c AS (SELECT c_custkey, b.path AS bp, b.place, b.filled, r.path AS rp, c_custkey % 3 = 0 AS again, c_custkey IN (SELECT o_custkey FROM m WHERE kind = 'refined') AS seeds
  FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey)
SELECT c_custkey, CASE WHEN NOT again AND bp IS NOT NULL THEN (CASE WHEN NOT filled THEN 'empty' WHEN place = 0 THEN 'preferred' ELSE 'older' END)
  WHEN rp IS NOT NULL THEN 'reuse' WHEN seeds THEN 'sync' WHEN again THEN 'build' ELSE 'missing' END AS outcome, CASE WHEN NOT again AND bp IS NOT NULL THEN bp ELSE rp END AS path FROM c""")
def ct3(spark, d):
    """A customer is a dataset, its orders are manifests; every third dataset is to be rebuilt."""
    kind = F.when(F.col("o_orderkey") % 16 < 2, "bank").when(F.col("o_orderkey") % 16 < 4, "refined").otherwise("news")
    place = F.when(F.col("o_orderpriority") < "3", 0).otherwise(F.year("o_orderdate") - 1990)
    matches = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    manifests = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), kind.alias("kind"), place.alias("place"), F.concat(F.lit("manifest-"), F.col("o_orderkey").cast("string")).alias("path"),
        matches.alias("matches"), (F.col("o_totalprice") > 100000).alias("filled"),
    )
    return control.resolution(table(spark, d, "customer"), manifests, ["c_custkey"], F.col("c_custkey") % 3 == 0)


_RULES = [("base", "best_base_", "weights.bin"), ("delta", "best_delta_", "model.bin")]


@query("ct5_found_runs", """WITH roots AS (SELECT c_custkey AS k, '/runs/' || CASE WHEN c_custkey % 10 = 0 THEN 'best_base_' ELSE 'run_' END || c_custkey AS root FROM customer),
f AS (SELECT o_custkey AS k, o_orderkey AS o, o_custkey % 10 = 0 AND o_orderkey % 8 = 4 AS own, o_orderkey % 8 AS kind FROM orders),
n AS (SELECT k, bool_or(own) AS own, count(*) FILTER (kind = 0) AS bases, count(*) FILTER (kind = 1) AS deltas, min(o) FILTER (kind = 0) AS b, min(o) FILTER (kind = 1) AS d FROM f GROUP BY 1),
x AS (SELECT root, 'base' AS role, coalesce(own, FALSE) AS own, coalesce(bases, 0) AS candidates, root || '/best_base_' || b AS one FROM roots LEFT JOIN n USING (k)
  UNION ALL SELECT root, 'delta', FALSE, coalesce(deltas, 0), root || '/best_delta_' || d FROM roots LEFT JOIN n USING (k))
SELECT root, role, CASE WHEN own THEN 'given' WHEN candidates = 1 THEN 'found' WHEN candidates > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
  CASE WHEN own THEN root WHEN candidates = 1 THEN one END AS path, candidates FROM x""")
def ct5(spark, d):
    """A customer is a root, some roots are runs themselves; the orders are files in and below the roots."""
    root = lambda k: F.concat(F.lit("/runs/"), F.when(F.col(k) % 10 == 0, "best_base_").otherwise("run_"), F.col(k).cast("string"))
    o = F.col("o_orderkey")
    kind = F.when(o % 8 == 0, "/best_base_").when(o % 8 == 1, "/best_delta_").otherwise("/best_old_")
    own = (F.col("o_custkey") % 10 == 0) & (o % 8 == 4)
    path = F.concat(root("o_custkey"), F.when(own, "").otherwise(F.concat(kind, o.cast("string"))), F.when(o % 4 == 0, "/weights.bin").otherwise("/model.bin"))
    return runs.chosen(table(spark, d, "orders").select(path.alias("path")), table(spark, d, "customer").select(root("c_custkey").alias("root")), _RULES)


_LOG = """log AS (SELECT replace(lower(substr(o_orderpriority, 3)), ' ', '-') AS dataset, 24 * (1 + year(o_orderdate)::INT % 4) AS horizon, o_orderkey AS o FROM orders)"""


@query("ct6_job_report", f"""WITH {_LOG}, j AS (SELECT DISTINCT dataset, horizon FROM log UNION SELECT DISTINCT dataset, 120 FROM log),
m AS (SELECT dataset, horizon, row_number() OVER (ORDER BY dataset, horizon) - 1 AS place FROM j WHERE dataset <> 'low' AND horizon <> 48),
t AS (SELECT *, row_number() OVER (PARTITION BY dataset, horizon ORDER BY o DESC) AS nth FROM log WHERE o % 3 = 0 QUALIFY nth <= 3),
v AS (SELECT dataset, horizon, nth, CASE WHEN o % 2 = 0 THEN 'FINAL' ELSE 'BASE' END AS tag, unnest(['mse', 'mae']) AS metric, unnest([o % 1000 + 0.5, -(o % 7)]) AS number FROM t)
SELECT place, dataset, horizon, CASE WHEN nth IS NULL THEN 'no_summary' ELSE 'ok' END AS status, nth, tag, metric, number::DOUBLE AS number FROM m LEFT JOIN v USING (dataset, horizon)""")
def ct6(spark, d):
    """Orders are the lines of the logs of runs named by priority and year; the logs are written and read as text."""
    dataset = F.replace(F.lower(F.substring("o_orderpriority", 3, 100)), F.lit(" "), F.lit("-"))
    horizon = ((F.year("o_orderdate") % 4 + 1) * 24).cast("string")
    o = F.col("o_orderkey")
    said = F.concat(F.lit("[TEST]["), F.when(o % 2 == 0, "FINAL").otherwise("BASE"), F.lit("] mse="), (o % 1000).cast("string"), F.lit(".5 mae=-"), (o % 7).cast("string"))
    rows = table(spark, d, "orders").select(F.concat(F.lit("best_base_"), dataset, F.lit("_h"), horizon).alias("run"), "o_orderkey", F.when(o % 3 == 0, said).otherwise(F.concat(F.lit("epoch "), o.cast("string"))).alias("value"))
    path = stored.place(spark, "logs")
    ordered = rows.repartitionByRange("run", "o_orderkey").sortWithinPartitions("run", "o_orderkey")  # parts are numbered in this order
    ordered.select("run", "value").write.partitionBy("run").text(path)
    names = rows.select("run").distinct()
    names = names.union(names.select(F.regexp_replace("run", "_h[0-9]+$", "_h120"))).distinct()
    of = lambda n: F.regexp_extract("run", "^best_base_(.*)_h([0-9]+)$", n)
    matrix = runs.jobs(names, "run", of(1), of(2), ["urgent", "high", "medium", "not-specified"], [24, 72, 96, 120])
    told = runs.summaries(runs.lines(spark, path), F.regexp_extract("file", "run=([^/]*)/", 1), r"\[TEST\]\[(\w+)\]", 3)
    x = runs.report(matrix, told)
    return x.select("place", "dataset", "horizon", "status", F.col("nth").cast("bigint").alias("nth"), "tag", "metric", "number")


@query("src13_frontier", """WITH RECURSIVE r AS (SELECT 0::BIGINT AS id, 0 AS depth UNION ALL SELECT 6 * id + k, depth + 1 FROM r, range(1, 7) t(k) WHERE id IN (SELECT page_id FROM pages) AND id % 10 <> 3)
SELECT 'https://site' || id % 7 || '.example/p/' || id AS url, depth, id IN (SELECT page_id FROM pages) AS answered FROM r""")
def src13(spark, d):
    """The pages answer; each also links to six others, some of which are not there, and back to where it was linked; pages of an earlier year are not followed."""
    at = lambda i: F.concat(F.lit("https://site"), (i % 7).cast("string"), F.lit(".example/p/"), i.cast("string"))
    i = F.col("page_id")
    linked = F.array(*(6 * i + k for k in range(1, 7)), F.floor((i - 1) / 6))
    anchors = F.array_join(F.transform(linked, lambda j: F.concat(F.lit('<a href="'), at(j), F.lit('/?from=list">x</a>'))), "")
    replies = table(spark, d, "pages").select(at(i).alias("url"), F.concat("html", anchors).alias("html"), F.when(i % 10 == 3, 2023).otherwise(2024).alias("year"))
    seeds = spark.range(1).select(at(F.col("id")).alias("url"))
    links = text.page_links(F.col("html"), F.col("url"))
    found = frontier.crawl(seeds, lambda asked: replies.join(asked, "url"), links, F.rlike("url", F.lit(r"^https://site[0-6]\.example/p/[0-9]+$")), F.col("year") == 2024)
    return found.select("url", "depth", "answered")


@query("src12_archive", """WITH RECURSIVE l AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events WHERE ts < TIMESTAMP '2024-01-25'), r AS (SELECT min(t) AS t FROM l UNION ALL SELECT min(l.t) FROM r JOIN l ON l.t >= r.t + INTERVAL 36 HOUR HAVING min(l.t) IS NOT NULL),
s AS (SELECT t, strftime(t, '%Y%m%d%H%M%S') AS stamp FROM r)
SELECT stamp, link, strftime(t, '%Y-%m-%d %H:%M:%S') AS published FROM s, (VALUES (TRUE), (FALSE)) v(own), LATERAL (SELECT 'http://a.example/' || CASE WHEN own THEN stamp ELSE 'all' END AS link)""")
def src12(spark, d):
    """The hours that have events are snapshots of a feed; a stream reads those 36 hours apart, and their items are parsed."""
    ship(spark)
    spark.dataSource.register(archives.ArchiveSnapshots)
    hours = table(spark, d, "events").select(F.date_trunc("HOUR", "ts").alias("t")).distinct()
    stamps = sorted(r.s for r in hours.select(F.date_format("t", "yyyyMMddHHmmss").alias("s")).collect())  # the hours of the time axis
    o = {"transport": "kairosight.sources.testing.archive", "url": ",".join(stamps), "target": "feed", "days": "1.5", "to": "20240125"}
    sink = stored.place(spark, "snapshots")
    _run(spark.readStream.format("archive_snapshots").options(**o).load(), sink, "append")
    found = feeds.items(spark.read.option("basePath", sink).parquet(f"{sink}/batch=*"), "body", ["stamp"])
    return found.select("stamp", "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))
