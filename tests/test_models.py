"""Models, shuffles and summaries against plain recomputations."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kairosight.functions import text
from kairosight.operators import bank, news, splits
from kairosight.plans import etl_queries, registry, text_queries, time_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("events", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_ops2_shuffles_every_row_into_exact_shares(spark, duck):
    found = {r.event_id: r.split for r in registry.QUERIES["ops2_shuffled_split"](spark, FOLDER).collect()}
    assert found == dict(duck.sql(registry.ORACLE["ops2_shuffled_split"]).fetchall())
    sizes = {s: sum(v == s for v in found.values()) for s in ("train", "val", "test")}
    assert sizes == {"train": 7000, "val": 1000, "test": 2000}
    low = sum(i < 5000 for i, s in found.items() if s == "train")
    assert abs(low - 3500) < 4 * 40  # a shuffle, not a cut of the ids


def trend(x, k):
    half = (k - 1) // 2
    padded = np.concatenate([np.repeat(x[0], half), x, np.repeat(x[-1], k - 1 - half)])
    return np.array([padded[i : i + k].mean() for i in range(len(x))])


def fit(x, y):
    """Ridge regression by least squares on rows that stand for the penalty; the bias has none."""
    n = x.shape[1]
    a = np.vstack([np.column_stack([x, np.ones(len(x))]), np.column_stack([np.sqrt(1e-3) * np.eye(n), np.zeros(n)])])
    return np.linalg.lstsq(a, np.vstack([y, np.zeros((n, y.shape[1]))]), rcond=None)[0]


def test_ma8_scores_later_windows(spark, duck):
    series = {}
    for k, t, v in duck.sql("select event_type, date_trunc('hour', ts) as t, avg(value) from events group by all order by 1, 2").fetchall():
        series.setdefault(k, []).append((str(t), v))
    before, after = [], []
    for rows in series.values():
        for i in range(0, len(rows) - 29, 6):
            times, values = zip(*rows[i : i + 30], strict=True)
            if times[-1] < "2024-01-21":
                before.append(values)
            elif times[24] >= "2024-01-21":
                after.append(values)
    (h, y), (g, z) = ((np.array(w)[:, :24], np.array(w)[:, 24:]) for w in (before, after))
    parts = lambda m: np.array([np.concatenate([trend(r, 7), r - trend(r, 7)]) for r in m])
    one = lambda m: np.column_stack([m, np.ones(len(m))])
    a = one(parts(g)) @ fit(parts(h), y)
    b = one(g - g[:, -1:]) @ fit(h - h[:, -1:], y - h[:, -1:]) + g[:, -1:]
    expected = {"mae_a": abs(a - z).mean(), "mae_b": abs(b - z).mean(), "mae_base": abs(g[:, -1:] - z).mean()}
    found = registry.QUERIES["ma8_linear_forecast"](spark, FOLDER).first().asDict()
    assert len(after) > 100 and found == pytest.approx(expected, abs=2e-4)


def test_ma16_directions_by_singular_values(spark, duck):
    ids, vectors = zip(*duck.sql("select vec_id, embedding from embeddings order by 1").fetchall(), strict=True)
    v = np.array(vectors, float)
    top = np.linalg.svd(v - v.mean(0), full_matrices=False)[2][:3]
    top *= np.sign(top[np.arange(3), np.abs(top).argmax(1)])[:, None]
    found = {r.vec_id: [r.pc1, r.pc2, r.pc3] for r in registry.QUERIES["ma16_principal_components"](spark, FOLDER).collect()}
    assert sorted(found) == list(ids)
    assert np.abs(np.array([found[i] for i in ids]) - v @ top.T).max() < 1e-4


def summary(t):
    """The first three different sentences, stopped at 800 characters."""
    kept = []
    for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", t or "").strip()):
        if s and s not in kept:
            if len(kept) >= 3 or sum(map(len, kept)) >= 800:
                break
            kept.append(s)
    x = " ".join(kept)
    return x if len(x) <= 800 else re.sub(r"\s\S*$", "", x[:800]) + "..."


def test_tx25_summaries_of_all_documents(spark, duck):
    found = {r.doc_id: r.summary for r in registry.QUERIES["tx25_extract_summary"](spark, FOLDER).collect()}
    assert found == {i: summary(t) for i, t in duck.sql("select doc_id, text from documents").fetchall()}


def greedy(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "second"]])
def test_thinned_is_the_greedy_chain(spark, keys):
    rng = np.random.default_rng(3)
    rows = [(int(k), "ab"[int(s)], int(t)) for k, s, t in zip(rng.choice(5, 3000, p=[0.6, 0.1, 0.1, 0.1, 0.1]), rng.integers(0, 2, 3000), rng.integers(0, 500_000, 3000), strict=True)]
    df = spark.createDataFrame([*rows, (1, "a", None), (None, None, 5), rows[0]], "k int, second string, t long").repartition(5).withColumn("at", F.timestamp_seconds("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # chains go on across batches
    try:
        out = splits.thinned(df, "at", 0.05, keys)
        found = {}
        for r in out.collect():
            found.setdefault(tuple(r[k] for k in keys), []).append(r.t)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, s, t in [*rows] if keys else [*rows, (None, None, 5)]:
        groups.setdefault(tuple({"k": k, "second": s}[c] for c in keys), []).append(t)
    assert {k: sorted(set(v)) for k, v in found.items()} == {k: greedy(v, 4320) for k, v in groups.items()}
    assert out.columns == df.columns
    assert splits.thinned(df.limit(0), "at", 1, keys).count() == 0


def test_grids_slices_and_months_of_rows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:10:00'), (1, TIMESTAMP '2024-01-01 02:40:00'), (2, TIMESTAMP '2024-03-05 10:00:00'), (2, NULL), (3, NULL) t(k, at)")
    grid = [(r.k, str(r.t)) for r in bank.grids(df, ["k"], "at", 60).orderBy("k", "t").collect()]
    assert grid == [(1, f"2024-01-01 0{h}:00:00") for h in range(4)] + [(2, "2024-03-05 10:00:00")]
    daily = [(r.k, str(r.t)) for r in bank.grids(df, ["k"], "at", 0).orderBy("k").collect()]
    assert daily == [(1, "2024-01-01 00:00:00"), (2, "2024-03-05 00:00:00")]
    spans = spark.sql("SELECT * FROM VALUES (1, DATE '2024-01-01', DATE '2024-01-16'), (2, DATE '2024-01-01', DATE '2024-01-01'), (3, NULL, DATE '2024-01-01') t(k, a, b)")
    cut = [(r.k, str(r.lo)[:10], str(r.hi)[:10]) for r in splits.slices(spans, "a", "b", 7).orderBy("lo").collect()]
    assert cut == [(1, "2024-01-01", "2024-01-08"), (1, "2024-01-08", "2024-01-15"), (1, "2024-01-15", "2024-01-16")]
    year = splits.months(spark.createDataFrame([(2024,)], "year int"), "year").orderBy("month").collect()
    assert [r.month for r in year] == [*range(1, 13)] and str(year[1]["last"]) == "2024-02-29"


def test_manifests_and_names(spark):
    banks = spark.range(6).withColumnRenamed("id", "bank")
    said = [(0, "tau", "5.0"), (0, "variant", "load"), (0, "made", "x"), (1, "tau", "5.000000000001"), (1, "variant", "load"), (2, "tau", "5"), (3, "tau", "5.1"), (3, "variant", "load"), (5, "tau", "5"), (5, "tau", "six"), (5, "variant", "load")]
    manifests = spark.createDataFrame(said, "bank long, key string, value string")
    found = {r.bank: r.matches for r in news.manifests_match(banks, manifests, ["bank"], {"tau": 5.0, "variant": "load"}).collect()}
    assert found == {0: True, 1: True, 2: False, 3: False, 4: None, 5: False}
    names = spark.createDataFrame([(["A b", "a_B", "c"],), (["C"],), ([],), (None,), ([None, "AB"],)], "names array<string>")
    assert [r[0] for r in names.select(text.find_name(F.col("names"), ["x", "ab", "C!"])).collect()] == ["a_B", "C", None, None, "AB"]
