import numpy as np
import pytest
from pyspark.sql import functions as F

from kairosight.llm import hash_forest as H
from kairosight.llm import runtime


def exact(ids, x, queries, k=5):
    x = np.asarray(x, float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        at = ids.index(q)
        s = x @ x[at] / (norm * norm[at])
        order = [i for i in sorted(range(len(ids)), key=lambda i: (-round(s[i], 12), ids[i])) if ids[i] != q]
        out[q] = [(ids[i], s[i]) for i in order[:k]]
    return out


def test_recall_on_a_whole_table(spark):
    rows = runtime.table(spark, "/root/testdata/sf0.1", "embeddings")
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids = [i for i, _ in data]
    truth = exact(ids, [v for _, v in data], [i for i in ids if i % 50 == 0])
    found = {}
    for r in H.query(rows).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == truth.keys()
    hits = 0
    for q, near in found.items():
        assert len(near) == 5 and near == sorted(near, key=lambda p: (-p[1], p[0]))
        expected = dict(truth[q])
        hits += len(expected.keys() & dict(near).keys())
        for i, s in near:
            if i in expected:
                assert s == pytest.approx(expected[i], abs=1e-14)
    assert hits >= 0.93 * 5 * len(truth)


def test_small_sets_are_exact_and_cases(spark):
    nan = float("nan")
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=4).tolist()) for i in range(0, 60)]
    vectors += [(60, vectors[3][1]), (61, vectors[3][1]), (100, vectors[3][1]), (150, [0.0] * 4), (200, None), (201, [1.0, nan, 0.0, 0.0]), (202, [1.0, None, 0.0, 0.0]), (203, [1.0]), (None, [1.0] * 4), (250, [])]
    rows = vectors + [vectors[1], vectors[0]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    usable = vectors[:63]
    truth = exact([i for i, _ in usable], np.array([v for _, v in usable], np.float32).astype(float), [0, 50, 100])
    found = {}
    for r in H.query(frame).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [i for i, _ in near] for q, near in truth.items()}
    assert found[100][:3] == [3, 60, 61]


def test_fewer_candidates_than_asked_and_empty(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in H.query(frame).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert H.query(frame.limit(0)).count() == 0
    assert H.query(frame.where("vec_id = 0")).count() == 0


def test_each_length_is_an_index_of_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(101)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(4)] + [(5000, [1.0, 2.0, 3.0, 4.0])]
    found = {}
    for r in H.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    short, long = rows[:101], rows[101:105]
    expected = {q: [i for i, _ in near] for q, near in exact([i for i, _ in short], [v for _, v in short], [0, 50, 100]).items()}
    expected |= {q: [i for i, _ in near] for q, near in exact([i for i, _ in long], [v for _, v in long], [1000]).items()}
    assert found == expected
