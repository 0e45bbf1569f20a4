import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from kairosight.llm import words
from kairosight.llm import toxicity as T


def made_up(seed=1, n=900, bad=("grobnik", "vlatz", "żurp")):
    rng = random.Random(seed)
    word = lambda: rng.choice("bdfgk") + rng.choice("aeiou") + rng.choice("lmnr") + rng.choice(["", "a", "ok", "it"])
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([5, 40, 120, 400]))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(bad).capitalize() + rng.choice(["", ",", "###"])
        docs.append((i, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((i, toxic))
    return docs, labels, bad


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id long, text string, lang string, score double").repartition(4)
    return d, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("own"))


def test_held_out_documents(spark):
    docs, labels, bad = made_up()
    found = {r.doc_id: r for r in T.query(*frames(spark, docs, labels)).collect()}
    assert len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in found.items())
    toxic = {i for i, t in docs if any(b.lower() in t.lower() for b in bad)}
    held = [r for r in found.values() if r.held_out]
    right = [r.predicted == (r.doc_id in toxic) for r in held]
    assert sum(right) >= 0.97 * len(right) and sum(r.doc_id in toxic for r in held) > 20


def by_hand(docs, labels, rule):
    """The model and the evidence of a text, word by word."""
    text_of = dict(docs)
    low = lambda t: [w for w in "".join(c.lower() if c < "\x80" and c.isalnum() else c if c >= "\x80" else " " for c in t).split(" ") if w]
    pairs = [Counter(), Counter()]
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            w = ["^", *low(text_of[i])]
            pairs[1 - y].update(zip(w, w[1:], strict=False))
    contexts = [Counter(w for _, w in p) for p in pairs]
    total = [sum(c.values()) for c in contexts]
    kept = {w for w in contexts[0] | contexts[1] if contexts[0][w] + contexts[1][w] >= rule.least_word}
    part = [{w: c[w] / n for w in kept} for c, n in zip(contexts, total, strict=True)]
    own = [{w: max(p[w] - rule.discount / n, 0) for w in kept} for p, n in zip(part, total, strict=True)]
    both = sum(sum(p.values()) for p in part)
    share = [{w: o[w] + (sum(p.values()) - sum(o.values())) * (part[0][w] + part[1][w]) / both for w in kept} for o, p in zip(own, part, strict=True)]
    rare = [max(1 - sum(p.values()), 1e-9) for p in part]
    often = {p for p in pairs[0] | pairs[1] if pairs[0][p] + pairs[1][p] >= rule.least_pair}
    tables = [pairs[0], pairs[1], pairs[0] + pairs[1]]
    after = [defaultdict(int) for _ in tables]
    for t, n in zip(tables, after, strict=True):
        for (v, _), k in t.items():
            n[v] += k
    given = [defaultdict(float) for _ in tables]
    for t, g in zip(tables, given, strict=True):
        for v, w in often:
            g[v] += max(t[v, w] - rule.discount, 0)

    def levels(v, w, y):
        def pair(t, n, g):
            return (max(t[v, w] - rule.discount, 0) / n[v] if (v, w) in often and n[v] else 0.0), 1 - (g[v] / n[v] if n[v] else 0.0)

        own, left = pair(tables[y], after[y], given[y])
        shared, rest = pair(tables[2], after[2], given[2])
        return own + left * (shared + rest * (share[y][w] if w in kept else rare[y] / max(rare)))

    def evidence(text):
        w = ["^", *low(text)]
        distinct = set(zip(w, w[1:], strict=False))
        return len(distinct), sum(math.log(1 - rule.toxic_share + rule.toxic_share * levels(v, x, 0) / levels(v, x, 1)) for v, x in distinct)

    return evidence


def test_evidence_equals_a_recomputation(spark):
    docs, labels, _ = made_up(4, 250)
    docs += [(1000, "grobnik"), (1001, ""), (1002, "VLATZ vlatz vlatz bala bala unseen")]
    rule = T.Rule(least_pair=2, ordinary_each=50)
    model = T.fit(*frames(spark, docs, labels), rule)
    expected = by_hand(docs, labels, rule)
    batch = pa.record_batch([pa.array([t for _, t in docs])], names=["text"])
    size, evidence = model.evidence(*words.column(batch, "text"))
    for (_, t), n, e in zip(docs, size, evidence, strict=True):
        assert (n, pytest.approx(e, abs=1e-9)) == (expected(t)[0], expected(t)[1])
    assert len(model.pairs.keys) > 0


def test_cases(spark):
    docs, labels, _ = made_up(2, 300)
    odd = [(None, "vlatz grobnik"), (9000, None), (9001, ""), (9002, "... \n"), (9003, "vlatz, " * 200_000), (5, docs[5][1])]
    labels += [(9001, None), (None, 1), (9002, 7), (labels[0][0], 1 - labels[0][1])]
    found = T.query(*frames(spark, docs + odd, labels)).collect()
    assert len(found) == len(docs) + len(odd)
    empty = {r.score for r in found if r.doc_id in (9000, 9001, 9002)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert [r.held_out for r in found if r.doc_id is None] == [True]
    assert len({r.score for r in found if r.doc_id == 5}) == 1
    d, lab = frames(spark, docs[:5], labels)
    assert T.query(d.limit(0), lab).count() == 0
    assert {r.score for r in T.query(d, lab.limit(0)).collect()} == {0.0}
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 0.5 for r in T.query(d, only).collect())


def test_bounds_hold(spark):
    docs, labels, _ = made_up(3, 400)
    rule = T.Rule(toxic_rows=10, ordinary_each=2, curve_rows=15, words_kept=40, pairs_kept=30, least_word=1, least_pair=1)
    model = T.fit(*frames(spark, docs, labels), rule)
    assert 0 < len(model.words.keys) <= 40 and len(model.pairs.keys) <= 30
    kinds = T._sample(frames(spark, docs, labels)[1], rule).groupBy("toxic", "curve").count().collect()
    assert all(r["count"] <= 3 * (15 if r.curve else 10 if r.toxic else 20) for r in kinds)
    assert np.isfinite(model.curve).all()
