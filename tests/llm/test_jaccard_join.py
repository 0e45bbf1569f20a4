import random
import re
from itertools import combinations

import numpy as np
import pytest

from kairosight.llm import jaccard_join as J
from kairosight.llm import runtime

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, rule):
    """rows: (id, text) with distinct ids."""
    sets = {i: shingles(t, rule.shingle) for i, t in rows}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    by_size = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for x, a in enumerate(by_size):
        for b in by_size[x + 1 :]:
            if 100 * len(sets[a]) < rule.percent * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 100 * both >= rule.percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, copies=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 4)))
    rows = [(0, None), (1, ""), (2, " \t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "x" * 50_000)]
    for size in (8, 15, 25, 60, 200, 900):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 30, size // 10])):
                at = rng.randrange(len(text))
                rng.choice([lambda: text.__setitem__(at, word()), lambda: text.insert(at, word()), lambda: len(text) > 4 and text.pop(at)])()
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(word() for _ in range(55))
    rows += [(len(rows) + i, " ".join(word() for _ in range(40)) + " " + shared) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rule", [J.Rule(3, 90), J.Rule(5, 80)])
def test_signatures_lose_no_link(rule):
    rows = corpus(11, 40)
    sets = [np.sort(np.array([hash(s) & (1 << 63) - 1 for s in shingles(t, rule.shingle)], np.uint64)) for _, t in rows]
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    owner, sig = J.signatures(doc, np.concatenate(sets), np.array([len(s) for s in sets]), rule)
    signed = [set(sig[owner == i].tolist()) for i in range(len(sets))]
    n = 0
    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        union = len(sets[a]) + len(sets[b]) - both
        if both and both < union and 100 * both >= rule.percent * union:
            n += 1
            assert signed[a] & signed[b]
    assert n > 100


@pytest.mark.parametrize("rule", [J.Rule(3, 90), J.Rule(5, 80)])
def test_components(spark, rule):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    expected = brute(rows, rule)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.query(docs, rule).collect()}
    assert found == expected
    kept = {r.doc_id for r in J.representatives(docs, rule).collect()}
    assert kept == {c for _, c in expected.values()}


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (None, "lonely words here now"), (None, None), (8, "A b c  d")]
    found = sorted(map(str, J.query(spark.createDataFrame(rows, schema)).select("doc_id", "n_shingles", "component_id").collect()))
    as_text = lambda *r: f"Row(doc_id={r[0]}, n_shingles={r[1]}, component_id={r[2]})"
    assert found == sorted([as_text(None, 2, 8), as_text(9, 2, 8), as_text(9, 2, 8), as_text(None, 2, None), as_text(None, 0, None), as_text(8, 2, 8)])
    assert J.query(spark.createDataFrame([], schema)).count() == 0


def test_small_table(spark):
    docs = runtime.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.query(docs).collect()}
    assert found == brute(rows, J.Rule())


@pytest.mark.parametrize("widest", [J.BLOCK_SHARP, 256] if hasattr(J, "BLOCK_SHARP") else [0])
def test_large_texts_with_one_passage_stay_no_pairs(spark, monkeypatch, widest):
    """60 texts of 1,500 words share 900 of them: signatures meet, sets do not link; two near copies of one pair still do."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(900)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(600))])) for i in range(60)]
    far = rows[7][1].split(" ")
    for at in range(905, 1500, 50):
        far[at] = word()
    rows += [(60, " ".join(far)), (61, rows[8][1] + " end"), (62, " ".join(word() for _ in range(700)))]
    monkeypatch.setattr(J, "COMMON_HITS", 1 << 40)  # the passage stays in the domain
    monkeypatch.setattr(J, "BLOCK_SHARP", widest, raising=False)
    counts, verify = [], J._verify

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(J, "_verify", counted)
    rule = J.Rule(5, 80)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()}
    assert found == brute(rows, rule)
    assert found[60][1] == 7 and found[61][1] == 8
    assert sum(counts[1:]) <= 10


@pytest.mark.parametrize(("block", "shingles"), [(1024, 1 << 20), (16, 1 << 13)])
def test_near_copies_that_just_fail_leave_no_square_of_pairs(spark, monkeypatch, block, shingles):
    """289 texts change words of one base at places that are lines of a plane: two of them differ in 114 or 124 shingles of 512 each, 113 would link."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(516)]
    rows = []
    for slope in range(17):
        for start in range(17):
            text = list(base)
            for at in (*(4 + 5 * (17 * x + (slope * x + start) % 17) for x in range(6)), 514):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    rows += [(289, rows[5][1] + " end"), (290, rows[200][1] + " end")]
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BLOCK_SETS", shingles, raising=False)
    counts, durable = {}, runtime.durable

    def counted(df, label):
        out = durable(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(runtime, "durable", counted)
    rule = J.Rule(5, 80)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()}
    assert found == brute(rows, rule)
    assert len({c for _, c in found.values()}) == 289
    assert 0 < counts["across"] < 30 * len(rows)
