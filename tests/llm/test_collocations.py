import random
import re
from collections import Counter

import pytest

from kairosight.llm import collocations as C
from kairosight.llm import runtime


def brute(rows, rule):
    """Counting every run of words, one by one."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, rule.max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = {}
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= rule.least}
    for (lang, p), a in cands.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(m == lang and len(q) > len(p) and 100 * b >= rule.share_percent * a and inside(q) for (m, q), b in cands.items()):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return [(lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, found in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(found)[: rule.top])]


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "red", "fox", "über", "日本", "a-b", "x", "0"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "de", None]), text()) for _ in range(n)]
    return rows + [("en", "new york city hall " * 9), ("en", None), ("en", ""), ("de", "...,;"), ("fr", "one"), (None, "the red fox")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, "f", 1) for lang, t in rows], "lang string, text string, phrase string, rank int").repartition(5)


@pytest.mark.parametrize("rule", [C.Rule(least=5), C.Rule(least=3, share_percent=60, top=7), C.Rule(max_words=2, least=4), C.Rule(max_words=3, least=1, top=50)])
def test_equals_brute_force(spark, rule):
    rows = corpus()
    found = C.query(frame(spark, rows), rule).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows, rule), key=str)
    assert len(found) > 20


def test_ranks_meet_across_buckets(spark, monkeypatch):
    rows, rule = corpus(8, 200), C.Rule(least=2, top=40)
    monkeypatch.setattr(C, "BUCKETS", 3)
    assert sorted(map(tuple, C.query(frame(spark, rows), rule).collect()), key=str) == sorted(brute(rows, rule), key=str)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows, rule = corpus(5), C.Rule(least=4)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "BITS_EACH", 1)
    assert sorted(map(tuple, C.query(frame(spark, rows), rule).collect()), key=str) == sorted(brute(rows, rule), key=str)


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, left, right = 10**13 + 7, 3 * 10**10 + 1, 9 * 10**11 + 3, 5 * 10**11 + 9
    every = spark.createDataFrame([("en", 1, "a", left), ("en", 1, "b", right), ("en", 2, "a b", a)], "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    assert [r.score for r in C.scored(every, totals).collect()] == [1000 * a * n // (left * right)]


def test_empty_long_and_whole_tables(spark):
    docs = frame(spark, [("en", "x")])
    assert C.query(docs.where("lang = 'none'")).count() == 0
    long = [("en", "alpha beta gamma delta " * 60_000 + "z" * 100_000)]
    rule = C.Rule(least=59_999)
    assert sorted(map(tuple, C.query(frame(spark, long), rule).collect()), key=str) == sorted(brute(long, rule), key=str)
    docs = runtime.table(spark, "/root/testdata/sf0.001", "documents")
    rule = C.Rule(least=20)
    assert sorted(map(tuple, C.query(docs, rule).collect()), key=str) == sorted(brute([(r.lang, r.text) for r in docs.collect()], rule), key=str)
