import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kairosight.llm import lbl_model as L
from kairosight.llm import runtime

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check(found, rows):
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    expected = {}
    for i, t in rows:
        w = tokens(t)
        expected[i] = (held(i), len(w), sum(x in train for x in w), n, sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    assert len(found) == len(rows)
    for r in found:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][:4]
        assert r.base_score == pytest.approx(expected[r.doc_id][4], rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


@pytest.mark.parametrize("setting", [L.Setting(), L.Setting(start_tokens=60_000, shard_tokens=70_000, together=2)])
def test_small_table_held_out_gain_and_partitions(spark, setting):
    """The gain, and equal scores however the input is cut; the second setting trains several shards and averages twice."""
    docs = runtime.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = None
    for parts in (1, 8, 64):
        found = L.query(docs.repartition(parts, "doc_id")).collect()
        if first is None:
            check(found, rows)
            first = {r.doc_id: r.score for r in found}
        assert {r.doc_id: r.score for r in found} == pytest.approx(first, rel=1e-7)  # products are in single precision
        base, own, n = (sum(r[c] for r in found if r.held_out) for c in ("base_score", "score", "n_tokens"))
        assert (own - base) / n > 0.2  # log10 a token


def test_scores_again_by_hand(spark):
    """Scores equal a token-by-token recomputation from the model's tables, with whole sums in place of batched products."""
    docs = L._folds(runtime.table(spark, "/root/testdata/sf0.001", "documents"))
    table, model = L.fit(docs)
    t, head, s = model.tables, model.head, model.setting
    full = {r.hash: r.n for r in table.collect()}
    found = {r.doc_id: r.score for r in L.score(docs, table, model).collect()}
    log_sum = lambda x: math.log(np.exp(x.astype(np.float64)).sum())
    rows = [r for r in docs.collect() if len(r.text or "") < 3000][:12]
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x = L.Tokens(data, np.array([0, len(data)]), head, s)
        total = 0.0
        for i in range(len(x.out)):
            q = np.append(t["one"][x.one[i]] + t["two"][x.two[i]], 1)
            own = t["out"] @ q
            total += own[x.out[i]] - log_sum(own)
            if x.out[i] == 0:
                q = np.append(t["tail_one"][x.one[i]] + t["tail_two"][x.two[i]] + t["tail_own"][x.own[i]], 1)
                k = x.own_class[i]
                own = t["class"] @ q
                total += own[k] - log_sum(own)
                low, high = head.base[k], head.base[k + 1]
                own = t["leaf"][low:high] @ q
                total += own[x.leaf[i] - low] - log_sum(own)
                if x.leaf[i] == low:
                    total += math.log(full.get(int(x.hash[i : i + 1].view(np.int64)[0]), 0) + 0.5) - math.log(head.mass[low])
        assert found[r.doc_id] == pytest.approx(total / math.log(10), rel=1e-4)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (None, "b c " * 200_000), (12, "x" * 300_000), (7, "é\x0bÉ ß"), (11, "new words")]
    schema = "doc_id long, text string, n int"
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], schema)
    check(L.query(docs).collect(), rows)
    assert L.query(spark.createDataFrame([], schema)).count() == 0
