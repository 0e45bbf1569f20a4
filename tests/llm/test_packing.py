import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kairosight.llm import packing, runtime

P = pytest.importorskip("public_tokenizers")


def brute(lengths, capacity):
    """Best-fit decreasing, bin by bin: how full each bin gets (bins that are equally full are interchangeable)."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        b = min(fit, key=lambda b: b[0]) if fit else None
        if b is None:
            bins.append(b := [capacity, []])
        b[0] -= n
        b[1].append(n)
    return sorted(sum(b[1]) for b in bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([5, 16, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, capacity // 3 + 1]) for _ in range(rng.randint(0, 120))]
        histogram = defaultdict(int)
        rank = [histogram.__getitem__(n) for n in lengths if histogram.__setitem__(n, histogram[n] + 1) is None]
        p = packing.plan(dict(histogram), capacity)
        where, offset = packing.place(p, np.array(lengths, np.int64), np.array(rank, np.int64) - 1)
        content = defaultdict(list)
        for n, b, o in zip(lengths, where, offset, strict=True):
            content[b].append((o, n))
        for rows in content.values():
            at = 0
            for o, n in sorted(rows):
                assert o == at
                at += n
            assert at <= capacity
        assert sorted(sum(n for _, n in rows) for rows in content.values()) == brute(lengths, capacity)
        assert len(content) == p["bins"][0]


TEXTS = [None, "", "Hello World's ÀÉ 12½ §", "<|startoftext|>a", "Σίσυφος ΟΔΥΣΣΕΎΣ é  İ", "word " * 5000, "x\x0by\x85z ª­"]


@pytest.mark.parametrize("rows", [TEXTS, None, []])
def test_pack(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    if rows is None:
        docs = runtime.table(spark, "/root/testdata/sf0.001", "documents")
        texts = {r.doc_id: r.text for r in docs.collect()}
    else:
        texts = dict(enumerate(rows))
        docs = spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, length string")
    found = packing.query(docs).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert len(found) == sum(-(-len(x) // 2048) for x in ids.values())
    bins = defaultdict(list)
    for r in found:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    lengths = [r.length for r in found]
    assert len(bins) == len(brute(lengths, 2048)) if lengths else not bins


def test_ids_column(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [list(r.ids) for r in packing.pack(docs, ids=True).select("ids").collect()] == [[320, 321, 0]] * 2
