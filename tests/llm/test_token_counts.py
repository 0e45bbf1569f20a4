import random

import pytest

from kairosight.llm import runtime
from kairosight.llm import token_counts as T


def library(vocabulary):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    return Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=True))


def expect(tokenizer, text):
    return len(tokenizer.encode(T.MARK + text.replace(" ", T.MARK), add_special_tokens=False).ids) if text else 0


TEXTS = [None, "", " ", "Hello  world.\n\n\n x", "日本語 \U0001f600\U0001f600 é", "<unk> a<unk>\x01 <s> <0x41>", "▁ a ▁▁b", "ab" * 60, "\x00\x01 \x02", "naïve ñandú ça"]


def test_random_vocabularies_with_ties():
    rng = random.Random(4)
    for _ in range(60):
        pieces = {T.MARK, "<unk>"} | {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)} | {T.MARK + "".join(rng.choices("abc", k=2)) for _ in range(3)}
        if rng.random() < 0.3:
            pieces |= {"a" + T.MARK + "b"}
        pieces -= {"<unk>"}
        vocabulary = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((p, float(-rng.randint(1, 4))) for p in sorted(pieces))]
        tokenizer, own = library(vocabulary), T.Counter(vocabulary)
        texts = ["".join(rng.choices("abcd <é", k=rng.randint(1, 30))) for _ in range(60)]
        assert [n for n, _ in own.count(texts)] == [expect(tokenizer, t) for t in texts]


def test_public_vocabulary():
    tokenizer, own = library(T.load()), T.counter()
    assert own.independent
    texts = [t or "" for t in TEXTS]
    assert [n for n, _ in own.count(texts)] == [expect(tokenizer, t) for t in texts]


def test_query(spark):
    tokenizer = library(T.load())
    docs = runtime.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in enumerate(TEXTS, 1)] + [(None, "twice"), (None, "twice")], "doc_id long, text string"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    found = [(r.doc_id, r.n_tokens) for r in T.query(docs).collect()]
    assert sorted(found, key=str) == sorted(((i, expect(tokenizer, t)) for i, t in texts), key=str)
    assert T.query(docs.limit(0)).count() == 0


def test_one_very_long_word_needs_no_long_states():
    n, score = T.counter().word(T.MARK + "xy" * 200_000)
    assert n > 0 and score < 0
    m, _ = T.counter().word(T.MARK + "xy" * 100_000)
    assert n == pytest.approx(2 * m, abs=3)
