import hashlib
import random
import time

import pytest

from kairosight.llm import bpe_trie, runtime

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", "Hello world's  end\n\n ça été ñandú, 12³ ###!!", "<|endoftext|>a<|endoftext|> b", "日本語 текст  x y é", "aaaaaaa" * 9, " " * 50 + "x", "a\r\n\tb", "\x00\x1c \x85", "🙂" * 5, "don't I'LL they've"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_words_match_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdethinos 'ré.,!1\n", k=rng.randint(1, 60))) for _ in range(3000)] + [t or "" for t in TEXTS]
    texts += ["".join(chr(rng.choice([rng.randint(32, 255), rng.randint(32, 0x2FFF)])) for _ in range(30)) for _ in range(300)]
    for t, (ids, decoded) in zip(texts, bpe_trie.codec().encode(texts), strict=True):
        e = library.encode(t, add_special_tokens=False)
        assert ids == ",".join(map(str, e.ids)), t
        assert decoded == library.decode(e.ids, skip_special_tokens=False) == t


def test_query(spark, library):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (2, TEXTS[2], 3)], "doc_id long, text string, n_tokens int")
    found = bpe_trie.query(docs).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        ids = library.encode("x" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_trie.encode(docs.limit(0)).count() == 0


def test_whole_small_table(spark, library):
    docs = runtime.table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe_trie.encode(docs).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id]


def test_long_texts_without_a_break(library):
    rng = random.Random(9)
    texts = ["a" * 100_000, "é漢" * 25_000, " " * 70_000, "".join(rng.choices("abcdeth", k=100_000)), "=" * 50_000 + "x", "ha" * 40_000]
    began = time.perf_counter()
    found = list(bpe_trie.Codec(P.path("byte_bpe_50k.json")).encode(texts))
    assert time.perf_counter() - began < 20
    for t, (ids, decoded) in zip(texts, found, strict=True):
        assert ids == ",".join(map(str, library.encode(t, add_special_tokens=False).ids)) and decoded == t
