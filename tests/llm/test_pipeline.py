"""The pipeline on a small made-up corpus, against the brute-force versions of its stages."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from test_jaccard_join import brute as near_brute
from test_packing import brute as pack_brute
from test_substring_dedup import brute as dedup_brute

from kairosight.llm import quality_rules, substring_dedup

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(5, 14))).capitalize() + ". "
    text = lambda n: "".join(sentence() for _ in range(n))
    passage = text(7)
    bases = [text(rng.randint(3, 20)) for _ in range(25)]
    rows = [*bases, *bases[:5], *(b.replace(" a", " xx", 1) for b in bases[5:15]), *(text(4) + passage + text(3) for _ in range(8)), passage, passage + " ", "", None, "short", "*** ### " * 40, "SHOUT LOUD " * 30, "same words again " * 40]
    rng.shuffle(rows)
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    bits = {r.doc_id: r.fail_bits for r in quality_rules.ledger(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = [(i, t) for i, t, *_ in rows if bits[i] & quality_rules.POLICIES[quality_rules.CURRENT] == 0]
    assert 40 < len(kept) < len(rows) - 5
    first = {c for _, c in near_brute(kept, corpus_pipeline.NEAR).values()}
    near = [(i, t) for i, t in kept if i in first]
    assert len(near) < len(kept)
    left = {i: t for i, (_, n, t) in dedup_brute(near, substring_dedup.WHOLE).items() if n == 0 or t.strip()}
    assert any(left[i] != t for i, t in near if i in left)
    assert {r.doc_id for r in found} == set(left)

    from public_tokenizers import path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    total = defaultdict(int)
    for r in found:
        total[r.doc_id] += r.length
    assert dict(total) == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert len({r.sequence_id for r in found}) == len(pack_brute([r.length for r in found], 2048))


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus()[:10], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
