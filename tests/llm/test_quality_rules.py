import re
from collections import Counter

from kairosight.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, fail_bits long"


def brute(text):
    text = text or ""
    ws, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    count, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if count[r] > 1:
            covered.update(range(i, i + 8))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n ", "a b\na b\n\na b \n", "x y z w v u t s " * 40, "ÄÖ é ß ###\tq\x0bw", "word " * 3 + "\n" + "w" * 3_000_000, "Prose with many words. " * 2 + " ".join(f"w{i}" for i in range(400))]


def test_against_brute_force(spark):
    rows = [(i, t, None, 5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", None)]
    found = quality_rules.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        e = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 20 or 100 * e[4] > 30 * e[0])
        assert not (r.base_failed and r.kept)
    assert [r.kept for r in found if r.doc_id == 7] == [True]


def test_keep_and_ablations(spark):
    docs = spark.createDataFrame([(i, t, None, 5) for i, t in enumerate(TEXTS)], SCHEMA)
    assert [tuple(r) for r in quality_rules.keep(docs).collect()] == [(7, TEXTS[7], None, 5)]
    ledger = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.POLICIES[r.policy], quality_rules.BIT[r.rule]
        assert r.kept == sum(b & mask == 0 for b in bits)
        assert r.kept_without == sum(b & mask & ~bit == 0 for b in bits)
        assert r.rejected_by_this_alone == sum(b & mask == bit for b in bits)


def test_empty_table(spark):
    assert quality_rules.query(spark.createDataFrame([], SCHEMA)).count() == 0
