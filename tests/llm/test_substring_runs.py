"""Spans under Rule.both: a long sentence alone, and the run of two that starts at it."""

from test_substring_dedup import WORD, corpus, sentences

from kairosight.llm import substring_dedup as S


def spans(parts, rule):
    full = [i for i, p in enumerate(parts) if WORD.search(p)]
    for x, i in enumerate(full):
        run, short = [], False
        for y in range(x, len(full)):
            run += WORD.findall(parts[full[y]])
            whole = y - x + 1 >= rule.sentences and len(run) >= rule.words
            if whole or (len(run) >= rule.enough_words and not short):
                short = True
                yield i, full[y], tuple(run)
            if whole:
                break


def brute(rows, rule):
    first, out = {}, {}
    parts = {i: sentences(t) for i, t in rows if t is not None}
    for i in sorted(parts):
        gone = set()
        for s, e, words in spans(parts[i], rule):
            if words in first:
                gone.update(range(s, e + 1))
            first.setdefault(words, i)
        out[i] = (len(parts[i]), len(gone), "".join(p for k, p in enumerate(parts[i]) if k not in gone))
    return out | {i: (0, 0, None) for i, t in rows if t is None}


def test_the_sentence_after_a_long_one_goes_too(spark):
    a, b = " ".join(f"a{i}" for i in range(45)) + ". ", " ".join(f"b{i}" for i in range(15)) + ". "
    rows = [(i, f"{a}{b}" + f"other{i} text{i} goes{i} on{i}.") for i in range(3)]
    found = {r.doc_id: r.text for r in S.query(spark.createDataFrame(rows, "doc_id long, text string"), S.WHOLE).collect()}
    assert found == {0: rows[0][1], 1: " other1 text1 goes1 on1.", 2: " other2 text2 goes2 on2."}


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.query(docs, S.WHOLE).collect()}
    assert found == brute(rows, S.WHOLE)
