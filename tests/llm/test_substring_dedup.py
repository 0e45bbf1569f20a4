import random
import re

from kairosight.llm import runtime
from kairosight.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(text):
    out, at = [], 0
    for i, c in enumerate(text):
        if c == "\n" or (c in ".!?" and i + 1 < len(text) and text[i + 1] in " \t\n\x0b\x0c\r"):
            out.append(text[at : i + 1])
            at = i + 1
    return [*out, text[at:]] if at < len(text) else out


def spans(parts, rule):
    """(first sentence, last, words) of each span."""
    full = [i for i, p in enumerate(parts) if WORD.search(p)]
    for x, i in enumerate(full):
        run = []
        for y in range(x, len(full)):
            run += WORD.findall(parts[full[y]])
            if len(run) >= rule.enough_words or (y - x + 1 >= rule.sentences and len(run) >= rule.words):
                yield i, full[y], tuple(run)
                break


def brute(rows, rule):
    first, out = {}, {}
    parts = {i: sentences(t) for i, t in rows if t is not None}
    for i in sorted(parts):
        gone = set()
        for s, e, words in spans(parts[i], rule):
            if words in first:
                gone.update(range(s, e + 1))
            first.setdefault(words, (i, s))
        out[i] = (len(parts[i]), len(gone), "".join(p for k, p in enumerate(parts[i]) if k not in gone))
    return out | {i: (0, 0, None) for i, t in rows if t is None}


def corpus():
    rng = random.Random(8)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefgé", k=3)) for _ in range(n)) + rng.choice([". ", "! ", "?\n", ".\n\n", "\n"])
    passages = ["".join(sentence(rng.choice([4, 9, 30, 60])) for _ in range(rng.randint(1, 5))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \n . \n"), (3, "no end"), (4, "w " * 30000)]
    for i in range(5, 200):
        body = [sentence(rng.randint(1, 14)) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), rng.choice(passages))
        rows.append((i, "".join(body)))
    rows += [(200, rows[50][1]), (201, rows[60][1] * 2)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string").repartition(4)
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.query(docs).collect()}
    assert found == brute(rows, S.Rule())
    assert found[200][2].strip() == ""


def test_nulls_repeats_and_empty(spark):
    text = "one two three four five six seven eight nine ten. " * 2 + "eleven twelve thirteen. last words."
    rows = [(None, text), (1, text), (1, text), (None, text + " " + text)]
    found = S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_removed for r in found)) == [0, 0, 0, 2]
    assert S.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_small_table(spark):
    rows = [(r.doc_id, r.text) for r in runtime.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    found = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.query(runtime.table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert found == brute(rows, S.Rule())
