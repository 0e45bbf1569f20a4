import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kairosight.llm import fill_in_middle as M
from kairosight.llm import runtime


def brute(doc_id, text, percent=100, first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= percent:
        return (doc_id, len(lines), "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < first else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, len(lines), form, len(p), len(m), sha(out), sha(text))


ROWS = [(1, "a\nb\nc"), (2, "\n\n\n"), (3, ""), (4, None), (5, "x <M> y\n"), (6, "é\n漢字\n🙂 end"), (7, "one line"), (None, "no\nid\n"), (7, "one line"), (8, "<\nS>\n<P\n>M>"), (9, "a\r\nb\x0bc d\n"), (10, "<P>"), (-3, "x\ny\n"), (11, "\n")]


def test_equals_brute_force(spark):
    rows = ROWS + [(100 + i, "".join(f"line {j} <\n" for j in range(i))) for i in range(60)] + [(500, "word " * 400_000 + "\n" + "z\n" * 200_000)]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    assert sorted(map(str, map(tuple, M.query(docs).collect()))) == sorted(str(brute(i, t)) for i, t in rows)
    assert {r.form for r in M.query(docs).collect()} == {"plain", "spm", "psm"}


def test_shares_and_carried_columns(spark):
    rule = M.Rule(percent=40, suffix_first_percent=10)
    rows = [(i, "a\nb\nc\n") for i in range(400)]
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, fim long")
    out = M.transformed(docs, rule)
    assert out.columns == ["doc_id", "text", "fim", "fim_"]
    found = out.select("doc_id", "fim", "fim_.*").collect()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in found} == {brute(i, t, 40, 10) for i, t in rows}
    assert 100 < sum(r.form != "plain" for r in found) < 220 and all(r.fim == 2 * r.doc_id for r in found)
    assert all(M.restore(r.output, r.form) == "a\nb\nc\n" for r in found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\nab é"), st.integers(-5, 10**6))
def test_round_trip(text, doc_id):
    n, form, a, b, out = M.transform(text, doc_id, M.Rule(), M.regex.compile(M.Rule.unit))
    assert M.restore(out, form) == text
    assert (doc_id, n, form, a, b, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) == brute(doc_id, text)


def test_empty_and_whole_tables(spark):
    docs = runtime.table(spark, "/root/testdata/sf0.001", "documents")
    assert M.query(docs.limit(0)).count() == 0
    assert sorted(map(str, map(tuple, M.query(docs).collect()))) == sorted(str(brute(r.doc_id, r.text)) for r in docs.collect())


@pytest.mark.parametrize("text", ["", "a", "\n"])
def test_unit_ends(text):
    assert list(M.unit_ends(text, M.regex.compile(M.Rule.unit))) == [len(text)] * bool(text)
