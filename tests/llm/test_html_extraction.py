import html
import random
import re

import numpy as np
import pytest

from kairosight.llm import html_dom, html_samples, runtime
from kairosight.llm import html_extraction as H
from kairosight.llm.boosted_trees import BoostedTrees


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_boosted_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = BoostedTrees(2, rounds=20, depth=3).fit(x[:1500], y[:1500])
    assert (m.log_probabilities(x[1500:]).argmax(1) == y[1500:]).mean() > 0.95


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(2)
    allowed = {0: (0, 2), 1: (0, 1, 2), 2: (2,)}
    for _ in range(40):
        n = rng.randint(1, 6)
        parents = np.array([-1, *(rng.randrange(i) for i in range(1, n))])
        logp = np.array([[rng.uniform(-3, 0) for _ in range(3)] for _ in range(n)])

        def all_labels(i=0, have=()):
            if i == n:
                yield have
                return
            for label in (0, 1, 2) if i == 0 else allowed[have[parents[i]]]:
                yield from all_labels(i + 1, (*have, label))

        best = max(sum(logp[i, v] for i, v in enumerate(x)) for x in all_labels())
        found = H.decode(parents, logp)
        assert sum(logp[i, v] for i, v in enumerate(found)) == pytest.approx(best)


def test_held_out_pages(model):
    """Pages of other seeds than the training's: nearly all come out exactly."""
    right = 0
    pages = html_samples.pages(120, 77)
    for source in pages:
        page, y = H._labelled(source)
        right += html_dom.blocks(page, (H.labels([page], model)[0] == 0).tolist()) == html_dom.blocks(page, (y == 0).tolist())
    assert right >= 0.95 * len(pages)


CASES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>One\n two&nbsp;three<br>four<p>Five <b>six</article><footer>&copy; x</footer>", "Title & more\nOne two three four\nFive six"),
    ("<article><p>Text &lt;b&gt; &#233;&#xE9; &eacute</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>more</p></article>", "Text <b> éé é\nmore"),
    ("<body><header><h1>Site</h1></header><main><h1>Head</h1><p>Main text of some length, with words.</p><aside class=related><a href=/1>other</a></aside></main><section id=comments><div class=comment><p>First! nice one.</p></div></section></body>", "Head\nMain text of some length, with words."),
    ("<article><p>cut off in the mid", "cut off in the mid"),
    ("<article><p>cut off in a tag <a href=\"x", "cut off in a tag"),
    ("", ""),
    (None, ""),
    ("<" * 2000 + "<div>" * 3000, None),
]


def test_cases(spark, model):
    docs = spark.createDataFrame([(i, None if i == 5 else "u", h, "x") for i, (h, _) in enumerate(CASES)] + [(1, "u", CASES[1][0], "x")], "page_id long, url string, html string, text string")
    found = H.extract(docs, model).collect()
    assert len(found) == len(CASES) + 1
    for r in found:
        if CASES[r.page_id][1] is not None:
            assert r.text == CASES[r.page_id][1]
        assert r.n_chars == len(r.text)
    assert H.extract(docs.limit(0), model).count() == 0


def test_small_table(spark, model):
    """These pages have one layout; a regular expression finds their articles."""
    for r in H.extract(runtime.table(spark, "/root/testdata/sf0.001", "pages"), model).join(runtime.table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html"), "page_id").collect():
        inner = re.sub(r"<[^>]*$", "", r.html[r.html.index("<article>") + 9 :].split("</article>")[0]).replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner))
        assert r.text == "\n".join(p for p in parts if p)


# Written by hand in layouts that html_samples does not make, or makes otherwise: the article has no tag or name of its own, or lists links.
SENTENCES = ["The harbour was quiet, and the boats lay still.","Nobody spoke for a while; then, slowly, the captain rose.","He had seen worse, he said, in winter.","They left at noon, with the tide, and came back late."]
MENU = '<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About</a></li></ul>'
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SENTENCES)
TEXT = "\n".join(SENTENCES)
HAND = [
    (f"<html><body>{MENU}<h1>The harbour</h1>{PARAGRAPHS}</body></html>","The harbour\n"+TEXT),
    (f"<html><body><div>{PARAGRAPHS}</div></body></html>",TEXT),
    (f"<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div>{PARAGRAPHS}{PARAGRAPHS}</div><footer>© 2020 Harbour News</footer></body>",TEXT+"\n"+TEXT),
    (f'<body>{MENU}<div class="css-9ab"><div class="css-1x"><h1>The harbour</h1>{PARAGRAPHS}</div></div></body>',"The harbour\n"+TEXT),
    (f"<body><table><tr><td>{MENU}</td><td><h1>The harbour</h1>{PARAGRAPHS}</td></tr></table></body>","The harbour\n"+TEXT),
    (f"<body><section><h2>The harbour</h2>{PARAGRAPHS}</section></body>","The harbour\n"+TEXT),
    (f"<body>{' '.join(SENTENCES)}<br><br>{' '.join(SENTENCES)}</body>"," ".join(SENTENCES)+' '+" ".join(SENTENCES)),
    (f"<body><article><h1>Links</h1>{PARAGRAPHS}<p>See:</p><ul><li><a href=/1>First reference work</a></li><li><a href=/2>Second reference work</a></li><li><a href=/3>Third one</a></li><li><a href=/4>Fourth</a></li></ul></article></body>","Links\n"+TEXT+"\nSee:\nFirst reference work\nSecond reference work\nThird one\nFourth"),
    (f'<body><div id=content><h1>A</h1>{PARAGRAPHS}</div><div class=sidebar><p>About us, the team.</p></div></body>',"A\n"+TEXT),
    (f'<body><div role=main><h1>A</h1>{PARAGRAPHS}</div></body>',"A\n"+TEXT),
    (f'<body><div class="page"><header><div class=logo>Site</div><nav>{MENU}</nav></header><div class="row"><div class="col-8"><h1>A</h1>{PARAGRAPHS}</div><aside><h3>More</h3><ul><li><a href=/x>Other story</a></li></ul></aside></div><footer><p>© 2021</p></footer></div></body>',"A\n"+TEXT),
    ("<body><div>"+"".join(f"<div>{p}</div>" for p in SENTENCES)+"</div></body>",TEXT),
    (f"<body><main><section><h1>A</h1>{PARAGRAPHS}</section><section class=comments><h2>Comments</h2><p>Nice one, really.</p></section></main></body>","A\n"+TEXT),
    (f"<body><center><font>{PARAGRAPHS}</font></center></body>",TEXT),
]


@pytest.mark.parametrize("case", range(len(HAND)))
def test_pages_written_by_hand(model, case):
    source, text = HAND[case]
    assert H.texts([source], model) == [text]


def test_many_unclosed_silent_elements_and_a_very_long_page(model):
    assert H.texts(["<noscript>" * 40_000], model) == [""]
    long = "<article><h1>Long</h1>" + "<p>A sentence, and one more. </p>" * 40_000 + "</article>"
    assert H.texts([long], model) == ["Long" + "\nA sentence, and one more." * 40_000]
