"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded hierarchically.

Each node of a page gets features: its tag, tokens of its class, id and role, what its ancestors are, text
and link density of its subtree, depth, place among its siblings and shares of the page.  Boosted trees give
each node the probabilities of being content (its own text is kept), passage (a frame whose own text goes but
which may hold content) or dropped (with all below it).  Decoding takes the most probable labels of the whole
tree under the rule that below content there is only content or dropped, and below dropped only dropped, so no
descendant contradicts an ancestor.

The trees are trained here, on made-up pages with known main text (a fixed, documented number of them, PAGES);
no page of the corpus is used.

Defined cases: null and empty html give an empty text; truncated and unclosed markup is read as far as it
goes; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_dom, html_samples, runtime, words
from .boosted_trees import BoostedTrees
from .html_samples import CONTENT, DROPPED, PASSAGE

#: Made-up pages that the trees are trained on.
PAGES = 1000
_TAGS = ("html", "body", "main", "article", "section", "div", "p", "heading", "list", "li", "nav", "header", "footer", "aside", "form", "table", "quote", "control", "inline", "other")
_GROUP = (
    {t: "heading" for t in ("h1", "h2", "h3", "h4", "h5", "h6")} | {t: "list" for t in ("ul", "ol", "dl", "menu")} | {t: "li" for t in ("li", "dt", "dd")}
    | {t: "table" for t in ("table", "tr", "td", "th", "tbody", "thead", "caption")} | {t: "quote" for t in ("blockquote", "pre", "figure", "figcaption")}
    | {t: "control" for t in ("button", "fieldset", "legend", "details", "summary", "dialog")} | {t: "inline" for t in html_dom.INLINE}
)
#: Tokens of class, id and role by what they hint at.
_HINTS = {
    "content": "article content post entry story main body text",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination links tabs",
    "head": "header masthead banner top logo",
    "foot": "footer copyright bottom legal",
    "side": "sidebar side aside rail widget related recommended more tags",
    "advert": "ad ads advert advertisement sponsor sponsored promo",
    "notice": "cookie consent notice alert popup modal newsletter subscribe signup gdpr overlay",
    "comment": "comment comments reply replies responses disqus respond",
    "share": "share social follow",
}
_HINT_OF = {w: i for i, (_, ws) in enumerate(_HINTS.items()) for w in ws.split()}
_WORDS = re.compile(r"[a-z]+")
_N_HINTS = len(_HINTS)
FEATURES = len(_TAGS) + 2 * _N_HINTS + 29


def features(page: html_dom.Page) -> np.ndarray:
    """One row for each node."""
    nodes = page.nodes
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    chars, links, stops, n_words, n_links, paragraphs, size, inside = (np.zeros(n) for _ in range(8))
    has_main = np.zeros(n)
    tag = np.array([_TAGS.index(g if g in _TAGS else "other") for g in (_GROUP.get(x.tag, x.tag) for x in nodes)])
    for i, x in enumerate(nodes):
        chars[i], links[i], stops[i], n_words[i], n_links[i] = x.own_chars, x.own_link_chars, x.stops, x.words, x.links
    own = chars.copy()
    paragraphs[tag == _TAGS.index("p")] = 1
    size[:] = 1
    main = (tag == _TAGS.index("article")) | (tag == _TAGS.index("main"))
    has_main[main] = 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
        n_words[p] += n_words[i]
        n_links[p] += n_links[i]
        paragraphs[p] += paragraphs[i]
        size[p] += size[i]
        has_main[p] += has_main[i]
    hints = np.zeros((n, _N_HINTS))
    for i, x in enumerate(nodes):
        if x.names:
            for w in _WORDS.findall(x.names):
                h = _HINT_OF.get(w)
                if h is not None:
                    hints[i, h] = 1
    above = np.zeros((n, _N_HINTS))
    up = np.zeros((n, 5))  # article or main, nav or header or footer, aside, form, list above
    kinds = [main, np.isin(tag, [_TAGS.index(t) for t in ("nav", "header", "footer")]), tag == _TAGS.index("aside"), tag == _TAGS.index("form"), tag == _TAGS.index("list")]
    kind = np.column_stack(kinds).astype(float)
    for i in range(1, n):
        p = parent[i]
        above[i] = np.maximum(above[p], hints[p])
        up[i] = np.maximum(up[p], kind[p])
        inside[i] = nodes[i].order
    siblings = np.array([len(nodes[p].children) if p >= 0 else 1 for p in parent])
    safe = np.maximum(parent, 0)
    total = max(chars[0], 1)
    # plain text (outside links) of the siblings before and after, of the parent itself and its siblings
    plain = chars - links
    before, after = np.zeros(n), np.zeros(n)
    for x in nodes:
        if x.children:
            at = np.array(x.children)
            sums = np.cumsum(plain[at])
            before[at], after[at] = sums - plain[at], sums[-1] - sums
    beside = [np.log1p(v) for v in (before, after, before[safe], after[safe], own[safe])]
    x = np.column_stack([
        np.eye(len(_TAGS))[tag], hints, above, up,
        np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), stops / np.maximum(n_words, 1), np.log1p(n_words), np.log1p(n_links),
        np.log1p(paragraphs), np.log1p(size), chars / size, chars / total, chars / np.maximum(chars[safe], 1), np.array([x.depth for x in nodes]),
        inside, siblings, inside / siblings, has_main - main > 0, own / np.maximum(chars, 1),
        *beside, links / np.maximum(n_links, 1), np.full(n, has_main[0] > 0),
    ])
    return x.astype(np.float64)


def decode(parents: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The most probable consistent labels of a tree whose nodes come parents first."""
    n = len(parents)
    best = logp.copy()
    choice = np.zeros((n, 3), np.int64)  # label of a node under each label of its parent
    allowed = {CONTENT: (CONTENT, DROPPED), PASSAGE: (CONTENT, PASSAGE, DROPPED), DROPPED: (DROPPED,)}
    rows, up, picks = best.tolist(), parents.tolist(), choice.tolist()
    for i in range(n - 1, 0, -1):
        row, above = rows[i], rows[up[i]]
        for label, options in allowed.items():
            top = max(options, key=row.__getitem__)
            picks[i][label] = top
            above[label] += row[top]
    out = np.zeros(n, np.int64)
    out[0] = PASSAGE if rows[0][PASSAGE] >= max(rows[0]) else int(np.argmax(rows[0]))
    for i in range(1, n):
        out[i] = picks[i][out[up[i]]]
    return out


_LABEL = re.compile(r' data-k="(\d)"')


def _labelled(source: str) -> tuple[html_dom.Page, np.ndarray]:
    """A made-up page and the classes of its nodes; the hints are read through ids of their own and not seen by the features."""
    marked = _LABEL.sub(lambda m: f' role="k{m[1]}"', source)
    page = html_dom.parse(marked)
    labels = np.full(len(page.nodes), PASSAGE)
    for i, node in enumerate(page.nodes):
        m = re.search(r"\bk(\d)$", node.names)
        if m:
            labels[i] = int(m[1])
            node.names = node.names[: m.start()].strip()
    return page, labels


@lru_cache(maxsize=2)
def trained(n: int = PAGES) -> BoostedTrees:
    """The trees, fitted once a process."""
    found = [_labelled(p) for p in html_samples.pages(n, 1)]
    return BoostedTrees(3).fit(np.concatenate([features(p) for p, _ in found]), np.concatenate([y for _, y in found]))


def labels(found: list[html_dom.Page], model: BoostedTrees) -> list[np.ndarray]:
    """Decoded labels of the nodes of some pages; the trees see all of them at once."""
    logp = model.log_probabilities(np.concatenate([features(p) for p in found]))
    out, at = [], 0
    for p in found:
        n = len(p.nodes)
        out.append(decode(np.array([x.parent for x in p.nodes]), logp[at : at + n]))
        at += n
    return out


def texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    found = [html_dom.parse(s or "") for s in sources]
    return ["\n".join(html_dom.blocks(p, (y == CONTENT).tolist())) for p, y in zip(found, labels(found, model), strict=True)] if found else []


def extract(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages; one narrow pass over the whole html."""
    model = model or trained()

    def run(batch: pa.RecordBatch):
        for part in words.chunks(batch, "html", words.PIECE):
            found = texts(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return runtime.map_batches(read, run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
