"""A small forgiving HTML parser: nodes for elements that matter to layout, and the text of each."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select datalist head title textarea".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, up to the nearest of those.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("article aside body html main nav section table td th div header footer form".split())


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    order: int  # among the siblings
    names: str  # class, id and role, lower case
    block: bool
    children: list[int] = field(default_factory=list)
    own_chars: int = 0
    own_link_chars: int = 0
    links: int = 0
    stops: int = 0
    words: int = 0


@dataclass
class Page:
    nodes: list[Node]
    #: (node, text) in page order; a text of None is a block boundary.
    flow: list[tuple[int, str | None]]


def parse(source: str) -> Page:
    """Nodes in document order (parents first) and the flow of texts."""
    nodes = [Node("html", -1, 0, 0, "", True)]
    flow: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the node that holds their text
    links = 0
    endless: set[str] = set()  # silent elements of which no end tag follows

    def text(raw: str) -> None:
        if not raw:
            return
        t = html.unescape(raw)
        at = stack[-1][1]
        flow.append((at, t))
        n = len(t.strip())
        if n:
            node = nodes[at]
            node.own_chars += n
            node.words += t.count(" ") + 1
            node.stops += t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
            if links:
                node.own_link_chars += n

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag, at = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                flow.append((at, None))

    at = 0
    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE or tag == "p" and stack[i][0] in _SCOPE:
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1 and tag == "html":
            continue
        if tag == "br" or tag == "wbr":
            flow.append((stack[-1][1], " " if tag == "br" else ""))
            continue
        if tag in VOID:
            if tag == "hr":
                flow.append((stack[-1][1], None))
            continue
        if tag in SILENT:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(source, at)
            if end is None:
                endless.add(tag)
            if end:
                at = end.end()
            elif tag in RAW:
                at = n
            elif tag == "head":
                end = re.compile(r"(?=<body[\s>])", re.IGNORECASE).search(source, at)
                at = end.start() if end else at
            if tag not in ("svg", "math", "audio", "video", "canvas"):
                flow.append((stack[-1][1], None))
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag in _ENDS:
            ended, limits = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ended:
                    close(i)
                    break
                if stack[i][0] in limits:
                    break
        holder = stack[-1][1]
        names = ""
        if m[3] and not m[3].isspace():
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])}
            names = " ".join(found[k] for k in ("class", "id", "role") if k in found).lower()
        block = tag not in INLINE
        if tag == "a":
            links += 1
            nodes[holder].links += 1
        if block:
            flow.append((holder, None))
        if block or names and tag != "a":
            node = len(nodes)
            parent = nodes[holder]
            nodes.append(Node(tag, holder, parent.depth + 1, len(parent.children), names, block))
            parent.children.append(node)
            holder = node
        stack.append((tag, holder))
    return Page(nodes, flow)


def blocks(page: Page, keep: list[bool]) -> list[str]:
    """Texts of the blocks of kept nodes, white space collapsed."""
    out, now = [], []
    for node, t in page.flow:
        if t is None:
            if now:
                line = " ".join("".join(now).split())
                if line:
                    out.append(line)
                now = []
        elif keep[node]:
            now.append(t)
    line = " ".join("".join(now).split())
    if line:
        out.append(line)
    return out
