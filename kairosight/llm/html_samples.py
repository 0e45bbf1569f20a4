"""Pages made up with known main text, to train and test the extractor: many layouts, words of no language."""

from __future__ import annotations

import html
import random

CONTENT, PASSAGE, DROPPED = 0, 1, 2
_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er ion th é ü ñ".split()


class Sampler:
    """Writes one page; `labels` holds the class of each element that the parser makes a node of, in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.text: list[str] = []
        self.style = self.r.choice(["plain", "plain", "shout", "symbols"])
        self.blind = self.r.random() < 0.4  # neither tags nor names tell where the article is

    def word(self) -> str:
        w = "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))
        return {"plain": w, "shout": w.upper() + "!!", "symbols": w + self.r.choice(["***", "&&&", "%%%", "$$$"])}[self.style]

    def words(self, n: int) -> str:
        w = [self.word() for _ in range(n)]
        for i in range(self.r.randint(4, 12), n, self.r.randint(5, 14)):
            w[i - 1] += self.r.choice([".", ",", ".", "?"])
        return " ".join(w) + self.r.choice([".", "", "."])

    def tag(self, name: str, label: int, body, cls: str = "", close: bool = True) -> None:
        attrs = f' class="{cls}"' if cls and self.r.random() < 0.7 else f" id='{cls}'" if cls else ""
        self.out.append(f'<{name}{attrs} data-k="{label}">')
        body() if callable(body) else self.out.append(html.escape(body, quote=False))
        if close:
            self.out.append(f"</{name}>")

    def links(self, n: int, label: int = DROPPED, items: bool = True) -> None:
        for _ in range(n):
            link = f'<a href="/{self.r.randint(1, 99)}">{html.escape(self.words(self.r.randint(1, 4)), quote=False)}</a>'
            self.tag("li", label, lambda link=link: self.out.append(link), close=self.r.random() < 0.9) if items else self.out.append(link + " ")

    def menu(self, tag: str, cls: str) -> None:
        def body():
            if self.r.random() < 0.3:
                self.tag(self.r.choice(["h2", "h3", "div"]), DROPPED, self.words(2))
            if self.r.random() < 0.75:
                self.tag("ul", DROPPED, lambda: self.links(self.r.randint(2, 12)))
            else:
                self.links(self.r.randint(2, 8), items=False)

        self.tag(tag, DROPPED, body, cls)

    def junk(self) -> None:
        r = self.r
        kind = r.choice(["ad", "ad", "cookie", "side", "form", "share", "related", "comments", "menu", "crumbs", "notice"])
        box = r.choice(["div", "div", "section", "aside"])
        if kind == "ad":
            self.tag(box, DROPPED, self.words(r.randint(2, 40)), r.choice(["ad", "ads", "advert", "sponsored", "promo-box", "banner-ad", "ad-slot"]))
        elif kind in ("cookie", "notice"):
            self.tag(box, DROPPED, lambda: (self.tag("p", DROPPED, self.words(r.randint(5, 40))), self.tag("button", DROPPED, self.words(1))), r.choice(["cookie-notice", "consent", "notice", "alert", "popup", "newsletter", "gdpr"]))
        elif kind == "side":
            self.tag("aside" if r.random() < 0.6 else "div", DROPPED, lambda: (self.tag("h3", DROPPED, self.words(2)), [self.tag("p", DROPPED, self.words(r.randint(3, 40))) for _ in range(r.randint(1, 3))]), r.choice(["sidebar", "widget", "side", "", "rail"]) if box != "div" else "sidebar")
        elif kind == "form":
            self.tag("form", DROPPED, lambda: (self.tag("p", DROPPED, self.words(r.randint(2, 12))), self.out.append('<input name="q">'), self.tag("button", DROPPED, self.words(1))), r.choice(["", "search", "signup"]))
        elif kind == "share":
            self.tag("div", DROPPED, lambda: self.links(r.randint(2, 5), items=False), r.choice(["share", "social", "share-bar"]))
        elif kind == "related":
            self.menu(box, r.choice(["related", "more-stories", "recommended", "tags"]))
        elif kind == "comments":
            def one():
                self.tag(r.choice(["div", "li", "article"]), DROPPED, lambda: (self.tag("span", DROPPED, self.words(2), "author"), [self.tag("p", DROPPED, self.words(r.randint(3, 50))) for _ in range(r.randint(1, 2))]), r.choice(["comment", "reply", "comment-body"]))

            self.tag(r.choice(["section", "div", "ol"]), DROPPED, lambda: (self.tag("h2", DROPPED, self.words(2)), [one() for _ in range(r.randint(1, 5))]), r.choice(["comments", "responses comments", "comment-list", "disqus"]))
        else:
            self.menu("nav" if r.random() < 0.5 else "div", r.choice(["menu", "breadcrumbs", "navbar", "nav", "pagination"]))

    def opaque(self) -> str:
        """A name that says nothing."""
        r = self.r
        return r.choice(["", "", "css-" + "".join(r.choices("0123456789abcdef", k=r.randint(3, 6))), "".join(r.choices("abcdefghijkz", k=r.randint(1, 4))) + str(r.randint(1, 99)), "col-" + str(r.randint(1, 12)), "box", "inner", "wrap"])

    def references(self) -> None:
        """A paragraph and a list of links that belongs to it."""
        r = self.r
        self.tag("p", CONTENT, self.words(r.randint(2, 30)) + r.choice([":", "", ""]))
        self.tag(r.choice(["ul", "ol"]), CONTENT, lambda: self.links(r.randint(1, 7), CONTENT))

    def paragraph(self, name: str) -> None:
        self.tag(name, CONTENT, self.words(self.r.choice([3, 8, 20, 40, 80, 150])), self.opaque() if self.r.random() < 0.3 else "")

    def content(self) -> None:
        """Blocks of the article."""
        r = self.r
        if self.blind:
            block = r.choice(["p", "p", "p", "div"])
            if r.random() < 0.6:
                self.tag(r.choice(["h1", "h1", "h2"]), CONTENT, self.words(r.randint(1, 10)))
            for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
                kind = r.random()
                if kind < 0.8:
                    self.paragraph(block)
                elif kind < 0.87:
                    self.references()
                elif kind < 0.93:
                    self.tag(r.choice(["h2", "h3"]), CONTENT, self.words(r.randint(1, 7)))
                else:
                    self.tag("blockquote", CONTENT, self.words(r.randint(4, 30)))
            return
        if r.random() < 0.8:
            self.tag(r.choice(["h1", "h1", "h2"]), CONTENT, self.words(r.randint(1, 10)))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.7:
                n = r.choice([1, 3, 8, 20, 40, 80, 150])
                if r.random() < 0.25:
                    self.tag("p", CONTENT, lambda n=n: self.out.append(f"<b>{html.escape(self.words(n), quote=False)}{r.choice(['</b>', '<br>', '</b><br>'])}"), close=r.random() < 0.5)
                elif r.random() < 0.25:
                    self.tag("p", CONTENT, lambda n=n: (self.out.append(html.escape(self.words(n), quote=False) + " "), self.links(1, items=False)))
                else:
                    self.tag("p", CONTENT, self.words(n), close=r.random() < 0.8)
            elif kind < 0.78:
                self.tag(r.choice(["h2", "h3"]), CONTENT, self.words(r.randint(1, 7)))
            elif kind < 0.86:
                self.tag(r.choice(["ul", "ol"]), CONTENT, lambda: [self.tag("li", CONTENT, self.words(r.randint(1, 20))) for _ in range(r.randint(1, 6))])
            elif kind < 0.9:
                self.tag("blockquote", CONTENT, lambda: self.tag("p", CONTENT, self.words(r.randint(4, 30))))
            elif kind < 0.93:
                self.tag("table", CONTENT, lambda: [self.tag("tr", CONTENT, lambda: [self.tag("td", CONTENT, self.words(r.randint(1, 5))) for _ in range(3)]) for _ in range(r.randint(1, 4))])
            elif kind < 0.95:
                self.tag("div", CONTENT, self.words(r.randint(10, 60)))
            elif kind < 0.98:
                self.references()
            else:
                self.tag("pre", CONTENT, self.words(r.randint(3, 30)))
            if r.random() < 0.08:
                self.junk()

    def page(self) -> str:
        r = self.r
        if self.blind:
            return self.blind_page()
        self.out.append(f"<!DOCTYPE html><html><head><title>{html.escape(self.words(4))}</title><style>p{{}}</style><script>var t='</p>';</script></head><body data-k=\"{PASSAGE}\">")

        def some(p, f, *a):
            if r.random() < p:
                f(*a)

        if r.random() < 0.4:
            self.tag(r.choice(["header", "header", "div"]), DROPPED, lambda: (self.tag(r.choice(["h1", "div", "p"]), DROPPED, self.words(r.randint(1, 5))), some(0.5, self.menu, "nav", "")), r.choice(["header", "site-header", "masthead", "banner"]))
        some(0.7, self.menu, r.choice(["nav", "nav", "div"]), r.choice(["menu", "nav", "navbar", "main-menu", "navigation"]) if r.random() < 0.6 else "nav")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            self.junk()
        named = r.choice(["article", "content", "post", "entry-content", "story-body", "article-body", "post-content", "main-text"])
        shape = r.random()
        if shape < 0.45:
            body = lambda: self.tag("article", CONTENT, self.content, r.choice(["", "", named]))
        elif shape < 0.6:
            body = lambda: self.tag("main", CONTENT, self.content, r.choice(["", named]))
        else:
            body = lambda: self.tag(r.choice(["div", "div", "section"]), CONTENT, self.content, named)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner = body

            def body(inner=inner):
                before, after = r.random() < 0.2, r.random() < 0.4
                self.tag(r.choice(["div", "main", "div"]) if shape < 0.45 else "div", PASSAGE, lambda: (before and self.junk(), inner(), after and self.junk()), r.choice(["", "wrapper", "container", "page", "layout", "row", "columns"]))

        body()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            self.junk()
        some(0.8, lambda: self.tag(r.choice(["footer", "footer", "div"]), DROPPED, lambda: (self.out.append("&copy; " + html.escape(self.words(r.randint(2, 30)), quote=False)), some(0.4, self.menu, "div", "links")), r.choice(["footer", "site-footer", "copyright", "bottom"])))
        self.out.append("</body></html>")
        return self.finished()

    def cells(self, body) -> None:
        """A table that only lays the page out: a menu beside the article."""
        r = self.r
        menu = lambda: self.tag("td", DROPPED, lambda: self.tag("ul", DROPPED, lambda: self.links(r.randint(3, 9))) if r.random() < 0.5 else self.links(r.randint(3, 9), items=False))
        own = lambda: self.tag("td", CONTENT, body)
        self.tag("table", PASSAGE, lambda: self.tag("tr", PASSAGE, lambda: (menu(), own()) if r.random() < 0.7 else (own(), menu())))

    def blind_page(self) -> str:
        """The article under body itself, plain or opaquely named boxes, sections, tables or as bare text; junk tells itself by tag, name or links."""
        r = self.r
        shape = r.choice(["body", "body", "box", "box", "box", "section", "table", "text"])
        self.out.append(f'<!DOCTYPE html><html><head><title>{html.escape(self.words(4))}</title></head><body data-k="{CONTENT if shape == "text" else PASSAGE}">')

        def edge(first: bool) -> None:
            kind = r.random()
            if kind < 0.35:
                self.tag("ul", DROPPED, lambda: self.links(r.randint(3, 10)), self.opaque())
            elif kind < 0.55:
                self.tag("div", DROPPED, lambda: self.links(r.randint(2, 9), items=False), self.opaque())
            elif kind < 0.65:
                self.menu("nav", "")
            elif kind < 0.75:
                self.tag("aside", DROPPED, lambda: (self.tag(r.choice(["h3", "h4", "p"]), DROPPED, self.words(r.randint(1, 3))), self.tag("ul", DROPPED, lambda: self.links(r.randint(1, 6)))), self.opaque())
            elif kind < 0.9:
                self.tag("header" if first else "footer", DROPPED, lambda: (self.tag(r.choice(["p", "div", "h1"] if first else ["p", "div"]), DROPPED, ("" if first else "© ") + self.words(r.randint(1, 12))), self.links(r.randint(0, 4), items=False)), self.opaque())
            else:
                self.junk()

        for _ in range(r.choice([0, 1, 1, 1, 2])):
            edge(True)
        if shape == "body":
            self.content()
        elif shape == "text":
            for _ in range(r.randint(1, 6)):
                self.out.append(html.escape(self.words(r.choice([8, 20, 60, 120])), quote=False) + r.choice(["<br><br>", "<br>", " <hr>"]))
        elif shape == "table":
            self.cells(self.content)
        else:
            body = lambda: self.tag("section" if shape == "section" else "div", CONTENT, self.content, self.opaque())
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                inner = body

                def body(inner=inner):
                    before, after = r.random() < 0.2, r.random() < 0.3
                    self.tag("div", PASSAGE, lambda: (before and edge(True), inner(), after and edge(False)), self.opaque())

            body()
        for _ in range(r.choice([0, 1, 1, 2])):
            edge(False)
        self.out.append("</body></html>")
        return self.finished()

    def finished(self) -> str:
        r = self.r
        source = "".join(self.out)
        return source[: r.randint(len(source) // 2, len(source))] if r.random() < 0.15 else source


def pages(n: int, seed: int) -> list[str]:
    """Made-up pages; every element carries its class in data-k."""
    return [Sampler(seed * 1_000_003 + i).page() for i in range(n)]
