"""Labelled pages for the page model: layouts drawn by rule, every element marked as content, boilerplate or wrapper."""

from __future__ import annotations

import random

# Words that sites name their parts with, by what the part is.
CONTENT_NAMES = "content article post entry story body text main page".split()
PARTS = {
    "menu": "nav menu navbar navigation toolbar tabs breadcrumb pagination pager toc sitemap".split(),
    "header": "header masthead topbar branding logo banner hero site".split(),
    "footer": "footer bottom copyright colophon legal imprint".split(),
    "side": "sidebar side aside widget rail related recommended popular trending tag archive".split(),
    "notice": "notice cookie consent gdpr alert warning message popup modal overlay paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense outbrain".split(),
    "form": "form search login signup subscribe newsletter register contact".split(),
    "share": "share social follow like button author byline meta".split(),
    "comments": "comment comments reply replies discussion respond thread disqus guestbook".split(),
}
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
CONTENT, PLAIN, WRAPPER = "c", "b", "w"


class _Layout:
    """Draws one page. Words carry no meaning: the model sees their number only."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, end: str = ".") -> str:
        n = self.r.randint(low, high)
        return " ".join("lorem ipsum dolor sit amet consectetur".split()[self.r.randrange(6)] for _ in range(n)) + end

    def named(self, names: list[str]) -> str:
        name = self.r.choice(names)
        name = self.r.choice([name, name, f"{self.r.choice(['site', 'page', 'main', 'block', 'x'])}-{name}", f"{name}-{self.r.choice(['box', 'area', 'list', 'inner', 'wrap'])}"])
        return self.r.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"', f' class="{name} {self.r.choice(["row", "clearfix", "col-8", "js"])}"'])

    def el(self, tag: str, mark: str, inner: str, attrs: str = "") -> str:
        return f'<{tag}{attrs} data-y="{mark}">{inner}</{tag}>'

    def links(self, n: int, mark: str = PLAIN) -> str:
        return self.el("ul", mark, "".join(self.el("li", mark, f'<a href="/x">{self.words(1, 3, "")}</a>') for _ in range(n)))

    def part(self, kind: str) -> str:
        """A part of the page that is no content."""
        r = self.r
        tag = TAGS.get(kind) if r.random() < 0.6 else None
        attrs = "" if tag and r.random() < 0.6 else self.named(PARTS[kind])
        tag = tag or r.choice(["div", "div", "section", "ul"] if kind == "menu" else ["div", "div", "section"])
        p = lambda a, b: self.el("p", PLAIN, self.words(a, b))
        if kind == "menu":
            items = "".join(self.el("li", PLAIN, f'<a href="/x">{self.words(1, 3, "")}</a>') for _ in range(r.randint(2, 9)))
            inner = items if tag == "ul" else r.choice([self.el("ul", PLAIN, items), "".join(f'<a href="/x">{self.words(1, 2, "")}</a> ' for _ in range(r.randint(2, 8)))])
        elif kind == "comments":
            each = lambda: self.el("div", PLAIN, p(3, 60) + r.choice(["", p(5, 40)]), self.named(PARTS[kind])) if r.random() < 0.5 else p(3, 80)
            inner = r.choice(["", self.el("h3", PLAIN, self.words(1, 3, ""))]) + "".join(each() for _ in range(r.randint(1, 8)))
        elif kind == "form":
            inner = r.choice(["", p(2, 15)]) + self.el("label", PLAIN, self.words(1, 3, "")) + "<input name=q>" + r.choice(["", self.el("select", PLAIN, "<option data-y=b>one<option data-y=b>two")]) + self.el("button", PLAIN, "Go")
        elif kind == "side":
            inner = r.choice(["", self.el("h3", PLAIN, self.words(1, 3, ""))]) + r.choice([self.links(r.randint(2, 8)), p(5, 60), p(5, 40) + self.links(3)])
        else:
            inner = r.choice([self.words(2, 25), p(2, 40), p(2, 30) + r.choice(["", self.links(r.randint(1, 5))]), self.el("div", PLAIN, self.words(2, 30))])
        return self.el(tag, PLAIN, inner, attrs)

    def content(self) -> str:
        """A piece of content."""
        r = self.r
        p = lambda a, b: self.el("p", CONTENT, self.words(a, b))
        kind = r.random()
        if kind < 0.62:
            return p(1, r.choice([3, 20, 120]))
        if kind < 0.72:
            return self.el(r.choice(["h2", "h2", "h3", "h4"]), CONTENT, self.words(1, 10, ""))
        if kind < 0.80:
            return self.el(r.choice(["ul", "ol"]), CONTENT, "".join(self.el("li", CONTENT, self.words(1, 25)) for _ in range(r.randint(2, 6))))
        if kind < 0.84:
            return self.el("blockquote", CONTENT, r.choice([p(4, 40), self.words(4, 40)]))
        if kind < 0.87:
            return self.el("pre", CONTENT, self.words(3, 40))
        if kind < 0.90:
            return self.el("figure", CONTENT, self.el("figcaption", CONTENT, self.words(2, 20)))
        if kind < 0.93:
            rows = "".join(self.el("tr", CONTENT, "".join(self.el("td", CONTENT, self.words(1, 6, "")) for _ in range(3))) for _ in range(r.randint(1, 4)))
            return self.el("table", CONTENT, self.el("tbody", CONTENT, rows))
        if kind < 0.97:
            return self.el("p", CONTENT, f'{self.words(3, 30)} <a href="/x">{self.words(1, 6, "")}</a> {self.words(2, 30)}')
        return self.el("div", CONTENT, self.words(5, 80))

    def body(self) -> str:
        r = self.r
        pieces = [self.content() for _ in range(r.choice([1, 2, 4, 8, 16]))]
        for kind, share in (("advert", 0.15), ("share", 0.15), ("side", 0.08), ("notice", 0.05), ("form", 0.05)):
            if r.random() < share:
                pieces.insert(r.randint(0, len(pieces)), self.part(kind))
        title = self.el("h1", CONTENT, self.words(2, 12, ""))
        pieces.insert(0, r.choice([title, title, title, self.el("header", CONTENT, title), ""]))
        if r.random() < 0.15:
            pieces.append(self.part("comments"))
        return "".join(pieces)

    def page(self) -> str:
        r = self.r
        inner = self.body()
        kind = r.random()
        if kind < 0.40:
            inner = self.el("article", CONTENT, inner, r.choice(["", "", self.named(CONTENT_NAMES)]))
        elif kind < 0.55:
            inner = self.el("main", CONTENT, inner, r.choice(["", self.named(CONTENT_NAMES)]))
        elif kind < 0.85:
            inner = self.el(r.choice(["div", "div", "section"]), CONTENT, inner, self.named(CONTENT_NAMES))
        elif kind < 0.90:
            inner = self.el("table", WRAPPER, self.el("tr", WRAPPER, self.el("td", PLAIN, self.links(4)) + self.el("td", CONTENT, inner)))
        elif kind < 0.95:
            inner = self.el("div", CONTENT, inner)
        before = [self.part(k) for k in ("header", "menu", "notice", "advert", "form", "menu") if r.random() < 0.4]
        after = [self.part(k) for k in ("share", "comments", "side", "advert", "form", "notice", "footer") if r.random() < 0.35]
        r.shuffle(before)
        if kind < 0.4 and r.random() < 0.3:
            inner = self.el("main", WRAPPER, inner + "".join(after[:1]))
            after = after[1:]
        if r.random() < 0.4:
            inner = self.el("div", WRAPPER, "".join(before[-1:]) + inner + "".join(after[:1]), self.named(["wrapper", "container", "page", "layout", "site", "outer", "main"]))
            before, after = before[:-1], after[1:]
        body = self.el("body", WRAPPER, "".join(before) + inner + "".join(after))
        return f"<!DOCTYPE html><html data-y=w><head data-y=b><title>{self.words(2, 9, '')}</title></head>{body}</html>"

    def bare(self) -> str:
        """Text without any structure to speak of."""
        text = self.words(3, 80)
        return self.r.choice([text, f"<p data-y=c>{text}</p><p data-y=c>{text}</p>", f"<html data-y=c><body data-y=c>{text}</body></html>"])


def labelled_pages(rows: int = 500, seed: int = 11) -> list[str]:
    """rows pages in HTML; data-y of an element is c, b or w. One in 20 is bare."""
    return [_Layout(seed * 1_000_003 + k).bare() if k % 20 == 19 else _Layout(seed * 1_000_003 + k).page() for k in range(rows)]
