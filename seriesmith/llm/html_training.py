"""Labelled pages to train the block labeller on, laid out at random from a seed.

Every page has an article among page furniture. Which block is which is known because the words of
the article carry a mark, which is taken off again before anything is learned from the text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from seriesmith.llm.html_blocks import Block, leaf_blocks

MARK = "⁠"
#: Names that class and id attributes are drawn from, by what the element holds.
NAMES = {
    "article": "article content post entry story main body text article-body post-content entry-content main-content post-body story-body article-text blog-post".split(),
    "menu": "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs links".split(),
    "header": "header masthead topbar site-header page-header banner-top logo".split(),
    "footer": "footer site-footer page-footer copyright legal bottom colophon".split(),
    "side": "sidebar side aside related widget rail recommended trending more-stories related-posts widget-area read-more".split(),
    "notice": "notice cookie cookie-notice consent banner alert gdpr cookie-banner popup modal".split(),
    "advert": "ad ads advert advertisement sponsored promo ad-slot sponsor banner-ad adsbygoogle ad-container".split(),
    "form": "form search newsletter subscribe signup login search-form".split(),
    "comments": "comments comment comment-list discussion responses replies comment-body reader-comments".split(),
}
#: Names of layout that hold an article and furniture alike, and names that say what an article has beside it.
LAYOUT = "page wrapper container layout site wrap row grid outer inner columns page-wrapper site-content".split()
BESIDE = "sidebar-left has-sidebar with-sidebar right-sidebar no-comments has-comments with-ads has-ads header-fixed no-header sticky-nav has-nav has-banner with-footer menu-open".split()
_SYLLABLES = "an er in on the re ti es or ou ea st en le la de el os ar ie ung sch ein der que ent ion pa vi mi lo ta ci ra zu".split()

#: What sentences end with; text alone should not give a block away.
ENDINGS = [".", ".", ".", "!", "?", "", "", "%%%", ".***", ",", ")"]


def _lexicon(rng: random.Random, n: int = 2000) -> list[str]:
    return ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


class _Maker:
    def __init__(self, rng: random.Random, lexicon: list[str]):
        self.rng, self.lexicon = rng, lexicon

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.lexicon, k=self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.rng.choice(ENDINGS) for _ in range(self.rng.randint(low, high)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.words(1, 1)}">{text}</a>'

    def name(self, kind: str) -> str:
        return self.rng.choice(["class", "class", "class", "id"]) + f'="{self.rng.choice(NAMES[kind])}"'

    def box(self, kind: str, tags: tuple[str, ...], inner: str) -> str:
        """An element whose tag says what it holds, or a plain one whose name does."""
        r = self.rng
        if kind != "article" and r.random() < 0.25:  # neutral elements within
            inner = f'<div class="{r.choice([*LAYOUT, "content", "body", "text", "main"])}">{inner}</div>'
        if tags and r.random() < 0.6:
            tag = r.choice(tags)
            name = f" {self.name(kind)}" if r.random() < 0.4 else ""
            if kind == "article" and r.random() < 0.3:
                name = f' class="{" ".join(r.sample([*NAMES[kind], *BESIDE], 2))}"'
            return f"<{tag}{name}>{inner}</{tag}>"
        tag = r.choice(["div", "div", "section"])
        if kind == "article" and r.random() < 0.25:
            names = [r.choice(NAMES[kind]), r.choice(BESIDE)]
            r.shuffle(names)
            return f'<{tag} class="{" ".join(names)}">{inner}</{tag}>'
        return f"<{tag} {self.name(kind)}>{inner}</{tag}>"

    def items(self, low: int, high: int) -> str:
        cells = "".join(f"<li>{self.link(self.words(1, 3))}</li>" for _ in range(self.rng.randint(low, high)))
        return f"<ul>{cells}</ul>"

    def prose(self, low: int, high: int) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(low, high)):
            text = self.sentences(1, 6)
            if r.random() < 0.3:
                text = f"<{(t := r.choice(['b', 'em', 'strong', 'i']))}>{text}</{t}>"
            if r.random() < 0.15:
                text += " " + self.link(self.words(1, 3))
            out.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
        return "".join(out)

    def article(self) -> str:
        r = self.rng
        parts = [f"<h1>{self.words(2, 10)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 4)):
            parts.append(self.prose(1, 5))
            kind = r.random()
            if kind < 0.2:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.3:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 15)}.</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.38:
                parts.append(f"<blockquote>{self.prose(1, 1)}</blockquote>")
            elif kind < 0.44:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.5:
                parts.append(f"<pre>{self.words(3, 12)}</pre>")
        return "".join(parts)

    def furniture(self, kind: str) -> str:
        r = self.rng
        if kind == "menu":
            return self.box(kind, ("nav", "menu"), self.items(3, 9) if r.random() < 0.8 else " | ".join(self.link(self.words(1, 2)) for _ in range(r.randint(3, 7))))
        if kind == "header":
            return self.box(kind, ("header",), f"<div>{self.words(1, 3)}</div><p>{self.words(2, 8)}</p>" + (self.furniture("menu") if r.random() < 0.5 else ""))
        if kind == "footer":
            sign = r.choice(["&copy; ", "© ", "", ""])
            return self.box(kind, ("footer",), r.choice(["", self.items(2, 5), self.prose(1, 1)]) + f"<p>{sign}{self.words(1, 4)} &middot; {self.words(2, 8)}.</p>" * r.randint(0, 1) + f"{sign}{self.words(2, 9)}")
        if kind == "side":
            return self.box(kind, ("aside",), f"<h3>{self.words(1, 4)}</h3>" + (self.items(2, 6) if r.random() < 0.5 else self.prose(1, 3)))
        if kind == "form":
            return self.box(kind, (), f'<form action="/x"><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 12)}.</p><button>{self.words(1, 2)}</button></form>')
        if kind == "comments":
            one = lambda: r.choice(['<div class="comment">{}</div>', "<li>{}</li>", '<article class="comment">{}</article>', "<div>{}</div>"]).format(
                f"<b>{self.words(1, 2)}</b> " * r.randint(0, 1) + self.prose(1, 2)
            )
            return self.box(kind, (), f"<h3>{self.words(1, 2)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 5))))
        text = self.sentences(1, 3)  # notices and adverts
        return self.box(kind, ("dialog",) if kind == "notice" and r.random() < 0.2 else (), text if r.random() < 0.5 else f"<p>{text}</p>" + f"<button>{self.words(1, 2)}</button>" * r.randint(0, 1))

    def interrupted(self, inner: str) -> str:
        """The article with furniture between its paragraphs, some of it a named paragraph or list only."""
        r = self.rng
        for kind in ("advert", "side", "form", "menu", "notice", "comments"):
            for _ in range(r.choice([0, 0, 0, 1, 1, 2]) if kind in ("advert", "side") else r.random() < 0.2):
                cut = inner.find("<p>", r.randint(0, max(0, len(inner) - 1)))
                where = cut if cut >= 0 and kind != "comments" else len(inner)
                if kind in ("advert", "side") and r.random() < 0.25:
                    piece = r.choice([f"<p {self.name(kind)}>{self.sentences(1, 2)}</p>", self.items(1, 4).replace("<ul", f"<ul {self.name(kind)}")])
                else:
                    piece = self.furniture(kind)
                inner = inner[:where] + piece + inner[where:]
        return inner

    def plain(self, inner: str) -> str:
        """The article in elements that say nothing, or in none."""
        for _ in range(self.rng.choice([0, 0, 1, 2, 3])):
            inner = f"<div>{inner}</div>"
        return inner

    def page(self) -> str:
        r = self.rng
        before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.2), ("side", 0.15)) if r.random() < p]
        after = [k for k, p in (("side", 0.4), ("advert", 0.25), ("comments", 0.4), ("form", 0.2), ("menu", 0.15), ("notice", 0.1)) if r.random() < p]
        r.shuffle(before)
        r.shuffle(after)
        inner = _marked(self.article())
        if r.random() < 0.04:  # text and nothing else
            return MARK + re.sub("<[^>]*>", " ", self.prose(1, 3))
        if r.random() < 0.7:
            inner = self.interrupted(inner)
        main = self.plain(inner) if r.random() < 0.15 else self.box("article", ("article", "article", "main"), inner)
        if r.random() < 0.3:
            main = f"<main>{main}{self.furniture('comments') if r.random() < 0.2 else ''}</main>"
        if r.random() < 0.2:
            main = f'<div class="{r.choice([*LAYOUT, *BESIDE])}">{main}{self.furniture("side") if r.random() < 0.3 else ""}</div>'
        title = self.words(2, 8)
        body = "".join(map(self.furniture, before)) + main + "".join(map(self.furniture, after)) + (self.furniture("footer") if r.random() < 0.85 else "")
        if r.random() < 0.4:
            body = f'<div class="{" ".join(r.sample([*LAYOUT, *BESIDE], r.randint(1, 2)))}">{body}</div>'
        if r.random() < 0.06:
            body = f'<form id="{r.choice(["form", "page-form", "main-form"])}" method="post">{body}</form>'
        if r.random() < 0.25:  # a fragment: no wrapper, perhaps nothing but the article
            return body if r.random() < 0.4 else main
        head = f' class="{" ".join(r.sample(BESIDE, 2))}"' if r.random() < 0.2 else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body{head}>{body}</body></html>"


def _marked(fragment: str) -> str:
    """MARK after every tag that text follows."""
    return fragment.replace(">", ">" + MARK)


def labelled_pages(n: int, seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    """Blocks of ``n`` pages, each with 1 for the article's and 0 for others."""
    rng = random.Random(seed)
    lexicon = _lexicon(rng)
    for _ in range(n):
        blocks = leaf_blocks(_Maker(rng, lexicon).page())
        labels = [int(MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "."
        yield blocks, labels
