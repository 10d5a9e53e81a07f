"""Leaf blocks of a page's DOM with their text, and the features by which they are labelled."""

from __future__ import annotations

import html
import re
from collections import Counter

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # quotes hold an attribute's value after an equals sign only
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?=[a-zA-Z/!])[^>]*\Z",
    re.S | re.I,
)
_UNQUOTED = re.compile(r"=\s*[^\s\"']+\Z")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")

#: Tags inside which text runs on.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start of one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: A start of the key ends an open element of the value, up to the nearest of its holders.
ENDS_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset("ul ol dl select table tbody thead body div section article".split())
#: Elements without text of the page. What RAW holds is not markup; a self-closing slash counts in svg only.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "noscript", "iframe")}
SKIPPED = frozenset(("svg", "template"))
#: Parts of an svg that hold HTML, starts that end an svg left open, and tags that svg has as well.
SVG_HTML = frozenset("foreignobject desc title".split())
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
IN_SVG_TOO = frozenset("a title style script font".split())


#: Elements that hold every page, or none that is a fragment.
WRAPPERS = frozenset(("html", "body"))
#: Elements whose tag tells something of what they hold; others do if they are named.
TELLING = frozenset("article main nav aside header footer form dialog menu section search details".split())
#: Elements of running text, which group no blocks unless they are named.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address".split())
#: Parts of a form, whose text is never the page's.
CONTROLS = frozenset("button select option optgroup textarea datalist label legend".split())


class Block:
    """``path``: the tags around the block, each once, that of the block itself last; ``names``: words of their names.

    ``near``: tag and words of the innermost two ancestors that tell something, from the inside.
    ``step``: where the block stands to the one before: in the same group, in a group within, back
    outside, or across in another one.
    """

    __slots__ = ("path", "text", "link_chars", "names", "near", "step")

    def __init__(self, path, text, link_chars, names, near=(), step="same"):
        self.path, self.text, self.link_chars, self.names, self.near, self.step = path, text, link_chars, names, near, step


def leaf_blocks(page: str) -> list[Block]:
    """Runs of text between block tags, in page order, character references decoded and white space joined.

    Unclosed, crossed and cut-off tags are allowed. Comments, scripts and styles have no text; what is
    skipped ends where HTML ends it, so a self-closed, nested or open svg takes nothing else with it.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tag, words of its class, id and role
    parts: list[str] = []
    link_chars = links = 0
    # what groups blocks and what tells something of them; groups carry the number of elements opened before
    groups: list[int] = [0]
    telling: list[tuple[str, tuple[str, ...]]] = []
    opened = 0
    last_group, last_depth, last_opened = 0, 0, 0

    def flush():
        nonlocal link_chars, last_group, last_depth, last_opened
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                leaf = blocks[-1:]
                group = groups[-1]
                if group == last_group:
                    step = "same"
                elif last_depth < len(groups) and groups[last_depth] == last_group:
                    step = "in"
                else:
                    step = "out" if group <= last_opened else "across"
                last_group, last_depth, last_opened = group, len(groups) - 1, opened
                out.append(Block((*(t for t in tags if t not in leaf), *leaf), text, min(link_chars, len(text)), tuple(names), tuple(telling[:-3:-1]), step))
        link_chars = 0

    # what is open, counted, so that a block costs what differs around it and not how deep it lies
    open_tags: Counter = Counter()
    blocks: list[str] = []
    tags: Counter = Counter()
    names: Counter = Counter()

    def push(tag: str, words: tuple[str, ...]):
        nonlocal links, opened
        links += tag == "a"
        open_tags[tag] += 1
        stack.append((tag, words))
        if tag not in INLINE:
            opened += 1
            blocks.append(tag)
            tags[tag] += 1
            names.update(words)
            if words or tag not in TEXTUAL:
                groups.append(opened)
            if tag not in WRAPPERS and (words or tag in TELLING):
                telling.append((tag, words))

    def pop(upto: int):
        nonlocal links
        for t, words in stack[upto:]:
            links -= t == "a"
            open_tags[t] -= 1
            if t not in INLINE:
                blocks.pop()
                if words or t not in TEXTUAL:
                    groups.pop()
                if t not in WRAPPERS and (words or t in TELLING):
                    telling.pop()
                for counts, some in ((tags, (t,)), (names, words)):
                    for x in some:
                        counts[x] -= 1
                        if not counts[x]:
                            del counts[x]
        del stack[upto:]

    at = 0
    skipped: list[str] = []  # open svg, parts of it that hold HTML, template
    while found := _TAG.search(page, at):
        if found.start() > at and not skipped:
            piece = page[at : found.start()]
            parts.append(piece)
            if links > 0:
                link_chars += len(piece)
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        end = bool(found[1])
        in_svg = skipped[-1:] == ["svg"]
        if in_svg and (tag in ("p", "br") or (tag not in IN_SVG_TOO and open_tags[tag] > 0) if end else tag in ENDS_SVG):
            skipped, in_svg = [], False
        if tag in RAW and not end and not in_svg:
            close = RAW[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in SKIPPED or skipped:
            if end:
                if tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
            elif tag == "template" if skipped[:1] == ["template"] or not (skipped or tag == "svg") else tag == "svg" or tag in SVG_HTML:
                # a slash closes elements of svg only, and none that ends an unquoted value
                if tag == "template" or not found[3].endswith("/") or _UNQUOTED.search(found[3]):
                    skipped.append(tag)
            continue
        if tag in RAW:
            continue
        if end:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag in ("br", "hr"):
            parts.append(" ")
        if tag not in INLINE and tag != "br":
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, -1, -1) if open_tags["p"] else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in ENDS_SIBLING:
            for k in range(len(stack) - 1, -1, -1) if any(open_tags[t] for t in ENDS_SIBLING[tag]) else ():
                if stack[k][0] in ENDS_SIBLING[tag]:
                    pop(k)
                    break
                if stack[k][0] in HOLDERS:
                    break
        attributes = found[3]
        words = ()
        if "=" in attributes:
            words = tuple(w for m in _ATTRIBUTE.findall(attributes) for w in _NAME.findall((m[1] or m[2] or m[3]).lower()))
        push(tag, words)
    if not skipped:
        parts.append(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The step from the block before, ancestor tags, words of their names by nearness, and the shape of the text.

    Words on an article itself (``article class="sidebar-left"``) are kept apart from those on other elements.
    """
    out = []
    for b in blocks:
        size = len(b.text)
        words = b.text.count(" ") + 1
        density = b.link_chars / size
        f = [f"step={b.step}", "bias", f"leaf={b.path[-1] if b.path and b.path[-1] not in WRAPPERS else ''}"]
        f += [f"in={t}" for t in b.path if t not in WRAPPERS]
        told: set[str] = set()
        for level, (tag, named) in enumerate(b.near):
            f.append(f"near{level}={tag}")
            f += [f"{'article' if tag in ('article', 'main') else 'name'}{level}={x}" for x in sorted({*named})]
            told.update(named)
        f.append("pair=" + "<".join(tag for tag, _ in b.near))
        f += [f"far={x}" for x in b.names if x not in told]
        f.append(f"words={min(words.bit_length(), 7)}")
        f.append("links=" + ("all" if density > 0.9 else "most" if density > 0.4 else "some" if density > 0 else "none"))
        if b.text[-1] in ".!?:;\"'»”…":
            f.append("ends")
        if "©" in b.text or "(c)" in b.text.lower():
            f.append("rights")
        if not CONTROLS.isdisjoint(b.path):
            f.append("control")
        out.append(f)
    return out
