"""Main text of web pages: flat text blocks, classified by a decision tree on their and their neighbours' shallow features.

A page becomes a flat sequence of text blocks.  Each block's features are word count and link density, the same of
the blocks before and after it, where it stands among headings, long blocks and runs of links, and what the names of the elements around it say.
The tree is trained on the small labelled table below, anew in each process (some milliseconds), and never on the pages it is to judge.
Each page of the table stands there once more with nothing said by names, and some with names that mislead, so names are
features among others: counts, densities and places decide wherever they say enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.DOTALL,
)
#: Where a tag begins that the page's end cuts off.
CUT_OFF = re.compile(r"<(?:[A-Za-z/!?]|\Z)")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ATTRIBUTE = re.compile(r"([A-Za-z][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "video", "audio", "textarea", "select", "button", "option", "datalist"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: Elements that do not end a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "meta", "link",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What an element's name, class, id or role says about its content.
BOILERPLATE_NAMES = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "copyright", "dialog", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "navigationlist", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "promoted", "related", "replies", "reply",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tag", "tags", "toolbar", "widget", "alert",
}
MAIN_NAMES = {"article", "main"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody"}
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    boilerplate: bool
    heading: bool
    sign: int = 0


#: Words that tell of the publisher's rights, or of cookies, accounts and subscriptions, rather than of anything.
RIGHTS = re.compile(r"\W*(?:©|\(c\)|copyright\b)", re.IGNORECASE)
NOTICE = re.compile(r"\b(?:cookies?|gdpr|privacy policy|newsletters?|terms of use)\b", re.IGNORECASE)
NO_SIGN, RIGHTS_SIGN, NOTICE_SIGN = 0, 1, 2
#: Words from which on a block counts as long, and up to which a linked one may be a menu's.
LONG, ITEM = 10, 4


def sign_of(text: str) -> int:
    """Whether a block speaks of the publisher's rights, or (a short one) is a notice."""
    if RIGHTS.match(text):
        return RIGHTS_SIGN
    return NOTICE_SIGN if len(text) < 600 and NOTICE.search(text) else NO_SIGN


#: What a boilerplate word may say it is part of: ``related-posts`` is, ``comments-off`` is not.
PART_WORDS = {
    "area", "bar", "block", "body", "box", "container", "content", "entry", "form", "group", "inner", "item", "items", "link", "links", "list", "menu", "panel", "post", "posts",
    "section", "slot", "stories", "text", "thread", "title", "unit", "wrap", "wrapper",
}
#: Words beside which a boilerplate word tells of the page's layout: ``has-sidebar``, ``related-layout``.
LAYOUT_WORDS = {"has", "with", "without", "no", "layout"}
#: Words that also hold for an article, and for articles inside: readers' comments, teasers, advertisements.
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "promotion", "promoted", "related", "replies", "reply", "sponsor", "sponsored", "widget"}
#: How firmly an element is no main text: a compound name (``right-sidebar``), which an article inside takes back, or more.
LOOSE, FIRM = 1, 2
NO_DISPLAY = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
HIDDEN = re.compile(r"(?<![\w:-])hidden(?![\w:-])(?!\s*=\s*[\"']?false)", re.IGNORECASE)


def says(name: str, rest: str, head: bool = False) -> tuple[bool, int, bool]:
    """Whether an element's name or its class, id or role point to the main text, how firmly to anything else, and whether it is hidden.

    Page and body say nothing by their words, main is the main text whatever it is called.  ``head``: inside an article,
    whose own header, under whatever name, is a part of it.
    """
    main, other, hidden = name in MAIN_NAMES, FIRM if name in BOILERPLATE_NAMES and not (head and name == "header") else 0, False
    if "=" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role", "itemprop", "aria-label") and name not in ("html", "body", "main"):
                for token in value.split():
                    words = [w.lower() for w in SPLIT_WORDS.split(token) if w]
                    if not words or LAYOUT_WORDS.intersection(words):
                        continue
                    main |= not MAIN_WORDS.isdisjoint(words)
                    # a whole name, or a compound that ends in the word, or begins with it and names a part of it
                    told = ASIDE_WORDS if name == "article" else BOILERPLATE_WORDS
                    begins = words[0] if len(words) == 2 and words[1] in PART_WORDS else ""
                    found = {w for w in (words[-1], begins) if w in told} - ({"header"} if head else set())
                    if found:
                        other = max(other, FIRM if len(words) == 1 or found & ASIDE_WORDS else LOOSE)
            elif key == "aria-hidden":
                hidden |= value.strip().lower() == "true"
            elif key == "style":
                hidden |= bool(NO_DISPLAY.search(value))
    if "hidden" in rest.lower():
        hidden |= bool(HIDDEN.search(ATTRIBUTE.sub(lambda m: m[0] if m[1].lower() == "hidden" else " ", rest)))
    return main and not other, other, hidden


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, white space in each turned into one space; blocks without text are left out.

    Unclosed elements, stray closing tags and cut-off pages are taken as they come: a closing tag ends the nearest open element of its name.
    """
    out: list[Block] = []
    # name, silent, main, boilerplate, hidden, each with what stands around it; and how many of each name are open
    stack: list[tuple[str, bool, bool, int, bool]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []
    anchor = 0
    heading = False
    nothing = ("", False, False, 0, False)

    def end_block() -> None:
        if text:
            words = unescape("".join(text)).split()
            if words:
                links = len(unescape("".join(linked)).split()) if linked else 0
                _, _, main, other, hidden = stack[-1] if stack else nothing
                out.append(Block(" ".join(words), len(words), min(links, len(words)), main, other > 0 or hidden, heading, sign_of(" ".join(words[:120]))))
            text.clear()
            linked.clear()

    def close(name: str) -> None:
        """Take the nearest open element of this name off the stack, with all inside it."""
        while opened[name]:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == name:
                return

    at, last = 0, html.rfind(">")
    while at < len(html):
        found = TAG.search(html, at) if at <= last else CUT_OFF.search(html, at)
        told = html[at : found.start() if found else len(html)]
        if told and not (stack and stack[-1][1]):
            text.append(told)
            if anchor:
                linked.append(told)
        if not found or at > last:
            break
        at = found.end()
        if found["name"] is None:
            continue
        name, rest = found["name"].lower(), found["rest"]
        inline = name in INLINE
        if not inline:
            end_block()
        elif name == "a" and anchor and not found["close"]:
            anchor -= 1  # links do not nest
        if found["close"]:
            close(name)
            if name == "a" and anchor:
                anchor -= 1
            if name in HEADINGS:
                heading = False
            continue
        if name in VOID:
            continue
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(html, at)
            at = closing.start() if closing else len(html)
        if name == "p" and stack and stack[-1][0] == "p":
            close("p")
        if name == "body":  # ends a head that was left open
            close("head")
        up = stack[-1] if stack else nothing
        main, other, hidden = says(name, rest, up[2]) if rest or not inline else (False, 0, False)
        if not inline:
            outer = 0 if name == "main" or name == "article" and up[3] == LOOSE else up[3]
            stack.append((name, up[1] or name in SILENT, up[2] or main, max(outer, other), up[4] or hidden))
            opened[name] += 1
        elif hidden or opened[name]:  # other inline elements say nothing about their block
            stack.append((name, True, *up[2:]))
            opened[name] += 1
        anchor += name == "a"
        heading = heading or name in HEADINGS
    end_block()
    return out


def features(page: list[Block]) -> np.ndarray:
    """Per block, in the order of NAMES."""
    words = np.array([b.words for b in page], dtype=float)
    density = np.array([b.linked / b.words for b in page])
    heading = np.array([b.heading for b in page])
    main, other = (np.array(x, bool) for x in ([b.main for b in page], [b.boilerplate for b in page]))
    before, after = np.r_[0, words[:-1]], np.r_[words[1:], 0]
    plain = np.where((density < 0.5) & ~heading, words, 0)
    long = plain >= LONG
    # runs of short blocks that are links as a whole
    item = (density == 1) & (words <= ITEM) & ~heading
    edges = np.flatnonzero(np.diff(np.r_[0, item.astype(int), 0]))
    run = np.zeros(len(page))
    for i, j in zip(edges[::2], edges[1::2]):
        run[i:j] = j - i
    own = main & ~other
    longest = np.where(own, plain[own].max(initial=0), plain.max(initial=0))
    sign = np.array([b.sign for b in page])
    return np.column_stack([
        words, density, before, np.r_[0, density[:-1]], after, np.r_[density[1:], 0], heading, main, other, np.full(len(page), float(own.any())),
        np.minimum(np.cumsum(heading), 2), np.full(len(page), float(heading.any())), sign == RIGHTS_SIGN, sign == NOTICE_SIGN, np.minimum(run, 6), np.minimum(longest, 40),
        np.cumsum(long) > long, np.cumsum(long[::-1])[::-1] > long, other & own.any(),
    ]).astype(float)


#: Word count and link density of a block and of those before and after it; whether it is a heading; what names say of it, and whether they name any main text;
#: headings up to it (2 at most) and whether there are any; what it speaks of; the run of linked items that it is in; words of the longest plain block of its kind; whether long ones come before and after it; and whether names set it apart from main text that they name.
NAMES = (
    "words", "density", "words before", "density before", "words after", "density after", "heading", "in main", "in other", "main is named",
    "headings so far", "headings", "rights", "notice", "run of items", "longest", "long before", "long after", "in other beside main",
)


def made_page(menu: int, advert: int, body: list[int], footer: int, notice: int = 0) -> list[tuple[int, ...]]:
    """A plain page: a menu of linked words, an advert, a notice, a heading, paragraphs, and a line of rights; as rows of LABELLED."""
    rows = [(1 + k % 2, 1 + k % 2, 0, 0, 1, 0) for k in range(menu)]
    rows += [(advert, 0, 0, 0, 1, 0)] * (advert > 0) + [(notice, 0, 0, 0, 1, 0, NOTICE_SIGN)] * (notice > 0)
    return [*rows, (8, 0, 1, 1, 0, 1), *((n, 0, 0, 1, 0, 1) for n in body), *[(footer, 0, 0, 0, 1, 0, RIGHTS_SIGN)] * (footer > 0)]


#: Labelled blocks, a page each: (words, linked words, heading, inside main, inside boilerplate, is main text[, sign]).
LABELLED = [
    # a page that names its article: all of it counts, short blocks too, except what is marked as something else
    [(6, 6, 0, 0, 1, 0), (9, 0, 0, 0, 1, 0), (8, 0, 1, 1, 0, 1), (60, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (35, 4, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1), (12, 0, 0, 1, 1, 0), (25, 0, 0, 1, 0, 1), (10, 0, 0, 0, 1, 0)],
    [(1, 1, 0, 0, 1, 0), (1, 1, 0, 0, 1, 0), (40, 0, 0, 0, 1, 0), (5, 0, 1, 1, 0, 1), (120, 2, 0, 1, 0, 1), (3, 3, 0, 1, 0, 1), (80, 0, 0, 1, 0, 1), (45, 0, 0, 1, 1, 0), (7, 2, 0, 0, 0, 0), (30, 0, 0, 0, 0, 0)],
    [(12, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0), (3, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1), (15, 15, 0, 1, 0, 1), (20, 0, 0, 0, 0, 0)],
    [(50, 0, 0, 0, 1, 0), (70, 3, 0, 0, 1, 0), (9, 0, 1, 1, 0, 1), (200, 0, 0, 1, 0, 1), (6, 0, 1, 1, 1, 0), (90, 0, 0, 1, 1, 0), (90, 0, 0, 1, 1, 0), (15, 1, 0, 0, 1, 0)],
    [(3, 0, 1, 1, 0, 1), (20, 20, 0, 1, 0, 1), (14, 9, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1)],
    [(1, 0, 0, 1, 0, 1)],
    [(30, 0, 0, 0, 0, 0), (300, 0, 0, 0, 0, 0), (5, 5, 0, 1, 0, 1), (8, 0, 0, 1, 1, 0), (2, 1, 0, 1, 0, 1), (60, 0, 0, 0, 0, 0)],
    [(4, 0, 1, 0, 0, 0), (35, 1, 0, 0, 0, 0), (16, 0, 1, 1, 0, 1), (1, 1, 0, 1, 0, 1), (40, 40, 0, 1, 0, 1), (90, 0, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1)],
    [(2, 2, 0, 1, 1, 0), (2, 2, 0, 1, 1, 0), (44, 0, 0, 1, 0, 1), (3, 0, 0, 1, 0, 1), (70, 0, 0, 0, 0, 0), (20, 3, 0, 0, 0, 0)],
    [(150, 0, 0, 1, 0, 1), (150, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1)],
    [(10, 10, 0, 1, 0, 1), (11, 11, 0, 1, 0, 1), (12, 12, 0, 1, 0, 1), (6, 0, 0, 0, 0, 0)],
    # single short links in an article's text stay
    [(5, 0, 1, 1, 0, 1), (2, 2, 0, 1, 0, 1), (40, 0, 0, 1, 0, 1), (4, 0, 0, 1, 0, 1), (3, 3, 0, 1, 0, 1), (6, 0, 0, 1, 0, 1), (1, 1, 0, 1, 0, 1), (30, 1, 0, 1, 0, 1)],
    [(3, 0, 1, 1, 0, 1), (1, 1, 0, 1, 0, 1), (8, 0, 0, 1, 0, 1), (4, 4, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (9, 1, 0, 1, 0, 1), (3, 3, 0, 1, 0, 1)],
    # lists of links that are all there is of an article
    [(1, 1, 0, 0, 1, 0), (2, 0, 1, 1, 0, 1), (2, 2, 0, 1, 0, 1), (3, 3, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (4, 4, 0, 1, 0, 1), (6, 0, 0, 0, 1, 0, 1)],
    [(2, 0, 1, 1, 0, 1), (1, 1, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (1, 1, 0, 1, 0, 1), (3, 0, 0, 1, 0, 1)],
    [(4, 0, 1, 1, 0, 1), (5, 0, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (3, 3, 0, 1, 0, 1), (1, 1, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1)],
    # an article may speak of rights and cookies; a notice inside the element that holds it stands before its heading
    [(7, 0, 1, 1, 0, 1), (30, 1, 0, 1, 0, 1, 2), (80, 2, 0, 1, 0, 1), (60, 0, 0, 1, 0, 1), (9, 0, 0, 1, 0, 1, 1)],
    [(20, 2, 0, 1, 0, 0, 2), (5, 0, 1, 1, 0, 1), (90, 2, 0, 1, 0, 1), (12, 0, 0, 1, 0, 1, 1), (14, 0, 0, 1, 0, 1)],
    [(8, 0, 0, 0, 1, 0), (5, 0, 1, 1, 0, 1), (3, 0, 0, 1, 0, 1, 1), (2, 0, 0, 1, 0, 1), (9, 0, 0, 0, 1, 0, 1)],
    [(9, 0, 0, 0, 1, 0), (6, 0, 1, 1, 0, 1), (40, 0, 0, 1, 0, 1), (16, 0, 0, 1, 0, 1, 2), (11, 0, 0, 1, 0, 1), (4, 0, 0, 1, 0, 1, 1), (10, 0, 0, 0, 1, 0, 1)],
    # what is marked as something else inside an article goes, links and short lines too
    [(1, 0, 1, 1, 0, 1), (70, 0, 0, 1, 0, 1), (2, 2, 0, 1, 1, 0)],
    [(6, 0, 1, 1, 0, 1), (50, 2, 0, 1, 0, 1), (3, 3, 0, 1, 1, 0), (1, 1, 0, 1, 1, 0), (40, 0, 0, 1, 0, 1), (4, 0, 0, 1, 1, 0), (20, 1, 0, 1, 0, 1), (5, 5, 0, 1, 1, 0), (1, 0, 0, 1, 1, 0)],
    [(5, 0, 1, 1, 0, 1), (2, 0, 0, 1, 1, 0), (9, 0, 0, 1, 0, 1), (7, 0, 1, 1, 1, 0), (60, 0, 0, 1, 1, 0), (8, 0, 0, 1, 0, 1), (2, 2, 0, 1, 1, 0), (3, 3, 0, 1, 1, 0), (9, 0, 0, 0, 1, 0, 1)],
    # menus that nothing marks, inside the element that holds the article: runs of very short blocks that are links as a whole
    [(1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (6, 0, 1, 1, 0, 1), (70, 2, 0, 1, 0, 1), (25, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (44, 0, 0, 1, 0, 1)],
    [(7, 0, 1, 1, 0, 1), (90, 4, 0, 1, 0, 1), (52, 0, 0, 1, 0, 1), (2, 2, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (3, 3, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (20, 0, 0, 0, 1, 0)],
    [(3, 3, 0, 1, 0, 0), (3, 3, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (9, 9, 1, 1, 0, 1), (120, 6, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (80, 0, 0, 1, 0, 1), (3, 0, 0, 0, 0, 0)],
    # pages that name nothing: long blocks with few links, their headings and short blocks between them
    [(1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (7, 0, 1, 0, 0, 1), (55, 1, 0, 0, 0, 1), (38, 0, 0, 0, 0, 1), (4, 0, 0, 0, 0, 1), (61, 2, 0, 0, 0, 1), (3, 2, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0)],
    [(4, 4, 0, 0, 0, 0), (5, 4, 0, 0, 0, 0), (9, 0, 1, 0, 0, 1), (24, 0, 0, 0, 0, 1), (18, 0, 0, 0, 0, 1), (30, 3, 0, 0, 0, 1), (12, 11, 0, 0, 0, 0), (14, 14, 0, 0, 0, 0), (9, 9, 0, 0, 0, 0), (5, 1, 0, 0, 0, 0)],
    [(2, 2, 0, 0, 1, 0), (40, 0, 0, 0, 1, 0), (6, 0, 1, 0, 0, 1), (90, 5, 0, 0, 0, 1), (45, 0, 0, 0, 0, 1), (33, 0, 0, 0, 1, 0), (11, 0, 0, 0, 1, 0), (20, 0, 0, 0, 0, 1), (26, 1, 0, 0, 1, 0)],
    [(25, 20, 0, 0, 0, 0), (40, 0, 0, 0, 0, 1), (150, 10, 0, 0, 0, 1), (30, 28, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 1)],
    [(2, 2, 0, 0, 0, 0), (5, 0, 1, 0, 0, 1), (60, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1), (1, 1, 0, 0, 0, 0)],
    [(3, 3, 0, 0, 0, 0), (4, 0, 1, 0, 0, 1), (30, 1, 0, 0, 0, 1), (70, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)],
    [(9, 0, 1, 0, 0, 1), (45, 2, 0, 0, 0, 1), (80, 0, 0, 0, 0, 1), (6, 6, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (7, 0, 0, 0, 0, 0, 1)],
    # short texts on pages that name nothing, whole texts without any markup, and notices among them
    [(9, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1)],
    [(5, 0, 0, 0, 0, 1)],
    [(4, 0, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1), (2, 0, 0, 0, 0, 1)],
    [(200, 0, 0, 0, 0, 1)],
    [(14, 0, 0, 0, 0, 1)],
    [(30, 0, 0, 0, 0, 0, 2), (7, 0, 1, 0, 0, 1), (60, 0, 0, 0, 0, 1), (45, 1, 0, 0, 0, 1)],
    [(6, 0, 1, 0, 0, 1), (70, 1, 0, 0, 0, 1), (35, 0, 0, 0, 0, 1), (31, 1, 0, 0, 0, 0, 2)],
    [(50, 0, 0, 0, 0, 1), (25, 0, 0, 0, 0, 0, 2), (8, 0, 0, 0, 0, 0, 1)],
    # names that mislead: all of the page stands in something that is called a sidebar
    [(1, 1, 0, 0, 1, 0), (2, 2, 0, 0, 1, 0), (7, 0, 1, 0, 1, 1), (80, 2, 0, 0, 1, 1), (60, 0, 0, 0, 1, 1), (8, 0, 0, 0, 1, 0, 1)],
    [(2, 2, 0, 0, 1, 0), (1, 1, 0, 0, 1, 0), (2, 2, 0, 0, 1, 0), (6, 0, 1, 0, 1, 1), (150, 2, 0, 0, 1, 1), (90, 0, 0, 0, 1, 1), (3, 0, 0, 0, 1, 1), (45, 0, 0, 0, 1, 1), (12, 0, 0, 0, 1, 0, 1)],
]
#: Plain pages; each also stands in the table with its names blanked.
PLAIN = [
    made_page(6, 9, [40, 1, 25, 60, 3, 12], 12), made_page(4, 14, [5, 9, 30], 8), made_page(5, 4, [1, 2], 15), made_page(6, 7, [120, 80, 2, 45], 9), made_page(6, 12, [8], 7),
    made_page(5, 18, [17, 11, 1, 4, 22], 19), made_page(3, 0, [33, 50], 10), made_page(6, 25, [70, 6, 9, 3], 0), made_page(0, 6, [20, 35], 14), made_page(4, 10, [1, 1, 2, 1], 11), made_page(6, 8, [14, 55], 6, notice=20), made_page(2, 0, [3, 7, 90], 5, notice=35),
]


def with_asides(page: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """A plain page with marked forms, boxes and links between its article's blocks, and readers' comments after it."""
    kinds = ((1, 0), (3, 3), (12, 0), (2, 2), (45, 3), (1, 1), (4, 0))
    rows: list[tuple[int, ...]] = []
    for n, row in enumerate(page):
        rows.append(row)
        if row[3]:
            rows += [(*kinds[(n + k) % len(kinds)], 0, 1, 1, 0) for k in range(1 + n % 2)]
    end = len(rows) - (rows[-1][3] == 0)
    return [*rows[:end], (11, 0, 0, 0, 1, 0), (3, 3, 0, 0, 1, 0), (40, 0, 0, 0, 1, 0), *rows[end:]]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    blank = [[(w, k, h, 0, 0, y, *sign) for w, k, h, _, _, y, *sign in page] for page in PLAIN]
    table = [*LABELLED, *PLAIN, *map(with_asides, PLAIN), *blank]
    x = np.concatenate([features([Block("", w, k, bool(m), bool(o), bool(h), *sign) for w, k, h, m, o, _, *sign in page]) for page in table])
    return x, np.array([row[5] for page in table for row in page])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A classification tree: a leaf (label,), or (feature, threshold, at most it, above it), split by least Gini impurity."""
    if depth == 0 or y.min() == y.max():
        return (int(2 * y.sum() >= len(y)),)

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    # among equals the first of NAMES, whose last split is what names say
    best = None
    for k in (1, 0, 12, 13, 14, 6, 10, 11, 15, 16, 17, 5, 3, 4, 2, 18, 8, 7, 9):
        values = np.unique(x[:, k])
        for at in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= at
            cost = impurity(y[left]) + impurity(y[~left])
            if best is None or cost < best[0] - 1e-9:
                best = (cost, k, float(at), left)
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    _, k, at, left = best
    return (k, at, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def down(node: tuple, rows: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] = bool(node[0])
            return
        left = x[rows, node[0]] <= node[1]
        down(node[2], rows[left])
        down(node[3], rows[~left])

    down(tree, np.arange(len(x)))
    return out


_TREE: list[tuple] = []


def main_text(html: str | None) -> str:
    """The blocks that the tree keeps, in page order, joined by one space; empty if there are none."""
    if not _TREE:
        _TREE.append(grow(*labelled_table()))
    page = blocks(html or "")
    if not page:
        return ""
    keep = classify(_TREE[0], features(page))
    return " ".join([b.text for b, k in zip(page, keep) if k])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: its main text (null or empty html: empty) and that text's code points.

    A page is read whole, whatever its length, in time linear in it.  Rows without an id or url and repeated rows are each extracted; an empty
    table gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[key].cast("long"), pages[url].cast("string"), pages[html].cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
