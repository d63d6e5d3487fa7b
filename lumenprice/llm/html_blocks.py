"""Blocks of text of an HTML page, with what the markup says about them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never part of an article.
OUT_TAGS = frozenset("aside button dialog embed fieldset footer form head menu nav object select svg canvas map audio video applet math".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id that name such parts.
OUT_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paging toolbar topbar "
    "header masthead footer sidebar sidebars aside rail widget widgets colophon copyright "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay alert alerts disclaimer toast paywall "
    "newsletter subscribe subscription signup signin login register form search searchbox share sharing social follow "
    "comment comments commentlist reply replies respond disqus discussion reader-comments "
    "related recommended recommendations teaser teasers trending popular tags outbrain taboola skip".split()
)
CONTAINER_WORDS = frozenset("article articlebody article-body article-content post-content post-body entry-content story-body main-content maincontent story-content".split())
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    text: str
    contained: bool  # inside the element that is marked as the article
    outside: bool  # inside a part that is marked as something else
    link_share: float


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(source)} if source and not source.isspace() else {}


def is_out(tag: str, own: dict[str, str], contained: bool) -> bool:
    if tag in OUT_TAGS or tag == "header" and not contained:
        return True
    if not own:
        return False
    if own.get("role", "").lower() in OUT_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "main", "article") and not own.get("class", "").lower().startswith(("comment", "teaser", "ad")):
        return False
    names = f"{own.get('class', '')} {own.get('id', '')}"
    return bool(names.strip()) and any(n.lower() in OUT_WORDS for n in NAME_PART.findall(names))


def is_container(tag: str, own: dict[str, str]) -> bool:
    if tag in ("article", "main") or own.get("role") in ("main", "article") or own.get("itemprop") == "articleBody":
        return True
    return bool(own) and any(n in CONTAINER_WORDS for n in f"{own.get('class', '')} {own.get('id', '')}".lower().split())


def blocks(html: str) -> list[Block]:
    """The blocks in page order; white space is one blank, character references are decoded, empty blocks are left out.

    An element that starts an article ends the parts before it that were never closed. A tag that
    isn't closed by > up to the end is text.
    """
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    # open elements: tag, marked as something else, container, link
    stack: list[tuple[str, bool, bool, bool]] = []
    outside = contained = link = 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, contained > 0, outside > 0, links / len(text)))
            parts.clear()
        links = 0

    def pop():
        nonlocal outside, contained, link
        _, a, b, c = stack.pop()
        outside -= a
        contained -= b
        link -= c

    def add(text: str):
        nonlocal links
        text = unescape(text) if "&" in text else text
        parts.append(text)
        if link:
            links += len(text.strip())

    at, end = 0, len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0 or html.find(">", start) < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        found = COMMENT.match(html, start)
        if found:
            at = found.end()
            continue
        found = TAG.match(html, start) or LOOSE_TAG.match(html, start)
        if not found:
            add("<")
            at = start + 1
            continue
        at = found.end()
        closing, tag, rest = found[1], found[2].lower(), found[3]
        if closing:
            if tag in BLOCK:
                flush()
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            else:
                parts.append(" ")
            continue
        if tag in ("td", "th", "option"):
            parts.append(" ")
        own = attributes(rest)
        container = is_container(tag, own)
        out_here = is_out(tag, own, contained > 0)
        if tag in BLOCK:
            flush()
            if container and outside and tag in ("article", "main") and not out_here and not any(s[2] for s in stack):
                while outside:
                    pop()
            while tag != "html" and stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop()
            if tag in ("li", "dt", "dd", "tr") and stack and stack[-1][0] == tag:
                pop()
        if not rest.endswith("/") or tag in BLOCK:
            is_link = tag == "a"
            stack.append((tag, out_here, container, is_link))
            outside += out_here
            contained += container
            link += is_link
    flush()
    return out
