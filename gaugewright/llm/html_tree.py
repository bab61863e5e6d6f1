"""A tolerant reader of HTML pages: a tree of elements and of the text blocks under them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes template textarea title select button noscript svg math object audio video canvas".split())
NO_MARKUP = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BORDERS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
SCOPES = frozenset("html body table td th caption button object article section main aside nav header footer div li ul ol form blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+|\d+")
TAKEN = 64


@dataclass
class Page:
    """Elements (parent, tag, name words) in page order, and blocks (element, text, characters in links)."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The tree of a page. Scripts, styles, form fields, comments and the head's title give no text. Any input is read to its end."""
    page = Page([-1], ["#page"], [()])
    stack, at, length = [0], 0, len(source)
    parts: list[tuple[str, int]] = []
    links = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                page.blocks.append((stack_block(), text, sum(len(p.strip()) for p, linked in parts if linked)))
            parts = []

    def stack_block() -> int:
        for node in reversed(stack):
            if page.tags[node] not in INLINE:
                return node
        return 0

    def close_to(place: int) -> None:
        nonlocal links
        for node in stack[place:]:
            links -= page.tags[node] == "a"
        del stack[place:]

    while at < length:
        found = TOKEN.search(source, at)
        end = found.start() if found else length
        if end > at:
            raw = source[at:end]
            parts.append((html.unescape(raw) if "&" in raw else raw, links))
        if not found:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag or not found[0].endswith(">"):
            continue  # a comment, a declaration, or a tag cut off by the end of the page
        tag = tag.lower()
        if closing:
            if tag == "p" or tag not in INLINE:
                flush()
            for place in range(len(stack) - 1, 0, -1):
                open_tag = page.tags[stack[place]]
                if open_tag == tag:
                    close_to(place)
                    break
                if tag in INLINE and open_tag not in INLINE:
                    break  # an end tag of running text does not close a block
                if tag == "p" and open_tag in SCOPES:
                    break
            continue
        if tag == "br":
            parts.append((" ", links))
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if tag not in INLINE and tag not in ("button", "select", "object", "svg", "math", "noscript"):
                flush()
            closed = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
            if closed:
                at = closed.end()
            elif tag in NO_MARKUP:
                at = length
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_PARAGRAPH:
            for place in range(len(stack) - 1, 0, -1):
                if page.tags[stack[place]] == "p":
                    close_to(place)
                    break
                if page.tags[stack[place]] in SCOPES:
                    break
        if tag in SIBLINGS:
            for place in range(len(stack) - 1, 0, -1):
                if page.tags[stack[place]] in BORDERS[tag]:
                    break
                if page.tags[stack[place]] in SIBLINGS[tag]:
                    close_to(place)
                    break
        page.parents.append(stack[-1])
        page.tags.append(tag)
        page.names.append(tuple(w for m in NAMES.finditer(attributes[:4096]) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())[:TAKEN]) if "=" in attributes else ())
        if not (found[0].endswith("/>") and tag not in INLINE and tag not in CLOSES_PARAGRAPH):
            stack.append(len(page.tags) - 1)
            links += tag == "a"
    flush()
    return page
