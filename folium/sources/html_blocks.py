"""Blocks of HTML pages: headings, paragraphs, code, tables, figures and formulas in order.

The tree is naive: an element ends where its end tag stands, or with its parent; there are no
implied end tags, so a paragraph that is never closed holds what follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from folium.sources.fragments import Fragment, Import, Places, script

# Elements by what becomes of them.
BLOCK_KIND = dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading") | {"p": "paragraph", "blockquote": "paragraph", "li": "paragraph", "pre": "code", "table": "table"}
CONTAINERS = frozenset("div article section main aside header footer nav body html figure figcaption".split())
BOUNDARIES = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset(("script", "style", "noscript"))
NOT_TEXT = DROPPED | {"annotation", "annotation-xml"}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], raw: str = "") -> None:
        self.tag, self.attributes, self.raw = tag, attributes, raw
        self.children: list[Element | str] = []

    def all(self, *tags: str) -> Iterator[Element]:
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            now = todo.pop()
            if now.tag in tags:
                yield now
            todo += [c for c in reversed(now.children) if isinstance(c, Element)]


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#page", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.get_starttag_text() or "")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        depth = next((d for d in range(len(self.open) - 1, 0, -1) if self.open[d].tag == tag), None)
        if depth is not None:
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def formula_text(node: Element) -> str:
    said = (node.attributes.get("alttext") or node.attributes.get("alt") or "").strip()
    if said and re.search(r"[\\^_{}]", said):
        sign = "$$" if node.attributes.get("display", "").lower() == "block" else "$"
        return sign + said.strip("$") + sign
    return said or re.sub(r"\s+", "", "".join(_strings(node)))


def _strings(node: Element) -> Iterator[str]:
    todo: list[Element | str] = [node]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            yield now
        elif now.tag not in NOT_TEXT:
            todo += reversed(now.children)


#: Stand in a stream of text for the edge of a block, and for an element that gave no text; noncharacters, so no page holds them.
_EDGE, _NOTHING = "\ufdd0", "\ufdd1"
_LINE_END = re.compile(f"(?<=[^\\s{_EDGE}{_NOTHING}]){_EDGE}+")


def _stream(node: Element) -> Iterator[str]:
    """The text of an element in order, with marks at the edges of the blocks in it."""
    todo: list[Element | str] = list(reversed(node.children))
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            yield now or _NOTHING
        elif now.tag == "br":
            yield "\n"
        elif now.tag == "math":
            yield formula_text(now) or _NOTHING
        elif now.tag in ("sup", "sub"):
            inner = inline_text(now)
            yield script(inner, now.tag == "sup") or inner or _NOTHING
        elif now.tag not in NOT_TEXT and now.tag != "img":
            sides = [_EDGE] if now.tag in BOUNDARIES else []
            todo += [*sides, *reversed(now.children), *sides]


def inline_text(node: Element) -> str:
    """Text of an element with line ends where blocks begin and end: at the edges of blocks that stand behind a letter or sign."""
    return _LINE_END.sub("\n", "".join(_stream(node))).replace(_EDGE, "").replace(_NOTHING, "")


def collapse(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def read_html(source: str) -> Import:
    out, places = Import(), Places(source.removeprefix("﻿"))

    def add(kind: str, text: str, sought: str | None = None) -> None:
        if text.strip():
            out.fragments.append(Fragment(kind, text, *places.find(text if sought is None else sought)))

    def figure(node: Element) -> None:
        add("figure", node.attributes.get("alt", "").strip() or "[image]", node.raw)
        target = node.attributes.get("src", "").strip()
        if target:
            out.links.append((len(out.fragments), target))
        if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:|//", target):
            out.issues.append((f"image-b{len(out.fragments):05d}", f"Image {target} is not in the source folder"))

    def block(node: Element) -> None:
        if node.tag == "table":
            add("table", "\n".join(" | ".join(collapse(inline_text(c)) for c in row.all("td", "th")) for row in node.all("tr")).strip())
        elif node.tag == "pre":
            whole = "".join(_strings(node))
            add("code", whole.strip("\n"), whole)
        else:
            add(BLOCK_KIND[node.tag], collapse(inline_text(node)))
        for image in node.all("img"):
            figure(image)

    root = tree(places.source)
    held: list[str] = []

    def flush() -> None:
        text = collapse("".join(held))
        held.clear()
        add("paragraph", text)

    # Text between blocks is held until the next block or the end of its container.
    todo: list = [next(root.all("body"), root)]
    if todo[0].tag in BLOCK_KIND:
        block(todo.pop())
    else:
        todo = [flush, *reversed(todo.pop().children)]
    while todo:
        now = todo.pop()
        if callable(now):
            now()
        elif isinstance(now, str):
            held.append(now)
        elif now.tag in DROPPED:
            continue
        elif now.tag in BLOCK_KIND:
            flush()
            block(now)
        elif now.tag == "img":
            flush()
            figure(now)
        elif now.tag in CONTAINERS:
            flush()
            todo.append(flush)
            todo += reversed(now.children)
        elif now.tag == "math":
            held.append(formula_text(now))
        else:
            held.append(inline_text(now))
            for image in now.all("img"):
                flush()
                figure(image)
    return out
