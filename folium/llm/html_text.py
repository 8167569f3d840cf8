"""Operator 1, HTML extraction by layout-aware rendering.

A tree builder reads tags leniently: void elements, implied end tags (a block closes an open
paragraph; list items, cells, rows, options and terms close their like), stray end tags, raw
text of scripts and styles. Visibility rules then drop what a reader would not see, and all
other text is laid out: inline text collapses its blanks, blocks begin on lines of their own
with blank lines where browsers put margins, lists get markers and indents, and table cells
are aligned in columns, spans included.

Nothing is recursive but tables within cells, to MOST_TABLES levels; deeper tables are laid out as
blocks. Every page is read in one pass, in time proportional to its length. Cells are padded to the widest of
their column that is no wider than WIDEST_PADDED; wider ones stick out, and a table of more than MOST_ALIGNED columns or
WIDEST_TABLE characters is not padded at all, so the text is never much longer than the page.

Defined cases: a null or empty html gives an empty text; text without any tag is one paragraph;
an unclosed tag or comment at the end is dropped; an element never closed ends with the page;
repeated rows are rendered each; an empty table gives no rows; extra columns are ignored; text outside
the cells of a table comes before it, as in browsers, unless its row or row group is hidden; of a drawing
the text elements are shown, of a formula all but its annotations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from folium.llm.shared import lean_batches

#: Tables within tables that are aligned; each takes a few frames of the stack.
MOST_TABLES = 100
WIDEST_PADDED, WIDEST_TABLE, MOST_ALIGNED = 120, 2000, 200

# The most that a cell may span in HTML.
MOST_COLUMNS_SPANNED, MOST_ROWS_SPANNED = 1000, 65534

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style noscript template title iframe object canvas audio video map datalist noembed noframes rp meta link base param source track col colgroup area embed annotation annotation-xml".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCKS = CLOSES_P | frozenset("html body caption tr td th thead tbody tfoot legend optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table hr fieldset".split())
#: Start tag: the open elements that it closes, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th")),
    "dt": (("dt", "dd"), ("dl", "table", "td", "th")),
    "dd": (("dt", "dd"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist", "table")),
    "optgroup": (("option", "optgroup"), ("select", "table")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("thead", "tbody", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
    "body": (("head",), ()),
}
#: An end tag of anything else does not close these.
WALLS = frozenset("td th table caption html body foreignobject svg math".split())
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Elements of a drawing that are never drawn where they stand, and those that hold its text.
UNDRAWN = frozenset("defs symbol clippath mask marker pattern metadata desc filter lineargradient radialgradient".split())
DRAWN_TEXT = frozenset("text foreignobject".split())

_TAG_END = re.compile(r""">|=[ \t\n\f\r]*["']""")
_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*")
_ATTRIBUTE = re.compile(r"""([^ \t\n\f\r/>="']+)(?:[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*"|'[^']*'|[^ \t\n\f\r>]*))?""")
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#page", {})
    stack = [root]
    opened: dict[str, int] = {}
    lower = None

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def close(tags: tuple[str, ...], walls: frozenset[str] | tuple[str, ...]) -> None:
        """Pops up to the outermost of the tags that no wall hides."""
        if not any(opened.get(t) for t in tags):
            return
        target = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                target = depth
            elif stack[depth].tag in walls:
                break
        if target is not None:
            while len(stack) > target:
                pop()

    def close_last(tag: str, walls: frozenset[str]) -> bool:
        if not opened.get(tag):
            return False
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == tag:
                while len(stack) > depth:
                    pop()
                return True
            if stack[depth].tag in walls:
                return False
        return False

    at, n = 0, len(html)
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            text = html[at:begin]
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if begin == n:
            break
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        after = html[begin + 1 : begin + 2]
        if after in ("!", "?"):
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        ending = after == "/"
        name = _NAME.match(html, begin + 1 + ending)
        if not name:
            if ending:  # a bogus comment
                end = html.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
                at = begin + 1
            continue
        end, look = -1, name.end()
        while (mark := _TAG_END.search(html, look)) is not None:
            if mark[0] == ">":
                end = mark.start()
                break
            quote = html.find(mark[0][-1], mark.end())
            if quote < 0:
                break
            look = quote + 1
        if end < 0:
            break
        tag, at = name[0].lower(), end + 1
        if ending:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not close_last("p", WALLS):
                stack[-1].children.append(Node("p", {}))
            elif tag not in ("p", "html", "body"):
                close_last(tag, frozenset(("table",)) - {tag} if tag in TABLE_TAGS else WALLS - {tag})
            continue
        if tag in CLOSES_P:
            close_last("p", WALLS)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        raw = html[name.end() : end]
        node = Node(tag, _attributes(raw) if raw.strip(" /\t\n\f\r") else {})
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            lower = html.lower() if lower is None or len(lower) != n else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]", lambda m: m[0].lower(), html)
            stop = lower.find(f"</{tag}", at)
            stop = n if stop < 0 else stop
            inner = html[at:stop]
            node.children.append(unescape(inner) if tag in ("textarea", "title") and "&" in inner else inner)
            end = html.find(">", stop)
            at = n if end < 0 else end + 1
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def _style(node: Node) -> str:
    return node.attributes.get("style", "").lower().replace(" ", "")


def _unseen(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attributes:
        return True
    if node.tag == "input":
        return node.attributes.get("type", "text").lower() not in ("submit", "button", "reset")
    if node.tag == "dialog" and "open" not in node.attributes:
        return True
    return "style" in node.attributes and "display:none" in _style(node)


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines under construction: inline text joins the open line, blocks ask for line breaks before what follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.breaks = 0  # line breaks asked for; 2 leaves a blank line
        self.indents: list[str] = []
        self.marker: str | None = None

    def block(self, breaks: int) -> None:
        self.end_line()
        self.breaks = max(self.breaks, breaks)
        self.space = False

    def end_line(self) -> None:
        if self.parts:
            self._put("".join(self.parts).rstrip(" "))
            self.parts = []
            self.breaks = 1

    def _put(self, line: str) -> None:
        if self.lines and self.breaks > 1 and self.lines[-1]:
            self.lines.append("")
        self.breaks = 1
        indent = "".join(self.indents)
        if self.marker is not None:
            indent = "".join(self.indents[:-1]) + self.marker
            self.marker = None
        self.lines.append((indent + line).rstrip(" "))

    def inline(self, text: str) -> None:
        text = _BLANKS.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or (bool(text) and bool(self.parts))
            return
        if text[0] == " ":
            self.space, text = bool(self.parts), text[1:]
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = text[-1] == " "
        self.parts.append(text[:-1] if self.space else text)

    def exact(self, text: str) -> None:
        """Preformatted text: its lines and blanks stay."""
        first, *more = text.replace("\r\n", "\n").split("\n")
        self.parts.append((" " if self.space and self.parts else "") + first)
        self.space = False
        for line in more:
            self.end_line() if any(self.parts) else self._blank()
            self.parts = [line] if line else []

    def _blank(self) -> None:
        self.parts = []
        if self.lines:
            self.breaks = 2

    def line_break(self) -> None:
        if self.parts:
            self.end_line()
        elif self.lines:
            self.breaks = 2
        self.space = False

    def rows(self, lines: list[str]) -> None:
        """Finished lines, such as a table's."""
        for line in lines:
            self._put(line)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(node: Node, name: str, default: int) -> int:
    found = _NUMBER.match(node.attributes.get(name, ""))
    return int(found[1]) if found else default


def _rows_of(table: Node) -> Iterator[tuple[Node, list[Node]]]:
    """Rows of a table in order, with the caption as a row of its own kind."""
    late: list[Node] = []
    for part in table.children:
        if not isinstance(part, Node) or _unseen(part):
            continue
        if part.tag == "tfoot":
            late.append(part)
        elif part.tag == "tr":
            yield part, [c for c in part.children if isinstance(c, Node)]
        elif part.tag in ("thead", "tbody"):
            yield from _rows_of(part)
        elif part.tag in ("td", "th"):
            yield part, [part]
        else:
            yield part, []
    for part in late:
        yield from _rows_of(part)


def _loose_text(table: Node, shown: bool) -> Iterator[tuple[str, bool]]:
    """Text that stands directly in a table, its row groups or its rows, in order, and whether it is shown."""
    for part in table.children:
        if isinstance(part, str):
            if part.strip():
                yield part, shown
        elif part.tag in ("thead", "tbody", "tfoot") and not _unseen(part):
            yield from _loose_text(part, _shown(part, shown))
        elif part.tag == "tr" and not _unseen(part):
            yield from ((c, _shown(part, shown)) for c in part.children if isinstance(c, str) and c.strip())


def _drawn_texts(svg: Node, shown: bool) -> list[tuple[Node, bool]]:
    """The text elements of a drawing in order, and whether each is shown."""
    out: list[tuple[Node, bool]] = []
    todo = [(svg, shown)]
    while todo:
        node, seen = todo.pop()
        if node.tag in UNDRAWN or _unseen(node):
            continue
        seen = _shown(node, seen)
        if node.tag in DRAWN_TEXT:
            out.append((node, seen))
        else:
            todo += [(c, seen) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _table(table: Node, depth: int, pre: bool, shown: bool) -> list[str]:
    """A table as lines with aligned columns."""
    outside: list[str] = []
    grid: list[dict[int, tuple[list[str], int]]] = []
    blocked: dict[int, int] = {}  # column: the row from which no cell above covers it any more
    number = 0
    for text, seen in _loose_text(table, shown):
        outside += render([text], depth + 1, pre, seen)
    for row, cells in _rows_of(table):
        if not cells:
            if row.tag != "tr":
                outside += render([row], depth + 1, pre, shown)
            continue
        line: dict[int, tuple[list[str], int]] = {}
        column = 0
        for cell in cells:
            if _unseen(cell):
                continue
            while blocked.get(column, 0) > number:
                column += 1
            across = min(MOST_COLUMNS_SPANNED, max(1, _number(cell, "colspan", 1)))
            down = min(MOST_ROWS_SPANNED, max(1, _number(cell, "rowspan", 1)))
            inner = render(cell.children if cell.tag in ("td", "th") else [cell], depth + 1, pre, _shown(cell, shown))
            line[column] = (inner, across)
            if down > 1:
                blocked.update(dict.fromkeys(range(column, column + across), number + down))
            column += across
        number += 1
        if any(inner for inner, _ in line.values()):
            grid.append(line)
    used = sorted({c for line in grid for c, (inner, _) in line.items() if inner})
    place = {c: i for i, c in enumerate(used)}
    widths = [0] * len(used)
    for line in grid:
        for c, (inner, across) in line.items():
            if c in place and (across == 1 or not any(c < other < c + across for other in used)):
                widths[place[c]] = max([widths[place[c]], *[w for x in inner if (w := _width(x)) <= WIDEST_PADDED]])
    out = list(outside)
    aligned = len(used) <= MOST_ALIGNED and sum(widths) <= WIDEST_TABLE
    for line in grid:
        columns = used if aligned else [c for c in line if c in place]
        for k in range(max(len(inner) for inner, _ in line.values())):
            if not aligned:
                out.append(" | ".join(line[c][0][k] if k < len(line[c][0]) else "" for c in columns).rstrip(" "))
                continue
            text, owed = "", 0
            for i, c in enumerate(columns):
                inner, across = line.get(c, ([], 1))
                piece = inner[k] if k < len(inner) else ""
                over = max(0, _width(piece) - widths[i])
                pad = max(0, widths[i] + min(0, -owed) - _width(piece)) if not over else 0
                owed = max(0, owed - widths[i]) if not piece and owed else over
                text += ("" if i == 0 else " | ") + piece + " " * pad
            out.append(text.rstrip(" "))
    return out


def _shown(node: Node, shown: bool) -> bool:
    """Whether text directly in the element is shown: visibility is inherited and may be set anew."""
    if "style" in node.attributes:
        style = _style(node)
        if "visibility:hidden" in style or "visibility:collapse" in style:
            return False
        if "visibility:visible" in style:
            return True
    return shown


def render(nodes: list[Node | str], depth: int = 0, pre: bool = False, shown: bool = True) -> list[str]:
    """Lines of the visible text of some nodes."""
    out = Layout()
    # What is left to do, last first: a node with its state, or a function that ends an element.
    todo: list = [(node, pre, shown, None) for node in reversed(nodes)]
    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        node, pre, shown, counter = step
        if isinstance(node, str):
            if shown:
                out.exact(node) if pre else out.inline(node)
            continue
        tag = node.tag
        if _unseen(node):
            continue
        shown = _shown(node, shown)
        if tag == "br":
            out.line_break()
            continue
        if tag == "wbr" or tag == "img":
            continue
        if tag == "input":
            if shown:
                out.inline(" " + node.attributes.get("value", "") + " ")
            continue
        if tag == "hr":
            out.block(2)
            out.breaks = 2
            continue
        if tag == "svg":
            for drawn, seen in reversed(_drawn_texts(node, shown)):
                todo += [lambda: out.block(1), *[(c, pre, seen, None) for c in reversed(drawn.children)], lambda: out.block(1)]
            continue
        if tag == "table" and depth < MOST_TABLES:
            out.block(2)
            out.rows(_table(node, depth, pre, shown))
            out.breaks = 2
            continue
        children = node.children
        if tag == "select":
            options = [o for c in children if isinstance(c, Node) for o in (c.children if c.tag == "optgroup" else [c]) if isinstance(o, Node)]
            children = [o for o in options if "selected" in o.attributes][:1] or options[:1]
        elif tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag in ("pre", "textarea", "xmp"):
            pre = True
            if children and isinstance(children[0], str) and children[0][:1] == "\n":
                children = [children[0][1:], *children[1:]]
        elif tag in ("q",):
            children = ["“", *children, "”"]
        breaks = 2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and out.indents) else 1 if tag in BLOCKS else 0
        if breaks:
            out.block(breaks)
        ends = []
        below = None
        if tag in ("ul", "menu", "dir"):
            below = [None, 0]
        elif tag == "ol":
            down = "reversed" in node.attributes
            items = sum(isinstance(c, Node) and c.tag == "li" for c in children) if down else 1
            below = [_number(node, "start", items), -1 if down else 1]
        elif tag == "li":
            mark = "- "
            if counter is not None and counter[0] is not None:
                counter[0] = _number(node, "value", counter[0])
                mark = f"{counter[0]}. "
                counter[0] += counter[1]
            out.indents.append(" " * len(mark))
            out.marker = mark

            def leave() -> None:
                out.end_line()
                out.marker = None
                out.indents.pop()

            ends.append(leave)
        elif tag in ("blockquote", "dd"):
            out.indents.append("  ")
            ends.append(lambda: (out.end_line(), out.indents.pop()))
        if tag in ("td", "th"):  # only of a table that is laid out as blocks
            ends.append(lambda: out.inline(" "))
        if breaks:
            ends.append(lambda breaks=breaks: out.block(breaks))
        todo += reversed(ends)
        todo += [(child, pre, shown, below if below is not None else None) for child in reversed(children)]
    return out.done()


def html_to_text(html: str | None) -> str:
    """The visible text of a page, laid out."""
    if not html:
        return ""
    return "\n".join(render([parse(html)])).replace("\xa0", " ").strip("\n")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = [html_to_text(x.as_py()) for x in part.column("html")]
            sizes = [pa.array([f(t) for t in texts], pa.int64()) for f in (len, lambda t: t.count("\n") + 1 if t else 0)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), *sizes], names=["page_id", "url", "text", "n_chars", "n_lines"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines of every page."""
    rows = lean_batches(pages).selectExpr("cast(page_id as long) as page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_lines long")


def op1(pages: DataFrame) -> DataFrame:
    """The laid-out visible text of every page."""
    return extract_text(pages)
