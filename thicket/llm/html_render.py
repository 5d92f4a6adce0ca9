"""Layout-aware text of HTML pages.

A tree builder reads the markup as browsers do: void elements, implied end tags (a new ``p``,
``li``, ``tr``, ``td`` or ``option`` ends the one before), raw text in scripts and styles, end tags
without a start, unclosed elements, and a head that the first visible content ends. Open elements are
found by name, not by a walk, so broken markup takes no longer than other. The renderer then walks
the tree and emits every visible text: blocks on lines of their own, paragraphs set apart, list items
with bullets or numbers, preformatted text as it is, and table cells in aligned columns, with their
column and row spans. Hidden elements (scripts, styles, templates, ``hidden``, ``display: none``, hidden
inputs, closed dialogs) give nothing; of ``visibility: hidden`` only what is visible inside. ``aria-hidden``
ones and the text of ``svg`` and ``math`` are on the screen, so they count. Cells wider than ``WIDTH``
are whole but push their own line only, as one such cell would else widen every row; tables nested
deeper than ``NESTED`` are written as blocks.

Pages are independent, so Spark reads and renders them where they lie; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B

BATCH_BYTES = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset(
    "head script style template title noscript iframe noembed noframes object audio video canvas datalist input rp"
    " desc metadata defs symbol clippath mask marker annotation annotation-xml".split()  # of svg and math
)
#: Elements that may stand in a head; any other, or text, ends it.
HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes".split())
#: Blocks with a blank line before and after, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCKS = SPACED | frozenset(
    "html body div article section nav aside header footer main address li dt dd form fieldset legend details summary figcaption center tr caption optgroup option text foreignobject mtr".split()
)
#: A start tag ends an open element of these names, if none of the fences lies between.
ENDS: dict[str, tuple[frozenset, frozenset]] = {}


def _ends(tags: str, closed: str, fences: str) -> None:
    for tag in tags.split():
        ENDS[tag] = (frozenset(closed.split()), frozenset(fences.split()))


#: Elements that hold back the end tags of others, and the end tags that pass them.
CELLS = ("table", "td", "th")
THROUGH_CELLS = frozenset("table tr tbody thead tfoot body html".split())

_ends("p div article section nav aside header footer main address h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset details center", "p", "button td th caption table")
_ends("li", "li p", "ul ol menu")
_ends("dt dd", "dt dd p", "dl")
_ends("tr", "tr td th p caption colgroup", "table")
_ends("td th", "td th p", "tr table")
_ends("thead tbody tfoot", "thead tbody tfoot tr td th p caption colgroup", "table")
_ends("option", "option", "select datalist")
_ends("optgroup", "option optgroup", "select")
_ends("body", "head", "")

#: A quoted value begins after an equals sign only; an apostrophe elsewhere in a tag is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
#: The largest spans of a cell that browsers take.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
BLANKS = re.compile(r"[ \t\n\f\r]+")
#: Widest table column that is padded; wider cells only push their own line.
WIDTH = 40
#: Tables nested deeper than this are written as plain blocks.
NESTED = 12


class Node:
    """An element, or with ``text`` a run of text."""

    __slots__ = ("tag", "attributes", "children", "text")

    def __init__(self, tag: str, attributes: dict | None = None, text: str = ""):
        self.tag, self.attributes, self.children, self.text = tag, attributes or {}, [], text

    @property
    def shown(self) -> bool:
        a = self.attributes
        closed = self.tag == "dialog" and "open" not in a
        return not (self.tag in NEVER_SHOWN or closed or "hidden" in a or ("style" in a and INVISIBLE.search(a["style"])))


class Stack:
    """The open elements, with the places of each name, so that no element is walked over to find another."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        while len(self.nodes) > depth:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_below(self, tags: Iterable[str], fence: int) -> int:
        """Place of the outermost open element of these names inside ``fence``, 0 if there is none."""
        inside = (own[k] for t in tags if (own := self.places.get(t)) and (k := bisect_right(own, fence)) < len(own))
        return min(inside, default=0)


def build(page: str) -> Node:
    """The tree of a page; every input gives one."""
    root = Node("#root")
    stack, at = Stack(root), 0
    size = len(page)

    def add_text(text: str) -> None:
        text = html.unescape(text)
        if stack.nodes[-1].tag == "head" and text.strip(" \t\n\f\r"):
            stack.cut(len(stack.nodes) - 1)
        stack.nodes[-1].children.append(Node("#text", text=text))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            depth = stack.last([tag])
            if depth and (tag in THROUGH_CELLS or depth >= stack.last(CELLS)):
                stack.cut(depth)
            elif tag == "p":  # an end tag alone stands for an empty paragraph
                stack.nodes[-1].children.append(Node("p"))
        elif m[2]:
            tag = m[2].lower()
            if stack.nodes[-1].tag == "head" and tag not in HEAD:
                stack.cut(len(stack.nodes) - 1)
            if tag in ENDS:
                closed, fences = ENDS[tag]
                if depth := stack.first_below(closed, stack.last(fences)):
                    stack.cut(depth)
            attributes = {}
            if m[3].strip("/ \t\r\n"):
                for a in ATTRIBUTE.finditer(m[3]):
                    attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            node = Node(tag, attributes)
            stack.nodes[-1].children.append(node)
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                end = close.start() if close else size
                if end > at:
                    node.children.append(Node("#text", text=html.unescape(page[at:end]) if tag in ("title", "textarea") else page[at:end]))
                at = close.end() if close else size
            elif tag not in VOID:
                stack.push(node)
    hide(root)
    return root


def hide(root: Node) -> None:
    """Take the text out of what ``visibility`` hides; a visible element inside stays."""
    todo = [(root, False)]
    while todo:
        node, hidden = todo.pop()
        if (style := node.attributes.get("style")) and (found := VISIBILITY.findall(style)):
            hidden = found[-1].lower() != "visible"
        if hidden:
            node.text = ""
            node.tag = {"li": "div", "img": "span", "hr": "div"}.get(node.tag, node.tag)
        todo.extend((child, hidden) for child in node.children)


class Lines:
    """Finished lines, and the one being written."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""

    def word(self, text: str) -> None:
        """Inline text; blanks run together, also across elements."""
        parts = BLANKS.split(text)
        if not parts[0] and len(parts) > 1:
            self.space = True
        body = " ".join(x for x in parts if x)
        if body:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(body)
            self.space = False
        if len(parts) > 1 and not parts[-1]:
            self.space = True

    def end(self, gap: int = 0) -> None:
        """End the line; ``gap`` blank lines come before the next text."""
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append((self.indent + line).rstrip())


def render(root: Node, depth: int = 0) -> str:
    """Text of a tree that lies ``depth`` tables deep."""
    out = Lines()
    _walk(root, out, depth)
    out.end()
    return "\n".join(out.lines)


def _walk(root: Node, out: Lines, depth: int) -> None:
    """Depth first with a stack of its own, so that deep nesting cannot end the process."""
    todo: list = [root]
    counters: list[list] = []
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node = item
        if node.tag == "#text":
            out.word(node.text)
            continue
        if not node.shown:
            continue
        tag = node.tag
        if tag == "br":
            if out.now:
                out.end()
            else:
                out.put("") if out.lines and not out.gap else None
            continue
        if tag == "hr":
            out.end(1), out.put("----"), out.end(1)
            continue
        if tag in ("td", "th", "mtd"):  # a cell that no table aligns
            out.space = True
            todo.append(lambda: setattr(out, "space", True))
        if tag == "img":
            out.word(node.attributes.get("alt", ""))
            continue
        if tag == "table" and depth < NESTED:
            out.end(1)
            for line in _table(node, depth + 1):
                out.put(line)
            out.end(1)
            continue
        if tag in ("pre", "textarea"):
            out.end(1)
            for line in _plain(node).strip("\n").split("\n"):
                out.put(line)
            out.end(1)
            continue
        if tag in BLOCKS:
            gap = 1 if tag in SPACED and not (tag in ("ul", "ol") and counters) else 0
            out.end(gap)
            after = [lambda gap=gap: out.end(gap)]
            if tag in ("ul", "ol"):
                start = node.attributes.get("start", "1")
                counters.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                after.append(counters.pop)
            elif tag == "li":
                kind = counters[-1] if counters else ["ul", 1]
                if kind[0] == "ol" and re.fullmatch(r"-?\d{1,9}", number := node.attributes.get("value", "")):
                    kind[1] = int(number)
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                old = out.indent
                out.now.append("  " * max(len(counters) - 1, 0) + mark)
                after.append(lambda old=old: setattr(out, "indent", old))
            elif tag in ("blockquote", "dd"):
                old, out.indent = out.indent, out.indent + "  "
                after.append(lambda old=old: setattr(out, "indent", old))
            todo.extend(reversed(after[1:]))
            todo.append(after[0])
        todo.extend(reversed(node.children))


def _plain(node: Node) -> str:
    """Text of an element with its blanks."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag == "#text":
            out.append(n.text)
        elif n is node or n.shown:
            if n.tag == "br":
                out.append("\n")
            todo.extend(reversed(n.children))
    return "".join(out)


def _table(table: Node, depth: int) -> list[str]:
    """Captions, then rows with aligned cells. A cell of several lines, also a table in a cell, takes several."""
    lines, rows, todo = [], [], list(reversed(table.children))
    taken: dict[int, int] = {}  # columns that a cell of an earlier row covers, and up to which row
    while todo:
        node = todo.pop()
        if node.tag == "#text" or not node.shown:
            if node.tag == "#text" and node.text.strip(" \t\n\f\r"):
                lines.append(" ".join(x for x in BLANKS.split(node.text) if x))
            continue
        if node.tag == "tr":
            cells, column = [], 0
            for cell in node.children:
                if cell.tag == "#text":
                    if not cell.text.strip(" \t\n\f\r"):
                        continue
                    text, wide, high = [" ".join(x for x in BLANKS.split(cell.text) if x)], 1, 1
                elif cell.shown:
                    text, wide, high = _cell(cell, depth), _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
                else:
                    continue
                while taken.get(column, 0) > len(rows):  # by a cell of an earlier row
                    column += 1
                cells.append((column, text, wide))
                if high > 1:
                    taken.update((column + k, len(rows) + high) for k in range(wide))
                column += wide
            rows.append(cells)
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(node.children))
        else:
            lines += _cell(node, depth)
    # Only columns in which a cell begins take room, so a wide span of nothing takes none.
    begins = sorted({column for cells in rows for column, _, _ in cells})
    widths = [0] * len(begins)
    placed = []
    for cells in rows:
        own = [(bisect_left(begins, column), bisect_left(begins, column + wide), text) for column, text, wide in cells]
        placed.append(own)
        for a, b, text in own:
            if b - a == 1:
                widths[a] = max(widths[a], min(max(map(len, text), default=0), WIDTH))
    ends = [0]
    for width in widths:
        ends.append(ends[-1] + width + 3)
    for own in placed:
        for k in range(max((len(text) for _, _, text in own), default=0)):
            line, at = "", 0
            for a, b, text in own:
                line += "".join(" " * widths[c] + " | " for c in range(at, a))  # columns of cells from earlier rows, and missing ones
                line += (text[k] if k < len(text) else "").ljust(ends[b] - ends[a] - 3) + " | "
                at = b
            lines.append(line[:-3].rstrip())
    return lines


def _span(cell: Node, name: str, most: int) -> int:
    """Columns or rows of a cell; a rowspan of 0 runs to the end of the table."""
    value = cell.attributes.get(name, "1") if cell.tag in ("td", "th") else "1"
    if not re.fullmatch(r"\d{1,9}", value):
        return 1
    return min(int(value), most) or (most if name == "rowspan" else 1)


def _cell(node: Node, depth: int) -> list[str]:
    inner = Node("div")
    inner.children = node.children
    return render(inner, depth).split("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rendered text of every page.

    Returns one row per input row: ``id_col``, ``title`` (null if the page has none), ``text`` and
    ``n_lines``. A null page has a null title and text and no lines, an empty one an empty text.
    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty
    result. No page is cut, however long or deeply nested; broken markup gives what a browser shows.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.batched(batches, BATCH_BYTES, "html"):
            titles, texts = [], []
            for page in table.column("html").to_pylist():
                root = build(page) if page is not None else None
                texts.append(None if root is None else render(root))
                titles.append(None if root is None else title(root))
            lines = [0 if not t else t.count("\n") + 1 for t in texts]
            yield from pa.table({"id": table.column("id"), "title": pa.array(titles, pa.string()), "text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64())}).to_batches()

    return rows.mapInArrow(run, f"id {id_type}, title string, text string, n_lines long").withColumnRenamed("id", id_col)


def title(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return " ".join(x for x in BLANKS.split(_plain(node)) if x)
        if node.tag != "svg":
            todo.extend(reversed(node.children))
    return None
