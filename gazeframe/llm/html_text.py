"""Text of web pages as a reader sees it: a small tree builder, visibility rules, and a renderer that keeps the layout.

The builder closes elements whose end tags HTML lets one leave out (paragraphs, list items, table parts, options) and
ignores stray end tags. What a browser hides (scripts, styles, ``hidden``, ``display:none`` and the like, and what a
graphic holds beside its text) is left out; all other text is kept, at any depth. Blocks stand on lines of their own, paragraphs and headings have an empty line around them, list
items a marker and indent, and a table's cells are padded so that its columns line up, also under cells that span rows
or columns. A line of a cell that is longer than WIDE stands out of its column. All padding and indenting of a page
comes from one budget of PADDING times its source; from where that is used up, tables' cells stand in a line unpadded
and lines are not indented. The same holds within more than NESTED tables, lists or quotes. So a page's text
stays in proportion to its source; markers and text are all there. Pages of any length are walked without recursion.

Also hidden are a ``dialog`` that isn't open, all of a closed ``details`` but its summary, popovers, and text under
``visibility:hidden``, though not what is made visible again inside. Numbered lists follow ``start``, ``reversed`` and ``value``.

Defined results: a null html gives a null text, an empty one an empty text. Broken markup never fails. Repeated rows
give repeated results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from gazeframe.llm.common import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object canvas audio video datalist annotation annotation-xml".split())
#: Within a graphic: what is not drawn; else only text within these elements is.
UNDRAWN = frozenset("desc metadata defs symbol marker pattern clippath mask".split())
DRAWN = ("text", "foreignobject")
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = SPACED | frozenset("html body div section article main header footer nav aside address form fieldset li dt dd hr details summary figcaption caption center menu dir legend".split())
#: A start tag closes these open elements, if no element of the second set is in between.
IMPLIED = {
    **dict.fromkeys(SPACED | frozenset("div section article main header footer nav aside address form fieldset hr details menu dir center".split()), (frozenset({"p"}), frozenset({"button", "td", "th", "caption"}))),
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "p", "caption"}), frozenset({"table"}))),
    "body": (frozenset({"head"}), frozenset({"html"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: These start tags end a graphic or formula that they stand in, if none of the second set is in between.
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = (frozenset({"svg", "math"}), frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split()))
_UNSEEN = re.compile(r"display\s*:\s*none|content-visibility\s*:\s*hidden|(?:^|;)\s*opacity\s*:\s*0(?:\.0*)?\s*(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_WHOLE = re.compile(r"-?\d{1,9}", re.A)
NESTED = 200
#: Characters of a cell's line that a column is made as wide as at most; how many times a page's source its padding may be, beside 4096 characters.
WIDE, PADDING = 80, 8
#: Columns and rows that a cell spans at most, as in HTML.
SPANS = {"colspan": 1000, "rowspan": 65534}


class Node:
    """An element. ``hidden``: neither it nor anything in it is seen; ``dark``: text directly in it isn't; ``shut``: a closed details, 1 before its summary, 2 after."""

    __slots__ = ("tag", "attrs", "children", "hidden", "dark", "shut")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        style = attrs.get("style") or ""
        self.hidden = tag in HIDDEN or "hidden" in attrs or "popover" in attrs or bool(_UNSEEN.search(style)) or tag == "input" or tag == "dialog" and "open" not in attrs
        said = _VISIBILITY.findall(style)
        self.dark = said[-1].lower() != "visible" if said else parent is not None and parent.dark
        self.shut = int(tag == "details" and "open" not in attrs)
        if parent is not None and parent.shut:
            if tag == "summary" and parent.shut == 1:
                parent.shut = 2
            else:
                self.hidden = True


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in ``open`` of each tag's elements

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, k: int) -> None:
        for node in reversed(self.open[k:]):
            self.at[node.tag].pop()
        del self.open[k:]

    def _end_implied(self, closes, until) -> None:
        last = self._last(until)
        found = [at[bisect_right(at, last)] for at in (self.at[t] for t in closes if self.at.get(t)) if at[-1] > last]
        if found:
            self._close(min(found))

    def handle_starttag(self, tag, attrs):
        if tag in LEAVES:
            self._end_implied(*FOREIGN)
        if tag in IMPLIED:
            self._end_implied(*IMPLIED[tag])
        node = Node(tag, dict(attrs), self.open[-1])
        node.hidden = node.hidden or tag in UNDRAWN and bool(self.at["svg"])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)
        if tag == "textarea":
            self.set_cdata_mode(tag)  # tags in it are text

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("script", "style", "iframe") or self._last(FOREIGN[0]) > self._last(FOREIGN[1] - {tag})):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        k = self._last((tag,))
        if tag not in BLOCK and self._last(("table",)) > k:
            return
        if k:
            self._close(k)
        elif tag == "p":
            self.handle_starttag("p", [])
            self._close(len(self.open) - 1)

    def handle_data(self, data):
        last = self.open[-1]
        if self._last(("svg",)) <= self._last(DRAWN) and not last.dark and not last.shut:
            last.children.append(unescape(data) if last.tag == "textarea" and self.cdata_elem else data)


class _Block:
    """Lines of a nested page with what stands before the first one and before the others."""

    __slots__ = ("first", "rest", "lines")

    def __init__(self, first: str, rest: str, lines: list):
        self.first, self.rest, self.lines = first, rest, lines


class _Budget:
    """Characters that padding and indenting may still add to a page."""

    __slots__ = ("left",)

    def __init__(self, left: int):
        self.left = left


class _Page:
    """Lines under construction: inline text gathers in ``line``; ``gap`` empty lines are due before the next one."""

    def __init__(self, budget: _Budget, tables: int = 0):
        self.budget = budget
        self.lines: list[str | _Block] = []
        self.line: list[str] = []
        self.gap = 0
        self.tables = tables  # how many tables it is in

    def end(self, gap: int = 0) -> None:
        text = _SPACE.sub(" ", "".join(self.line)).strip(" ")
        self.line = []
        if text:
            self.put(text)
        self.gap = max(self.gap, gap)

    def put(self, text: str | _Block) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.lines.append(text)


def _flat(lines: list[str | _Block], budget: _Budget) -> list[str]:
    """The lines with those of the blocks, each behind what its blocks put before it."""
    out = []
    marks: list[str] = []  # of the open blocks
    fresh = 0  # those from here on have had no line yet
    stack = [(iter(lines), "")]
    while stack:
        line = next(stack[-1][0], None)
        if line is None:
            stack.pop()
            del marks[-1:]
            fresh = min(fresh, len(marks))
        elif isinstance(line, _Block):
            stack.append((iter(line.lines), line.rest))
            marks.append(line.first)
        else:
            before = marks[:NESTED] + marks[max(fresh, NESTED) :] if budget.left > 0 else marks[fresh:]
            budget.left -= sum(map(len, marks[: min(fresh, NESTED)])) if budget.left > 0 else 0
            if marks and line.strip():
                line = ("".join(before) + line).rstrip()
            else:
                for mark in reversed(before):
                    line = (mark + line).rstrip() if line else ""
            out.append(line)
            marks[fresh:] = [rest for _, rest in stack[fresh + 1 :]]
            fresh = len(marks)
    return out


def _run(walk: Iterator) -> None:
    """Runs a walk that yields the walks of parts, each to be done before it goes on: recursion without the call stack."""
    stack = [walk]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        else:
            stack.append(part)


def _walk(node: Node, page: _Page) -> Iterator:
    for child in node.children:
        if isinstance(child, str):
            page.line.append(child)
        elif child.hidden:
            continue
        elif child.tag == "br":
            page.end()
        elif child.tag == "pre":
            page.end(1)
            inner = "".join(_texts(child)).strip("\n")
            for line in inner.split("\n") if inner.strip() else []:
                page.put(line.rstrip())
            page.gap = 1
        elif child.tag == "table" and page.tables < NESTED:
            page.end(1)
            yield _table(child, page)
            page.gap = 1
        elif child.tag in ("ul", "ol", "menu", "dir"):
            page.end(0 if node.tag == "li" else 1)
            yield _list(child, page)
            page.gap = max(page.gap, 0 if node.tag == "li" else 1)
        elif child.tag == "dd":
            yield _nested(child, page, "    ", "    ")
        elif child.tag == "blockquote":
            page.end(1)
            yield _nested(child, page, "> ", "> ")
            page.gap = 1
        elif child.tag in BLOCK or child.tag == "tr" and page.tables >= NESTED:
            gap = int(child.tag in SPACED)
            page.end(gap)
            yield _walk(child, page)
            page.end(gap)
        elif child.tag in ("td", "th", "option", "text", "mtd"):
            page.line.append(" ")
            yield _walk(child, page)
            page.line.append(" ")
        elif child.children:
            yield _walk(child, page)


def _nested(node: Node, page: _Page, first: str, rest: str) -> Iterator:
    page.end()
    own = _Page(page.budget, page.tables)
    yield _walk(node, own)
    own.end()
    if own.lines:
        page.put(_Block(first, rest, own.lines))


def _list(node: Node, page: _Page) -> Iterator:
    start = node.attrs.get("start") or ""
    back = "reversed" in node.attrs
    items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    number = int(start) if _WHOLE.fullmatch(start) else items if back else 1
    loose = Node("div", {})
    for child in [*node.children, None]:
        if isinstance(child, Node) and child.tag == "li" or child is None:
            if loose.children:
                yield _nested(loose, page, "  ", "  ")
                loose = Node("div", {})
            if child is not None and not child.hidden:
                value = child.attrs.get("value") or ""
                number = int(value) if _WHOLE.fullmatch(value) else number
                mark = f"{number}. " if node.tag == "ol" else "- "
                yield _nested(child, page, mark, " " * len(mark))
                number += -1 if back else 1
        else:
            loose.children.append(child)


def _texts(node: Node) -> Iterator[str]:
    stack = [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            yield child
        elif not child.hidden:
            if child.tag == "br":
                yield "\n"
            stack.append(iter(child.children))


def _rows(node: Node, loose: Node) -> Iterator[Node]:
    stack = [iter(node.children)]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, Node) and child.tag in ("tbody", "thead", "tfoot"):
            if not child.hidden:
                stack.append(iter(child.children))
        elif isinstance(child, Node) and child.tag == "tr":
            if not child.hidden:
                yield child
        else:
            loose.children.append(child)


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name) or ""
    return min(int(value), SPANS[name]) if re.fullmatch(r"[1-9]\d{0,5}", value, re.A) else 1


def _columns(rows: list[list[tuple[int, int, list[str]]]]) -> list[list[tuple[int, list[str]]]]:
    """Rows of (columns, rows, lines) as rows of (column, lines): each cell's first free column, without columns that no cell starts in."""
    placed, starts = [], set()
    room = 64 * sum(map(len, rows)) + 4096  # a table whose spans need more than this is taken without them
    taken: list[tuple[int, int, int]] = []  # first column, end, first row below
    for r, cells in enumerate(rows):
        taken = sorted(t for t in taken if t[2] > r)
        room -= len(taken)
        if room < 0:
            return [list(enumerate(lines for _, _, lines in row)) for row in rows]
        out, column, k = [], 0, 0
        new = []
        for wide, high, lines in cells:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            out.append((column, lines))
            starts.add(column)
            if high > 1:
                new.append((column, column + wide, r + high))
            column += wide
        taken += new
        placed.append(out)
    number = {c: k for k, c in enumerate(sorted(starts))}
    return [[(number[c], lines) for c, lines in row] for row in placed]


def _loose(grid: list[list[tuple[int, list[str]]]]) -> list[str]:
    return [" | ".join(x for x in (lines[k] for _, lines in row if k < len(lines))) for row in grid for k in range(max((len(lines) for _, lines in row), default=0))]


def _aligned(grid: list[list[tuple[int, list[str]]]], budget: _Budget) -> list[str]:
    """The lines of a table's rows; if padding goes beyond the budget, cells stand one after the other."""
    width: dict[int, int] = {}
    for row in grid:
        for c, lines in row:
            width[c] = max([width.get(c, 0), *(len(x) for x in lines if len(x) <= WIDE)])
    out = []
    left = budget.left
    place, total = {}, 0  # characters of the columns before
    for c in sorted(width):
        place[c], total = total, total + width[c] + 3
    for row in grid:
        cells = dict(row)
        last = row[-1][0] if row else -1
        high = max((len(lines) for _, lines in row), default=0)
        if high * place.get(last, 0) > left + sum(len(x) for _, lines in row for x in lines):
            return _loose(grid)
        for k in range(high):
            parts = [x[k] if k < len(x) else "" for x in (cells.get(c, []) for c in range(last + 1))]
            out.append(" | ".join(x.ljust(width[c]) for c, x in enumerate(parts)).rstrip())
            left -= len(out[-1]) - sum(map(len, parts))
        if left < 0:
            return _loose(grid)
    budget.left = left
    return out


def _table(table: Node, page: _Page) -> Iterator:
    loose = Node("div", {})
    rows = []
    for row in _rows(table, loose):
        cells = []
        rest = Node("div", {})
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th"):
                if not cell.hidden:
                    own = _Page(page.budget, page.tables + 1)
                    yield _walk(cell, own)
                    own.end()
                    cells.append((_span(cell, "colspan"), _span(cell, "rowspan"), [x for x in _flat(own.lines, page.budget) if x]))
            else:
                rest.children.append(cell)
        loose.children += rest.children
        rows.append(cells)
    out = _Page(page.budget, page.tables + 1)
    yield _walk(loose, out)  # captions, and text that is out of place
    out.end()
    for line in [*_flat(out.lines, page.budget), *_aligned(_columns(rows), page.budget)]:
        page.put(line)


def render(html: str) -> str:
    """The visible text of a page."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    page = _Page(_Budget(PADDING * len(html) + 4096))
    _run(_walk(builder.root, page))
    page.end()
    return "\n".join(_flat(page.lines, page.budget))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of every page (page_id, html)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                texts = [None if h is None else render(h) for h in part.column(1).to_pylist()]
                lines = [None if t is None else t.count("\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"])

    return bounded_batches(pages).select("page_id", "html").mapInArrow(work, "page_id long, text string, n_lines long")
