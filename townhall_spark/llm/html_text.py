"""HTML extraction: the visible text of a page, laid out as a browser would.

A tree builder keeps the open elements, closing those whose end tags are implied.
When an element closes, its content is laid out and handed to its parent, so depth
costs no recursion: blocks stand on lines of their own, list items get markers and
indents, table cells are padded to the width of their column, up to a limit, and keep
clear of cells that span rows. Visibility follows the elements, their attributes and
style, and style sheets as far as their selectors name a tag, a class or an id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townhall_spark.llm.common import values

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title object iframe datalist "
                   "audio video canvas annotation annotation-xml".split())
_HIDDEN_IN_SVG = frozenset("desc defs metadata".split())
# Blocks with an empty line around them, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
LINED = frozenset("html body div article section nav aside header footer main address form "
                  "fieldset li dt dd tr caption thead tbody tfoot details summary figcaption "
                  "option legend center".split())
# An opening tag closes these open elements, but none outside of the bounds.
IMPLIED = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
# What may stand in a head; any other start tag, and text that is not blank, ends it.
_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style "
                     "template title".split())
_CLOSES_P = (SPACED | LINED) - {"html", "body", "tr", "thead", "tbody", "tfoot", "option"}
_P_BOUNDS = ("td", "th", "table", "button", "caption")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_MOST_SPAN = 1000


# Characters to which a column is padded; a longer cell is broken into lines at its spaces,
# and a longer word runs over.
MOST_WIDTH = 60
# Characters up to which the empty columns side by side in a line are written out; a wider blank
# is written as "×" and how many columns it stands for, in tables of any size.
MOST_BLANK = 4 * MOST_WIDTH


class _Row(str):
    """A line of a table, which stays whole in the cells of tables around it: broken there, its
    empty columns would be lines of their own, and padded once more at each depth."""

    __slots__ = ()


class Cell(NamedTuple):
    lines: list[str]
    columns: int
    rows: int


def _grid(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Rows of (column, cell): each in the first column that no cell of a row above reaches
    into. Columns in which no cell starts are left out."""
    out, busy = [], {}
    for row in rows:
        placed, column = [], 0
        taken = {c for c, left in busy.items() if left}
        for cell in row:
            while column in taken:
                column += 1
            placed.append((column, cell))
            if cell.rows > 1:
                for c in range(column, column + cell.columns):
                    busy[c] = max(busy.get(c, 0), cell.rows)
            column += cell.columns
        busy = {c: left - 1 for c, left in busy.items() if left > 1}
        out.append(placed)
    used = {c: n for n, c in enumerate(sorted({c for row in out for c, _ in row}))}
    return [[(used[c], cell) for c, cell in row] for row in out]


def _broken(lines: list[str]) -> list[str]:
    """Lines of at most ``MOST_WIDTH`` characters, unless a word or a table has more."""
    out = []
    for line in lines:
        while len(line) > MOST_WIDTH and not isinstance(line, _Row):
            at = line.rfind(" ", 0, MOST_WIDTH + 1)
            at = at if at > 0 else line.find(" ", MOST_WIDTH)
            if at < 0:
                break
            out.append(line[:at].rstrip(" "))
            line = line[at:].lstrip(" ")
        out.append(line)
    return out


def _line(cells: list[tuple[int, str]], width: list[int], begin: list[int]) -> _Row:
    """Texts of a line at their columns, which have these widths and begin there."""
    out, at = [], 0
    for column, text in cells:
        if begin[column] - begin[at] > MOST_BLANK:
            out.append(f"×{column - at}")
        elif column > at:
            out.extend([" " * w for w in width[at:column]])
        out.append(text.ljust(width[column]))
        at = column + 1
    return _Row(" | ".join(out).rstrip())


def _padded(rows: list[list[Cell]]) -> list[_Row]:
    """Rows of cells as lines, each column as wide as its widest line.

    A row's layout follows from its cells and the columns, however many rows there are, and
    from any line the column of each text can be told."""
    grid = [[(c, _broken(cell.lines)) for c, cell in row] for row in _grid(rows)]
    width = [0] * (1 + max((c for row in grid for c, _ in row), default=0))
    for row in grid:
        for c, lines in row:
            width[c] = max(width[c], min(max(map(len, lines)), MOST_WIDTH))
    begin = list(accumulate((w + 3 for w in width), initial=0))
    out = []
    for row in grid:
        shown = [[] for _ in range(max((len(lines) for _, lines in row), default=0))]
        for c, lines in row:
            for line, text in zip(shown, lines, strict=False):
                if text.strip(" "):
                    line.append((c, text))
        for line in shown:
            # A line ends at the row's last cell, also where that is empty.
            if not line or line[-1][0] < row[-1][0]:
                line.append((row[-1][0], ""))
            out.append(_line(line, width, begin))
    return out


def _after(mark: str, line: str) -> str:
    """The line behind a mark or an indent; that of a table remains one."""
    return type(line)(mark + line)


def _declared(style: str) -> dict[str, str]:
    return {name.lower(): value.lower() for name, value in _DECLARED.findall(style)}


def _rules(css: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(selector, declarations) of the rules that hold on any screen."""
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    at = 0
    while (begin := css.find("{", at)) >= 0:
        head, at = css[at:begin].strip(), begin + 1
        if head.startswith("@"):
            depth = 1
            while depth and at < len(css):
                depth += (css[at] == "{") - (css[at] == "}")
                at += 1
            continue
        end = css.find("}", at)
        end = len(css) if end < 0 else end
        declared = _declared(css[at:end])
        if declared:
            for selector in head.split(","):
                yield selector.strip(), declared
        at = end + 1


def _number(value: str | None) -> int:
    """A positive number in an attribute, else 1."""
    return int(value) or 1 if re.fullmatch(r"[0-9]{1,9}", value or "") else 1


class _Open:
    """An open element: its finished lines, the line being written, and its gaps."""

    __slots__ = ("tag", "hidden", "unseen", "pre", "attrs", "lines", "line", "gap", "rows", "count")

    def __init__(self, tag: str, attrs: dict, hidden: bool, unseen: bool, pre: bool):
        self.tag, self.attrs, self.pre = tag, attrs, pre
        # What is hidden takes all inside with it; what is unseen may hold what is visible.
        self.hidden, self.unseen = hidden, unseen
        self.lines, self.line, self.gap = [], [], 0
        self.rows, self.count = [], 0

    def text(self, text: str) -> None:
        if self.pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.line.append(first)
            for part in rest:
                self.end_line(True)
                self.line.append(part)
            return
        text = _SPACE.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            self.line.append(text)

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.line)
        self.line = []
        line = line if self.pre else line.strip(" ")
        if line or keep_empty:
            self._add([line])

    def _add(self, lines: list[str]) -> None:
        if self.lines and self.gap == 2:
            self.lines.append("")
        if self.lines:
            self.lines.extend(lines)
        else:
            self.lines = lines
        self.gap = 0

    def block(self, lines: list[str], spaced: bool) -> None:
        """Lines of a block inside, with an empty line around it if ``spaced``."""
        self.end_line()
        if lines:
            self.gap = max(self.gap, 2 if spaced else 1)
            self._add(lines)
            self.gap = 2 if spaced else 1

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Open("#root", {}, False, False, False)]
        self.tags = {}
        # Declarations of style sheets by tag, sign and name of simple selectors.
        self.styles: dict[tuple[str, str, str], dict[str, str]] = {}
        self.sheet: list[str] = []

    def _style(self, tag: str, attrs: dict) -> dict[str, str]:
        """What style sheets, then the element's own style declare."""
        found = {}
        if self.styles:
            names = [("", "")] + [(".", c) for c in (attrs.get("class") or "").split()]
            names += [("#", attrs["id"])] if attrs.get("id") else []
            for sign, name in names:
                for of in ("", tag):
                    found |= self.styles.get((of, sign, name), {})
        return found | _declared(attrs.get("style") or "")

    def _near(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> int | None:
        """The innermost open element of ``tags``, with none of ``bounds`` inside it."""
        if not any(self.tags.get(t) for t in tags):
            return None
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                return at
            if self.stack[at].tag in bounds:
                return None
        return None

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._fold()

    def _end_head(self) -> None:
        """Closes a head that is the innermost open element."""
        if self.stack[-1].tag == "head":
            self._fold()

    def _imply(self, tag: str) -> None:
        if tag not in _IN_HEAD:
            self._end_head()
        if tag in _CLOSES_P and (at := self._near(("p",), _P_BOUNDS)) is not None:
            self._close_to(at)
        if tag in IMPLIED:
            while (at := self._near(*IMPLIED[tag])) is not None:
                self._close_to(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._imply(tag)
        top = self.stack[-1]
        if tag in VOID:
            if not top.hidden and not top.unseen:
                if tag == "br":
                    top.end_line(True)
                elif tag == "hr":
                    top.block(["---"], True)
            return
        named = dict(attrs)
        style = self._style(tag, named)
        hidden = (top.hidden or tag in HIDDEN or style.get("display") == "none"
                  or ("hidden" in named and "display" not in style)
                  or (tag in _HIDDEN_IN_SVG and bool(self.tags.get("svg")))
                  or (top.tag == "details" and "open" not in top.attrs and tag != "summary"))
        seen = style.get("visibility", "inherit")
        unseen = top.unseen if seen == "inherit" else seen in ("hidden", "collapse")
        self.stack.append(_Open(tag, named, hidden, unseen, top.pre or tag in ("pre", "textarea")))
        self.tags[tag] = self.tags.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.tags.get("p"):
            self.stack[-1].block([], True)
            return
        bounds = ("table",) if tag not in ("table", "body", "html") else ()
        at = self._near((tag,), bounds)
        if at is not None:
            self._close_to(at)

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head()
        top = self.stack[-1]
        if top.tag == "style":
            self.sheet.append(data)
        if not top.hidden and not top.unseen and not (
                top.tag == "details" and "open" not in top.attrs):
            if top.tag in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol", "dl") \
                    and not data.strip():
                return
            top.text(data)

    def _fold(self) -> None:
        """Closes the innermost element and hands what it shows to its parent."""
        own, parent = self.stack.pop(), self.stack[-1]
        self.tags[own.tag] -= 1
        if own.tag == "style" and not self.tags.get("template"):
            for selector, declared in _rules("".join(self.sheet)):
                if (match := _SELECTOR.fullmatch(selector)) and selector:
                    of = ((match[1] or "").lower(), match[2] or "", match[3] or "")
                    self.styles[of] = self.styles.get(of, {}) | declared
            self.sheet = []
        if own.hidden:
            return
        tag = own.tag
        if tag in ("td", "th"):
            row = next((e for e in reversed(self.stack) if e.tag in ("tr", "table")), None)
            if row is not None:
                row.rows.append([Cell(own.done() or [""],
                                      min(_number(own.attrs.get("colspan")), _MOST_SPAN),
                                      min(_number(own.attrs.get("rowspan")), _MOST_SPAN))])
                return
        if tag == "tr":
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            cells = [c for row in own.rows for c in row]
            if table is not None:
                table.rows.append(("row", cells))
                cells = []
            parent.block(own.done() + (_padded([cells]) if cells else []), False)
            return
        if tag == "table":
            loose = [c for c in own.rows if not isinstance(c, tuple)]
            rows = [r[1] for r in own.rows if isinstance(r, tuple)]
            rows = [r for r in rows + [sum(loose, [])] if r]
            parent.block(own.done() + (_padded(rows) if rows else []), True)
            return
        if tag == "li":
            home = next((e for e in reversed(self.stack) if e.tag in ("ul", "ol")), None)
            mark = "- "
            if home is not None and home.tag == "ol":
                mark = f"{_number(home.attrs.get('start')) + home.count}. "
                home.count += 1
            lines = own.done()
            lines = [_after(mark, lines[0])] + [_after(" " * len(mark), x) if x else x
                                                for x in lines[1:]] if lines else []
            parent.block(lines, False)
            return
        if tag == "dd":
            parent.block([_after("  ", x) if x else x for x in own.done()], False)
            return
        if tag in SPACED or tag in LINED:
            nested = tag in ("ul", "ol") and any(e.tag == "li" for e in self.stack)
            parent.block(own.done(), tag in SPACED and not nested)
            return
        # An inline element: what it holds goes on in its parent's line.
        if own.lines:
            parent.block(own.done(), False)
        elif not parent.line and own.pre == parent.pre:
            parent.line = own.line
        else:
            for part in own.line:
                if not own.pre and parent.line and parent.line[-1].endswith(" "):
                    part = part.removeprefix(" ")
                if part:
                    parent.line.append(part)

    def finish(self) -> str:
        self.close()
        self._close_to(1)
        return "\n".join(self.stack[0].done()).strip("\n")


def visible_text(html: str | None) -> str:
    """The text that a page shows; empty for a null, empty or invisible page."""
    page = _Page()
    page.feed(html or "")
    return page.finish()


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, n_chars) per page: its visible text, laid out.

    Pages are read whole, however malformed. A null page has an empty text; repeated
    rows each give a row; an empty table gives an empty table; other columns are not
    read. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["key", "text", "n_chars"])
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(
        run, f"key {kind}, text string, n_chars long").withColumnRenamed("key", key)
