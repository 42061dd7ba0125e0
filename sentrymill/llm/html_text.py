"""HTML extraction: layout-aware rendering of whole pages to text.

The tree builder supplies implied tags and visibility; the renderer emits all
visible text: blocks on lines of their own, blank lines around paragraphs and the
like, list markers with nesting, line breaks and preformatted text as they are, and
table cells in aligned columns.  The cascade decides what is visible (see `Styles`): an
invisible element can hold visible ones, a later or more specific rule can show what another hides.

Defined results: a null or empty page gives an empty text; a page of plain text gives
that text; broken markup never raises; repeated rows are rendered each on its own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import body
from sentrymill.llm.html_tree import Node, Styles, build

# Blocks with a blank line before and after, and blocks that only start and end a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr xmp fieldset".split())
PLAIN = frozenset("address article aside body center dd details dialog div dt figcaption footer form header hgroup html legend li main nav "
                  "optgroup option search section summary tr caption textarea".split())
LISTS = frozenset("ul ol menu dir".split())
ROWS = frozenset("tbody thead tfoot".split())
CELL_GAP = "  "
# Cells wider than this are not waited for when columns are aligned; their text stays whole.
ALIGN_WIDTH = 60

_SPACES = re.compile(r"[ \t\n\r\f]+")


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Finished lines, the line being written, and the indentation in force."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.current: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.indent: list[str] = []
        self.marker = ""  # replaces the end of the indentation on the next line
        self.open_end = True  # at the start of a line or after white space

    def text(self, data: str) -> None:
        data = _SPACES.sub(" ", data)
        if self.open_end and data[:1] == " ":
            data = data[1:]
        if data:
            self.current.append(data)
            self.open_end = data[-1] == " "

    def raw(self, data: str) -> None:
        """Preformatted text: line feeds and blanks stay."""
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.current.append(first)
        for line in rest:
            self.line(keep=True)
            if line:
                self.current.append(line)
        self.open_end = False

    def line(self, keep: bool = False) -> None:
        """Ends the current line; an empty one counts only if it is to be kept."""
        text = "".join(self.current)
        text = text if keep else text.rstrip(" ")
        if text or (keep and self.done and not self.blank):
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            prefix = "".join(self.indent)
            if self.marker and text:
                prefix, self.marker = prefix[:len(prefix) - len(self.marker)] + self.marker, ""
            self.done.append(prefix + text if text else "")
        self.current = []
        self.open_end = True

    def space(self) -> None:
        self.line()
        self.blank = True

    def finish(self) -> list[str]:
        self.line()
        while self.done and not self.done[-1].strip():
            self.done.pop()
        return self.done


class Renderer:
    def __init__(self, styles: Styles):
        self.styles = styles

    def children(self, node: Node, out: Lines, raw: bool) -> None:
        for child in node.children:
            if not isinstance(child, str):
                self.node(child, out, raw)
            elif node.shown:
                (out.raw if raw else out.text)(child)

    def node(self, node: Node, out: Lines, raw: bool = False) -> None:
        tag = node.tag
        if self.styles.gone(node):
            return
        if tag == "br":
            if node.shown:
                out.line(keep=True)
        elif tag == "hr":
            out.space()
        elif tag == "table":
            out.space()
            self.table(node, out)
            out.space()
        elif tag in LISTS:
            self.list(node, out, raw)
        elif tag in ("blockquote", "dd"):
            (out.space if tag == "blockquote" else out.line)()
            out.indent.append("  " if tag == "blockquote" else "    ")
            self.children(node, out, raw)
            (out.space if tag == "blockquote" else out.line)()
            out.indent.pop()
        elif tag in ("pre", "xmp", "textarea"):
            out.space()
            lead = node.children[0] if node.children and isinstance(node.children[0], str) else ""
            if lead.startswith("\n"):
                node.children[0] = lead[1:]
            self.children(node, out, True)
            out.space()
        elif tag in SPACED or tag in PLAIN:
            ends = out.space if tag in SPACED else out.line
            ends()
            self.children(node, out, raw)
            ends()
        elif tag == "input":
            if node.shown and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                out.text(" " + node.attributes.get("value", "") + " ")
        elif tag in ("td", "th"):
            self.children(node, out, raw)
            out.text(" ")
        else:
            self.children(node, out, raw)

    def list(self, node: Node, out: Lines, raw: bool) -> None:
        inner = bool(out.indent)
        (out.line if inner else out.space)()
        start = node.attributes.get("start", "").strip()
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li" and not self.styles.gone(child):
                value = child.attributes.get("value", "").strip()
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                marker = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                out.line()
                if not child.shown:
                    self.children(child, out, raw)  # what is visible in it, without a marker
                    out.line()
                    continue
                out.indent.append(" " * len(marker))
                before, out.marker = out.marker, out.marker + marker
                self.children(child, out, raw)
                out.line()
                out.marker = "" if not out.marker.endswith(marker) else before
                out.indent.pop()
            elif not isinstance(child, str):
                self.node(child, out, raw)
            elif node.shown:
                out.text(child)
        (out.line if inner else out.space)()

    def _rows(self, table: Node) -> tuple[list[Node], list[Node]]:
        rows, others = [], []
        for child in table.children:
            if isinstance(child, Node) and not self.styles.gone(child):
                if child.tag == "tr":
                    rows.append(child)
                elif child.tag in ROWS:
                    more, rest = self._rows(child)
                    rows += more
                    others += rest
                else:
                    others.append(child)
        return rows, others

    def table(self, table: Node, out: Lines) -> None:
        rows, others = self._rows(table)
        for node in others:
            self.node(node, out)
            out.line()
        grid: list[list[list[str]]] = []
        held: dict[int, int] = {}  # column: rows that a cell above still covers
        for row in rows:
            line: list[list[str]] = []
            for cell in row.children:
                if not isinstance(cell, Node) or self.styles.gone(cell):
                    continue
                while held.get(len(line), 0):
                    held[len(line)] -= 1
                    line.append([])
                inner = Lines()
                self.children(cell, inner, False)
                span, down = (int(v) if (v := cell.attributes.get(k, "").strip()).isdecimal() and 0 < int(v[:4]) <= 100 else 1
                              for k in ("colspan", "rowspan"))
                for i in range(span):
                    if down > 1:
                        held[len(line)] = down - 1
                    line.append(inner.finish() if i == 0 else [])
            grid.append(line)
        columns = max(map(len, grid), default=0)
        widths = [0] * columns
        for line in grid:
            for i, cell in enumerate(line):
                fitting = [w for w in map(width, cell) if w <= ALIGN_WIDTH]
                widths[i] = max(widths[i], *fitting, 0) if fitting else widths[i]
        for line in grid:
            for k in range(max(map(len, line), default=0)):
                parts = []
                for i, cell in enumerate(line):
                    text = cell[k] if k < len(cell) else ""
                    parts.append(text + " " * max(0, widths[i] - width(text)))
                out.current.append(CELL_GAP.join(parts).rstrip())
                out.line(keep=True)


def render(source: str) -> str:
    """The visible text of a page."""
    root, styles = build(source)
    out = Lines()
    Renderer(styles).children(root, out, False)
    return "\n".join(out.finish())


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", out: str = "text") -> DataFrame:
    """One row per row of pages: id and the visible text of the whole page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([render(x) for x in part.column(1).to_pylist()], pa.string())], [id_col, out])

    rows = pages.select(id_col, body(html_col).alias("_html"))
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField(out, T.StringType())])).select(
        id_col, out, F.length(out).cast("bigint").alias("n_chars"))
