"""Operator 8: the visible text of web pages, laid out.

A small tree builder reads tags with implied ends (``p``, ``li``, table parts, ...), a renderer
walks the tree with an explicit stack, so deep nesting needs no recursion. All visible text is
emitted: blocks on lines of their own with one blank line between paragraphs, list items with
marks and indentation, table rows with cells padded to common columns, ``pre`` as it stands.
Hidden content (scripts, styles, templates, ``hidden``, ``display:none``, ``visibility:hidden``)
is left out.

Defined results: a null or empty page gives an empty text; broken markup never fails, an unclosed
tag ends with its parent and a stray end tag is ignored; repeated rows are rendered each; an empty
table gives an empty result; other columns are ignored. No shuffle; pages are Arrow slices.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfold.llm.common import text_slices

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe noembed noframes object svg math canvas audio video "
    "datalist area map param".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p "
    "pre section select summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
ENDS_P = BLOCKS - frozenset("option select body html td th tr tbody thead tfoot caption".split())

#: A new element closes these open ones, up to a boundary element.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag never reaches through these.
SCOPE = frozenset({"table", "td", "th", "caption", "html"})

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_BLANKS = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("name", "hidden", "children", "start")

    def __init__(self, name: str, hidden: bool = False, start: int = 1):
        self.name, self.hidden, self.start = name, hidden, start
        self.children: list[Node | str] = []


def _attributes(raw: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)
    }


def _node(name: str, raw: str) -> Node:
    hidden, start = name in HIDDEN, 1
    if raw and not raw.isspace():
        attributes = _attributes(raw)
        hidden = (
            hidden
            or "hidden" in attributes
            or bool(_INVISIBLE.search(attributes.get("style", "")))
            or (name == "input" and attributes.get("type", "").lower() == "hidden")
        )
        if name == "ol" and re.fullmatch(r"-?\d{1,9}", attributes.get("start", "")):
            start = int(attributes["start"])
        if name == "img" and attributes.get("alt") and not hidden:
            node = Node(name)
            node.children.append(attributes["alt"])
            return node
    return Node(name, hidden, start)


def build_tree(page: str) -> Node:
    """The element tree; text stands in it unescaped."""
    root = Node("#root")
    stack = [root]
    position = 0
    match = _TOKEN.search(page)
    while match:
        if match.start() > position:
            stack[-1].children.append(html.unescape(page[position : match.start()]))
        position = match.end()
        name = (match[2] or "").lower()
        if match[0].startswith("<![CDATA["):
            pass
        elif match[1]:
            _close(stack, name)
        elif name:
            _imply(stack, name)
            node = _node(name, match[3])
            stack[-1].children.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, position)
                inner = page[position : end.start() if end else len(page)]
                node.children.append(html.unescape(inner) if name in ("title", "textarea") else inner)
                position = end.end() if end else len(page)
            elif name not in VOID:
                stack.append(node)
        match = _TOKEN.search(page, position)
    if position < len(page):
        stack[-1].children.append(html.unescape(page[position:]))
    return root


def _imply(stack: list[Node], name: str) -> None:
    """Ends that the start of ``name`` implies."""
    if name in ENDS_P:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name == "p":
                del stack[depth:]
                break
            if stack[depth].name in BLOCKS:
                break
    if name in CLOSES:
        closed, boundary = CLOSES[name]
        cut = None
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in boundary:
                break
            if stack[depth].name in closed:
                cut = depth
        if cut is not None:
            del stack[cut:]


def _close(stack: list[Node], name: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name == name:
            del stack[depth:]
            return
        if stack[depth].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            return


class _Layout:
    """Collects lines; ``gap`` is the number of line ends due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent = ""
        self.mark = ""
        self.blank = False

    def text(self, value: str) -> None:
        self.parts.append(value)

    def end_line(self) -> None:
        line = _BLANKS.sub(" ", "".join(self.parts)).strip(" ")
        self.parts.clear()
        if line:
            self._emit(line)

    def _emit(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.indent
        if self.mark:
            lead, self.mark = self.indent[: len(self.indent) - len(self.mark)] + self.mark, ""
        self.lines.append(lead + line)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def verbatim(self, value: str) -> None:
        self.end_line()
        for line in value.strip("\n").split("\n"):
            if line.strip():
                self._emit(line.rstrip())
            else:
                self.blank = True


def _plain(node: Node) -> str:
    """All visible text below a node on one line, blocks apart by a space."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.hidden:
            apart = item.name in BLOCKS or item.name in ("br", "img")
            if apart:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(item.children))
    return _BLANKS.sub(" ", "".join(out)).strip(" ")


def _raw_text(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.name == "br":
            out.append("\n")
        elif not item.hidden:
            stack.extend(reversed(item.children))
    return "".join(out)


def _table(node: Node, layout: _Layout) -> None:
    """Rows with cells padded to the width of their column."""
    rows: list[list[str]] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                rows.append([_BLANKS.sub(" ", item).strip(" ")])
        elif item.hidden:
            continue
        elif item.name == "tr":
            row = []
            for x in item.children:
                if isinstance(x, str):
                    row.extend([_BLANKS.sub(" ", x).strip(" ")] if x.strip() else [])
                elif not x.hidden:
                    row.append(_plain(x))
            rows.append(row)
        elif item.name in ("tbody", "thead", "tfoot", "colgroup"):
            stack.extend(reversed(item.children))
        else:
            rows.append([_plain(item)])
    widths: dict[int, int] = {}
    for row in rows:
        if len(row) > 1:
            for c, cell in enumerate(row):
                widths[c] = max(widths.get(c, 0), len(cell))
    for row in rows:
        if any(row):
            line = " | ".join(cell.ljust(widths.get(c, 0)) if len(row) > 1 else cell for c, cell in enumerate(row))
            layout._emit(line.rstrip())


def render(root: Node) -> str:
    """The visible text of a tree."""
    layout = _Layout()
    lists: list[int | None] = []
    indents: list[str] = []
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            layout.text(item)
        elif isinstance(item, tuple):
            name = item[0]
            layout.block(name in SPACED)
            if name in ("ul", "ol", "menu"):
                lists.pop()
                layout.blank = layout.blank and not lists
            if name in ("li", "blockquote", "dd"):
                layout.indent, layout.mark = indents.pop(), ""
        elif item.hidden:
            continue
        elif item.name in ("br", "hr"):
            layout.block(item.name == "hr")
        elif item.name == "pre":
            layout.block(True)
            layout.verbatim(_raw_text(item))
            layout.block(True)
        elif item.name == "table":
            layout.block(True)
            _table(item, layout)
            layout.block(True)
        elif item.name in BLOCKS:
            nested = item.name in ("ul", "ol", "menu") and bool(lists)
            layout.block(item.name in SPACED and not nested)
            if item.name in ("ul", "ol", "menu"):
                lists.append(item.start if item.name == "ol" else None)
            if item.name in ("li", "blockquote", "dd"):
                indents.append(layout.indent)
                mark = ""
                if item.name == "li":
                    mark = "- "
                    if lists and lists[-1] is not None:
                        mark = f"{lists[-1]}. "
                        lists[-1] += 1
                layout.indent += " " * len(mark) if mark else "  "
                layout.mark = mark
            stack.append((item.name,))
            stack.extend(reversed(item.children))
        else:
            if item.name == "img":
                layout.text(" ")
                stack.append(" ")
            stack.extend(reversed(item.children))
    layout.end_line()
    return "\n".join(layout.lines)


def page_text(page: str | None) -> str:
    return render(build_tree(page)) if page else ""


def extract_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``key`` and ``text`` of every row of ``pages``."""
    kind = pages.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [page_text(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return (
        pages.select(F.col(key).alias("key"), F.col(markup).alias("text"))
        .mapInArrow(extract, f"key {kind}, text string")
        .withColumnRenamed("key", key)
    )
