"""Visible text of web pages, laid out as a reader would see it.

The page is cut into tags and text, and a tree is built with the tags that authors leave out: an opening paragraph, list
item, row or cell closes the one before it, a block closes an open paragraph, an end tag closes what is open inside it, and
an end tag without its start is ignored. What no browser shows is left out: head matter, scripts, comments, templates,
form controls, and elements that `hidden`, `aria-hidden`, or a style of no display or visibility hides. All other text is
kept, menus and footers too.

Layout: blocks stand on lines of their own, paragraphs, headings, lists, tables and quotes with a blank line around;
white space is folded but in `pre`; list items get `-` or their number and are indented by depth; the cells of a table are
padded to the width of their column. Work and memory are linear in a page, and pages are independent rows.

Defined cases: a null page has null text; a page without visible text has the empty text; unfinished tags are text;
other columns of the input stay, one named `text` is overwritten; repeated rows are rendered one by one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_FOLD = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title template noscript iframe object svg canvas audio video map select option datalist textarea input "
    "button noembed noframes math".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr figure".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main "
    "menu nav section summary caption tr thead tbody tfoot td th".split()
)
CELLS = frozenset(("td", "th"))
# Opening the key closes the nearest open one of the values, unless one of the walls stands before it.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
# Elements nested deeper than this hold no more elements; what follows goes to the last one's level, as browsers do it.
DEPTH = 512
# An end tag does not reach past these.
SCOPE = frozenset(("td", "th", "caption", "table", "html", "body"))


class Node:
    __slots__ = ("children", "seen", "tag", "value")

    def __init__(self, tag: str, seen: bool = True, value: str = ""):
        self.tag, self.seen, self.value, self.children = tag, seen, value, []


def _tag_end(page: str, at: int) -> int:
    """Behind the `>` of the tag whose name ends at `at`, quoted ones skipped; -1 if there is none."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return -1
        quote = min((k for k in (page.find('="', at, close), page.find("='", at, close)) if k >= 0), default=-1)
        if quote < 0:
            return close + 1
        end = page.find(page[quote + 1], quote + 2)
        if end < 0:
            return close + 1
        at = end + 1


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack = [root]
    open_tags: dict[str, int] = {}  # how many of each tag are open: most searches of the stack need not start

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def close(names: tuple[str, ...], walls) -> None:
        if any(open_tags.get(n) for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth].tag
                if tag in names:
                    return pop_to(depth)
                if tag in walls:
                    return None
        return None

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(Node("#text", value=html.unescape(value) if "&" in value else value))

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        begin, inner = found.start(), found.end()
        if found[2] is None:
            end = page.find("-->", inner) + 3 if found[0] == "<!--" else page.find(">", inner) + 1
            text(page[at:begin])
            at = end if end >= 3 or (found[0] != "<!--" and end > 0) else n
            continue
        end = _tag_end(page, inner)
        if end < 0:
            text(page[at:])
            break
        text(page[at:begin])
        tag, at = found[2].lower(), end
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not open_tags.get("p"):
                stack[-1].children.append(Node("p"))
            else:
                close((tag,), SCOPE - {tag} if tag not in ("table", "html", "body", "tr", "thead", "tbody", "tfoot") else ("table",) if tag != "table" else ())
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in BLOCK and open_tags.get("p"):
            close(("p",), SCOPE)
        seen = tag not in UNSEEN
        given = page[inner : end - 1]
        value = ""
        if seen and given.strip("/ \t\n\r\f"):
            attributes = {a.lower(): v.strip("\"'") for a, v in _ATTRIBUTE.findall(given)}
            seen = (
                "hidden" not in attributes
                and attributes.get("aria-hidden", "").lower() != "true"
                and not ("style" in attributes and _HIDING.search(html.unescape(attributes["style"])))
            )
            value = attributes.get("start", "") if tag == "ol" else ""
        node = Node(tag, seen, value)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            body, at = (page[at : stop.start()], page.find(">", stop.start()) + 1 or n) if stop else (page[at:], n)
            node.children.append(Node("#text", value=body))
        elif tag not in VOID and not given.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


class Lines:
    """Text under way: finished lines, the open line, and the white space still owed before the next word."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.space = False

    def word(self, value: str) -> None:
        folded = _FOLD.sub(" ", value)
        if not folded.strip(" "):
            self.space |= bool(folded)
            return
        if (self.space or folded[0] == " ") and self.open:
            self.open.append(" ")
        self.open.append(folded.strip(" "))
        self.space = folded[-1] == " "

    def end_line(self) -> None:
        if self.open:
            self.lines.append("".join(self.open))
        self.open, self.space = [], False

    def gap(self) -> None:
        self.end_line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _table(cells: list[list[str]]) -> list[str]:
    """Rows with their cells padded to the widths of the columns."""
    widths: dict[int, int] = {}
    for row in cells:
        for i, cell in enumerate(row):
            widths[i] = max(widths.get(i, 0), _width(cell))
    return [" | ".join(c + " " * (widths[i] - _width(c)) for i, c in enumerate(row)).rstrip() for row in cells]


class Frame:
    """One open element of the rendering: what comes when its children are done."""

    __slots__ = ("children", "done", "out", "pre")

    def __init__(self, children, out, pre, done):
        self.children, self.out, self.pre, self.done = iter(children), out, pre, done


def render(page: str) -> str:
    """The visible text of a page."""
    top = Lines()
    frames = [Frame(parse(page).children, top, False, None)]
    numbers: list[int | None] = []
    tables: list[list[list[str]]] = []
    while frames:
        frame = frames[-1]
        node = next(frame.children, None)
        if node is None:
            frames.pop()
            if frame.done:
                frame.done()
            continue
        out, tag = frame.out, node.tag
        if tag == "#text":
            if frame.pre:
                first, *rest = node.value.replace("\r\n", "\n").split("\n")
                out.open.append(first)
                for line in rest:
                    out.lines.append("".join(out.open).rstrip())
                    out.open = [line]
            else:
                out.word(node.value)
            continue
        if not node.seen:
            continue
        if tag == "br":
            if out.open:
                out.end_line()
            continue
        edge = out.gap if tag in SPACED and not (tag in ("ul", "ol") and numbers) else out.end_line if tag in BLOCK else None
        if edge and not (tag in CELLS or tag in ("tr", "thead", "tbody", "tfoot")):
            edge()
        if tag == "hr":
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            numbers.append((int(node.value) if re.fullmatch(r"-?[0-9]{1,9}", node.value) else 1) if tag == "ol" else None)

            def list_done(edge=edge):
                numbers.pop()
                edge()

            frames.append(Frame(node.children, out, False, list_done))
        elif tag in ("li", "dd", "blockquote"):
            mark = "  "
            if tag == "li":
                count = numbers[-1] if numbers else None
                mark = "- " if count is None else f"{count}. "
                if numbers and count is not None:
                    numbers[-1] = count + 1
            own = Lines()

            def item_done(own=own, out=out, mark=mark, edge=edge, first=mark if tag == "li" else "  "):
                for i, line in enumerate(own.finish()):
                    out.lines.append(((first if not i else " " * len(mark)) + line).rstrip())
                edge()

            frames.append(Frame(node.children, own, frame.pre, item_done))
        elif tag == "table":
            tables.append([])

            def table_done(out=out):
                rows = tables.pop()
                out.lines.extend(_table([r for r in rows if any(r)]))
                out.gap()

            frames.append(Frame(node.children, out, False, table_done))
        elif tag == "tr" and tables:
            tables[-1].append([])
            frames.append(Frame(node.children, out, False, None))
        elif tag in CELLS and tables:
            own, row = Lines(), tables[-1]
            if not row:
                row.append([])

            def cell_done(own=own, row=row[-1]):
                row.append(" ".join(line.strip() for line in own.finish() if line))

            frames.append(Frame(node.children, own, False, cell_done))
        else:
            frames.append(Frame(node.children, out, frame.pre or tag == "pre", edge))
    return "\n".join(top.finish())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` without their markup and with its visible `text`."""
    kept = [f for f in pages.schema.fields if f.name not in (column, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not p.is_valid else render(p.as_py()) for p in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), "text"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"])
    return pages.select(*(f.name for f in kept), column).mapInArrow(run, fields)
