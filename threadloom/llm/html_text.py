"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout.

Defined results. A null or empty page gives an empty text. Text that no tag surrounds is kept. Every visible text node
appears in the output, blanks collapsed except in <pre>. Unclosed and misnested tags never fail; neither does depth, as
both passes use explicit stacks, and text of any length is taken whole. The cells of a table's column are as wide as its
longest line, so a table's text is at most as large as its rows times its columns' widths. Repeated pages are rendered
each on its own; other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, title string, text string, n_chars long, n_blocks long, n_list_items long, n_table_rows long"

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*+)|<[!?][^>]*+(?:>|$)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("script style template noscript head iframe object noembed noframes datalist audio video canvas svg title".split())
#: What a head may hold; any other start tag, and text, ends an open head.
IN_HEAD = frozenset("base head html link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A blank line stands before and after these; the other blocks begin and end a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article section figure form fieldset header footer main nav aside hr".split())
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Start tag: the open elements it ends, and those beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: These stand apart from the text around them on the same line.
APART = frozenset("button input meter progress select textarea".split())
#: Inputs that show their value as a label.
LABELLED = frozenset("button reset submit".split())
#: A cell spans so many columns and rows at most, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source and not source.isspace():
        for m in _ATTR.finditer(source):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def build(source: str) -> Node:
    """The tree of a page; missing end tags and missing rows are implied."""
    root = Node("#root", {})
    stack, at, lowered = [root], 0, None
    # How often each tag is open: what isn't open is never looked for, so deep pages stay linear.
    opened: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            if stack[-1].tag == "head" and piece.strip(" \t\n\f\r"):
                close({"head"}, frozenset())
            stack[-1].children.append(piece)

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def cut(place: int) -> None:
        for node in stack[place:]:
            opened[node.tag] -= 1
        del stack[place:]

    def close(ended: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of `ended` inside the nearest of `bounds`."""
        if not any(opened[t] for t in ended):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ended:
                found = i
            elif stack[i].tag in bounds:
                break
        if found:
            cut(found)

    while (m := _TAG.search(source, at)) is not None:
        text(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                if stack[-1].tag == "head":
                    close({"head"}, frozenset())
                stack[-1].children.append(Node("br", {}))
                continue
            inline = tag not in BLOCKS and tag not in ("noscript", "object", "template")
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                other = stack[i].tag
                if other == tag:
                    cut(i)
                    break
                # An inline end tag does not end a block, and nothing in a cell ends what stands around its table.
                if inline and other in BLOCKS or other == "table" or other in ("td", "th") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                    break
            continue
        name = m[2] or m[4]
        if not name:
            continue
        tag, attrs = name.lower(), _attributes(m[3] if m[2] else m[5])
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr", {}))
        if opened["head"] and (tag == "body" or tag not in IN_HEAD and stack[-1].tag == "head"):
            close({"head"}, frozenset())
        node = Node(tag, attrs)
        if tag not in RAW and tag not in VOID:
            push(node)
            continue
        stack[-1].children.append(node)
        if tag in RAW:
            lowered = source.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at) if len(lowered) == len(source) else source.find(f"</{tag}", at)
            end = len(source) if end < 0 else end
            node.children.append(html.unescape(source[at:end]) if tag in ("title", "textarea") else source[at:end])
            close_at = source.find(">", end)
            at = len(source) if close_at < 0 else close_at + 1
    text(source[at:])
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a:
        return False
    if node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    return not ("style" in a and _GONE.search(a["style"]))


def shown_options(select: Node) -> list[Node]:
    """What a browser shows of a select: all options of a list box, the chosen or else the first of a drop-down."""
    found, todo = [], list(reversed(select.children))
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and node.tag == "option":
            found.append(node)
        elif isinstance(node, Node) and visible(node):
            todo += reversed(node.children)
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or re.fullmatch(r"\d{1,9}", size) and int(size) > 1:
        return found
    return [x for x in found if "selected" in x.attrs][-1:] or found[:1]


class Writer:
    """Gathers lines: inline text collapses its blanks, gaps of one or two newlines wait until text follows."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.blocks = 0, False, 0
        self.indent, self.mark = [], ""

    def inline(self, piece: str) -> None:
        collapsed = _SPACE.sub(" ", piece)
        body = collapsed.strip(" ")
        if not body:
            self.space = self.space or bool(collapsed)
            return
        if self.line and (self.space or collapsed[0] == " "):
            self.line.append(" ")
        self.line.append(body)
        self.space = collapsed[-1] == " "

    def flush(self) -> None:
        if self.line:
            self.put(["".join(self.line)])
        self.line, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if self.done:
            self.done.append("\n" * max(1, self.gap))
        if not self.done or self.gap > 1:
            self.blocks += 1
        pad = "".join(self.indent)
        first = (pad[: len(pad) - len(self.mark)] if self.mark else pad) + self.mark
        self.done.append("\n".join((first if i == 0 else pad if x else "") + x for i, x in enumerate(lines)))
        self.mark, self.gap = "", 0

    def end(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)


def _span(cell: Node, name: str, most: int) -> int:
    digits = re.match(r"\s*\+?(\d{1,9})", cell.attrs.get(name, ""))
    return min(max(int(digits[1]), 1), most) if digits else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[dict[int, str]]:
    """Cells (text, columns, rows) at their columns; columns in which no cell begins are left out."""
    placed, taken = [], {}
    for row in rows:
        cells, at, begun = {}, 0, {}
        for text, columns, down in row:
            while taken.get(at, 0):
                at += 1
            cells[at] = text
            begun |= dict.fromkeys(range(at, at + columns), down)
            at += columns
        placed.append(cells)
        taken = {c: n for c, n in ({c: n - 1 for c, n in taken.items()} | {c: max(n, taken.get(c, 0)) - 1 for c, n in begun.items()}).items() if n > 0}
    order = {c: i for i, c in enumerate(sorted({c for cells in placed for c in cells}))}
    return [{order[c]: text for c, text in cells.items()} for cells in placed]


def _layout(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of cells as lines, the cells of a column aligned; a cell of several lines takes several lines."""
    split = [{i: text.split("\n") for i, text in row.items()} for row in _grid(rows)]
    widths: dict[int, int] = {}
    for row in split:
        for i, lines in row.items():
            widths[i] = max(widths.get(i, 0), max(map(len, lines)))
    out = []
    for row in split:
        if not any(any(lines) for lines in row.values()):
            continue
        for k in range(max(map(len, row.values()))):
            cells = {i: lines[k] for i, lines in row.items() if k < len(lines) and lines[k]}
            out.append(" | ".join(cells.get(i, "").ljust(widths[i]) for i in range(max(cells, default=-1) + 1)).rstrip())
    return out


def render(source: str | None) -> tuple[str, str, int, int, int]:
    """(title, text, blocks, list items, table rows) of a page."""
    root = build(source or "")
    title, n_items, n_rows, pre = "", 0, 0, 0
    writers, lists, tables = [Writer()], [], []
    todo: list[tuple[int, Node | str]] = [(0, root)]
    while todo:
        leaving, node = todo.pop()
        out = writers[-1]
        if isinstance(node, str):
            if pre:
                parts = node.split("\n")
                for i, part in enumerate(parts):
                    if part:
                        out.line.append(part)
                    if i < len(parts) - 1:
                        out.flush() if out.line else setattr(out, "gap", out.gap + 1)
            else:
                out.inline(node)
            continue
        tag = node.tag
        if not leaving:
            if tag == "title" and not title:
                title = _SPACE.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip(" ")
            if tag == "head" or not visible(node):
                todo += [(0, x) for x in reversed(node.children) if tag == "head" and isinstance(x, Node) and x.tag == "title"]
                continue
            if tag == "br":
                out.flush() if out.line else setattr(out, "gap", out.gap + 1)
                continue
            if tag == "img":
                if alt := node.attrs.get("alt", "").strip():
                    out.inline(f" {alt} ")
                continue
            if tag in APART:
                out.space = True
                if tag == "input":
                    if node.attrs.get("type", "").lower() in LABELLED:
                        out.inline(f" {node.attrs.get('value', '')} ")
                    continue
            if tag == "select":
                todo += [(0, x) for option in reversed(shown_options(node)) for x in (" ", option, " ")]
                continue
            if tag in BLOCKS:
                out.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                n_items += 1
                number = lists[-1] if lists else [False, 1]
                out.mark = f"{number[1]}. " if number[0] else "- "
                number[1] += 1
                out.indent.append(" " * len(out.mark))
            elif tag in ("blockquote", "dd"):
                out.indent.append("  ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append(([], len(writers)))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
                n_rows += 1
            elif tag in ("td", "th") and tables and tables[-1][0]:
                writers.append(Writer())
            todo.append((1, node))
            shut = tag == "details" and "open" not in node.attrs
            todo += [(0, x) for x in reversed(node.children) if not shut or isinstance(x, Node) and x.tag == "summary"]
        else:
            if tag in ("td", "th") and tables and tables[-1][0] and len(writers) > tables[-1][1]:
                cell = writers.pop()
                cell.flush()
                tables[-1][0][-1].append(("".join(cell.done), _span(node, "colspan", MOST_COLUMNS), _span(node, "rowspan", MOST_ROWS)))
                continue
            if tag in APART:
                out.space = True
            if tag in BLOCKS:
                out.flush()
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif tag == "li":
                out.indent.pop()
                out.mark = ""
            elif tag in ("blockquote", "dd"):
                out.indent.pop()
            elif tag == "pre":
                pre -= 1
            elif tag == "table" and tables:
                rows, _ = tables.pop()
                if lines := _layout(rows):
                    out.gap = max(out.gap, 2)
                    out.put(lines)
            if tag in BLOCKS:
                out.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
    out = writers[0]
    out.flush()
    return title, "".join(out.done), out.blocks, n_items, n_rows


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [render(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)),
            ],
            ["page_id", "url", "title", "text", "n_chars", "n_blocks", "n_list_items", "n_table_rows"],
        )


def extract_html(pages: DataFrame) -> DataFrame:
    """One row per page: its title and its visible text, laid out. A narrow map; nothing is shuffled."""
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(_run, SCHEMA)
