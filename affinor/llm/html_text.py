"""HTML extraction by layout-aware rendering.

A page is parsed into a tree with the implied tags of HTML (paragraphs, list items, table rows and cells and options that end by
themselves, content misplaced in tables moved in front of them), and the tree is rendered as a reader would see it: nothing hidden, block
spacing kept, lists with markers and indentation, table cells in aligned columns, preformatted text as it stands. Row spans end with their row
group and hold the first SPANNED columns; a run of empty columns takes GAP blanks of a line at most: so the output stays in proportion to the page.

Not visible: scripts, styles, templates and the like, the title, comments, elements with `hidden`, `display: none` or `visibility: hidden`
(unless a descendant turns visible again), the rest of a closed `details`, and a `dialog` that is not open.

Defined cases: null html gives an empty text; broken markup gives what a tolerant parser makes of it, never an error; text without any tag
is rendered as it is; elements nested beyond DEPTH become siblings, so no text is lost; repeated rows and rows without an id are
rendered one by one; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import map_batches

DEPTH = 150
PAD = 80  # a column is aligned up to this width
GAP = 200  # blanks that a run of empty columns takes in a line at most
SPANNED = 1000  # columns of a table that row spans can hold

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("script style template noscript title head iframe noembed noframes object canvas audio video datalist map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure hr fieldset".split())
PLAIN = frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr".split())
BLOCK = SPACED | PLAIN
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
ROW_GROUPS = frozenset("tbody thead tfoot".split())
# start tag: (open elements it ends, elements that stop the search)
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
           "optgroup": (("option", "optgroup"), ("select",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
           "tr": (("tr", "caption", "colgroup"), ("table",)), "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
           "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",))}
SCOPE = frozenset("table td th caption html button template object".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>?|/[^a-zA-Z>][^>]*>?|/>)""", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
SPACE = re.compile(r"[ \t\n\r\f]+")
NONE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class Tree:
    """Builds the tree; text nodes are plain strings."""

    def __init__(self, html: str):
        self.root = Node("body", {}, None)
        self.open = [self.root]
        self.parse(html)

    def parse(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                return
            m = TAG.match(html, lt)
            if not m:  # a lone "<"
                self.text(html[at:lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self.text(html[at:lt])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(m[3])} if m[3] and not m[3].isspace() else {}
            self.start(tag, attrs)
            if tag in RAW:
                stop = RAW_END[tag].search(html, at)
                end = stop.start() if stop else n
                if tag not in HIDDEN:
                    self.text(html[at:end], raw=tag == "xmp")
                if self.open[-1].tag == tag:
                    self.open.pop()
                at = html.find(">", end) + 1 if stop else n
                if stop and not at:
                    return

    def text(self, s: str, raw: bool = False) -> None:
        if not raw and "&" in s:
            s = unescape(s)
        top = self.open[-1]
        if top.tag in TABLE_PARTS:
            if s.isspace():
                return
            self.before_table(s)
        else:
            top.children.append(s)

    def before_table(self, child) -> Node | None:
        """Content that may not stand in a table moves in front of it."""
        i = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == "table"), 0)
        table = self.open[i]
        parent = table.parent or self.root
        at = next((j for j in range(len(parent.children) - 1, -1, -1) if parent.children[j] is table), len(parent.children))
        parent.children.insert(at, child)
        return parent

    def pop_to(self, i: int) -> None:
        del self.open[max(1, i):]

    def close_implied(self, ends: tuple, stops) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t in ends:
                self.pop_to(i)
                return
            if t in stops:
                return

    def start(self, tag: str, attrs: dict) -> None:
        if tag in ("html", "body", "head", "frameset", "frame"):
            return
        if tag in ENDS_P:
            self.close_implied(("p",), SCOPE)
        if tag in IMPLIED:
            self.close_implied(*IMPLIED[tag])
        elif tag[0] == "h" and len(tag) == 2 and tag in SPACED and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        elif tag == "a":
            self.end("a")
        top = self.open[-1]
        if tag in ("td", "th"):
            if top.tag in ("table", *ROW_GROUPS):
                self.start("tr", {})
                top = self.open[-1]
            elif top.tag != "tr":
                self.close_implied(("td", "th"), ("tr", "table"))
                top = self.open[-1]
        node = Node(tag, attrs, top)
        allowed = tag in ("tr", "tbody", "thead", "tfoot", "caption", "colgroup", "col", "td", "th", "script", "style", "template")
        if top.tag in TABLE_PARTS and not allowed:
            node.parent = self.before_table(node)
        else:
            top.children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
            return
        if tag == "p" and not any(x.tag == "p" for x in self.open):
            self.open[-1].children.append(Node("p", {}, self.open[-1]))
            return
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i].tag
            if t == tag:
                if tag in FORMATTING and any(x.tag in BLOCK for x in self.open[i + 1:]):
                    del self.open[i]  # ends within a block that is still open
                else:
                    self.pop_to(i)
                return
            if tag in TABLE_PARTS or tag in ("td", "th", "caption"):
                if t == "table":
                    return
            elif t in SCOPE or (tag not in BLOCK and tag not in FORMATTING and t in BLOCK):
                return


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines of rendered text; white space collapses and blank lines between blocks do not add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap = False, 0

    def word(self, s: str) -> None:
        """Collapsed text."""
        if not s:
            return
        body = SPACE.sub(" ", s)
        if body[0] == " ":
            self.space = bool(self.line)
            body = body[1:]
        if body:
            self._open()
            if self.space:
                self.line.append(" ")
            self.space = body[-1] == " "
            self.line.append(body[:-1] if self.space else body)

    def _open(self) -> None:
        if not self.line and self.gap:
            if self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self._open()
                self.line.append(part)

    def newline(self) -> None:
        self._open()
        self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        """A block begins or ends here."""
        if self.line:
            self.newline()
        self.space = False
        self.gap = max(self.gap, 2 if spaced else 1)

    def rows(self, lines: list[str]) -> None:
        for x in lines:
            self._open()
            self.lines.append(x)

    def done(self) -> list[str]:
        if self.line:
            self.newline()
        out = [x.replace("\xa0", " ").rstrip() for x in self.lines]
        while out and not out[-1]:
            out.pop()
        return out


def number(i: int, kind: str) -> str:
    if kind in ("a", "A") and i > 0:
        s = ""
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(97 + r) + s
        return s if kind == "a" else s.upper()
    if kind in ("i", "I") and 0 < i < 4000:
        s = ""
        for v, r in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i")):
            s, i = s + r * (i // v), i % v
        return s if kind == "i" else s.upper()
    return str(i)


def integer(s: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", s or "")
    return int(m[1]) if m else default


class Renderer:
    def __init__(self):
        self.tables = self.items = 0

    def page(self, html: str) -> str:
        flow = Flow()
        self.children(Tree(html).root, flow, False, True)
        lines = flow.done()
        while lines and not lines[0]:
            lines.pop(0)
        return "\n".join(lines)

    def children(self, node: Node, flow: Flow, pre: bool, visible: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if visible:
                    flow.verbatim(c) if pre else flow.word(c)
            else:
                self.element(c, flow, pre, visible)

    def element(self, node: Node, flow: Flow, pre: bool, visible: bool) -> None:
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN:
            return
        if attrs:
            style = attrs.get("style", "")
            if "hidden" in attrs or (style and NONE.search(style)) or (tag == "dialog" and "open" not in attrs):
                return
            if style and (v := VISIBILITY.search(style)):
                visible = v[1].lower() == "visible"
        elif tag == "dialog":
            return
        if tag == "br":
            if visible:
                flow.newline()
            return
        if tag == "hr":
            flow.block(True)
            return
        if tag not in BLOCK:
            if tag == "q" and visible:
                flow.word('"')
                self.children(node, flow, pre, visible)
                flow.word('"')
            else:
                if tag == "textarea":
                    pre = True
                self.children(node, flow, pre, visible)
            return
        spaced = tag in SPACED and not (tag in ("ul", "ol", "menu") and self.within_list(node))
        flow.block(spaced)
        if tag in ("ul", "ol", "menu"):
            self.list(node, flow, pre, visible)
        elif tag == "table":
            self.table(node, flow, pre, visible)
        elif tag == "details" and "open" not in attrs:
            for c in node.children:
                if isinstance(c, Node) and c.tag == "summary":
                    self.element(c, flow, pre, visible)
                    break
        elif tag in ("blockquote", "dd"):
            self.indented(node, flow, pre, visible, "  ", "  ")
        elif tag == "pre":
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
            self.children(node, flow, True, visible)
        elif tag == "li":
            self.indented(node, flow, pre, visible, "- ", "  ")
        else:
            self.children(node, flow, pre, visible)
        flow.block(spaced)

    @staticmethod
    def within_list(node: Node) -> bool:
        p = node.parent
        return p is not None and p.tag in ("li", "ul", "ol", "menu")

    def indented(self, node: Node, flow: Flow, pre: bool, visible: bool, first: str, rest: str) -> None:
        inner = Flow()
        self.children(node, inner, pre, visible)
        lines = inner.done()
        while lines and not lines[0]:
            lines.pop(0)
        if lines:
            flow.rows([(rest if i else first) + x if x else "" for i, x in enumerate(lines)])

    def list(self, node: Node, flow: Flow, pre: bool, visible: bool) -> None:
        own = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        ordered, step = node.tag == "ol", -1 if "reversed" in node.attrs else 1
        i = integer(node.attrs.get("start"), len(own) if step < 0 else 1)
        for c in node.children:
            if not isinstance(c, Node):
                if visible:
                    flow.word(c)
            elif c.tag != "li":
                if c.tag in ("ul", "ol", "menu"):  # a list directly within a list
                    flow.block(False)
                    inner = Flow()
                    self.list(c, inner, pre, visible)
                    flow.rows(["  " + x if x else "" for x in inner.done()])
                else:
                    self.element(c, flow, pre, visible)
            else:
                if "hidden" in c.attrs or NONE.search(c.attrs.get("style", "")):
                    continue
                i = integer(c.attrs.get("value"), i)
                mark = number(i, c.attrs.get("type") or node.attrs.get("type") or "1") + ". " if ordered else "- "
                i += step
                self.items += 1
                seen = visible
                if v := VISIBILITY.search(c.attrs.get("style", "")):
                    seen = v[1].lower() == "visible"
                flow.block(False)
                self.indented(c, flow, pre, seen, mark, " " * len(mark))
        flow.block(False)

    def cell(self, node: Node, pre: bool, visible: bool) -> list[str]:
        if "hidden" in node.attrs or NONE.search(node.attrs.get("style", "")):
            return []
        if v := VISIBILITY.search(node.attrs.get("style", "")):
            visible = v[1].lower() == "visible"
        flow = Flow()
        self.children(node, flow, pre, visible)
        return flow.done()

    def table(self, node: Node, flow: Flow, pre: bool, visible: bool) -> None:
        self.tables += 1
        rows, groups = [], {"thead": [], "": [], "tfoot": []}
        for c in node.children:
            if isinstance(c, str):
                continue
            if c.tag in ("caption", "script", "style"):
                self.element(c, flow, pre, visible)
            elif c.tag in ROW_GROUPS and not ("hidden" in c.attrs or NONE.search(c.attrs.get("style", ""))):
                groups.get(c.tag, groups[""]).extend((c, x) for x in c.children if isinstance(x, Node) and x.tag == "tr")
            elif c.tag == "tr":
                groups[""].append((None, c))
        rows = [(g, r) for part in groups.values() for g, r in part if not ("hidden" in r.attrs or NONE.search(r.attrs.get("style", "")))]
        until = [len(rows)] * len(rows)  # a row span ends with its row group
        for y in range(len(rows) - 2, -1, -1):
            until[y] = until[y + 1] if rows[y][0] is rows[y + 1][0] else y + 1
        grid, taken = [], {}
        for y, (_, r) in enumerate(rows):
            line, x = {}, 0
            for c in r.children:
                if not isinstance(c, Node) or c.tag not in ("td", "th"):
                    continue
                while taken.get(x, 0) > y:
                    x += 1
                across, down = min(1000, max(1, integer(c.attrs.get("colspan"), 1))), max(1, integer(c.attrs.get("rowspan"), 1))
                line[x] = (self.cell(c, pre, visible), across, (c.attrs.get("align") or r.attrs.get("align") or "").lower())
                if down > 1:
                    for k in range(x, min(x + across, SPANNED)):
                        taken[k] = min(y + down, until[y])
                x += across
            grid.append(line)
        widths: dict[int, int] = {}
        for line in grid:
            for x, (text, across, _) in line.items():
                if text:
                    w = min(PAD, max(map(width, text)))
                    widths[x] = max(widths.get(x, 0), w if across == 1 else min(w, 0))
        columns = sorted(widths)
        place = {x: k for k, x in enumerate(columns)}
        before = [0, *accumulate(widths[x] for x in columns)]
        flow.block(False)
        for line in grid:
            cells = [(place[x], *line[x]) for x in sorted(line) if line[x][0]]
            for i in range(max((len(t) for _, t, _, _ in cells), default=0)):
                out, room, at = [], 0, 0
                cells = [c for c in cells if len(c[1]) > i]
                for k, text, across, align in cells:
                    if k > at:  # empty columns, less what the text before them took
                        empty = before[k] - before[at]
                        out.append(" " * min(GAP, max(0, empty - room) + 2 * (k - at)))
                        room = max(0, room - empty)
                    s, w = text[i].replace("\xa0", " "), widths[columns[k]]
                    fill = max(0, w - width(s) - room)
                    room = max(0, room + width(s) - w) if across > 1 or room else 0
                    out.append((" " * fill + s if align == "right" else " " * (fill // 2) + s + " " * (fill - fill // 2) if align == "center" else s + " " * fill) + "  ")
                    at = k + 1
                flow.rows(["".join(out).rstrip()])
        flow.block(False)


def render(html: str | None) -> tuple[str, int, int]:
    """Visible text, tables and list items of a page."""
    r = Renderer()
    return r.page(html or "") if html else "", r.tables, r.items


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines, n_tables, n_items for every page. Pages are rendered where they lie, one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [render(h.as_py()) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[0].count("\n") + 1 if g[0] else 0 for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())],
                                  names=["page_id", "url", "text", "n_lines", "n_tables", "n_items"])
    return pages.select(F.col("page_id").cast("long"), "url", "html").transform(map_batches, run, "page_id long, url string, text string, n_lines int, n_tables int, n_items int")
