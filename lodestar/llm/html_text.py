"""Layout-aware HTML extraction: a tree builder with implied tags, visibility rules, and a text renderer."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow

_set = lambda x: frozenset(x.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen")
RAW = _set("script style xmp iframe noembed noframes")
ESCAPABLE = _set("textarea title")
#: Elements never rendered.
UNSEEN = _set("head script style template noscript iframe object embed audio video canvas datalist title meta link base param area source track noembed noframes svg:desc svg:metadata svg:defs svg:symbol svg:clippath svg:mask svg:pattern math:annotation math:annotation-xml")
#: Elements of drawings and formulas that aren't HTML's: their names here, by the element that they stand in.
FOREIGN = {"svg": _set("desc metadata defs symbol clippath mask pattern text"), "math": _set("annotation annotation-xml")}
#: Elements whose end tag closes whatever is still open in them.
CONTAINERS = _set("template select object video audio canvas svg math button")
BLOCK = _set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption tr thead tbody tfoot td th optgroup option search svg:text")
#: Blocks with an empty line before and after.
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure")
CLOSES_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section table ul summary search")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
#: Start tag -> (open elements it closes, elements that stop the search).
IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir table")),
    "dt": (_set("dt dd"), _set("dl table")),
    "dd": (_set("dt dd"), _set("dl table")),
    "option": (_set("option"), _set("select datalist optgroup")),
    "optgroup": (_set("option optgroup"), _set("select")),
}
#: Elements an end tag doesn't reach over.
SCOPE = _set("table td th caption html template")
#: What only a table's own structure may hold; anything else in it comes out before the table.
IN_TABLE = _set("caption colgroup col tbody thead tfoot tr td th script style template")
TABLE_PARTS = _set("table tbody thead tfoot tr")
#: Start tag of a table's part -> the open elements it is put into.
TABLE_HOLDERS = {"caption": _set("table"), "colgroup": _set("table"), "col": _set("table colgroup"), "tbody": _set("table"), "thead": _set("table"), "tfoot": _set("table"), "tr": _set("tbody thead tfoot table"), "td": _set("tr tbody thead tfoot table"), "th": _set("tr tbody thead tfoot table")}
_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The rest of a tag; a quote that never ends is a character like others. No part can match in two ways.
_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?")
_HIDES = re.compile(r"(?:^|;)\s*+(?:display\s*+:\s*+none|visibility\s*+:\s*+(?:hidden|collapse))\s*+(?:!important\s*+)?(?:;|$)", re.I)
_SHOWS = re.compile(r"(?:^|;)\s*+visibility\s*+:\s*+visible", re.I)
_WS = re.compile(r"[ \t\n\r\f]+")
_LONG_REF = re.compile(r"&#(\d{8,});?")
#: Start tags that leave an open head open.
IN_HEAD = _set("base basefont bgsound link meta title noscript noframes style script template head")
#: Indentation and alignment move no text beyond this column. Each line of a page has text of its own, so its rendering
#: is at most so many times as long.
MARGIN = 80


class Node:
    __slots__ = ("tag", "attrs", "kids", "holds_tables")

    def __init__(self, tag, attrs=""):
        self.tag, self.attrs, self.kids, self.holds_tables = tag, attrs, [], False


def unescaped(x: str) -> str:
    """Character references as characters; a number beyond all characters is a replacement character."""
    if "&" not in x:
        return x
    if "&#" in x:
        x = _LONG_REF.sub(lambda m: f"&#{n or 0};" if len(n := m[1].lstrip("0")) < 8 else "�", x)
    return html.unescape(x)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescaped(m[2] or m[3] or m[4] or ""))
    return out


def _tokens(doc: str):
    """(kind, text or name, attributes) of texts (""), start tags ("<") and end tags ("/"); sent a tag's name
    whose content is raw, gives that content as the next text. Linear: no part is read twice. A tag that the
    document's end cuts short is dropped."""
    at, n = 0, len(doc)
    text = 0  # where the text under way begins
    while at < n:
        lt = doc.find("<", at)
        if lt < 0 or lt + 1 >= n:
            break
        c = doc[lt + 1]
        m = _NAME.match(doc, lt + 1 + (c == "/"))
        if m is None and c not in "!?/":
            at = lt + 1
            continue
        if lt > text:
            yield "", doc[text:lt], ""
        if m is not None:
            rest = _REST.match(doc, m.end())
            if rest is None:
                return
            at = text = rest.end()
            raw = yield "/" if c == "/" else "<", m.group().lower(), doc[m.end() : at - 1]
            if raw == "plaintext":
                yield "", doc[at:], ""
                return
            if raw:
                end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(doc, at)
                yield "", doc[at : end.start() if end else n], ""
                close = doc.find(">", end.end()) if end else -1
                at = text = close + 1 if close >= 0 else n
        elif doc.startswith("<!--", lt):
            if doc.startswith((">", "->"), lt + 4):
                at = doc.index(">", lt) + 1
            else:
                end = _COMMENT_END.search(doc, lt + 4)
                at = end.end() if end else n
            text = at
        else:
            end = doc.find(">", lt)
            at = text = end + 1 if end >= 0 else n
    if text < n:
        yield "", doc[text:], ""


class _Stack:
    """Open elements, with the places of each tag, so that the nearest one is found at once."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        while len(self.nodes) > k:
            x = self.nodes.pop()
            self.places[x.tag].pop()
            if x.tag in BLOCK:
                self.blocks.pop()

    def nearest(self, tags) -> int:
        """The place of the innermost open element of tags, -1 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close(self, tags, stops, blocks: bool = False) -> bool:
        """Close through the innermost open element of tags, unless one of stops (or any block) is nearer."""
        k = self.nearest(tags)
        if k < 1 or self.nearest(stops) > k or blocks and self.blocks[-1] > k:
            return False
        self.cut(k)
        return True


def parse(doc: str) -> Node:
    """The tree of a document, with tags that HTML lets authors leave out implied."""
    root = Node("html")
    stack = _Stack(root)
    nodes = stack.nodes

    def add(x, foster: bool):
        """Add to the open element; foster: before the table whose structure is open."""
        here = nodes[-1]
        if foster and here.tag in TABLE_PARTS and (k := stack.nearest(("table",))) > 0:
            kids, table = nodes[k - 1].kids, nodes[k]
            at = len(kids) - 1
            while kids[at] is not table:
                at -= 1
            kids.insert(at, x)
        else:
            here.kids.append(x)

    tokens = _tokens(doc)
    sent = None
    while True:
        try:
            kind, tag, attrs = tokens.send(sent)
        except StopIteration:
            return root
        sent = None
        if not kind:
            blank = not tag.strip(" \t\n\r\f")
            if nodes[-1].tag == "head" and not blank:
                stack.cut(len(nodes) - 1)
            add(unescaped(tag), not blank)
            continue
        inside = next((f for f, names in FOREIGN.items() if tag in names and stack.places.get(f)), None)
        if inside:
            tag = f"{inside}:{tag}"
        if kind == "/":
            if tag == "br":
                add(Node("br"), True)
            elif tag == "p" and not stack.places.get("p"):
                add(Node("p"), True)
            elif tag in HEADINGS:
                stack.close(HEADINGS, SCOPE)
            elif tag == "table":
                stack.close({"table"}, {"template"})
            elif tag in TABLE_HOLDERS:
                stack.close({tag}, {"table", "template"})
            elif tag in CONTAINERS:
                stack.close({tag}, {"template"} - {tag})
            elif tag in BLOCK:
                stack.close({tag}, SCOPE - {tag}) if tag not in ("html", "body") else None
            else:
                stack.close({tag}, SCOPE, blocks=tag not in ("a", "span"))
            continue
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        if tag == "head" and nodes[-1].tag == "head":
            continue
        if tag in CLOSES_P:
            stack.close({"p"}, SCOPE | _BUTTON)
        if tag in HEADINGS and nodes[-1].tag in HEADINGS:
            stack.cut(len(nodes) - 1)
        if tag == "body" or (tag not in IN_HEAD and nodes[-1].tag == "head"):
            stack.close({"head"}, frozenset())
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        elif tag in ("select", "input", "textarea"):
            stack.close({"select"}, SCOPE)
        table = stack.nearest(("table",))
        if tag == "table" and table > 0:
            nodes[table].holds_tables = True
        in_table = table > stack.nearest(("template",)) and table > 0
        if tag in TABLE_HOLDERS and in_table:
            stack.cut(stack.nearest(TABLE_HOLDERS[tag]) + 1)
            if tag in ("td", "th") and nodes[-1].tag != "tr":
                row = Node("tr")
                nodes[-1].kids.append(row)
                stack.push(row)
        elif tag == "table" and in_table and nodes[-1].tag in TABLE_PARTS:
            nodes[table].holds_tables = False
            stack.cut(table)
        node = Node(tag, attrs)
        if tag in RAW or tag in ESCAPABLE or tag == "plaintext":
            add(node, tag not in IN_TABLE)
            try:
                _, text, _ = tokens.send(tag)
            except StopIteration:
                return root
            node.kids.append(unescaped(text) if tag in ESCAPABLE else text)
            continue
        add(node, tag not in IN_TABLE)
        if tag not in VOID and not (attrs.endswith("/") and stack.nearest(("svg", "math")) > 0):
            stack.push(node)


_BUTTON = frozenset(("button",))


class _Lines:
    """Text under construction: lines, and how many line ends the next text needs before it.

    A frame is an indented part. Blank lines at its ends don't count; its mark stands before its first text.
    """

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # pending line ends
        self.space = False
        self.begun = False
        self.columns = 0
        self.marks: list[str] = []  # of open frames without text yet
        self.fresh = 0  # open frames without text yet
        self.frames: list[tuple[int, int]] = []

    def enter(self, mark: str) -> None:
        self.frames.append((self.columns, len(self.done)))
        self.marks.append(mark)
        self.columns += len(mark)
        self.fresh += 1
        self.space = False

    def leave(self) -> None:
        self.columns, before = self.frames.pop()
        if self.fresh:
            self.fresh -= 1
            self.marks.pop()
            return
        self.gap = 0
        if not self.line:
            while len(self.done) > before and not self.done[-1]:
                self.done.pop()
            if len(self.done) > before:
                self.line = [self.done.pop()]

    def block(self, ends: int) -> None:
        self.space = False
        if not self.fresh:
            self.gap = max(self.gap, ends)

    def text(self, x: str, pre: bool) -> None:
        if pre:
            parts = x.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, p in enumerate(parts):
                if k:
                    self.broken()
                if p:
                    self.put((" " if self.space and self.line and not self.gap and not self.fresh else "") + p)
                    self.space = False
            return
        parts = _WS.split(x)
        for k, p in enumerate(parts):
            if k and self.line and not self.gap and not self.fresh:
                self.space = True
            if p:
                self.put((" " if self.space and self.line and not self.gap else "") + p)
                self.space = False

    def put(self, x: str) -> None:
        if self.gap:
            self._end_block()
        if not self.line:
            first = self.columns - sum(map(len, self.marks))
            self.line.append(" " * min(first, MARGIN) + "".join(self.marks))
        elif self.marks:
            self.line.append("".join(self.marks))
        self.marks.clear()
        self.line.append(x)
        self.begun = True
        self.fresh = 0

    def _end_block(self) -> None:
        """Pending line ends; a line that a forced end left empty isn't a line."""
        if self.begun:
            if self.line:
                self.done.append("".join(self.line).rstrip())
            self.done += [""] * (self.gap - 1)
        self.line, self.gap = [], 0

    def broken(self) -> None:
        """A forced line end."""
        if self.fresh:
            return
        if self.gap:
            self._end_block()
        if self.begun:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space, self.gap = [], False, 0

    def lines(self) -> list[str]:
        out = [*self.done, "".join(self.line).rstrip()]
        hi = len(out)
        while hi and not out[hi - 1]:
            hi -= 1
        lo = next((k for k in range(hi) if out[k]), hi)
        return out[lo:hi]


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan within what HTML allows; 0 only for a rowspan to the table's end."""
    raw = attributes(cell.attrs).get(name, "1") if name in cell.attrs.lower() else "1"
    m = re.match(r"\s*\+?(\d{1,6})", raw)
    return min(most, int(m[1])) if m else 1


def _rows(table: Node, seen: bool):
    """(row, whether its text shows) in order; hidden rows and parts go."""
    for x in table.kids:
        if isinstance(x, Node) and x.tag in ("tr", "tbody", "thead", "tfoot"):
            look = _visible(x, seen)
            if look is None:
                continue
            if x.tag == "tr":
                yield x, look
            else:
                for y in x.kids:
                    if isinstance(y, Node) and y.tag == "tr" and (own := _visible(y, look)) is not None:
                        yield y, own


class _Held:
    """The last row that holds each column: a tree of least values, grown where cells span rows."""

    def __init__(self, columns: int):
        self.size = 1 << columns.bit_length()
        self.least: dict[int, int] = {}  # of a node's columns, without what holds for a node above
        self.whole: dict[int, int] = {}  # held by all of a node's columns

    def hold(self, lo: int, hi: int, row: int) -> None:
        """Columns lo to hi (without hi) are held to a row."""
        self._hold(1, 0, self.size, lo, hi, row)

    def _hold(self, node, a, b, lo, hi, row):
        if lo <= a and b <= hi:
            self.whole[node] = max(self.whole.get(node, -1), row)
            return
        mid = (a + b) // 2
        if lo < mid:
            self._hold(2 * node, a, mid, lo, hi, row)
        if hi > mid:
            self._hold(2 * node + 1, mid, b, lo, hi, row)
        self.least[node] = min(self._of(2 * node), self._of(2 * node + 1))

    def _of(self, node: int) -> int:
        return max(self.whole.get(node, -1), self.least.get(node, -1))

    def free(self, at: int, row: int) -> int:
        """The first column from at on that no row before holds in this one."""
        found = self._free(1, 0, self.size, at, row)
        return found if found >= 0 else max(at, self.size)

    def _free(self, node, a, b, at, row):
        if b <= at or self._of(node) >= row:
            return -1
        if node not in self.whole and node not in self.least:
            return max(a, at)
        if b - a == 1:
            return a
        mid = (a + b) // 2
        found = self._free(2 * node, a, mid, at, row)
        return found if found >= 0 else self._free(2 * node + 1, mid, b, at, row)


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(column, colspan, cell) of each row's cells; cells that span rows keep their columns in the next ones."""
    sized = [[(max(1, _span(c, "colspan", 1000)), _span(c, "rowspan", 65534), c) for c in cells] for cells in rows]
    spanning = any(high != 1 for row in sized for _, high, _ in row)
    held = _Held(sum(wide for row in sized for wide, _, _ in row)) if spanning else None
    out = []
    for r, cells in enumerate(sized):
        row, at = [], 0
        for wide, high, c in cells:
            if held:
                at = held.free(at, r)
            row.append((at, wide, c))
            at += wide
        for (start, wide, _), (_, high, _) in zip(row, cells):
            if high != 1:
                held.hold(start, start + wide, r + high - 1 if high else len(rows))
        out.append(row)
    return out


def _grid(rows: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """Rows of (column, colspan, lines) with their columns aligned, up to the margin; cells beyond follow each other."""
    width: dict[int, int] = {}
    for row in rows:
        for k, (at, wide, cell) in enumerate(row):
            width.setdefault(at, 0)
            if wide == 1 or k == len(row) - 1:
                width[at] = max(width[at], max(map(len, cell), default=0))
    start, edge = {}, 0
    for at in sorted(width):
        start[at] = min(edge, MARGIN)
        edge += width[at] + 2 if width[at] else 0
    out = []
    for row in rows:
        full = [(start[at], cell) for at, _, cell in row if cell]
        for k in range(max((len(c) for _, c in full), default=0)):
            parts, n = [], 0
            for at, cell in full:
                if k < len(cell) and cell[k]:
                    pad = " " * (at - n) if n < at or not n else "  "
                    parts += (pad, cell[k])
                    n += len(pad) + len(cell[k])
            out.append("".join(parts).rstrip())
            full = [x for x in full if len(x[1]) > k + 1]
    return out


def _visible(node: Node, seen: bool) -> bool | None:
    """Whether a node's own text shows; None if nothing below it can."""
    if node.tag in UNSEEN:
        return None
    raw = node.attrs
    if node.tag == "dialog" and "open" not in attributes(raw):
        return None
    if raw:
        low = raw.lower()
        if "hidden" in low or "style" in low or "type" in low:
            a = attributes(raw)
            if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "input":
                return None
            style = a.get("style", "")
            if style and (h := _HIDES.search(style)):
                if "display" in h.group().lower() or re.search(r"display\s*+:\s*+none", style, re.I):
                    return None
                return False
            if style and _SHOWS.search(style):
                return True
    return seen


def _is_list(select: Node) -> bool:
    """Whether a select shows its options as a list."""
    a = attributes(select.attrs)
    return "multiple" in a or re.fullmatch(r"\s*0*([2-9]|[1-9]\d+)\s*", a.get("size", "")) is not None


def _shown(select: Node) -> list[Node]:
    """The options (and groups) of a select that show: all of a list's, else the chosen one, else the first that can be."""
    found, work = [], [(x, False) for x in reversed(select.kids)]
    while work:
        x, off = work.pop()
        if not isinstance(x, Node) or _visible(x, True) is None:
            continue
        a = attributes(x.attrs)
        if x.tag in ("option", "optgroup"):
            found.append((x, "selected" in a, off or "disabled" in a))
        if x.tag != "option":
            work += [(y, off or "disabled" in a) for y in reversed(x.kids)]
    if _is_list(select):
        return [x for x, _, _ in found]
    options = [o for o in found if o[0].tag == "option"]
    best = [o for o in options if o[1]][-1:] or [o for o in options if not o[2]][:1]
    return [x for x, _, _ in best]


# Rendering goes by generators: each yields the rendering of a part and is resumed when that has ended, so
# that nesting costs no Python frames.


def _run(work):
    """The result of a generator that yields others and goes on with their results."""
    stack, value = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def _table(node: Node, out: _Lines, seen: bool, depth: int):
    """Captions first, then a table's rows with cells aligned in columns.

    A table that holds tables lays out the page: its cells follow each other.
    """
    for x in node.kids:
        if isinstance(x, Node) and x.tag not in ("tr", "tbody", "thead", "tfoot", "colgroup", "col") or isinstance(x, str) and x.strip():
            holder = Node("div")
            holder.kids = [x]
            out.block(1)
            yield _render(holder, out, seen, False, [], depth)
            out.block(1)
    looks, rows = [], []
    for r, look in _rows(node, seen):
        looks.append(look)
        rows.append([c for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")])
    placed = _placed(rows)
    if node.holds_tables or all(len(r) < 2 and all(at == 0 for at, *_ in r) for r in placed):
        for row, look in zip(placed, looks):
            out.block(1)
            for k, (_, _, c) in enumerate(row):
                if (own := _visible(c, look)) is not None:
                    if k and out.line and not out.gap and not out.fresh:
                        out.line.append("  ")
                    yield _render(c, out, own, False, [], 0)
            out.block(1)
        return
    grid = []
    for row, look in zip(placed, looks):
        cells = []
        for at, wide, c in row:
            own, lines = _visible(c, look), []
            if own is not None:
                part = _Lines()
                yield _render(c, part, own, False, [], 0)
                lines = part.lines()
            cells.append((at, wide, lines))
        grid.append(cells)
    for k, y in enumerate(_grid(grid)):
        if k:
            out.broken()
        if y:
            out.put(y)


def _render(node: Node, out: _Lines, seen: bool, pre: bool, order: list, depth: int):
    kids = node.kids
    if node.tag == "details" and "open" not in attributes(node.attrs):
        kids = [x for x in kids if isinstance(x, Node) and x.tag == "summary"][:1]
    for x in kids:
        if isinstance(x, str):
            if seen:
                out.text(x, pre)
            continue
        tag = x.tag
        if tag == "br":
            if seen:
                out.broken()
            continue
        look = _visible(x, seen)
        if look is None:
            continue
        if tag == "hr":
            out.block(1)
            continue
        if tag == "img":
            alt = attributes(x.attrs).get("alt", "") if "alt" in x.attrs.lower() else ""
            if alt and look:
                out.text(alt, False)
            continue
        if tag == "select":
            for option in _shown(x):
                label = attributes(option.attrs).get("label", "") if "label" in option.attrs.lower() else ""
                if option.tag == "optgroup" or _is_list(x):
                    out.block(1)
                if label:
                    out.text(label, False)
                elif option.tag == "option":
                    yield _render(option, out, look, False, [], depth)
            if _is_list(x):
                out.block(1)
        elif tag == "table":
            out.block(2)
            yield _table(x, out, look, depth)
            out.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            first = attributes(x.attrs).get("start", "") if x.attrs else ""
            out.block(2 if depth == 0 else 1)
            step, begin = 1, 1
            if tag == "ol" and x.attrs and "reversed" in attributes(x.attrs):
                step, begin = -1, sum(isinstance(y, Node) and y.tag == "li" for y in x.kids)
            number = int(first) if re.fullmatch(r"-?\d{1,9}", first) else begin
            yield _render(x, out, look, pre, ["ol" if tag == "ol" else "ul", number, step], depth + 1)
            out.block(2 if depth == 0 else 1)
        elif tag == "li":
            mark = "- "
            if order and order[0] == "ol":
                own = attributes(x.attrs).get("value", "") if x.attrs else ""
                if re.fullmatch(r"-?\d{1,9}", own):
                    order[1] = int(own)
                mark = f"{order[1]}. "
                order[1] += order[2]
            out.block(1)
            out.enter(mark)
            yield _render(x, out, look, False, [], depth)
            out.leave()
            out.block(1)
        elif tag == "blockquote" or tag == "dd":
            out.block(2 if tag == "blockquote" else 1)
            out.enter("  ")
            yield _render(x, out, look, False, [], depth)
            out.leave()
            out.block(2 if tag == "blockquote" else 1)
        elif tag in BLOCK:
            ends = 2 if tag in SPACED else 1
            out.block(ends)
            yield _render(x, out, look, pre or tag == "pre" or tag == "textarea", [], depth)
            out.block(ends)
        else:
            yield _render(x, out, look, pre or tag in ("textarea", "listing", "plaintext", "xmp"), order, depth)


def html_to_text(doc: str | None) -> str:
    """All visible text of a document: blocks on lines of their own, lists marked, table cells aligned.

    Drawings' and formulas' text and a select's chosen option are visible too. Time is linear in the document (by a
    logarithm more in tables with cells that span rows) and so is the text's length (see MARGIN), whatever the nesting.
    """
    if not doc:
        return ""
    root = parse(doc.replace("\x00", "�"))
    look = _visible(root, True)
    if look is None:
        return ""
    out = _Lines()
    _run(_render(root, out, look, False, [], 0))
    return "\n".join(out.lines())


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines) for every row.

    A null or empty html gives an empty text, 0 and 0; broken or hostile markup neither fails nor takes long. Repeated rows stay
    repeated; other columns are ignored.
    """

    def one(batch):
        texts = [html_to_text(x.as_py()) for x in batch.column("html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")), one, "page_id long, text string, n_chars long, n_lines long")
