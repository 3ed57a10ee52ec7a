"""HTML extraction: a tree builder with implied tags, and a layout-aware rendering of all visible text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist param area rp".split())
HIDDEN_FOREIGN = frozenset("title desc metadata defs symbol style script annotation annotation-xml".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table ul caption tbody thead tfoot tr xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre xmp figure hr".split())
LISTS = frozenset("ul ol menu".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
CLOSES_P = BLOCK - frozenset("html body tbody thead tfoot tr caption dd dt li option optgroup legend".split()) | frozenset("ul ol dl dd dt li".split())
P_STOPS = ("table", "td", "th", "caption", "button", "object", "template")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_GROUP = (("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",))
#: start tag -> open elements that it ends, and the elements at which the search stops
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption"), ("table", "tr")),
    "th": (("td", "th", "caption"), ("table", "tr")),
    "tbody": _GROUP,
    "thead": _GROUP,
    "tfoot": _GROUP,
    "colgroup": _GROUP,
    "caption": _GROUP,
}

_SPACE = "\t\n\f\r "
_WHITE = re.compile(r"[\t\n\f\r ]+")
_NAME = re.compile(r"[^\t\n\f\r />]*")
#: Where markup begins: a tag's name, or a comment of whatever kind; any other "<" is text.
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z])|[!?]|/(?=[\s\S]))")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*)>")
_BETWEEN = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
_STYLE = re.compile(r"(?:^|;)[\s]*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])[^>]*>", re.I) for tag in RAW}
_INTEGER = re.compile(r"\s*(-?\d{1,9})")

#: Cells of more characters than this stand in their row as they are and do not widen their column.
WIDE_CELL = 200
#: Lists nested deeper are indented no further.
DEEPEST = 20


class Node:
    """An element: its children, whether it is gone for layout, and what it says about visibility (None: as its parent)."""

    __slots__ = ("tag", "kids", "gone", "seen", "given", "holds_table")

    def __init__(self, tag: str, gone: bool = False, seen: bool | None = None, given: dict[str, str] | None = None) -> None:
        self.tag, self.kids, self.gone, self.seen, self.given, self.holds_table = tag, [], gone, seen, given, False

    def number(self, name: str, default: int) -> int:
        found = _INTEGER.match(self.given.get(name, "")) if self.given else None
        return int(found[1]) if found else default


def read_tag(source: str, at: int) -> tuple[dict[str, str], int, bool] | None:
    """(attributes, place after the tag, self-closing) from behind a tag's name; None where the source ends within the tag.

    The states are those of the standard: before, in and after an attribute's name, before a value, and
    a value in double quotes, in single ones or in none, where a quote is a character like any other.
    """
    found: dict[str, str] = {}
    n = len(source)
    while True:
        gap = _BETWEEN.match(source, at)
        at = gap.end()
        if at >= n:
            return None
        if source[at] == ">":
            return found, at + 1, gap[0].endswith("/")
        m = _ATTRIBUTE_NAME.match(source, at)
        name, at = m[0].lower(), m.end()
        value = ""
        m = _EQUALS.match(source, at)
        if m:
            at = m.end()
            quote = source[at : at + 1]
            if quote in ('"', "'"):
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(source, at)
                value, at = m[0], m.end()
        found.setdefault(name, html.unescape(value) if "&" in value else value)


def _shown(tag: str, given: dict[str, str], foreign: bool) -> tuple[bool, bool | None]:
    """Whether an element is gone with all that it holds, and its visibility where it states one."""
    style = {k.lower(): v.lower() for k, v in _STYLE.findall(given.get("style", ""))}
    gone = tag in (HIDDEN_FOREIGN if foreign else HIDDEN) or (tag == "input" and given.get("type", "").lower() == "hidden")
    gone = gone or (tag == "dialog" and "open" not in given and "display" not in style)
    gone = gone or style.get("display") == "none" or ("hidden" in given and "display" not in style)
    seen = style.get("visibility")
    return gone, None if seen not in ("hidden", "collapse", "visible") else seen == "visible"


class _Builder:
    """The stack of open elements, with the places of each tag in it, so that no search walks the stack."""

    def __init__(self) -> None:
        self.root = Node("#root")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        if node.tag == "table" and (outer := self.last(("table",))):
            self.stack[outer].holds_table = True
        self.stack[-1].kids.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Close all from ``place`` on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def start(self, tag: str) -> None:
        """Close what a start tag implies to be over."""
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.cut(len(self.stack) - 1)
        if tag in CLOSES_P and (at := self.last(("p",))) > self.last(P_STOPS):
            self.cut(at)
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            stop = self.last(stops)
            firsts = [p[k] for t in ends if (p := self.places.get(t)) and (k := bisect_right(p, stop)) < len(p)]
            if firsts:
                self.cut(min(firsts))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.cut(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        at = self.last((tag,))
        if at and (tag == "table" or at > self.last(("table",))):
            self.cut(at)

    def text(self, data: str) -> None:
        if self.stack[-1].tag == "head" and data.strip(_SPACE):
            self.cut(len(self.stack) - 1)
        self.stack[-1].kids.append(html.unescape(data) if "&" in data else data)


def build_tree(source: str) -> Node:
    """A tree of elements and strings, in time linear in the source (but for a logarithm).

    Start tags end what they imply to be over (head, p before blocks, li, dt, dd, option, cells, rows, row
    groups); an end tag closes the nearest such element, but none outside the table it stands in; an
    unmatched one is ignored.  Raw elements end only at their own end tag, a tag that the source breaks off is dropped.
    """
    tree = _Builder()
    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if not m:
            tree.text(source[at:])
            break
        less, closing = m.start(), m[1] == "/"
        if not m[2]:
            if less > at:
                tree.text(source[at:less])
            if source.startswith("<!--", less):
                end = source.find("-->", less + 2)
                at = n if end < 0 else end + 3
            else:
                end = source.find(">", less)
                at = n if end < 0 else end + 1
            continue
        if less > at:
            tree.text(source[at:less])
        plain = _PLAIN_TAG.match(source, less)
        if plain:
            tag, given, at, empty = plain[2].lower(), {}, plain.end(), False
        else:
            name = _NAME.match(source, less + 1 + closing)
            read = read_tag(source, name.end())
            if read is None:
                break
            tag = name[0].lower()
            given, at, empty = read
        if closing:
            if tag == "br":
                tree.stack[-1].kids.append(Node("br"))
            else:
                tree.end(tag)
            continue
        foreign = bool(tree.places.get("svg") or tree.places.get("math"))
        tree.start(tag)
        gone, seen = _shown(tag, given, foreign)
        node = Node(tag, gone, seen, given if given and tag in ("ol", "li", "td", "th") else None)
        if tag == "img" and given.get("alt"):
            node.kids.append(given["alt"])
        if tag in RAW and not foreign:
            end = _RAW_END[tag].search(source, at) if tag != "plaintext" else None
            body = source[at : end.start() if end else n]
            at = end.end() if end else n
            if not gone:
                node.kids.append(html.unescape(body) if tag == "textarea" else body)
            tree.stack[-1].kids.append(node)
        elif tag in VOID or (empty and (foreign or tag in ("svg", "math"))):
            tree.stack[-1].kids.append(node)
        else:
            tree.push(node)
            if tag == "pre" and source.startswith("\n", at):
                at += 1
    return tree.root


class _Lines:
    """Lines under way: words join with single spaces, blocks begin lines, spaced blocks leave one empty."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def text(self, data: str) -> None:
        parts = _WHITE.split(data)
        for k, word in enumerate(parts):
            if k:
                self.space = True
            if word:
                if self.space and self.now:
                    self.now.append(" ")
                self.space = False
                self.now.append(word)

    def _begin(self) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False

    def kept(self, data: str) -> None:
        """Text in which spaces and line ends count."""
        for k, row in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                self._begin()
                self.done.append("".join(self.now).rstrip(" "))
                self.now, self.space = [], False
            if row:
                self.now.append(row)

    def line(self, blank: bool = False) -> None:
        if self.now:
            self._begin()
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = False
        self.gap |= blank

    def whole(self, lines: list[str]) -> None:
        """Finished lines as a spaced block."""
        self.line(True)
        if lines:
            self._begin()
            self.done += lines
        self.gap = True

    def ended(self) -> list[str]:
        self.line()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


class _Table:
    """The cells of a table under way, and what stands loose in it."""

    def __init__(self) -> None:
        self.loose = _Lines()
        self.captions: list[str] = []
        #: rows of (first column, one after the last, text)
        self.rows: list[list[tuple[int, int, str]]] = []
        #: columns that cells of earlier rows reach down into: (first, one after the last, last row)
        self.down: list[tuple[int, int, int]] = []

    def row(self) -> None:
        self.rows.append([])
        number = len(self.rows) - 1
        self.down = [x for x in self.down if x[2] >= number]

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row, number = self.rows[-1], len(self.rows) - 1
        at = row[-1][1] if row else 0
        for first, end, _ in self.down:  # in order of columns
            if first <= at < end:
                at = end
        row.append((at, at + across, text))
        if down > 1 and len(self.down) < 64:  # layout only: beyond so many at once, columns below are not shifted
            self.down = sorted([*self.down, (at, at + across, number + down - 1)])

    def lines(self) -> list[str]:
        """Caption and loose text, then rows: columns as wide as their widest cell, two spaces between."""
        starts = sorted({first for row in self.rows for first, _, _ in row})
        place = {first: k for k, first in enumerate(starts)}
        wide = [0] * len(starts)
        for row in self.rows:
            for first, end, text in row:
                if place[first] + 1 == len(starts) or end <= starts[place[first] + 1]:
                    wide[place[first]] = max(wide[place[first]], len(text) if len(text) <= WIDE_CELL else 0)
        at = [0]  # where each column begins
        for w in wide:
            at.append(at[-1] + w + 2 if w else at[-1])
        out = []
        for row in self.rows:
            line, length = [], 0
            for first, _, text in row:
                if text:
                    pad = max(at[place[first]] - length, 2 if length else 0)
                    line.append(" " * pad + text)
                    length += pad + len(text)
            if line:
                out.append("".join(line))
        return [*(x for x in self.captions if x), *(x for x in self.loose.ended() if x), *out]


class _Frame:
    """An open element in rendering, with what its children inherit."""

    __slots__ = ("node", "kids", "lists", "pre", "seen", "list_frame", "next", "inside")

    def __init__(self, node: Node, over: _Frame | None) -> None:
        self.node, self.kids, self.next = node, iter(node.kids), 1
        self.lists = over.lists if over else 0
        self.pre = over.pre if over else False
        self.seen = over.seen if over else True
        self.list_frame = over.list_frame if over else None
        self.inside = self.lists > 0  # in a list already: no empty lines around
        if node.seen is not None:
            self.seen = node.seen


def render_lines(root: Node) -> list[str]:
    """All visible text of a node, as lines; nesting is followed with a stack of its own, to any depth.

    A table that holds no other is laid out in columns.  One that holds tables is taken for page layout:
    its cells follow one another as blocks.  Text that stands in a table outside its cells goes before the rows.
    """
    outs: list[_Lines] = [_Lines()]  # the page; the loose text, a cell or a caption of the table under way
    table: _Table | None = None
    stack = [_Frame(root, None)]
    while stack:
        top = stack[-1]
        node, tag, out = top.node, top.node.tag, outs[-1]
        kid = next(top.kids, None)
        if kid is None:
            stack.pop()
            top.list_frame = None
            if table is not None and tag == "table":
                outs.pop()
                outs[-1].whole(table.lines())
                table = None
            elif table is not None and tag in ("td", "th"):
                outs.pop()
                table.cell(" ".join(x for x in out.ended() if x), min(1000, max(1, node.number("colspan", 1))), max(1, node.number("rowspan", 1)))
            elif table is not None and tag == "caption":
                outs.pop()
                table.captions += out.ended()
            elif tag in BLOCK or tag in ("td", "th"):
                out.line(tag in SPACED and not top.inside)
            continue
        if isinstance(kid, str):
            if top.seen:
                out.kept(kid) if top.pre else out.text(kid)
            continue
        if kid.gone:
            continue
        tag = kid.tag
        if tag == "br":
            out.line() if out.now or not top.pre else out.kept("\n")
            continue
        if tag == "hr":
            out.line(True)
            continue
        frame = _Frame(kid, top)
        stack.append(frame)
        if tag == "table" and table is None and not kid.holds_table:
            table = _Table()
            outs.append(table.loose)
            continue
        if table is not None and tag in ("tr", "td", "th", "caption") and len(outs) == 2 or table is not None and tag in ("td", "th", "caption"):
            if tag == "tr":
                table.row()
            else:
                outs.append(_Lines())
            continue
        if tag in BLOCK or tag in ("td", "th"):
            out.line(tag in SPACED and not frame.inside)
        if tag in ("pre", "xmp"):
            frame.pre = True
        elif tag in LISTS:
            frame.lists += 1
            frame.list_frame, frame.next = frame, kid.number("start", 1)
        elif tag == "li" and frame.seen:
            mark, owner = "-", frame.list_frame
            if owner is not None and owner.node.tag == "ol":
                number = kid.number("value", owner.next)
                mark, owner.next = f"{number}.", number + 1
            out.now.append("  " * min(DEEPEST, max(0, frame.lists - 1)) + mark)
            out.space = True
    return outs[0].ended()


def extract_text(source: str | None) -> str:
    """The visible text of a page; null, empty or markup-only pages give the empty string."""
    return "\n".join(render_lines(build_tree(source))) if source else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars, n_lines) of every row, whole pages in one pass without a shuffle.

    Defined cases: a null or empty page gives the empty string and 0 lines; rows stand for themselves, so
    repeated rows and null ids all come back; an empty table gives an empty table; other columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [extract_text(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64()), pa.array((x.count("\n") + bool(x) for x in found), pa.int64())], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
