"""The visible text of web pages, laid out: blocks, lists, preformatted text and aligned table cells.

A page becomes a tree (start and end tags that HTML lets authors leave out are put in), what is not shown is
dropped from it, and the rest is rendered. Both passes keep their own stacks, so depth is not limited.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of, tune

# Element names as HTML defines their roles.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object canvas audio video datalist rp defs metadata annotation annotation-xml".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend option optgroup".split())
LISTS = frozenset("ul ol menu dir".split())

#: What a start tag ends if it is open, and what that search does not look past.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "colgroup": (frozenset(["colgroup", "caption"]), frozenset(["table"])),
}
SCOPE = frozenset("table td th caption template html".split())

_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_MARK, _BREAK = re.compile("[\"'>]"), re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)\Z", re.I)
_PART = re.compile(r"[.#][\w-]+")
_SPACES = re.compile(r"[ \t\n\r\f]+")


# Fixed limits of the layout, the same for every page; a caller's own take their place. No text is left out for them.
#: A wider indent is written as ``SHORT_INDENT`` spaces.
WIDEST_INDENT, SHORT_INDENT = 256, 32
#: A cell that would stand further than this behind the one before it, or the line's begin, is not aligned.
WIDEST_GAP = 1024
#: Tables nest as deep as this; those inside are plain blocks.
NESTED_TABLES = 64
#: Spans of earlier rows are passed over in blocks of so many, if all of a block hold.
SPAN_BLOCK = 128


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        value = a or b or c
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


class Builder:
    """A tree from tags and texts in the order they come."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.many: Counter = Counter()
        self.body: Node | None = None
        self.styles: list[str] = []

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.many[node.tag] += 1

    def _cut(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        for node in self.open[at:]:
            self.many[node.tag] -= 1
        del self.open[at:]

    def _end(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``stop`` encloses it from."""
        if not any(self.many[t] for t in tags):
            return
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                found = i
            elif tag in stop:
                break
        if found is not None:
            self._cut(found)

    def _into_body(self) -> None:
        if self.body is None:
            self._cut(1)
            self.body = Node("body", {})
            self._push(self.body)

    def start(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag == "head":
            if self.body is None and len(self.open) == 1:
                self._push(Node("head", attrs))
            return
        if tag == "body":
            first = self.body is None
            self._into_body()
            if first:
                self.body.attrs = attrs
            return
        if self.body is None and not (tag in HEAD or any(n.tag in UNSEEN and n.tag != "head" for n in self.open)):
            self._into_body()
        if tag in CLOSES_P:
            self._end(frozenset(["p"]), SCOPE | frozenset(["button"]))
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr", {}))
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(-1)
        node = Node(tag, attrs)
        self._push(node)
        if tag in VOID or alone:
            self._cut(-1)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {}, True)
            return
        stop = SCOPE - {tag}
        for i in range(len(self.open) - 1, 0, -1) if self.many[tag] else ():
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in stop and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
            if self.open[i].tag == "table" and tag != "table":
                break
        if tag == "p":
            self.start("p", {}, True)

    def text(self, data: str) -> None:
        if self.body is None and not data.isspace() and self.open[-1].tag in ("html", "head"):
            self._into_body()
        self.open[-1].children.append(data)


class Scanner:
    """Where tags end, in time linear in the page however many of them do not.

    A tag ends at the first ``>`` outside quotes. A tag without one is text, and so may be the next, so what was learned
    on the way is kept: the next quote or ``>`` from a place on, and the opening quotes from which no end comes.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.hopeless: set[int] = set()
        self.known = {c: (0, -1) for c in ("mark", "break")}

    def _next(self, kind: str, pattern: re.Pattern, at: int) -> int:
        """The next match from ``at`` on, or the page's end; a gap that was looked through is not looked through again."""
        low, high = self.known[kind]
        if not low <= at <= high:
            m = pattern.search(self.page, at)
            high = m.start() if m else len(self.page)
            self.known[kind] = at, high
        return high

    def tag(self, at: int) -> tuple[str, int, int] | None:
        """``(name, end of the name, end of the tag)`` of the tag whose name begins at ``at``; None if it has no end."""
        page, stop = self.page, self._next("break", _BREAK, at)
        place, seen = stop, []
        while True:
            mark = self._next("mark", _MARK, place)
            if mark < len(page) and page[mark] == ">":
                return page[at:stop].lower(), stop, mark + 1
            close = -1
            if mark < len(page) and mark not in self.hopeless:
                seen.append(mark)
                close = page.find(page[mark], mark + 1)
            if close < 0:
                self.hopeless.update(seen)
                return None
            place = close + 1


def parse(page: str) -> Builder:
    """The tree of a page; unclosed elements end with the page, and a tag without an end is text."""
    tree, scanner = Builder(), Scanner(page)
    at = look = 0
    while True:
        m = _MARKUP.search(page, look)
        found = None
        if m and m[0][1] not in "!?":
            found = scanner.tag(m.start() + (2 if m[0][1] == "/" else 1))
            if found is None:
                look = m.end()
                continue
        upto = m.start() if m else len(page)
        if upto > at:
            data = page[at:upto]
            tree.text(html.unescape(data) if "&" in data else data)
        if not m:
            return tree
        if found is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = page.find(mark, m.end())
            at = look = len(page) if end < 0 else end + len(mark)
            continue
        tag, stop, at = found
        look = at
        if m[0][1] == "/":
            tree.end(tag)
            continue
        rest = page[stop : at - 1]
        # Only foreign elements are closed by a slash; a raw element's content follows whatever its tag looks like.
        tree.start(tag, _attributes(rest), rest.endswith("/") and (tree.many["svg"] > 0 or tree.many["math"] > 0 or tag in ("svg", "math")))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            data = page[at : close.start() if close else len(page)]
            at = look = close.end() if close else len(page)
            if tag == "style":
                tree.styles.append(data)
            if data:
                tree.text(html.unescape(data) if tag in ("textarea", "title") and "&" in data else data)
            tree.end(tag)


def _declarations(body: str) -> list[tuple[str, str, bool]]:
    """``(property, value, important)`` of the display and visibility declarations of a rule."""
    return [(p.lower(), v.lower(), bool(i)) for p, v, i in _DECLARATION.findall(body)]


def _on_screen(query: str) -> bool:
    """Whether an at-rule's block applies to a screen: media rules for screens or all media, and conditions."""
    name, _, rest = query.strip().lower().partition(" ")
    if name == "@media":
        return any(not re.match(r"\s*(only\s+)?(print|speech|not\s+(all|screen))\b", q) for q in rest.split(","))
    return name in ("@supports", "@layer")


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """``(selectors, body)`` of the rules of a style sheet that apply to a screen, in order."""
    blocks: list[tuple[str, bool]] = []  # heads of the open blocks, and whether what is inside applies
    held: list[str] = []
    for token in re.split(r"([{}])", _COMMENT.sub(" ", sheet)):
        if token == "{":
            head = "".join(held).rsplit(";", 1)[-1].strip()
            applies = not blocks or blocks[-1][1]
            blocks.append((head, applies and (not head.startswith("@") or _on_screen(head))))
            held = []
        elif token == "}":
            if blocks:
                head, applies = blocks.pop()
                if applies and not head.startswith("@"):
                    yield head, "".join(held)
            held = []
        else:
            held.append(token)


class Styles:
    """Display and visibility that a page's style sheets give, by simple selectors: a tag, classes and ids together.

    Of matching declarations an important one wins, then the more specific, then the later.
    """

    def __init__(self, sheets: list[str]) -> None:
        #: By the selector's last name: (names, weight, property, value).
        self.by_name: dict[str, list[tuple[frozenset[str], tuple, str, str]]] = {}
        order = 0
        for sheet in sheets:
            if "display" not in sheet and "visibility" not in sheet:
                continue
            for selectors, body in _rules(sheet):
                found = _declarations(body)
                for selector in selectors.split(",") if found else ():
                    m = _COMPOUND.match(selector.strip())
                    if not m or not (m[1] or m[2]):
                        continue
                    parts = _PART.findall(m[2])
                    tag = [m[1].lower()] if m[1] and m[1] != "*" else []
                    names = frozenset(tag + parts) or frozenset("*")
                    weight = (sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), len(tag))
                    for what, value, important in found:
                        order += 1
                        self.by_name.setdefault((parts or tag or ["*"])[-1], []).append((names, (important, weight, order), what, value))

    def of(self, node: Node) -> dict[str, str]:
        """The winning values for an element, its own style among them."""
        best: dict[str, tuple[tuple, str]] = {}
        attrs = node.attrs
        if self.by_name:
            names = {"*", node.tag, *("." + c for c in attrs.get("class", "").split())}
            if "id" in attrs:
                names.add("#" + attrs["id"])
            for name in names & self.by_name.keys():
                for needs, weight, what, value in self.by_name[name]:
                    if needs <= names and (what not in best or best[what][0] < weight):
                        best[what] = weight, value
        if "style" in attrs:
            for what, value, important in _declarations(attrs["style"]):
                weight = (important, (1 << 30, 0, 0), 0)
                if what not in best or best[what][0] <= weight:
                    best[what] = weight, value
        return {what: value for what, (_, value) in best.items()}


def _display(node: Node, style: dict[str, str]) -> bool:
    attrs = node.attrs
    if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in attrs) or (node.tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return False
    return style["display"] != "none" if "display" in style else "hidden" not in attrs


def _chosen(select: Node) -> set[int]:
    """The options of a select that a page shows: all of a list, else the last selected one or the first."""
    options, stack = [], [select]
    while stack:
        node = stack.pop()
        if node.tag == "option":
            options.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    if "multiple" in select.attrs or _number(select.attrs.get("size"), 1000) > 1:
        return set(map(id, options))
    marked = [o for o in options if "selected" in o.attrs]
    return {id(o) for o in marked[-1:] or options[:1]}


class Spaces:
    """The spaces that a line is laid out with: by its own indent and gaps, never by the rest of the page."""

    def __init__(self, max_indent: int | None = None, max_aligned: int | None = None) -> None:
        self.max_indent, self.max_aligned = max_indent, max_aligned

    def indent(self, width: int) -> str:
        if self.max_indent is not None:
            return " " * min(width, self.max_indent)
        return " " * (width if width <= WIDEST_INDENT else SHORT_INDENT)

    def gap(self, start: int, size: int) -> int:
        """The spaces before a cell at ``start`` in a line of ``size`` characters."""
        if self.max_aligned is None and start - size > WIDEST_GAP:
            return 2 if size else 0
        return start - size


class Writer:
    """Lines of text; spaces collapse, blocks begin new lines, and margins keep one empty line."""

    def __init__(self, spaces: Spaces) -> None:
        self.spaces = spaces
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.space = False
        self.indent: list[int] = []
        self.width = 0
        self.marker = ""

    def deeper(self, by: int) -> None:
        self.indent.append(by)
        self.width += by

    def back(self) -> None:
        self.width -= self.indent.pop()

    def _begin(self) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead = self.spaces.indent(self.width - (self.indent[-1] if self.marker else 0)) + self.marker
        self.marker = ""
        self.line = [lead] if lead else []

    def add(self, data: str) -> None:
        words = _SPACES.sub(" ", data)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if not self.filled:
            self._begin()
            self.filled = True
        elif self.space:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.rstrip(" "))

    filled = False

    def raw(self, data: str) -> None:
        parts = data.replace("\r\n", "\n").split("\n")
        for i, part in enumerate(parts):
            if i:
                self.break_line(True)
            if part:
                if not self.filled:
                    self._begin()
                    self.filled = True
                self.line.append(part)

    def break_line(self, keep_empty: bool = False) -> None:
        if self.filled:
            self.lines.append("".join(self.line).rstrip())
        elif keep_empty and self.lines and not self.gap:
            self.lines.append("")
        self.line, self.filled, self.space = [], False, False

    def block(self, spaced: bool) -> None:
        self.break_line()
        self.gap = self.gap or spaced

    def whole(self, lines: list[str]) -> None:
        self.break_line()
        for i, line in enumerate(lines):
            if not i or self.width:
                self._begin()
                line = ("".join(self.line) + line).rstrip()
            self.lines.append(line)
        self.line = []

    def text(self) -> str:
        self.break_line()
        return "\n".join(self.lines).strip("\n")


class Grid:
    """The cells of a table by row and column, with their spans."""

    def __init__(self) -> None:
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        #: Columns that cells of earlier rows reach down into: (first, after the last, rows from here on), in order, apart or of different rows.
        self.taken: list[tuple[int, int, int]] = []
        self.ahead: list[tuple[int, int, int]] = []
        self.passed = self.waited = 0
        #: By block of ``taken``: the first and last row at which any of it ends, and the column after it where its spans touch.
        self.blocks: dict[int, tuple[int, int, int | None]] = {}
        self.column = 0
        self.captions: list[str] = []

    def row(self) -> None:
        self.rows.append({})
        self.column = self.passed = 0
        before = self.taken
        self.taken, self.ahead = _joined(self.taken, self.ahead), []
        self.waited += 1
        if self.waited >= len(self.taken):  # spans that ended are passed over until then
            self.taken, self.waited = [s for s in self.taken if s[2] >= len(self.rows)], 0
        if self.taken is not before:
            self.blocks = {}

    def _block(self, at: int) -> tuple[int, int, int | None]:
        found = self.blocks.get(at)
        if found is None:
            spans = self.taken[at : at + SPAN_BLOCK]
            reach: int | None = spans[0][1]
            for first, end, _ in spans:
                if first > reach:
                    reach = None
                    break
                reach = max(reach, end)
            found = self.blocks[at] = min(s[2] for s in spans), max(s[2] for s in spans), reach
        return found

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.passed < len(self.taken) and self.taken[self.passed][0] <= self.column:
            # The last span may still grow, so its block is not kept.
            if self.passed % SPAN_BLOCK == 0 and self.passed + SPAN_BLOCK < len(self.taken):
                soonest, latest, reach = self._block(self.passed)
                if latest < len(self.rows) or (soonest >= len(self.rows) and reach is not None):
                    if latest >= len(self.rows):
                        self.column = max(self.column, reach)
                    self.passed += SPAN_BLOCK
                    continue
            first, end, last = self.taken[self.passed]
            if last >= len(self.rows):
                self.column = max(self.column, end)
            self.passed += 1
        self.rows[-1][self.column] = (lines, across)
        if down > 1:
            # Where it overlaps a span from above, both hold.
            self.ahead = _joined(self.ahead, [(self.column, self.column + across, len(self.rows) + down - 1)])
        self.column += across

    def lines(self, spaces: Spaces) -> list[str]:
        """The table's lines: each column as wide as its widest cell of its own."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, (lines, across) in row.items():
                widths[c] = max(widths.get(c, 0), *map(len, lines)) if across == 1 else widths.get(c, 0)
        # Where each column that a cell begins in begins: one sum over those columns.
        starts, at = {}, 0
        for c in sorted(widths):
            starts[c] = at
            at += widths[c] + 2
            if spaces.max_aligned is not None and at > spaces.max_aligned:
                break
        out = list(self.captions)
        for row in self.rows:
            if len(row) == 1 and 0 in row:
                out += row[0][0]
                continue
            columns = sorted(row)
            for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
                line, size = [], 0
                for c in columns:
                    text = row[c][0][i] if i < len(row[c][0]) else ""
                    if text:
                        start = max(starts.get(c, 0), size + 2 if size else 0)
                        line.append(" " * spaces.gap(start, size) + text)
                        size = start + len(text)
                out.append("".join(line))
        return [line.rstrip() for line in out]


def _joined(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of both lists by first column, ``a`` changed in place if ``b`` comes after it; neighbours that reach as far down become one."""
    kept = a
    if a and b and a[-1][0] > b[0][0]:
        kept, b = [], sorted(a + b)
    for span in b:
        if kept and kept[-1][1] == span[0] and kept[-1][2] == span[2]:
            kept[-1] = (kept[-1][0], span[1], span[2])
        else:
            kept.append(span)
    return kept


def _number(text: str | None, most: int) -> int:
    """A span attribute: its leading digits 0 to 9, within the limits that HTML sets; one where there are none."""
    digits = re.match(r"\s*\+?0*([0-9]*)", text or "")[1]
    return max(1, min(most, int(digits or 0))) if len(digits) < 10 else most


def _integer(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else None


def render(page: str, max_indent: int | None = None, max_aligned: int | None = None, max_tables: int | None = None) -> str:
    """All visible text of a page, laid out."""
    tree = parse(page)
    styles = Styles(tree.styles)
    spaces = Spaces(max_indent, max_aligned)
    depth = NESTED_TABLES if max_tables is None else max_tables
    writers, grids, counters = [Writer(spaces)], [], []
    plain, shown_options = 0, set()
    preformatted = 0
    stack: list[tuple[Node | str | None, Node, bool]] = [(tree.root, tree.root, True)]
    while stack:
        item, node, shown = stack.pop()
        out = writers[-1]
        if isinstance(item, str):
            if shown:
                if preformatted:
                    out.raw(item)
                elif node.tag not in ("table", "tbody", "thead", "tfoot", "tr", "colgroup") or not item.isspace():
                    out.add(item)
            continue
        tag = node.tag
        if item is None:  # the node ends
            if tag in ("td", "th") and grids and not plain:
                lines = writers.pop().text().split("\n")
                grids[-1].cell(lines, _number(node.attrs.get("colspan"), 1000), _number(node.attrs.get("rowspan"), 65534))
                continue
            if tag == "caption" and grids and not plain:
                grids[-1].captions += writers.pop().text().split("\n")
                continue
            if tag == "table" and plain:
                plain -= 1
            elif tag == "table":
                lines = grids.pop().lines(spaces)
                out = writers[-1]
                if any(lines):
                    out.whole(lines)
            if tag in LISTS:
                counters.pop()
            if tag == "li" and out.indent:
                out.break_line()
                out.back()
                out.marker = ""
            if tag in ("blockquote", "dd") and out.indent:
                out.break_line()
                out.back()
            if tag in ("pre", "textarea"):
                preformatted -= 1
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in LISTS and counters))
            continue
        style = styles.of(node)
        if not _display(node, style) or (tag == "option" and shown_options and id(node) not in shown_options):
            continue
        if "visibility" in style:
            shown = style["visibility"] == "visible" or (shown and style["visibility"] not in ("hidden", "collapse"))
        if tag == "br":
            if shown:
                out.break_line(True)
            continue
        if tag == "select":
            shown_options |= _chosen(node)
        if tag == "table" and len(grids) >= depth:
            out.block(True)
            plain += 1
        elif tag == "table":
            out.block(True)
            grids.append(Grid())
        elif tag == "tr" and grids and not plain:
            grids[-1].row()
        elif (tag in ("td", "th", "caption")) and grids and not plain:
            writers.append(Writer(spaces))
        elif tag in BLOCK:
            out.block(tag in SPACED and not (tag in LISTS and counters))
        if tag in LISTS:
            step = -1 if "reversed" in node.attrs else 1
            first = _integer(node.attrs.get("start"))
            if first is None:
                first = 1 if step == 1 else sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            counters.append([first, step] if tag == "ol" else None)
        elif tag == "li":
            count = counters[-1] if counters else None
            if count:
                own = _integer(node.attrs.get("value"))
                number = count[0] if own is None else own
                count[0] = number + count[1]
            out.marker = f"{number}. " if count else "- "
            out.deeper(len(out.marker))
        elif tag in ("blockquote", "dd"):
            out.deeper(2)
        elif tag in ("pre", "textarea"):
            preformatted += 1
        stack.append((None, node, shown))
        closed = tag == "details" and "open" not in node.attrs
        for child in reversed(node.children):
            if not closed or (isinstance(child, Node) and child.tag == "summary"):
                stack.append((child, node if isinstance(child, str) else child, shown))
    return writers[0].text()


def renderer(**limits: int | None):
    """A function from a column of pages to their text; null stays null."""

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            known = column.is_valid().to_pylist()
            yield pa.array([render(page, **limits) if k else None for page, k in zip(texts_of(column), known)], pa.string())

    return text


def extract_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text", max_indent: int | None = None, max_aligned: int | None = None, max_tables: int | None = None) -> DataFrame:
    """``pages`` with ``<out_col>``: the visible text of ``<html_col>``, laid out.

    Not shown: heads, scripts, styles, templates, ``hidden`` elements, ``display: none`` and ``visibility: hidden``
    (inline, and by the page's own style sheets: selectors of one tag, classes and ids, in rules for screens, the
    important, the more specific and the later one first), ruby parentheses, closed dialogs, the body of closed
    details and options that are not chosen. Embedded objects, frames, media and canvases have no text here. The text
    of drawings and formulas is shown. Selectors with combinators, attributes or states are not applied.

    Paragraphs, headings, lists and tables stand between empty lines, other blocks on lines of their own; list items
    have their mark and indent; preformatted text keeps its spaces; table cells are padded to their column, also
    across and down spans, and every column is aligned. How a part is laid out depends on that part alone, not on the
    page's length: an indent of over 256 columns is written as 32, a cell over 1,024 columns behind the one before it stands
    two spaces after it, and tables in more than 64 others are plain blocks. ``max_indent``, ``max_aligned``
    and ``max_tables`` set such limits outright, as high as a caller wants. No text is left out for any of that. A span that is no number is 1.

    A null page gives null, an empty page or one without visible text the empty text, a very long or deep one all of
    its text. Each row stands alone, so repeated rows give equal texts; an empty table gives no rows; a column
    ``<out_col>`` is replaced, others stay.
    """
    tune(pages.sparkSession)
    limits = {"max_indent": max_indent, "max_aligned": max_aligned, "max_tables": max_tables}
    return pages.withColumn(out_col, renderer(**limits)(F.col(html_col)))
