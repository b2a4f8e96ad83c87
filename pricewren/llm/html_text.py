"""Text of HTML pages as a reader sees it.

A tolerant tree builder with implied end tags and a layout pass: hidden elements give nothing; blocks stand on lines of their own, with blank
lines where browsers leave a margin; list items get their bullet or number and are indented by depth; tables become columns aligned by the
widest cell; preformatted text keeps its white space; elsewhere runs of white space become one space.

A scanner of its own reads tags, so that time grows with the length of the page whatever it holds; open elements are found by tag, not by
search. Text is never cut, but layout has bounds, so that a page's text is not many times its own size: columns are padded while the spaces of
a page stay below PADDING of its length (then cells stand apart by two spaces), and marks of nested lists and quotes end at MARKS levels.

All visible text is kept, navigation and footers included, labels of drawings and formulas too, and what aria-hidden hides from screen readers
alone. Hidden are the elements of HIDDEN, those with the attribute hidden, type "hidden", or a style with display: none or visibility: hidden (visible children of the latter stay visible), and closed details but
for their summary.

Defined results: null and empty pages give an empty text; text outside of any tag is text; what is not closed ends with its parent; a tag or
comment that the page's end cuts off shows nothing; repeated rows are rows of their own, null ids stay null, no pages give no rows. Only
page_id, url and html are read, so other columns, of whatever name, don't matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist iframe object audio video canvas".split())
#: Hidden inside of svg and math.
HIDDEN_INSIDE = frozenset("title desc defs metadata annotation annotation-xml".split())
#: Elements of formulas whose parts stand apart, above each other or in cells.
APART = frozenset("mfrac msup msub msubsup munder mover munderover mroot mmultiscripts mtr mtable".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption".split())
MARGINS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table hr menu dir".split())
#: An element whose start tag ends an open element of one of these, unless one of the second stands in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What may stand in a head. Any other start tag, and text, ends a head that is still open.
IN_HEAD = frozenset("title meta link base basefont bgsound noframes script style noscript template head html".split())
#: Start tags of these end an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
INLINE = frozenset("a b big code em font i s small strike strong tt u span".split())
SCOPE = frozenset("table td th caption button html".split())
_SPACE = re.compile("[ \t\n\r\f]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
#: Spaces that pad the columns of a page's tables, by its length and in any case; levels of lists and quotes that are marked.
PADDING, PADDING_FREE, MARKS = 8, 20_000, 16
#: Columns that spans are followed in.
COLUMNS = 200
#: Deepest nesting that is kept; deeper elements, and what is in them, become children of the last one.
DEPTH = 200


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Deep(Node):
    """An open element beyond DEPTH: its children are the list that takes what it holds, one that nobody reads where that is hidden."""

    __slots__ = ("gone", "shown")

    def __init__(self, node: Node, above: Node, last: Node):
        super().__init__(node.tag, node.attrs)
        style = _style(node)
        inside, shown = (above.gone, above.shown) if isinstance(above, Deep) else (False, above.children)
        shut = above.tag == "details" and "open" not in above.attrs and isinstance(above, Deep)
        self.gone = inside or _gone(node, style) or shut and node.tag != "summary"
        self.shown = shown  # where text of this element would stand but for a closed details
        visibility = style.get("visibility")
        if visibility in ("hidden", "collapse"):
            self.shown = []
        elif visibility == "visible":
            wrapper = Node("span", {"style": "visibility: visible"})
            if not self.gone:
                last.children.append(wrapper)
            self.shown = wrapper.children
        self.children = [] if self.gone or node.tag == "details" and "open" not in node.attrs else self.shown


_NAME = re.compile("[a-zA-Z][^\\s/>]*")
_ATTRIBUTE = re.compile("[\\s/]*(?:(>)|([^\\s/>][^\\s/>=]*)(?:\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"'][^\\s>]*)|(?=>)|([\"'])))?)")
_COMMENT_END = re.compile("--!?>")
#: Elements whose content is text up to their own end tag, and those of them in which entities count.
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
ESCAPABLE = frozenset("title textarea".split())
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in RAW}


class TreeBuilder:
    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by tag

    def feed(self, html: str) -> None:
        """Read a page in one pass."""
        at, n = 0, len(html)
        while at < n:
            less = html.find("<", at)
            if less < 0:
                less = n
            if less > at:
                self.handle_data(unescape(html[at:less]))
            if less == n:
                return
            c = html[less + 1 : less + 2]
            if c.isascii() and c.isalpha():
                at = self._tag(html, less)
            elif c == "/" and html[less + 2 : less + 3].isascii() and html[less + 2 : less + 3].isalpha():
                name = _NAME.match(html, less + 2)
                at, _ = self._attributes(html, name.end())
                if at < n or html.endswith(">"):
                    self.handle_endtag(name[0].lower())
            elif html.startswith("<!--", less):
                if html.startswith((">", "->"), less + 4):
                    at = html.index(">", less + 4) + 1
                else:
                    end = _COMMENT_END.search(html, less + 4)
                    at = end.end() if end else n
            elif c and c in "!?/":
                if html.startswith("<![CDATA[", less) and self._foreign():
                    end = html.find("]]>", less)
                    self.handle_data(html[less + 9 : end if end >= 0 else n])
                    at = end + 3 if end >= 0 else n
                else:
                    end = html.find(">", less)
                    at = end + 1 if end >= 0 else n
            else:
                self.handle_data("<")
                at = less + 1

    def _attributes(self, html: str, at: int) -> tuple[int, list[tuple[str, str]]]:
        """The attributes from a place behind a tag's name on, and where the tag ends: the end of the page if it isn't closed."""
        found = []
        while (m := _ATTRIBUTE.match(html, at)) is not None:
            if m[1]:
                return m.end(), found
            if m[6]:
                return len(html), []  # a quote that isn't closed
            found.append((m[2].lower(), unescape(next((v for v in m.group(3, 4, 5) if v is not None), ""))))
            at = m.end()
        return len(html), []

    def _tag(self, html: str, less: int) -> int:
        name = _NAME.match(html, less + 1)
        tag = name[0].lower()
        at, attrs = self._attributes(html, name.end())
        if at == len(html) and not html.endswith(">"):
            return at
        closed = html[at - 2] == "/"
        if closed:
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
        if tag in RAW and not (closed and self._foreign()):
            end = _RAW_END[tag].search(html, at)
            text = html[at : end.start() if end else len(html)]
            if text:
                self.handle_data(unescape(text) if tag in ESCAPABLE else text)
            if end is None:
                return len(html)
            at = end.start()
        return at

    def _push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def _cut(self, i: int) -> None:
        """Close all from place i on."""
        for node in self.open[i:]:
            self.places[node.tag].pop()
        del self.open[i:]

    def _last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of these, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _foreign(self) -> bool:
        return self._last(("svg", "math")) > 0

    def _end(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of tags, with what is open inside, unless an element of stop comes first."""
        i = self._last(tags)
        if i and i >= self._last(stop):
            self._cut(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._cut(len(self.open) - 1)
        if tag in CLOSES:
            tags, stop = CLOSES[tag]
            before = None
            while before != len(self.open):  # a new row ends the cell and the row
                before = len(self.open)
                self._end(tags, stop)
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, SCOPE)
        if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
            self._cut(len(self.open) - 1)
        if tag == "html" and self.places["html"]:
            return
        node, above = Node(tag, dict(reversed(attrs)) if attrs else {}), self.open[-1]  # the first of two attributes counts
        if self._foreign():
            if tag in HIDDEN_INSIDE:
                node.attrs["hidden"] = ""
            elif tag == "text":  # each stands at a place of its own
                node.attrs["style"] = "display: block; " + node.attrs.get("style", "")
            if above.tag in APART and any(isinstance(c, Node) for c in above.children):
                above.children.append(" ")
        if tag in VOID or len(self.open) < DEPTH:
            above.children.append(node)
        if tag not in VOID:
            if len(self.open) < DEPTH:
                self._push(node)
            else:
                deep = Deep(node, above, self.open[DEPTH - 1])
                if not deep.gone:
                    deep.shown.append(node)
                self._push(deep)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._foreign() and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        before = len(self.open)
        self._close(tag)
        if DEPTH < before > len(self.open) and (tag in BLOCKS or tag in ("td", "th", "text")):
            self.open[-1].children.append(Node("div", {}))  # what follows stands on a line of its own

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag in ("html", "body") or tag in VOID:
            return
        elif tag == "p" and not self.places["p"]:
            self.handle_starttag("p", [])
            self.handle_endtag("p")
        elif tag == "table":
            self._end({tag}, {"html"})
        elif tag == "p" or tag in INLINE:
            self._end({tag}, SCOPE)
        else:
            self._end({tag}, {"table", "html"})

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    return builder.root


class _Lines:
    """Lines under construction: inline text with collapsed spaces, and breaks of at least so many line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = True  # at the start of a line or after a space
        self.space = False
        self.gap = 0

    def text(self, data: str, kept: bool = False) -> None:
        if kept:
            head, *rest = data.split("\n")
            self._put(head)
            for line in rest:
                self.line_end()
                self._put(line)
            return
        words = _SPACE.split(data)
        for i, w in enumerate(words):
            if i:
                self.space = not self.blank
            if w:
                self._put((" " if self.space else "") + w)

    def _put(self, s: str) -> None:
        if s:
            if self.gap and not self.parts:
                if self.lines:
                    self.lines += [""] * (self.gap - 1)
                self.gap = 0
            self.parts.append(s)
            self.blank, self.space = False, False

    def line_end(self) -> None:
        if self.gap and self.lines and not self.parts:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.lines.append("".join(self.parts).rstrip(" "))
        self.parts, self.blank, self.space = [], True, False

    def block(self, margin: bool) -> None:
        if self.parts:
            self.line_end()
        self.blank, self.space = True, False
        self.gap = max(self.gap, 2 if margin else 1)

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self._put(line)
            self.line_end()

    def done(self) -> list[str]:
        if self.parts:
            self.line_end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _style(node: Node) -> dict[str, str]:
    style = node.attrs.get("style")
    return {k.lower(): v.lower() for k, v in _STYLE.findall(style)} if style else {}


def _gone(node: Node, style: dict[str, str]) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or bool(a) and ("hidden" in a or node.tag == "input" and a.get("type") == "hidden" or style.get("display") == "none")


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(1000, max(1, int(value))) if value.isascii() and value.isdigit() else 1


class Layout:
    def __init__(self, spaces: int = PADDING_FREE):
        self.spaces = spaces  # what is left for padding
        self.marks = 0  # levels of lists and quotes around

    def render(self, node: Node) -> str:
        out = _Lines()
        self._children(node, out, False, True, 0)
        return "\n".join(out.done())

    def _children(self, node: Node, out: _Lines, kept: bool, visible: bool, depth: int) -> None:
        numbered = 0
        if node.tag == "ol":
            start = node.attrs.get("start", "1")
            numbered = int(start) - 1 if re.fullmatch("-?[0-9]{1,9}", start) else 0
        shut = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if visible and not shut:
                    out.text(child, kept)
                continue
            if shut and child.tag != "summary":
                continue
            if child.tag == "li":
                numbered += 1
            self._node(child, out, kept, visible, depth, numbered if node.tag == "ol" else 0)

    def _node(self, node: Node, out: _Lines, kept: bool, visible: bool, depth: int, number: int) -> None:
        style = _style(node)
        if _gone(node, style):
            return
        visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)
        tag = node.tag
        if tag == "br":
            out.line_end()
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            if visible and node.attrs.get("alt"):
                out.text(node.attrs["alt"])
        elif tag == "wbr" or tag == "input":
            if visible and tag == "input" and node.attrs.get("type", "") in ("submit", "button", "reset") and node.attrs.get("value"):
                out.text(node.attrs["value"])
        elif tag == "table":
            out.block(True)
            out.add(self._table(node, visible, depth))
            out.block(True)
        elif tag in ("li", "blockquote", "dd") or tag == "pre":
            inner = _Lines()
            self.marks += 1
            self._children(node, inner, kept or tag == "pre", visible, depth + 1)
            self.marks -= 1
            lines = inner.done()
            if tag == "pre" and lines and not lines[0]:
                lines = lines[1:]
            mark = (f"{number}. " if number else "- ") if tag == "li" else {"blockquote": "> ", "dd": "    "}.get(tag, "") if self.marks < MARKS else ""
            rest = " " * len(mark) if tag == "li" else mark
            out.block(tag in MARGINS)
            if visible or lines:
                out.add([(mark if i == 0 else rest) + x if x else "" for i, x in enumerate(lines)] if lines else [mark.rstrip()] if tag == "li" and visible else [])
            out.block(tag in MARGINS)
        elif tag in BLOCKS or style.get("display") == "block":
            margin = tag in MARGINS and not (tag in ("ul", "ol", "menu", "dir") and depth)
            out.block(margin)
            self._children(node, out, kept, visible, depth + (tag in ("ul", "ol", "menu", "dir")))
            out.block(margin)
        else:
            if tag == "option":
                out.block(False)
            self._children(node, out, kept, visible, depth)

    def _rows(self, node: Node, visible: bool, rows: list[tuple[Node, bool]], captions: list[Node]) -> None:
        loose: Node | None = None  # cells or text without a row
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    captions.append(Node("caption", {}))
                    captions[-1].children.append(child)
                continue
            style = _style(child)
            if _gone(child, style):
                continue
            shown = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)
            if child.tag in ("thead", "tbody", "tfoot"):
                self._rows(child, shown, rows, captions)
            elif child.tag == "tr":
                rows.append((child, shown))
                loose = None
            elif child.tag in ("td", "th"):
                if loose is None:
                    loose = Node("tr", {})
                    rows.append((loose, visible))
                loose.children.append(child)
            elif child.tag not in ("colgroup", "col"):
                captions.append(child)

    def _table(self, node: Node, visible: bool, depth: int) -> list[str]:
        rows: list[tuple[Node, bool]] = []
        captions: list[Node] = []
        self._rows(node, visible, rows, captions)
        grid: list[dict[int, tuple[list[str], int]]] = []
        taken: dict[int, int] = {}  # columns that a cell from above still covers, with the rows left
        for row, shown in rows:
            cells: dict[int, tuple[list[str], int]] = {}
            x = 0
            covered = {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in row.children:
                if isinstance(cell, str) and not cell.strip():
                    continue
                inner, wide, high = _Lines(), 1, 1
                if isinstance(cell, str):
                    if shown:
                        inner.text(cell)
                else:
                    style = _style(cell)
                    if _gone(cell, style):
                        continue
                    see = {"hidden": False, "visible": True}.get(style.get("visibility", ""), shown)
                    if cell.tag in ("td", "th"):
                        wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
                        self._children(cell, inner, False, see, depth + 1)
                    else:
                        self._node(cell, inner, False, see, depth + 1, 0)
                while x in taken:
                    x += 1
                wide = min(wide, max(1, COLUMNS - x))
                cells[x] = (inner.done(), wide)
                if high > 1 and x < COLUMNS:
                    covered.update({c: high - 1 for c in range(x, x + wide)})
                x += wide
            taken = covered
            grid.append(cells)
        out = _Lines()
        for c in captions:
            self._node(c, out, False, visible, depth, 0)
            out.block(False)
        text, rows_ = out.done(), [self._lines_of(cells) for cells in grid]
        widths: dict[int, int] = {}
        for cells in grid:
            for x, (lines, wide) in cells.items():
                if wide == 1:
                    widths[x] = max(widths.get(x, 0), max(map(len, lines), default=0))
        starts, at = {}, 0  # where columns begin
        for x in range(max((x for cells in grid for x in cells), default=0) + 1):
            starts[x] = at
            at += widths.get(x, 0) + 2
        padded = [[self._padded(parts, starts) for parts in lines] for lines in rows_] if self._spaces(rows_, starts) <= self.spaces else None
        if padded is None:
            return text + ["  ".join(t for _, t in parts) for lines in rows_ for parts in lines]
        self.spaces -= self._spaces(rows_, starts)
        return text + [line for lines in padded for line in lines]

    @staticmethod
    def _lines_of(cells: dict[int, tuple[list[str], int]]) -> list[list[tuple[int, str]]]:
        """A row's lines, each with the column and text of the cells that have such a line."""
        out, left, k = [], sorted((x, lines) for x, (lines, _) in cells.items() if lines), 0
        while left:
            out.append([(x, lines[k]) for x, lines in left if lines[k]])
            k += 1
            left = [(x, lines) for x, lines in left if len(lines) > k]
        return out

    @staticmethod
    def _spaces(rows: list[list[list[tuple[int, str]]]], starts: dict[int, int]) -> int:
        """About how many spaces padding takes."""
        return sum(max(0, starts[parts[-1][0]] - sum(len(t) for _, t in parts[:-1])) for lines in rows for parts in lines if parts)

    @staticmethod
    def _padded(parts: list[tuple[int, str]], starts: dict[int, int]) -> str:
        out, size = [], 0
        for x, t in parts:
            gap = max(starts[x] - size, 2 if size else 0)
            out += [" " * gap, t]
            size += gap + len(t)
        return "".join(out)


def visible_text(html: str | None) -> str:
    return Layout(PADDING_FREE + PADDING * len(html)).render(parse(html)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages(page_id, url, html)."""

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([visible_text(h) for h in part.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(render, "page_id long, url string, text string")
