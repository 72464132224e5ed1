"""Visible text of HTML pages, laid out: blocks on lines of their own, lists with bullets and numbers, table cells in columns.

A tree is built from the page's tags, with the ends that HTML implies (a block ends an open paragraph, an item the item
before it, a cell the cell before it, and so on). Elements that a browser does not show are left out: head, scripts,
styles, templates, hidden attributes, display:none and visibility:hidden, closed details and dialogs, unchosen options.
What is visible again inside a hidden element is shown. Attributes decide alone: rules in ``<style>`` elements or linked
sheets are not applied. Nothing else is left out: menus and footers are visible text too.

Pages are cut into tags and texts in one pass that never goes back, so broken markup costs no more than its length. What
stands behind the beginning of a tag or comment that never ends is no text, as in a browser.

White space collapses as on screen, outside preformatted text; non-breaking spaces become spaces. A null or empty page has
an empty text; broken markup of any kind gives the text that is there; tags nested deeper than ``DEEPEST`` levels are read
as if they stood at that level. Equal pages give equal rows. A column named like the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shardloom.llm.batches import map_batches, without

DEEPEST = 150
# Columns are padded up to this width; a longer cell pushes its row aside.
WIDEST = 60

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Shown as blocks; those in GAP have a blank line around them.
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption"
).split())
GAP = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
UNSEEN = frozenset((
    "head script style template noscript title meta link base audio video canvas iframe object datalist noembed noframes param "
    "source track rp area map"
).split())
# A start tag ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("body html li dd dt option optgroup caption legend summary".split())
# A start tag ends these open elements, up to the nearest of the elements that bound the search.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"]
ENDS["rp"] = ENDS["rt"]
# An end tag does not close anything beyond these.
WALLS = frozenset("table td th caption template".split())
IN_HEAD = frozenset("base link meta title style script template noscript head".split())

_NONE = re.compile(r"(^|;)\s*display\s*:\s*none\s*(!important)?\s*(;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!important)?\s*(?=;|$)", re.I)
_PRE = re.compile(r"(^|;)\s*white-space\s*:\s*(pre|pre-wrap|break-spaces)\s*(;|$)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Element | str] = []


# Elements whose content is text up to their own end tag; in the second group references are read.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("textarea title".split())

_TAG = re.compile(r"[a-zA-Z][^\t\n\r\f />]*")
_BETWEEN = re.compile(r"[\t\n\r\f /]*")
_ATTRIBUTE = re.compile(r"[^\t\n\r\f />][^\t\n\r\f />=]*")
_EQUALS = re.compile(r"[\t\n\r\f ]*=[\t\n\r\f ]*")
_BARE = re.compile(r"[^\t\n\r\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\r\f />])", re.I) for tag in RAW | RAW_WITH_REFERENCES}


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str | None]], bool, int]:
    """Attributes from ``at`` on, whether the tag closes itself, and where it ends; -1 if it does not."""
    found = []
    while True:
        place = _BETWEEN.match(page, at).end()
        if place >= len(page):
            return found, False, -1
        if page[place] == ">":
            return found, page[place - 1] == "/" and place > at, place + 1
        name = _ATTRIBUTE.match(page, place)
        at = name.end()
        equals = _EQUALS.match(page, at)
        if not equals:
            found.append((name[0].lower(), None))
            continue
        at = equals.end()
        quote = page[at : at + 1]
        if quote in ('"', "'"):
            end = page.find(quote, at + 1)
            if end < 0:
                return found, False, -1
            value, at = page[at + 1 : end], end + 1
        else:
            value = _BARE.match(page, at)[0]
            at += len(value)
        found.append((name[0].lower(), unescape(value)))


def read_tags(page: str, builder: TreeBuilder) -> None:
    """Hand the tags and texts of a page to the builder, in order."""
    at = text = 0  # where to look on, and where the text that is not handed over begins

    def hand(end: int) -> None:
        if end > text:
            builder.handle_data(unescape(page[text:end]))

    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        tag = _TAG.match(page, at + 1 + (after == "/"))
        if not tag and after not in ("!", "?", "/"):
            at += 1  # a sign like any other
            continue
        hand(at)
        if not tag:
            if page.startswith(("<!-->", "<!--->"), at):
                at = page.index(">", at) + 1
            elif page.startswith("<!--", at):
                end = _COMMENT_END.search(page, at + 4)
                at = end.end() if end else -1
            else:
                at = page.find(">", at) + 1 or -1
        else:
            attrs, slash, end = _attributes(page, tag.end())
            if end >= 0:
                name = tag[0].lower()
                if after == "/":
                    builder.handle_endtag(name)
                elif slash:
                    builder.handle_startendtag(name, attrs)
                else:
                    builder.handle_starttag(name, attrs)
                if after != "/" and name == "plaintext":
                    builder.handle_data(page[end:])
                    end = -1
                elif after != "/" and name in _RAW_END and not builder.foreign():
                    close = _RAW_END[name].search(page, end)
                    raw = page[end : close.start() if close else len(page)]
                    builder.handle_data(unescape(raw) if name in RAW_WITH_REFERENCES else raw)
                    end = close.start() if close else -1
            at = end
        if at < 0:
            return
        text = at
    at = len(page)
    hand(at)


class TreeBuilder:
    """Elements and texts of a page as a tree of bounded depth."""

    def __init__(self) -> None:
        self.root = Element("html", {})
        self.open = [self.root]
        self.tags: Counter[str] = Counter()  # how many of each tag are open, so that most searches need not begin

    def _cut(self, k: int) -> None:
        self.tags.subtract(e.tag for e in self.open[k:])
        del self.open[k:]

    def foreign(self) -> bool:
        return self.tags["svg"] > 0 or self.tags["math"] > 0

    def _close(self, ended: frozenset[str], walls: frozenset[str]) -> None:
        """Close the outermost open element of ``ended`` above the nearest wall."""
        if not any(self.tags[tag] for tag in ended):
            return
        cut = 0
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in walls:
                break
            if tag in ended:
                cut = k
        if cut:
            self._cut(cut)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            self.root.attrs = {**dict(attrs), **self.root.attrs}
            return
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in ENDS_PARAGRAPH:
            self._close(frozenset(["p"]), WALLS)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._cut(-1)
        if tag not in IN_HEAD and tag != "body":
            self._close(frozenset(["head"]), frozenset())
        element = Element(tag, dict(attrs))
        self.open[-1].children.append(element)
        # What is not shown is not laid out either, so it may be deeper.
        if tag not in VOID and (len(self.open) != DEEPEST or not shown(element)):
            self.open.append(element)
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # Only void elements and foreign ones close themselves; elsewhere the slash means nothing.
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and self.foreign():
            self._cut(-1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return  # what follows belongs to the body all the same
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
            return
        for k in range(len(self.open) - 1, 0, -1) if self.tags[tag] else ():
            if self.open[k].tag == tag:
                self._cut(k)
                return
            if self.open[k].tag in WALLS and tag not in ("table", "tr", "thead", "tbody", "tfoot"):
                break
        if tag == "p":  # the end of a paragraph that was never begun is an empty one
            self.open[-1].children.append(Element("p", {}))

    def handle_data(self, data: str) -> None:
        if not data:
            return
        if self.open[-1].tag == "head" and data.strip():
            self._cut(-1)
        self.open[-1].children.append(data)


class Lines:
    """Lines of a block under construction; gaps between blocks do not add up."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.blank = True  # the line so far ends in white space or is empty

    def text(self, value: str, pre: bool) -> None:
        if pre:
            first, *rest = value.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.newline()
                self._add(line)
            return
        value = _SPACES.sub(" ", value)
        if self.blank:
            value = value.removeprefix(" ")
        if value:
            self._add(value)
            self.blank = value[-1] == " "

    def _add(self, value: str) -> None:
        if not value:
            return
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.now.append(value)
        self.blank = False

    def newline(self) -> None:
        """A forced line break."""
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.blank = [], True

    def edge(self, gap: int) -> None:
        """The border of a block: what follows starts on a new line, after ``gap - 1`` blank ones at least."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.blank = True
        self.gap = max(self.gap, gap)

    def put(self, block: list[str], first: str = "", rest: str = "") -> None:
        """Lines of a finished block, indented."""
        for k, line in enumerate(block):
            self.edge(0)
            if line or (k == 0 and first):
                self._add((first if k == 0 else rest) + line)
            else:
                self.newline()
        self.edge(1)

    def finish(self) -> list[str]:
        self.edge(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def shown(element: Element) -> bool:
    attrs = element.attrs
    if element.tag in UNSEEN or "hidden" in attrs or (element.tag == "dialog" and "open" not in attrs):
        return False
    if element.tag == "input" and (attrs.get("type") or "text").lower() in ("hidden", "checkbox", "radio", "image", "file", "color", "range", "password"):
        return False
    style = attrs.get("style")
    return not (style and _NONE.search(style)) and (seen(element, True) or _reveals(element))


def seen(element: Element, before: bool) -> bool:
    """Whether the text of an element is visible, given that of the element around it."""
    style = element.attrs.get("style")
    said = _VISIBILITY.findall(style) if style else None
    return said[-1].lower() == "visible" if said else before


def _reveals(element: Element) -> bool:
    """Whether something inside a hidden element is visible again."""
    held = [element]
    while held:
        for child in held.pop().children:
            if isinstance(child, Element):
                if seen(child, False):
                    return True
                held.append(child)
    return False


def _number(value: str | None, default: int) -> int:
    """An integer as HTML reads it; beyond 32 bits it is none."""
    found = re.match(r"[ \t\n\r\f]*([+-]?)0*(\d{1,11})", value or "")
    number = int(found[1] + found[2]) if found else default
    return number if abs(number) < 2**31 else default


def flow(element: Element, out: Lines, pre: bool = False, visible: bool = True) -> None:
    """Lay out the children of ``element``."""
    visible = seen(element, visible)
    children = element.children
    if element.tag == "details" and "open" not in element.attrs:
        children = [c for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
    elif element.tag == "select":
        children = _chosen(element)
    item = _number(element.attrs.get("start"), 1)
    for child in children:
        if isinstance(child, str):
            if visible:
                out.text(child, pre)
            continue
        if not shown(child):
            continue
        tag = child.tag
        if tag == "br":
            if visible:
                out.newline()
        elif tag == "hr":
            out.edge(2)
        elif tag == "input":
            if seen(child, visible):
                out.text(child.attrs.get("value") or "", False)
        elif tag == "table":
            out.edge(2)
            out.put(table_lines(child, visible))
            out.edge(2)
        elif tag == "li":
            number = element.tag == "ol"
            item = _number(child.attrs.get("value"), item)
            mark = (f"{item}. " if number else "- ") if seen(child, visible) else ""
            item += -1 if "reversed" in element.attrs else 1
            out.edge(1)
            out.put(_block(child, pre, visible), mark, " " * len(mark))
        elif tag in ("blockquote", "dd"):
            out.edge(2 if tag in GAP else 1)
            out.put(_block(child, pre, visible), "  ", "  ")
            out.edge(2 if tag in GAP else 1)
        elif tag in BLOCK or tag in ("tr", "tbody", "thead", "tfoot", "td", "th"):
            # A list inside an item stands close to it.
            gap = 2 if tag in GAP and not (tag in ("ul", "ol", "menu", "dir") and element.tag == "li") else 1
            out.edge(gap)
            flow(child, out, pre or tag == "pre" or _keeps_space(child), visible)
            out.edge(gap)
        else:
            flow(child, out, pre or tag == "textarea" or _keeps_space(child), visible)


def _keeps_space(element: Element) -> bool:
    style = element.attrs.get("style")
    return bool(style and _PRE.search(style))


def _block(element: Element, pre: bool, visible: bool = True) -> list[str]:
    inner = Lines()
    flow(element, inner, pre or _keeps_space(element), visible)
    return inner.finish()


def _chosen(select: Element) -> list[Element | str]:
    """The options a closed list shows: the chosen ones, or the first."""
    options: list[Element] = []
    held = [select]
    while held:
        element = held.pop()
        if element.tag == "option":
            options.append(element)
        held += [c for c in reversed(element.children) if isinstance(c, Element)]
    marked = [o for o in options if "selected" in o.attrs]
    if "multiple" in select.attrs:
        return list(options)
    return list((marked[-1:] or options[:1]))


def table_lines(table: Element, visible: bool = True) -> list[str]:
    """Rows as lines with cells in columns; spans take the columns and rows they say, longer cells break the alignment."""
    before: list[str] = []
    rows: list[list[tuple[Element, bool]]] = []
    visible = seen(table, visible)
    held: list[tuple[Element | str, bool]] = [(c, visible) for c in reversed(table.children)]
    loose: list[Element | str] = []
    while held:
        child, here = held.pop()
        if isinstance(child, str):
            loose += [child] * here
        elif not shown(child):
            continue
        elif child.tag == "caption":
            before += _block(child, False, here)
        elif child.tag in ("thead", "tbody", "tfoot"):
            held += [(c, seen(child, here)) for c in reversed(child.children)]
        elif child.tag == "tr":
            row = seen(child, here)
            cells = [(c, row) for c in child.children if isinstance(c, Element) and c.tag in ("td", "th") and shown(c)]
            loose += [c for c in child.children if (isinstance(c, str) and row) or (isinstance(c, Element) and c.tag not in ("td", "th"))]
            rows.append(cells)
        elif child.tag in ("td", "th"):
            rows.append([(child, here)])
        elif child.tag not in ("colgroup", "col"):
            loose.append(child)
    # Text that stands in a table outside its cells is shown before it.
    stray = Element("div", {})
    stray.children = loose
    before = _block(stray, False, visible) + before

    grid: list[dict[int, tuple[int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for cells in rows:
        line: dict[int, tuple[int, list[str]]] = {}
        column = 0
        covered = {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell, here in cells:
            while column in covered:
                column += 1
            wide = min(1000, max(1, _number(cell.attrs.get("colspan"), 1)))
            tall = min(65534, max(1, _number(cell.attrs.get("rowspan"), 1)))
            line[column] = wide, _block(cell, False, here)
            for c in range(column, column + wide):
                if tall > 1:
                    taken[c] = tall - 1
            column += wide
        grid.append(line)
    width: dict[int, int] = {}
    for line in grid:
        for column, (wide, block) in line.items():
            if wide == 1:
                width[column] = max(width.get(column, 0), min(WIDEST, max(map(len, block), default=0)))
    # Words of all columns before one, two signs between columns.
    columns = sorted(width)
    sums = [0, *accumulate(width[c] for c in columns)]
    out = before
    for line in grid:
        starts = {column: sums[bisect_left(columns, column)] + 2 * column for column in line}
        for k in range(max((len(block) for _, block in line.values()), default=0)):
            text, at = [], 0
            for column, (_, block) in sorted(line.items()):
                piece = block[k] if k < len(block) else ""
                if piece:
                    pad = max(starts[column] - at, 2 if text else 0)
                    text.append(" " * pad + piece)
                    at += pad + len(piece)
            out.append("".join(text).rstrip(" "))
    return out


def visible_text(page: str) -> str:
    builder = TreeBuilder()
    read_tags(page, builder)
    out = Lines()
    if shown(builder.root):
        flow(builder.root, out)
    return "\n".join(out.finish()).replace("\xa0", " ")


def extract_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page; row-local."""
    pages = without(pages, [name])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in pages.schema.fields] + [T.StructField(name, T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(html).cast(pa.binary()).to_pylist()
            texts = [visible_text((page or b"").decode("utf-8", "replace")) for page in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return map_batches(pages, step, schema)
