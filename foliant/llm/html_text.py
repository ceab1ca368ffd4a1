"""The visible text of web pages, laid out.

A tree builder reads tags, supplies the end tags that HTML implies (a paragraph ends at the next block, a list item at
the next one, cells, rows and their groups at the next of their kind) and ignores stray ones, so that elements nest.
The renderer follows the elements as they open and close: invisible ones (by element, ``hidden``, or a style of
display:none) give nothing, and text under visibility:hidden only shows where an inner style says visible; blocks
stand on their own lines, paragraphs, headings, lists and tables between blank lines; list items have a dash or their
number and are indented by depth, up to MAX_INDENT; the cells of a table stand in columns of equal width, as far as
MAX_COLUMN, and keep the lines of blocks and lists inside them; ``pre`` and ``textarea`` keep their white space; of a
``select`` that shows one option, the selected or else the first one is visible. Both work on a stack, in time in
proportion to the length of the page, whatever its depth.

Defined results: a null page gives null; an empty page, or one of text outside all elements, its text; what looks like
a tag but is none (as it never ends) is text; an unclosed comment or script reaches the end of the page; repeated rows
are each rendered; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.llm.common import small_batches

# Fixed values of HTML: classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style template noscript iframe object canvas audio video datalist title noembed noframes embed "
    "defs desc metadata symbol annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "caption ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre xmp figure hr".split())
PRE = frozenset("pre textarea xmp".split())
LISTS = frozenset("ul ol menu dir".split())
TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
#: A start tag ends the innermost open element of these, if none of the barriers is nearer.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "select": (frozenset(["select"]), frozenset(["td", "th", "caption"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
P_BARRIER = frozenset("td th caption button object table html".split())

MAX_INDENT = 60
MAX_COLUMN = 80
#: Cells further to the right follow the one before by two spaces.
MAX_OFFSET = 1000
#: Rows of a cell at most, as browsers have it; rowspan=0 stands for all that follow.
MAX_ROWS = 65_534
#: Tables within so many others are read row by row, a cell on a line.
MAX_TABLES = 20

NAME_END = re.compile(r"[\s/>]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
AS_BLOCK = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*(?:block|flex|grid|list-item|table)\s*(?:;|!|$)")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Tags:
    """The tags of a page from left to right, each found in time that adds up to the length of the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.marks = [m.start() for m in re.finditer("[>\"']", page)]
        self.ends: dict[int, int] = {}  # by mark: where a tag that meets it outside quotes ends, or -1
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.name = (0, -1)  # a stretch without the end of a name

    def _end(self, at: int) -> int:
        """The place of the first > outside quotes from there on, or -1."""
        met, found = [], -1
        while True:
            i = bisect_left(self.marks, at)
            if i == len(self.marks):
                break
            mark = self.marks[i]
            if mark in self.ends:
                found = self.ends[mark]
                break
            met.append(mark)
            sign = self.page[mark]
            if sign == ">":
                found = mark
                break
            if self.last_quote[sign] <= mark:
                break
            at = self.page.find(sign, mark + 1) + 1
        self.ends.update(dict.fromkeys(met, found))
        return found

    def _name_end(self, at: int) -> int:
        begin, end = self.name
        if not begin <= at < end:
            end = NAME_END.search(self.page, at).start()  # there is a > further on
            self.name = (at, end)
        return end

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """start, end, whether it is an end tag, name (empty: a comment or declaration), attributes."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            after = page[at + 1 : at + 2]
            if after in ("!", "?"):
                comment = page.startswith("<!--", at)
                end = page.find("-->", at + 4) if comment else page.find(">", at + 2)
                stop = len(page) if end < 0 else end + (3 if comment else 1)
                at = (yield at, stop, False, "", "") or stop
                continue
            closing = after == "/"
            first = page[at + 1 + closing : at + 2 + closing]
            if at < self.last and first.isascii() and first.isalpha():
                name_end = self._name_end(at + 1 + closing)
                end = self._end(name_end)
                if end >= 0:
                    name = page[at + 1 + closing : name_end]
                    at = (yield at, end + 1, closing, name.lower(), page[name_end:end]) or end + 1
                    continue
            at += 1


def events(page: str) -> Iterator[tuple[str, str, dict]]:
    """('open', tag, attributes), ('text', text, {}) and ('close', tag, {}), well nested."""
    stack: list[str] = []
    depths: dict[str, list[int]] = defaultdict(list)  # where each tag is on the stack

    def push(tag: str) -> None:
        depths[tag].append(len(stack))
        stack.append(tag)

    def close_to(depth: int) -> Iterator[tuple[str, str, dict]]:
        while len(stack) > depth:
            depths[stack[-1]].pop()
            yield "close", stack.pop(), {}

    def innermost(tags: frozenset, barriers: frozenset) -> int | None:
        place = max((depths[t][-1] for t in tags if depths[t]), default=-1)
        barrier = max((depths[t][-1] for t in barriers - tags if depths[t]), default=-1)
        return place if place > barrier else None

    at, tags = 0, iter(Tags(page))
    found = next(tags, None)
    while found:
        start, end, closing, tag, inside = found
        if start > at:
            yield "text", page[at:start], {}
        at, skip = end, None
        if tag and closing:
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            else:
                barriers = frozenset() if tag == "table" else frozenset(["table"])
                part = tag in TABLE_PARTS or tag == "table"
                place = innermost(frozenset([tag]), barriers if part else barriers | {"td", "th", "caption"})
                if place is not None:
                    yield from close_to(place)
        elif tag:
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(inside)}
            if tag in BLOCK or tag == "body":
                place = innermost(frozenset(["p"]), P_BARRIER)
                if place is not None:
                    yield from close_to(place)
            if tag in ENDS:
                place = innermost(*ENDS[tag])
                if place is not None:
                    yield from close_to(place)
            if tag in ("tr", "tbody", "thead", "tfoot"):  # what is left of a row or its group
                place = innermost(frozenset(["td", "th", "tr"]), frozenset(["table", "tbody", "thead", "tfoot"]))
                if place is not None:
                    yield from close_to(place)
            yield "open", tag, attributes
            if tag in VOID or inside.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                yield "close", tag, {}
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                yield "text", page[at : stop.start() if stop else len(page)], {}
                yield "close", tag, {}
                at = page.find(">", stop.start()) + 1 if stop else len(page)
                skip = at = at or len(page)
            else:
                push(tag)
        try:
            found = tags.send(skip)
        except StopIteration:
            break
    if at < len(page):
        yield "text", page[at:], {}
    yield from close_to(0)


class Flow:
    """Lines of text that grow: spaces collapse, line breaks and blank lines are asked for and come before text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.asked = 0  # line breaks before the next text
        self.space = False
        self.marker = ""
        self.indent = ""

    def breaks(self, n: int) -> None:
        self.asked = max(self.asked, n)
        self.space = False

    def line_break(self) -> None:
        self.asked = self.asked + 1 if self.asked else 1
        self.space = False

    def _start(self) -> None:
        if self.asked and self.parts:
            self.parts.append("\n" * self.asked)
        if self.asked or not self.parts:
            self.parts.append(self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker)
            self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.asked, self.space = 0, False

    def text(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        core = words.strip(" ")
        if not core:
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._start()
        self.parts.append(core)
        self.space = words[-1] == " "

    def lines(self, lines: list[str]) -> None:
        """Whole lines, as they are."""
        for line in lines:
            self._start()
            self.parts.append(line)
            self.asked = 1

    def done(self) -> str:
        return "".join(self.parts)


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, str, int]]]:
    """(column, text, columns) of each cell of (text, columns, rows): a cell of several rows keeps its columns in them."""
    out, held = [], []
    for row in rows:
        at, i, cells, new = 0, 0, [], []
        for text, span, down in row:
            while i < len(held) and held[i][0] <= at:
                at = max(at, held[i][1])
                i += 1
            cells.append((at, text, span))
            if down > 1:
                new.append((at, at + span, down))
            at += span
        held = sorted((start, stop, left - 1) for start, stop, left in [*held, *new] if left > 1)
        out.append(cells)
    return out


def _table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells (text of one or more lines, columns, rows) in columns of equal width, two spaces apart, up to MAX_OFFSET."""
    placed, widths = _placed(rows), {}
    for row in placed:
        for at, text, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(max(map(len, text.split("\n"))), MAX_COLUMN))
    offsets, offset, last = {}, 0, 0
    for at in sorted({at for row in placed for at, _, _ in row} | set(widths)):
        offset = min(offset + 2 * (at - last), MAX_OFFSET)
        offsets[at] = offset
        offset, last = min(offset + widths.get(at, 0), MAX_OFFSET), at
    lines = []
    for row in placed:
        cells = [(offsets[at], text.split("\n")) for at, text, _ in row if text]
        i = 0
        while cells:  # a cell takes part in as many lines as it has
            line = ""
            for at, cell in cells:
                line = (line.ljust(at - 2) + "  " if line else " " * at) + cell[i]
            lines.append(line)
            i += 1
            cells = [(at, cell) for at, cell in cells if len(cell) > i]
    return lines


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    flows, lists, tables, selects, marks = [Flow()], [], [], [], []
    hidden = pre = 0
    seen, opened = True, False
    for what, value, attributes in events(page):
        flow = flows[-1]
        fresh, opened = opened, what == "open" and value in PRE
        if what == "text":
            if hidden or not seen:
                continue
            text = html.unescape(value)
            if tables and tables[-1]["cell"] is None and not text.strip():
                continue
            if selects and not selects[-1]["inside"]:
                continue
            if tables and tables[-1]["cell"] is None:
                flow.breaks(1)  # text of a table itself stands before the table
            if pre:
                if fresh:  # a line break right after the tag isn't shown
                    text = re.sub(r"\A\r?\n", "", text)
                first, *rest = text.expandtabs(8).replace("\r\n", "\n").split("\n")
                if first:
                    flow.lines([first])
                    flow.asked = 0
                for line in rest:
                    flow.line_break()
                    if line:
                        flow.lines([line])
                        flow.asked = 0
            else:
                flow.text(text)
        elif what == "open":
            style = attributes.get("style", "")
            unseen = value in HIDDEN or "hidden" in attributes or bool(NO_DISPLAY.search(style))
            unseen = unseen or value == "input" or value == "dialog" and "open" not in attributes
            block = value not in BLOCK and bool(AS_BLOCK.search(style))
            marks.append((unseen, flow.indent, seen, block))
            hidden += unseen
            if hidden:
                continue
            visibility = VISIBILITY.findall(style)
            if visibility:
                seen = visibility[-1].lower() == "visible"
            if block:
                flow.breaks(1)
            if value == "br":
                flow.line_break()
            elif value in BLOCK:
                flow.breaks(2 if value in SPACED and not (value in LISTS and lists) else 1)
            if value in LISTS:
                start = attributes.get("start", "1")
                lists.append([value, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif value == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if re.fullmatch(r"-?[0-9]{1,9}", attributes.get("value", "")):
                    kind[1] = int(attributes["value"])
                flow.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent = (flow.indent + " " * len(flow.marker))[:MAX_INDENT]
            elif value in ("dd", "blockquote"):
                flow.indent = (flow.indent + "  ")[:MAX_INDENT]
            elif value in PRE:
                pre += 1
            elif value == "select":
                size = attributes.get("size", "1")
                one = "multiple" not in attributes and not re.fullmatch(r"[1-9][0-9]+|[2-9]", size)
                selects.append({"one": one, "shown": None, "inside": False, "selected": False})
            elif value == "option" and selects and not selects[-1]["inside"]:
                selects[-1] |= {"inside": True, "chosen": "selected" in attributes}
                flows.append(Flow())
            elif value == "table":
                deep = len(tables) >= MAX_TABLES
                tables.append({"rows": [], "cell": (1, 1) if deep else None, "depth": len(flows), "lists": lists, "pre": pre})
                lists, pre = [], 0
            elif value in ("tr", "td", "th") and len(tables) > MAX_TABLES:
                flow.breaks(1)
            elif value == "tr" and tables and tables[-1]["cell"] is None:
                tables[-1]["rows"].append([])
            elif value in ("td", "th") and tables and tables[-1]["cell"] is None:
                span, down = attributes.get("colspan", "1"), attributes.get("rowspan", "1")
                tables[-1]["cell"] = (
                    int(span) if re.fullmatch(r"[1-9][0-9]{0,2}", span) else 1,
                    MAX_ROWS if down == "0" else min(int(down), MAX_ROWS) if re.fullmatch(r"[1-9][0-9]{0,8}", down) else 1,
                )
                tables[-1]["depth"] = len(flows)
                flows.append(Flow())
        else:
            unseen, indent, before, block = marks.pop()
            if not hidden:
                if value in ("td", "th") and tables and tables[-1]["cell"] is not None and len(flows) > tables[-1]["depth"]:
                    inside = [line.rstrip() for line in flows.pop().done().split("\n")]
                    text = "\n".join([line for line in inside if line])
                    if not tables[-1]["rows"]:
                        tables[-1]["rows"].append([])
                    tables[-1]["rows"][-1].append((text, *tables[-1]["cell"]))
                    tables[-1]["cell"] = None
                    flow = flows[-1]
                elif value == "table" and tables:
                    table = tables.pop()
                    lists, pre = table["lists"], table["pre"]
                    flow.breaks(1)  # after text that stands in the table itself
                    flow.lines(_table_lines(table["rows"]))
                elif value == "option" and selects and selects[-1]["inside"]:
                    select = selects[-1]
                    text = flows.pop().done()
                    flow, select["inside"] = flows[-1], False
                    if not select["one"]:
                        flow.breaks(1)
                        flow.text(text)
                        flow.breaks(1)
                    elif select["shown"] is None or select["chosen"] and not select["selected"]:
                        select["shown"], select["selected"] = text, select["chosen"]
                elif value == "select" and selects:
                    flow.text(selects.pop()["shown"] or "")
                elif value in LISTS and lists:
                    lists.pop()
                elif value in PRE:
                    pre -= 1
                if block:
                    flow.breaks(1)
                if value in BLOCK:
                    if value == "li":
                        flow.marker = ""
                    flow.indent = indent
                    flow.breaks(2 if value in SPACED and not (value in LISTS and lists) else 1)
                seen = before
            hidden -= unseen
    return flows[0].done()


@F.pandas_udf(StringType())
def rendered(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([render(page) for page in batch], dtype=object)


def visible_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, text."""
    return small_batches(pages).select(F.col(id_col).alias("page_id"), rendered(F.col(html_col)).alias("text"))
