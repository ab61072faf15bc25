"""Layout-aware rendering of HTML to text.

A tree builder keeps the stack of open elements; start tags close what they imply (a block closes an open paragraph, an
item its sibling, a cell or row the one before), end tags close what is open inside. Elements that are not shown are
left out: head, scripts, styles and the like, what stands in place of scripts, objects and media that a browser would run,
dialogs that are not open, and anything with the attribute hidden or with display:none in its own style. Attributes are
read as names and values, so a word inside a value hides nothing, nor does aria-hidden, which speaks to readers aloud
only; buttons made by input show their value. They stand on the same stack, so that what ends a shown element ends them too; a head also ends at the first text
or element that is none of its own. Under visibility:hidden text is left out but keeps its place, up to an element that is
visible again. Rules of style sheets are not applied. Visible text is emitted as laid out: inline white space collapses,
blocks stand on lines of their own with blank lines around paragraphs and headings, list items get a bullet or their
number and an indent, preformatted text keeps its lines, options stand on a line each, and the cells of a table are padded
to aligned columns, which cells may span; wide characters count as two.

Defined cases: null or empty html gives empty text; markup that never closes is closed at the end; a `<` that starts no
tag is text; nesting may be of any depth (no recursion) and attributes of any length. A quoted value that never closes
ends with its tag, at the next `>`; a tag cut off by the page's end inside a quoted value is closed there. Whole pages are rendered. Indentation and padding are
bounded (INDENT, PAD, LINE), so the text is in proportion to the page.
Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by how they are laid out (fixed values of HTML).
UNSEEN = frozenset("head script style template noscript iframe object embed svg math canvas audio video datalist title meta link".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center details dd div dt dialog fieldset figcaption footer form header hgroup html legend li main nav option optgroup section select textarea summary caption tr thead tbody tfoot td th".split())
#: What may stand in a head without ending it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
#: What implied end tags do not reach out of; those of a paragraph.
_WALLS = frozenset("template object select foreignobject".split())
_SCOPE = _WALLS | {"table", "td", "th", "li", "div", "button"}
#: What a start tag closes, up to the nearest of the elements after it.
CLOSES = {
    "li": ({"li"}, _WALLS | {"ul", "ol", "table"}), "dt": ({"dt", "dd"}, _WALLS | {"dl", "table"}), "dd": ({"dt", "dd"}, _WALLS | {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}), "th": ({"td", "th"}, {"tr", "table", "template"}), "tr": ({"tr"}, {"table", "template"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table", "template"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table", "template"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table", "template"}),
    "option": ({"option"}, {"select"}),
}
_PLACE = {"td": "tr", "th": "tr", "tr": "table"}
#: A quote opens a value only after `=`; one that never closes is a character like others. The last group is empty where
#: no `>` outside of values follows. Possessive throughout: one pass over a tag, whatever its length.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+|["'])*+)(>?)""", re.S)
#: For the rest of a page in which a tag was found without an end: every tag ends at the next `>`.
_PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?)""", re.S)
_OPENED = re.compile(r"""=\s*["']""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_PAIR = re.compile(r"""([^\s"'>/=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+|["'/=]""")
_DECLARED = re.compile(r"""(?:^|[;{])\s*([a-z-]+)\s*:\s*([a-z-]+)""")
_QUOTES = re.compile(r"""\([^()]*\)|"[^"]*"|'[^']*'|/\*.*?\*/""", re.S)
#: The greatest spans that HTML has (fixed values).
MOST_SPAN = {"col": 1000, "row": 65534}


def _attributes(raw: str) -> dict[str, str]:
    """Values by name, the first of each name; entities are resolved."""
    out: dict[str, str] = {}
    for m in _PAIR.finditer(raw):
        if m[1]:
            value = m[2] or m[3] or m[4] or ""
            out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def _declared(style: str) -> dict[str, str]:
    """Keyword of each property of an inline style, the last of each; quoted text and arguments are not looked at."""
    return dict(_DECLARED.findall(_QUOTES.sub("", style).lower()))


def _number(text: str | None) -> int | None:
    m = re.match(r"\s*(-?[0-9]{1,9})", text or "")
    return int(m[1]) if m else None


#: Indentation stops to grow at so many columns. A table's line is aligned if its cells stand within LINE columns or
#: within PAD times their text.
INDENT, PAD, LINE = 64, 8, 256


class _Out:
    """Lines of text under construction."""

    __slots__ = ("lines", "line", "gap", "space")

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], [], 0, False

    def end_line(self):
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False

    def block(self, gap: int):
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, text: str, lead: str):
        if not self.line:
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            self.line.append(lead)
        self.line.append(text)

    def text(self) -> str:
        self.end_line()
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def _width(text: str) -> int:
    """Columns of a terminal: two for wide characters, none for those that combine."""
    return len(text) if text.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _table(rows: list[list[tuple]]) -> list[str]:
    """Rows of cells (text, columns, rows that it spans) as lines with aligned columns; a cell of several lines takes as
    many, and stands in the first row that it spans. A column in which no cell starts has no width. A line whose cells
    would stand more than PAD times their own text apart, and LINE columns, is not aligned."""
    placed, above = [], []  # above: (first column, end, rows left) of cells that still cover columns, in order
    for row in rows:
        at, line, k, new = 0, [], 0, []
        for text, span, down in row:
            while k < len(above) and above[k][0] <= at:
                at = max(at, above[k][1])
                k += 1
            line.append((at, at + span, text.split("\n")))
            if down > 1:
                new.append((at, at + span, down))
            at += span
        above = sorted((s, e, n - 1) for s, e, n in above + new if n > 1)
        placed.append(line)
    starts = sorted({at for line in placed for at, _, _ in line})
    width = [0] * len(starts)
    place = {at: i for i, at in enumerate(starts)}
    covers = lambda at, end: (place[at], bisect_left(starts, end))
    wide = []
    for line in placed:
        for at, end, lines in line:
            i, j = covers(at, end)
            if j - i == 1:
                width[i] = max(width[i], *map(_width, lines))
            else:
                wide.append((i, j, lines))
    for i, j, lines in wide:  # what does not fit widens its last column
        width[j - 1] += max(0, max(map(_width, lines)) - sum(width[i:j]) - 2 * (j - i - 1))
    start = [0, *accumulate(w + 2 for w in width)]
    out = []
    for line in placed:
        for k in range(max((len(c) for _, _, c in line), default=0)):
            cells = [(start[place[at]], c[k]) for at, _, c in line if k < len(c) and c[k]]
            own = sum(_width(c) for _, c in cells)
            if cells and cells[-1][0] > max(LINE, PAD * own):
                out.append("  ".join(c for _, c in cells).rstrip())
                continue
            text, used = [], 0
            for at, c in cells:
                text.append(" " * (at - used) + c)
                used = at + _width(c)
            out.append("".join(text).rstrip())
    return out


def render(html: str | None) -> str:
    html = html or ""
    outs, stack = [_Out()], []  # stack: [tag, lead, extra, unseen, visible]; extra holds a table's or a row's cells, or a cell's spans
    at, pre, lead, unseen, visible = 0, 0, "", 0, True  # unseen: elements on the stack that are not shown, all above those that are
    places: dict[str, list[int]] = {}  # of the open elements of a tag in the stack
    lists: list[list] = []

    def close() -> None:
        nonlocal pre, lead, unseen, visible
        tag, before, extra, gone, visible = stack.pop()
        places[tag].pop()
        if gone:
            unseen -= 1
            return
        if tag in ("td", "th"):
            cell = outs.pop().text()
            if places.get("tr"):
                stack[places["tr"][-1]][2].append((cell, *extra))
        elif tag == "tr":
            if places.get("table"):
                stack[places["table"][-1]][2].append(extra)
        elif tag == "table":
            lead = before
            outs[-1].block(1)
            for line in _table(extra):
                outs[-1].put(line, lead)
                outs[-1].end_line()
            outs[-1].block(1)
        elif tag in ("ul", "ol"):
            lists.pop()
            outs[-1].block(0 if lists else 1)
        elif tag == "pre":
            pre -= 1
            outs[-1].block(1)
        elif tag in BLOCK:
            outs[-1].block(1 if tag in PARAGRAPH else 0)
        lead = before

    def emit(text: str) -> None:
        if not visible:
            return
        out = outs[-1]
        if pre:
            for i, line in enumerate(text.split("\n")):
                if i:
                    if not out.line:
                        out.put("", lead)
                    out.end_line()
                if line:
                    out.put(line, lead)
            return
        words = _SPACE.sub(" ", text)
        body = words.strip(" ")
        if not body:
            out.space = out.space or bool(out.line and words)
            return
        if out.line and (out.space or words[0] == " "):
            body = " " + body
        out.put(body, lead)
        out.space = words[-1] == " "

    def push(tag: str, before: str, extra: list | None, gone: bool, was_visible: bool) -> None:
        nonlocal unseen
        places.setdefault(tag, []).append(len(stack))
        stack.append([tag, before, extra, gone, was_visible])
        unseen += gone

    def open_until(wanted: set, limit: set) -> int:
        """Place in the stack of the nearest wanted element inside limit, or -1."""
        nearest = lambda tags: max((places[x][-1] for x in tags if places.get(x)), default=-1)
        found = nearest(wanted)
        return found if found >= 0 and found >= nearest(limit) else -1

    def hides(have: dict[str, str] | str) -> bool:
        have = _attributes(have) if isinstance(have, str) else have
        return "hidden" in have or "style" in have and _declared(have["style"]).get("display") == "none"

    end, pattern = len(html), _TAG
    while at < end:
        m = pattern.search(html, at)
        if m and m[2] and not m[4]:
            if html.find(">", m.end(2)) >= 0:  # all that follow are in values
                pattern = _PLAIN
                m = pattern.search(html, at)
            elif not _OPENED.search(m[3]):
                m = None
        text = html[at : m.start() if m else end]
        if text and unseen and stack[-1][0] == "head" and text.strip(" \t\n\r\f"):
            close()
        if text and not unseen:
            emit(unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if not closing and unseen and stack[-1][0] == "head" and tag not in HEAD:
            close()
        if not closing and tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            raw, at = html[at : stop.start() if stop else end], stop.end() if stop else end
            if tag in ("xmp", "textarea") and not unseen and not hides(m[3]):
                outs[-1].block(0)
                pre += 1
                emit(raw if tag == "xmp" else unescape(raw))
                pre -= 1
                outs[-1].block(0)
            continue
        if closing:
            if tag == "p" and open_until({"p"}, {"table", "td", "th"}) < 0:
                if not unseen:
                    outs[-1].block(1)
                continue
            k = open_until({tag}, set() if tag == "table" else {"table"} if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot") else set())
            while k >= 0 and len(stack) > k:
                close()
            continue
        have = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        own = tag in UNSEEN or bool(have) and hides(have) or tag == "dialog" and "open" not in have
        if m[3].endswith("/") and (own and not unseen or tag in ("svg", "math") or places.get("svg") or places.get("math")):
            continue
        if tag in ("head", "html") and unseen:
            continue  # only the first counts
        if (tag in BLOCK or tag in ("dialog", "hr")) and (k := open_until({"p"}, _SCOPE)) >= 0:
            while len(stack) > k:
                close()
        if tag == "input" and not unseen and not (have and hides(have)) and have.get("type", "").strip().lower() in ("submit", "reset", "button"):
            emit(have.get("value", ""))
            continue
        if tag in VOID and (own or unseen):
            continue
        if tag == "br":
            if not outs[-1].line:
                outs[-1].put("", lead)
            outs[-1].end_line()
            continue
        if tag in VOID:
            if tag == "hr":
                outs[-1].block(1)
            elif tag == "img":
                emit(have.get("alt", ""))
            continue
        if tag in CLOSES and (k := open_until(*CLOSES[tag])) >= 0:
            while len(stack) > k:
                close()
        if tag in _PLACE and open_until({_PLACE[tag]}, {"table"} if tag != "tr" else set()) < 0:
            if open_until({"table"}, set()) < 0:
                continue  # a stray cell or row outside a table
            push("tr", lead, [], unseen > 0, visible)
        extra, before, was_visible = None, lead, visible
        gone = own or unseen > 0
        if "style" in have and (veil := _declared(have["style"]).get("visibility")) in ("hidden", "collapse", "visible"):
            visible = veil == "visible"
        if gone:
            pass
        elif tag in ("td", "th"):
            outs.append(_Out())
            lead = ""
            extra = [max(1, min(_number(have.get(f"{k}span")) or 1, most)) for k, most in MOST_SPAN.items()]
        elif tag in ("table", "tr"):
            if tag == "table":
                outs[-1].block(1)
            extra = []
        elif tag in ("ul", "ol"):
            outs[-1].block(0 if lists else 1)
            start = _number(have.get("start"))
            lists.append([1 if start is None else start] if tag == "ol" else [None])
        elif tag == "li":
            outs[-1].block(0)
            mark = "- "
            if lists and lists[-1][0] is not None:
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            if visible:
                outs[-1].put(mark, lead)
            lead += " " * len(mark) if len(lead) < INDENT else ""
        elif tag in BLOCK:
            if not (stack and stack[-1][0] == "li" and outs[-1].line and outs[-1].line[-1][-2:] in ("- ", ". ")):
                outs[-1].block(1 if tag in PARAGRAPH else 0)
            if tag == "pre":
                pre += 1
            elif tag in ("blockquote", "dd"):
                lead += "" if len(lead) >= INDENT else "    " if tag == "dd" else "> "
        push(tag, before, extra, gone, was_visible)
    while stack:
        close()
    return outs[0].text()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) for every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x.as_py()) for x in part.column(1)], pa.string())], [id_col, "text"])

    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")
