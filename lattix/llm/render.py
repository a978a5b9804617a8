"""HTML to text as a layout shows it: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.shared import bounded

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[^\s/>=]=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
GAP = re.compile(r"[\s/]*")
# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p blockquote h1 h2 h3 h4 h5 h6 ul ol dl pre table figure".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption dd dt li legend summary".split()) | {"p"}
#: A start tag ends the nearest of these open elements, if none of the fences stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "tr"}, {"table"}),
    "body": ({"head"}, {"body"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
}
# Types of input whose value is seen, and the most that a cell may span.
SHOWN = frozenset("text search email url tel number date time month week submit button reset".split()) | {""}
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A table's columns are aligned up to the width at which its lines have room for so many times its text.
ROOMY = 16
#: Levels by which text moves in; what is nested deeper stands below the last.
INDENTS = 40
PROPERTY = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
NOTE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


class Node:
    """An element. ``met`` and ``above``: the beginnings of selectors that it, and that some element around it, answers to."""

    __slots__ = ("tag", "kids", "attrs", "up", "met", "above")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.kids, self.attrs, self.up = tag, [], attrs or {}, up
        self.met = self.above = frozenset()


def scan(html: str) -> Iterator[tuple]:
    """``(text,)``, ``(name, attributes, closed, end)`` and ``(None, name)`` for text, start and end tags, each character read once.

    As a browser does: a tag or comment that never ends hides the rest, and ``<`` before anything but a name is text.
    ``scan.send(position)`` goes on elsewhere, after text that holds no tags.
    """
    at, end = 0, len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            yield (html[at:],)
            return
        kind = html[start + 1 : start + 2]
        if not (kind in ("!", "?", "/") or kind.isascii() and kind.isalpha()) or html.startswith("</>", start):
            following = html.find("<", start + 1)
            following = end if following < 0 else following
            yield (html[at:following],)
            at = following
            continue
        if start > at:
            yield (html[at:start],)
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4) + 3
            if at < 3:
                return
            continue
        name = NAME.match(html, start + (2 if kind == "/" else 1))
        if kind in "!?/":
            at = html.find(">", start) + 1
            if name and kind == "/" and at:
                yield None, name[0].lower()
            if not at:
                return
            continue
        at, attrs = name.end(), {}
        while True:
            gap = GAP.match(html, at)
            at = gap.end()
            if at >= end:
                return
            if html[at] == ">":
                break
            key = ATTRIBUTE.match(html, at) or re.compile("=").match(html, at)
            at, value = key.end(), ""
            if equals := EQUALS.match(html, at):
                at = equals.end()
                if html[at : at + 1] in ("'", '"'):
                    shut = html.find(html[at], at + 1)
                    if shut < 0:
                        return
                    value, at = html[at + 1 : shut], shut + 1
                else:
                    found = UNQUOTED.match(html, at)
                    value, at = found[0], found.end()
            attrs.setdefault(key[0].lower(), unescape(value) if "&" in value else value)
        at += 1
        at = (yield name[0].lower(), attrs, html[at - 2] == "/", at) or at


def build(html: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets: tags that HTML lets authors leave out are implied, stray end tags are ignored."""
    root, styles = Node("html"), []
    stack, places = [root], {"html": [0]}  # places: where elements of a name stand in the stack

    def last(names) -> int:
        return max([places[n][-1] for n in names if places.get(n)], default=-1)

    def close(names, fences=()) -> bool:
        at = last(names)
        if at < 1 or at < last(fences):
            return False
        for node in stack[at:]:
            places[node.tag].pop()
        del stack[at:]
        return True

    tokens, resume = scan(html), None
    while True:
        try:
            token = tokens.send(resume)
        except StopIteration:
            return root, styles
        resume = None
        if len(token) == 1:
            stack[-1].kids.append(unescape(token[0]) if "&" in token[0] else token[0])
            continue
        if token[0] is None:
            name = token[1]
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name not in VOID:
                close({name}, () if name in ("table", "body", "html", "div") else {"table", "td", "th"} - {name})
            continue
        name, attrs, closed, after = token
        if name in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"})
        if name in IMPLIED:
            ends, fences = IMPLIED[name]
            while close(ends, fences):
                pass
        if name in ("html", "body") and places.get(name):
            continue
        node = Node(name, attrs, stack[-1])
        stack[-1].kids.append(node)
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, after)
            raw = html[after : shut.start() if shut else len(html)]
            if name == "style":
                styles.append(raw)
            node.kids.append(unescape(raw) if name in ("textarea", "title") else raw)
            resume = (html.find(">", shut.start()) + 1 or len(html)) if shut else len(html)
        elif name not in VOID and not closed:
            places.setdefault(name, []).append(len(stack))
            stack.append(node)


def rules(styles: list[str]) -> dict:
    """What style sheets say of display and visibility, by the name, class or id that a selector's last element has.

    Selectors of elements (``p.note#x``) within others (``.ad p``, ``div > p``) are read, others are not; rules within
    ``@media`` count for ``screen`` and ``all``. What stands before the last element is a path of steps, each numbered
    once; at ``None`` are the steps, by name, class or id too.
    """
    out, order, steps, numbers = {}, 0, {}, {}
    for css in styles:
        css, at, depth, skipped = NOTE.sub(" ", css), 0, 0, 0
        braces = list(re.finditer(r"[{}]", css))
        for brace, following in zip(braces, [*braces[1:], None]):
            head, at = css[at : brace.start()].strip(), brace.end()
            if brace[0] == "}":
                if skipped:
                    skipped -= 1
                elif depth:
                    depth -= 1
                continue
            if skipped or (head.startswith("@") and not re.fullmatch(r"@media\s+(only\s+)?(screen|all)", head.rpartition(";")[2].strip(), re.I)):
                skipped += 1
                continue
            if head.startswith("@"):
                depth += 1
                continue
            depth += 1
            found = PROPERTY.findall(css[at : following.start() if following else len(css)])
            for selector in head.rpartition(";")[2].split(",") if found else ():
                if (parsed := _selector(selector)) is None:
                    continue
                *around, (key, tag, marks, child) = parsed
                before = None
                for k, t, m, c in around:
                    step = (before, c, t, m)
                    if step not in numbers:
                        numbers[step] = len(numbers)
                        steps.setdefault(k, []).append((numbers[step], t, m, before, c))
                    before = numbers[step]
                every = [m for _, _, marked, _ in parsed for m in marked]
                weight = (sum(m[0] == "#" for m in every), sum(m[0] == "." for m in every), sum(t != "*" for _, t, _, _ in parsed))
                for name, value, important in found:
                    order += 1
                    out.setdefault(key, []).append((bool(important), weight, order, tag, marks, before, child, name.lower(), value.lower()))
    if steps:
        out[None] = steps
    return out


def _selector(text: str) -> list[tuple[str, str, frozenset, bool]] | None:
    """``(key, tag, marks, child)`` of each element of a selector, ``child`` if it stands right below the one before; None if it has anything else."""
    out, child = [], False
    for part in re.findall(r">|[^\s>]+", text):
        if part == ">":
            if child or not out:
                return None
            child = True
            continue
        simple = SIMPLE.fullmatch(part)
        if not simple:
            return None
        marks, tag = re.findall(r"[.#][\w-]+", simple[2]), (simple[1] or "*").lower()
        out.append((marks[-1] if marks else tag, tag, frozenset(marks), child))
        child = False
    return out if out and not child else None


def styled(node: Node, sheet: dict) -> dict[str, str]:
    """The display and visibility that style sheets and the element's own style give it. Elements around it come first."""
    if not sheet and "style" not in node.attrs:
        return {}
    own = {f".{c}" for c in node.attrs.get("class", "").split()} | ({"#" + node.attrs["id"]} if node.attrs.get("id") else set())
    up = node.up
    if (steps := sheet.get(None)) is not None:
        if up is not None:
            node.above = up.above | up.met if up.met - up.above else up.above
        met = [n for key in (*own, node.tag, "*") for n, tag, marks, before, child in steps.get(key, ()) if tag in ("*", node.tag) and marks <= own and _below(node, before, child)]
        node.met = frozenset(met)
    best: dict[str, tuple] = {}
    for key in (*own, node.tag, "*"):
        for important, weight, order, tag, marks, before, child, name, value in sheet.get(key, ()):
            if tag in ("*", node.tag) and marks <= own and _below(node, before, child):
                best[name] = max(best.get(name, ()), (important, weight, order, value))
    for n, (name, value, important) in enumerate(PROPERTY.findall(node.attrs.get("style", ""))):
        best[name.lower()] = max(best.get(name.lower(), ()), (bool(important), (10**9, 0, 0), n, value.lower()))
    return {k: v[3] for k, v in best.items()}


def _below(node: Node, before: int | None, child: bool) -> bool:
    """Whether what a selector asks of the elements around ``node`` holds."""
    return before is None or (before in node.up.met if child and node.up else not child and before in node.above)


def width(s: str) -> int:
    """Cells of a line: wide characters take two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines under way: inline text runs on, blocks start a line, spaced blocks leave a blank line between.

    ``prefix`` stands before each line, ``head`` in its place before the next one (a list's mark).
    """

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.prefix, self.head, self.level = "", None, 0

    def text(self, s: str, pre: bool):
        if pre:
            first, *more = s.split("\n")
            self.now.append(first)
            for part in more:
                self.turn(True)
                self.now.append(part)
        elif words := s.split():
            self.now.append((" " if s[:1].isspace() else "") + " ".join(words) + (" " if s[-1:].isspace() else ""))
        elif s:
            self.now.append(" ")

    def put(self, line: str):
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(((self.prefix if self.head is None else self.head) + line).rstrip() if line else "")
        self.head = None

    def turn(self, pre: bool = False):
        line = "".join(self.now)
        line = line.rstrip() if pre else re.sub(" {2,}", " ", line).strip()
        if line or (pre and self.now):
            self.put(line)
        self.now = []

    def enter(self, mark: str, first: bool):
        """Move in by a mark (``first``: that stands before the first line) and return what ``leave`` takes."""
        kept = self.prefix, self.head
        self.level += 1
        if self.level <= INDENTS:
            start = self.prefix if self.head is None else self.head
            self.head = start + mark if first else None if self.head is None else self.head + mark
            self.prefix += " " * len(mark)
        return kept

    def leave(self, kept):
        used = self.head is None
        self.level -= 1
        self.prefix, self.head = kept[0], None if used else kept[1]

    def done(self) -> list[str]:
        self.turn()
        return self.lines


def _run(work: Generator):
    """Generators that yield others and get their results: recursion without a limit of depth."""
    stack, result = [work], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as end:
            stack.pop()
            result = end.value
    return result


def _number(s: str | None, default: int) -> int:
    return int(s) if s is not None and re.fullmatch(r"\s*-?\d{1,9}\s*", s) else default


def _shown(node: Node, sheet, seen: bool) -> tuple[bool, bool]:
    """Whether an element has boxes at all, and whether its own text is visible."""
    style = styled(node, sheet)
    gone = node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)
    display = style.get("display", "none" if gone else "")
    gone = display == "none" or node.tag in ("script", "style", "head", "title", "template")
    visibility = style.get("visibility")
    return not gone, seen if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")


def _plain(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack.extend(reversed(n.kids))
    return " ".join("".join(out).split())


def _options(select: Node) -> list[Node]:
    out, stack = [], list(reversed(select.kids))
    while stack:
        n = stack.pop()
        if not isinstance(n, str):
            out += [n] if n.tag == "option" else []
            stack.extend(reversed(n.kids) if n.tag == "optgroup" else ())
    return out


def layout(node: Node, page: Page, sheet, seen: bool = True, pre: bool = False) -> Generator:
    number = _number(node.attrs.get("start"), 1)
    closed = node.tag == "details" and "open" not in node.attrs
    for kid in node.kids:
        if isinstance(kid, str):
            if seen and not closed:
                page.text(kid, pre)
            continue
        if closed:  # only the first summary of closed details is seen
            if kid.tag != "summary" or closed == "said":
                continue
            closed = "said"
        shown, visible = _shown(kid, sheet, seen)
        if not shown:
            continue
        tag, attrs = kid.tag, kid.attrs
        if tag == "br":
            page.turn(pre)
        elif tag == "img":
            if visible and attrs.get("alt"):
                page.text(f" {attrs['alt']} ", pre)
        elif tag == "input":
            if visible and attrs.get("value") and attrs.get("type", "").lower() in SHOWN:
                page.text(f" {attrs['value']} ", pre)
        elif tag == "textarea":
            if visible:
                page.text(" ", pre)
                page.text("".join(kid.kids).removeprefix("\n"), True)
                page.text(" ", pre)
        elif tag == "select":
            options = _options(kid)
            if "multiple" not in attrs and _number(attrs.get("size"), 1) <= 1:
                options = [o for o in options if "selected" in o.attrs][-1:] or options[:1]
            if visible:
                page.text(f" {' '.join(map(_plain, options))} ", pre)
        elif tag == "table":
            page.turn(pre)
            page.gap = True
            for line in (yield table(kid, sheet, visible)):
                page.put(line)
            page.gap = True
        elif tag in ("ul", "ol", "menu", "dl", "blockquote", "li", "dd"):
            page.turn(pre)
            page.gap = page.gap or (tag in SPACED and node.tag != "li")
            mark = ""
            if tag == "li":
                number = _number(attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1 if "reversed" not in node.attrs else -1
            elif tag in ("dd", "blockquote"):
                mark = "  "
            kept = page.enter(mark, tag == "li") if mark else None
            yield layout(kid, page, sheet, visible, pre)
            page.turn(pre)
            if mark:
                page.leave(kept)
            page.gap = page.gap or (tag in SPACED and node.tag != "li")
        elif tag in BLOCK:
            page.turn(pre)
            page.gap = page.gap or tag in SPACED
            yield layout(kid, page, sheet, visible, pre or tag == "pre")
            page.turn(pre or tag == "pre")
            page.gap = page.gap or tag in SPACED
        elif kid.kids:
            yield layout(kid, page, sheet, visible, pre)


def table(node: Node, sheet, seen: bool) -> Generator:
    """Rows of cells, padded to their columns' widths; a cell may span columns and rows, and one of several lines makes its row as high."""
    above, rows = [], []  # rows of (columns, rows, lines)
    stack = [(kid, seen) for kid in reversed(node.kids)]

    def cell(c, visible: bool) -> Generator:
        inner = Page()
        yield layout(c, inner, sheet, visible)
        return min(max(1, _number(c.attrs.get("colspan"), 1)), MOST_COLUMNS), min(max(0, _number(c.attrs.get("rowspan"), 1)), MOST_ROWS), inner.done()

    while stack:
        kid, visible = stack.pop()
        if isinstance(kid, str):
            if kid.strip() and visible:
                above.append(" ".join(kid.split()))
            continue
        shown, visible = _shown(kid, sheet, visible)
        if not shown:
            continue
        if kid.tag == "tr":
            row = []
            for c in kid.kids:
                if isinstance(c, str):
                    if c.strip() and visible:
                        row.append((1, 1, [" ".join(c.split())]))
                    continue
                has, own = _shown(c, sheet, visible)
                if has:
                    row.append((yield cell(c, own)))
            rows.append(row)
        elif kid.tag in ("td", "th"):
            rows.append([(yield cell(kid, visible))])
        elif kid.tag in ("tbody", "thead", "tfoot"):
            stack.extend((k, visible) for k in reversed(kid.kids))
        else:
            inner, only = Page(), Node("div")
            only.kids = [kid]
            yield layout(only, inner, sheet, visible)
            above += inner.done()
    placed, taken = [], []  # taken: (first column, behind the last, last row) of what cells from above still cover
    for n, row in enumerate(rows):
        taken = _joined([x for x in taken if x[2] >= n])
        here, at, k, new = [], 0, 0, []
        for columns, down, lines in row:
            while k < len(taken) and taken[k][0] <= at:
                at, k = max(at, taken[k][1]), k + 1
            here.append((at, columns, lines))
            if down != 1:
                new.append((at, at + columns, min(n + down, len(rows)) - 1 if down else len(rows) - 1))
            at += columns
        taken += new
        placed.append(here)
    placed = [r for r in placed if any(any(lines) for *_, lines in r)]
    widths: dict[int, int] = {}
    used: list[int] = []  # the columns that have a width, in order
    for at, columns, lines in sorted((c for r in placed for c in r), key=lambda c: c[1]):
        wide = max(map(width, lines), default=0)
        if columns == 1:
            last, lacking = at, wide - widths.get(at, 0)
        else:
            inside = used[bisect_left(used, at) : bisect_left(used, at + columns)]
            last, lacking = inside[-1] if inside else at, wide - sum([widths[k] for k in inside]) - 2 * max(0, len(inside) - 1)
        if lacking > 0:
            if last not in widths:
                insort(used, last)
            widths[last] = widths.get(last, 0) + lacking
    heights = [max((len(lines) for *_, lines in r), default=0) for r in placed]
    told = sum(width(x) + 2 for r in placed for *_, lines in r for x in lines)
    most = max(widths.values(), default=0)
    while most and sum(heights) * sum(min(w, most) + 2 for w in widths.values()) > ROOMY * told:
        most //= 2
    starts, total = {}, 0
    for k in used:
        starts[k] = total
        total += min(widths[k], most) + 2 if most else 0
    out = list(above)
    for r, height in zip(placed, heights):
        for k in range(height):
            line, filled = [], 0
            for at, _, lines in r:
                if k < len(lines) and lines[k]:
                    place = bisect_left(used, at)
                    start = max(starts[used[min(place, len(used) - 1)]], filled + 2 if filled else 0)
                    line.append(" " * (start - filled) + lines[k])
                    filled = start + width(lines[k])
            out.append("".join(line).rstrip())
    return out


def _joined(taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals of columns in order, those that touch and end in one row as one."""
    out: list[tuple[int, int, int]] = []
    for first, behind, last in sorted(taken):
        if out and out[-1][1] == first and out[-1][2] == last:
            out[-1] = (out[-1][0], behind, last)
        else:
            out.append((first, behind, last))
    return out


def render(html: str | None) -> str | None:
    """All visible text of a page; null for null, empty for a page without any."""
    if html is None:
        return None
    tree, styles = build(html)
    page, sheet = Page(), rules(styles)
    styled(tree, sheet)
    _run(layout(tree, page, sheet))
    return "\n".join(page.done())


def rendered(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html`` in ``out`` (an existing column of that name is replaced).

    Row by row, without a shuffle. Null pages stay null, empty ones are empty; pages of any length and depth are read
    once from start to end, and a table is never wider than some times its text (``ROOMY``): columns that are wider are
    not aligned. Repeated rows give repeated rows; other columns pass. An empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([render(t.as_py()) for t in texts], pa.string())

    return bounded(pages).withColumn(out, of(F.col(html)))
