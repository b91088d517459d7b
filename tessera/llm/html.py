"""Layout-aware text of HTML pages.

A linear scanner with raw-text elements feeds a tree builder that closes what a tag implies to be
closed (p before blocks, li, dt, dd, option, ruby and table parts) and keeps closing tags inside the
cell that they stand in. When the tree stands, rules of ``style`` elements (screen media; tags, classes, ids,
attributes, ``:not``, ``:is``, ``:where``, ``:first-child``, and all four combinators) and inline styles decide what is
drawn and what is a block, ``!important`` ones first. Rules are matched from the root down: a node carries which beginnings of selectors
its ancestors and elder siblings have met, so the work is the nodes times the rules that name them. Rendering walks the tree without recursion: what isn't drawn
gives nothing (scripts, styles, head, templates, data lists, closed dialogs, all but the summary of
closed details, what ``audio``, ``video`` and ``canvas`` hold for browsers without them, notes and
unplaced parts of SVG and formulas, ``hidden``, ``display:none``); ``visibility`` holds for text until
an element inside sets it anew; form values, options, SVG text and formulas are text. Blocks stand
apart by line or blank line, breaks and preformatted text keep their lines, lists carry marks by
depth, and tables are set in columns, with cells of several lines and over several rows or columns.

Defined results: null pages count as empty and give empty text; broken markup never fails (a lone
"<" is text, unclosed elements end with the page); rows repeat as given; a column of the input that
bears the name of the output is replaced; an empty table gives none. Columns are padded to their widest
cell (wide characters count two), with at most ``BLANKS`` blanks a character of the page: where that doesn't do, the
widest columns stay ragged, so that the text's size follows the page's. A rule with another pseudo-class or
pseudo-element never holds for what a reader sees, and is left out.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import byte_slices

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ATTR = re.compile(r"""[\s/]*([^\s/>=]?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style head title template noscript iframe meta link datalist audio video canvas".split())
#: Elements that aren't drawn inside others.
UNDRAWN = {"svg": {"desc", "metadata", "defs", "symbol"}, "math": {"annotation", "annotation-xml"}}
#: Lines around a block: 1 for a line break only, 2 for a blank line.
SPACING = dict.fromkeys("html body div section article aside header footer nav main address form fieldset li dt dd tr center figcaption summary details option legend dialog optgroup caption hgroup search".split(), 1) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre xmp listing plaintext blockquote figure hr".split(), 2)
CLOSES_P = {t for t in SPACING if t not in "html body li dt dd tr option optgroup legend caption".split()} | {"li", "dt", "dd"}
PRE = {"pre", "textarea", "xmp", "listing", "plaintext"}
LISTS = {"ul", "ol", "menu"}
TABLE_PARTS = {"table", "caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}
SCOPE = ("table", "td", "th", "caption")
#: What an opening tag closes, and the elements that it does not look beyond.
IMPLIED = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "rb": ({"rt", "rp", "rb"}, {"ruby"}), "body": ({"head"}, set()),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
} | {t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot", "colgroup")}
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility|content-visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
PART = re.compile(r"""([a-zA-Z][\w-]*|\*)|([.#])((?:[\w-]|[^\x00-\x7f])+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*([iI])?\s*)?\]|:(not|is|where)\(|:(first-child)(?![\w-])""")
#: Displays whose boxes stand on lines of their own, and those that run on in the line.
BLOCK = set("block flex grid list-item table flow-root".split())
INLINE = set("inline inline-block inline-flex inline-grid inline-table contents".split())
SHOWN = {"hidden": False, "collapse": False, "visible": True, "initial": True}
VALUED = {"", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local", "submit", "button", "reset"}
BLANKS = 16
#: Tables inside so many others are set line by line: each level would copy their lines once more.
DEEPEST = 64


class Node:
    __slots__ = ("attrs", "children", "display", "hidden", "seen", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.hidden, self.seen, self.display = False, None, ""

    def spacing(self) -> int | None:
        """Lines around the element, None if it runs on in the line."""
        if self.display in INLINE and self.tag not in TABLE_PARTS:
            return None
        return SPACING.get(self.tag, 1 if self.display in BLOCK else None)


def number(attrs: dict, name: str, least: int, most: int, default: int) -> int:
    text = (attrs.get(name) or "").strip()
    return max(least, min(most, int(text))) if re.fullmatch(r"[+-]?\d{1,9}", text) else default


class Compound:
    """One element's part of a selector: a test of tag, attributes and what stands around it."""

    def __init__(self):
        self.tag, self.ids, self.classes, self.attrs, self.lists, self.first = "", [], [], [], [], False

    def key(self) -> str:
        return "#" + self.ids[0] if self.ids else "." + self.classes[0] if self.classes else self.tag or "*"

    def weight(self) -> tuple[int, int, int]:
        own = (len(self.ids), len(self.classes) + len(self.attrs) + self.first, bool(self.tag))
        inner = [max((c.weight() for c in inside), default=(0, 0, 0)) for kind, inside in self.lists if kind != "where"]
        return tuple(map(sum, zip(own, *inner, strict=True)))

    def fits(self, tag: str, attrs: dict, classes: set, first: bool) -> bool:
        if self.tag not in ("", tag) or self.first and not first or any(attrs.get("id") != i for i in self.ids) or not classes.issuperset(self.classes):
            return False
        for name, op, value, fold in self.attrs:
            held = attrs.get(name)
            if held is None:
                return False
            if fold:
                held, value = held.lower(), value.lower()
            if op and not ({"=": held == value, "~=": value in held.split(), "|=": held == value or held.startswith(value + "-")}[op] if op in ("=", "~=", "|=") else bool(value) and {"^=": held.startswith, "$=": held.endswith, "*=": held.__contains__}[op](value)):
                return False
        return all(any(c.fits(tag, attrs, classes, first) for c in inside) != (kind == "not") for kind, inside in self.lists)


def compound(text: str, at: int) -> tuple[Compound | None, int]:
    """The part of a selector that begins at ``at``, and where it ends; None if it can't be told."""
    out, start = Compound(), at
    while at < len(text):
        m = PART.match(text, at)
        if not m:
            break
        if m[1]:
            if at != start:
                return None, at
            out.tag = "" if m[1] == "*" else m[1].lower()
        elif m[2]:
            (out.ids if m[2] == "#" else out.classes).append(m[3])
        elif m[4]:
            out.attrs.append((m[4].lower(), m[5], m[6] or m[7] or m[8] or "", bool(m[9])))
        elif m[11]:
            out.first = True
        else:
            inside, at = [], m.end()
            while True:
                at += len(text[at:]) - len(text[at:].lstrip())
                one, at = compound(text, at)
                at += len(text[at:]) - len(text[at:].lstrip())
                if one is None or at >= len(text) or text[at] not in ",)":
                    return None, at
                inside.append(one)
                at += 1
                if text[at - 1] == ")":
                    break
            out.lists.append((m[10], inside))
            continue
        at = m.end()
    return (out if at > start else None), at


class Rules:
    """What ``style`` elements say about ``display`` and ``visibility``."""

    def __init__(self):
        #: By what names it: a compound, how it hangs on the beginning before it, the bit of that, its own bit, and the rules that end there.
        self.by: dict[str, list[tuple]] = defaultdict(list)
        #: Selectors that begin alike share their beginnings.
        self.begun: dict[tuple, tuple] = {}
        self.count = 0

    def add(self, css: str) -> None:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
        at, skip = "", 0  # skip: open blocks of rules that aren't for a screen
        for m in re.finditer(r"[^{}]*([{}]|\Z)", css):
            prelude = m[0][:-1].strip() if m[1] else ""
            if m[1] == "{":
                media = re.match(r"@media\b([^{]*)", prelude, re.I)
                if skip or (prelude.startswith("@") and not (media and re.fullmatch(r"\s*(only\s+)?(screen|all)\s*", media[1], re.I))):
                    skip += 1
                at = prelude
            elif m[1] == "}":
                if skip:
                    skip -= 1
                elif at and not at.startswith("@"):
                    self.rule(at, prelude)
                at = ""

    def rule(self, selectors: str, body: str) -> None:
        said = [(k.lower(), v.lower(), bool(w)) for k, v, w in DECLARED.findall(body)]
        if not said:
            return
        for one in re.split(r",(?![^(\[]*[)\]])", selectors):
            self.count += 1
            text, at, parts, link = one.strip(), 0, [], ""
            while at < len(text):
                start = at
                part, at = compound(text, at)
                if part is None:
                    parts = []
                    break
                parts.append((link, part, text[start:at]))
                m = re.compile(r"\s*([>+~]?)\s*").match(text, at)
                link, at = m[1] or " ", m.end()
            weight = tuple(map(sum, zip((0, 0, 0), *(p.weight() for _, p, _ in parts), strict=True)))
            before = 0
            for how, part, source in parts:
                key = (before, how, source)
                if key not in self.begun:
                    self.begun[key] = (part, how, before, 1 << len(self.begun), [])
                    self.by[part.key()].append(self.begun[key])
                before = self.begun[key][3]
            if parts:
                self.begun[key][4].append((weight, self.count, said))

    def of(self, node: Node, classes: set, first: bool, above: int, parent: int, elder: int, next_to: int) -> tuple[int, list]:
        """Which beginnings of selectors a node meets, as bits, and the rules that hold for it. ``above``, ``parent``,
        ``elder``, ``next_to``: what its ancestors, its parent, its elder siblings and the last of them meet."""
        met, found = 0, []
        around = {" ": above, ">": parent, "~": elder, "+": next_to}
        for key in (node.tag, "*", *("." + c for c in classes), "#" + node.attrs.get("id", "")):
            for part, how, before, bit, ends in self.by.get(key, ()):
                if (not how or around[how] & before) and part.fits(node.tag, node.attrs, classes, first):
                    met |= bit
                    found += ends
        return met, found


def style(root: Node, rules: Rules) -> None:
    """Sets what is drawn, seen and a block, from the root down."""
    # of an open node: its children to come, what it and its ancestors meet, and what its children so far meet
    walk = [[iter(root.children), 0, 0, 0, 0, True, frozenset()]]
    while walk:
        held = walk[-1]
        children, above, parent, elder, next_to, first, outer = held
        node = next((c for c in children if isinstance(c, Node)), None)
        if node is None:
            walk.pop()
            continue
        met, found = 0, []
        if rules.by:
            met, found = rules.of(node, set((node.attrs.get("class") or "").split()), first, above, parent, elder, next_to)
        said: dict[str, tuple] = {}
        own = [(k.lower(), v.lower(), bool(w)) for k, v, w in DECLARED.findall(node.attrs["style"])] if node.attrs.get("style") else []
        for order, rule in [*(((0, *r[:2]), r[2]) for r in found), ((1, (0, 0, 0), 0), own)]:
            for k, v, important in rule:
                said[k] = max(said.get(k, ((False, (-1,)), "")), ((important, order), v), key=lambda x: x[0])
        display = said["display"][1] if "display" in said else "none" if "hidden" in node.attrs else ""
        node.display = display
        node.hidden = node.tag in HIDDEN or display == "none" or said.get("content-visibility", ("", ""))[1] == "hidden"
        node.hidden |= (node.tag == "dialog" and "open" not in node.attrs) or any(node.tag in UNDRAWN[o] for o in outer)
        node.seen = SHOWN.get(said["visibility"][1]) if "visibility" in said else None
        held[3:6] = elder | met, met, False
        walk.append([iter(node.children), above | met, met, 0, 0, True, outer | {node.tag} if node.tag in UNDRAWN else outer])


def attributes(page: str, at: int, dead: set[int] | None) -> tuple[dict, int]:
    """Attributes of a tag whose name ends at ``at``, and the place behind the tag; -1 if it has no end. ``dead``: places
    between attributes from which no end was found, so that none is looked through twice; None: quotes are plain characters."""
    if dead is None:
        end = page.find(">", at)
        if end < 0:
            return {}, -1
        return {k.lower(): v.strip("\"'") for k, v in re.findall(r"([^\s=/]+)\s*=\s*([^\s]+)", page[at:end])}, end + 1
    found: dict = {}
    size, passed = len(page), []
    while at < size and at not in dead:
        passed.append(at)
        m = ATTR.match(page, at)
        if m.end() == at and page[at] == ">":
            return found, at + 1
        if m[1]:
            found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end() if m.end() > at else at + 1
        if at < size and page[at] == ">":
            return found, at + 1
    dead.update(passed)
    return {}, -1


def build(page: str) -> Node:
    """The tree of a page; text stands in it as strings."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    dead: set[int] = set()
    final = page.rfind(">")  # behind it no tag ends
    places: dict[str, list[int]] = defaultdict(list)  # where open elements stand in the stack, by tag
    rules = Rules()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(n: int) -> None:
        for node in stack[n:]:
            places[node.tag].pop()
        del stack[n:]

    while at < size:
        if page[at] != "<" or at > final:
            end = page.find("<", at) if at < final else size
            end = size if end < 0 else end
            stack[-1].children.append(entities.unescape(page[at:end]))
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = NAME.match(page, at + 1)
        attrs, end = attributes(page, m.end(), dead) if m else ({}, -1)
        if m and end < 0:
            attrs, end = attributes(page, m.end(), None)
        if not m or end < 0:
            stack[-1].children.append("<")
            at += 1
            continue
        tag, at = m[0].lower(), end
        if tag.startswith("/"):
            tag = tag[1:]
            if places.get(tag) and (tag in TABLE_PARTS or places[tag][-1] > last(SCOPE)):
                leave(places[tag][-1])
            continue
        if tag == "image":
            tag = "img"
        if tag in CLOSES_P or tag in IMPLIED:
            closes, beyond = IMPLIED.get(tag, (set(), set()))
            if tag in CLOSES_P:
                closes, beyond = closes | {"p"}, beyond | {"td", "th", "table", "caption", "body"}
            while (found := last(closes)) > last(beyond):
                leave(found)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            inside = page[at : found.start() if found else size]
            if tag == "style" and re.fullmatch(r"\s*(screen|all)?\s*", attrs.get("media") or "", re.I):
                rules.add(inside)
            if tag in ("textarea", "xmp"):
                node.children.append(entities.unescape(re.sub(r"\A\r?\n", "", inside)) if tag == "textarea" else inside)
            at = found.end() if found else size
        elif tag == "plaintext":
            node.children.append(page[at:])
            at = size
        elif tag not in VOID and not (page[at - 2] == "/" and (places.get("svg") or places.get("math") or tag in ("svg", "math"))):
            places[tag].append(len(stack))
            stack.append(node)
        if tag == "pre":
            at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
    style(root, rules)
    return root


class Lines:
    """Text under way: lines, the open line, and the space owed before what comes next."""

    def __init__(self):
        self.out: list[str | None] = []  # None: a blank line between blocks
        self.line: list[str] = []
        self.owed = 0
        self.mark = ""

    def text(self, words: str, pre: bool) -> None:
        if pre:
            first, *rest = words.replace("\r\n", "\n").split("\n")
            self.put(first)
            for r in rest:
                self.newline()
                self.put(r)
            return
        piece = re.sub(r"[ \t\n\r\f]+", " ", words)
        if not self.line or self.line[-1].endswith((" ", "\n")):
            piece = piece.lstrip(" ")
        self.put(piece)

    def put(self, piece: str) -> None:
        if not piece:
            return
        if not self.line:
            if self.owed > 1 and self.out:
                self.out.append(None)
            self.owed = 0
            if self.mark:
                self.line.append(self.mark)
                self.mark = ""
        self.line.append(piece)

    def newline(self) -> None:
        """A break: it ends the open line, or makes an empty one."""
        if self.line:
            self.end(0)
        elif self.out or self.mark:
            if self.owed > 1:
                self.out.append(None)
            self.owed = 0
            self.out.append(self.mark.rstrip())
            self.mark = ""

    def end(self, space: int) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip())
            self.line = []
        self.owed = max(self.owed, space)

    def done(self, cell: bool = False) -> list[str]:
        """The lines; in a cell, blocks follow one another without blank lines."""
        self.end(0)
        out = [x or "" for x in self.out if x is not None or not cell]
        while out and not out[-1]:
            out.pop()
        return out


def wide(text: str) -> int:
    """Places that a line takes: wide characters two, marks on others none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Covered:
    """The columns that cells above still cover, as runs that don't touch."""

    def __init__(self):
        self.cells: list[tuple[int, int, int]] = []  # first column, column behind, row behind
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.ends = 1 << 62

    def enter(self, row: int) -> None:
        if row >= self.ends:
            self.starts, self.stops, self.ends = [], [], 1 << 62
            old, self.cells = self.cells, []
            self.add([c for c in old if c[2] > row])

    def add(self, cells: list[tuple[int, int, int]]) -> None:
        for start, stop, end in cells:
            self.cells.append((start, stop, end))
            self.ends = min(self.ends, end)
            i, j = bisect.bisect_left(self.stops, start), bisect.bisect_right(self.starts, stop)
            if i < j:  # runs that it meets become one with it
                start, stop = min(start, self.starts[i]), max(stop, self.stops[j - 1])
            self.starts[i:j], self.stops[i:j] = [start], [stop]

    def free(self, at: int) -> int:
        """The first column from ``at`` on that is open."""
        i = bisect.bisect_right(self.starts, at) - 1
        return max(at, self.stops[i]) if i >= 0 else at


def table(rows: list[list[tuple[int, int, list[str]]]], blanks: list[int]) -> list[str]:
    """Lines of a table whose cells are (columns, rows, lines). ``blanks``: what may still be padded on the page."""
    placed: list[list[tuple[int, int, list[str]]]] = []  # per row: first column, columns, lines
    covered = Covered()
    for n_row, row in enumerate(rows):
        covered.enter(n_row)
        at, out, new = 0, [], []
        for columns, over, lines in row:
            at = covered.free(at)
            out.append((at, columns, lines))
            if over > 1:
                new.append((at, at + columns, n_row + over))
            at += columns
        placed.append(out)
        covered.add(new)
    used = sorted({c for row in placed for c, _, lines in row if lines} | {0})
    widths = dict.fromkeys(used, 0)
    for row in placed:
        for c, n, lines in row:
            if n == 1 and lines:
                widths[c] = max(widths[c], *map(wide, lines))
    drawn = sum(max((len(lines) for _, _, lines in row), default=0) for row in placed)
    total = sum(widths.values())
    for c in sorted(used, key=lambda c: (-widths[c], c)):  # the widest columns stay ragged where blanks don't do
        if drawn * total <= blanks[0]:
            break
        total -= widths[c]
        widths[c] = 0
    blanks[0] -= drawn * total
    out: list[str] = []
    for row in placed:
        cells = {c: (n, lines) for c, n, lines in row if lines}
        if not cells:
            continue
        columns = []  # lines and width, up to the row's last cell
        at, end = 0, bisect.bisect_right(used, max(cells))
        while at < end:
            n, lines = cells.get(used[at], (1, []))
            after = max(at + 1, bisect.bisect_left(used, used[at] + n))
            columns.append((lines, sum(widths[x] for x in used[at:after]) + 3 * (after - at - 1)))
            at = after
        for i in range(max(len(lines) for lines, _ in columns)):
            cut = [lines[i] if i < len(lines) else "" for lines, _ in columns]
            out.append(SPARE.sub("", " | ".join(x + " " * (width - wide(x)) for x, (_, width) in zip(cut, columns, strict=True))))
    return out


SPARE = re.compile(r"(?<![ |])[ |]+\Z")


def mark_of(kind: str, style: str, n: int) -> str:
    if kind != "ol":
        return "- "
    if style in ("a", "A") and n > 0:
        text, m = "", n
        while m:
            m, r = divmod(m - 1, 26)
            text = chr(97 + r) + text
    elif style in ("i", "I") and 0 < n < 4000:
        text, m = "", n
        for value, digits in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            text += digits * (m // value)
            m %= value
    else:
        return f"{n}. "
    return (text.upper() if style.isupper() else text) + ". "


def render(root: Node, size: int = 0) -> str:
    """The text of a tree that came from ``size`` characters."""
    page = Lines()
    blanks = [BLANKS * size + 4096]
    open_ = [page]  # the page, and the table cells that are open
    tables: list[list[list[tuple[int, int, list[str]]]]] = []
    lists: list[list] = []
    pre = 0
    walk: list[tuple[object, bool, bool]] = [(root, True, True)]
    while walk:
        node, enter, seen = walk.pop()
        now = open_[-1]
        if isinstance(node, str):
            if seen and (len(open_) > len(tables) or node.strip()):
                now.text(node, pre > 0)
            continue
        tag = node.tag
        nested = len(tables) > DEEPEST  # cells of such tables are set line by line
        if enter:
            if node.hidden:
                continue
            seen = seen if node.seen is None else node.seen
            if tag == "br":
                now.newline()
                continue
            if tag == "input" and seen and (node.attrs.get("type") or "").lower() in VALUED:
                now.text(node.attrs.get("value") or "", False)
                continue
            if (space := node.spacing()) is not None:
                now.end(space if not (tag in LISTS and lists) else 1)
            if tag in PRE:
                pre += 1
            elif tag in LISTS:
                items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if "reversed" in node.attrs else 1
                lists.append([tag, number(node.attrs, "start", -(10**9), 10**9, items), -1 if "reversed" in node.attrs else 1, node.attrs.get("type") or ""])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1, ""]
                kind[1] = number(node.attrs, "value", -(10**9), 10**9, kind[1])
                now.mark = "  " * max(0, len(lists) - 1) + mark_of(kind[0], kind[3], kind[1]) if seen and node.display not in INLINE | BLOCK - {"list-item"} else ""
                kind[1] += kind[2]
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if nested:
                    now.end(1)
                else:
                    open_.append(Lines())
            walk.append((node, False, seen))
            inside = node.children
            if tag == "details" and "open" not in node.attrs:
                inside = [c for c in inside if isinstance(c, Node) and c.tag == "summary"][:1]
            walk.extend((c, True, seen) for c in reversed(inside))
            continue
        if tag in ("td", "th") and tables:
            if nested:
                now.end(1)
                continue
            lines = open_.pop().done(cell=True)
            while lines and not lines[0]:
                del lines[0]
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((number(node.attrs, "colspan", 1, 1000, 1), number(node.attrs, "rowspan", 0, 65534, 1) or 65534, lines))
            continue
        if tag == "table":
            now.end(2)
            for line in table([r for r in tables.pop() if r], blanks):
                now.put(line or " ")
                now.end(1)
        elif tag in LISTS and lists:
            lists.pop()
        elif tag == "li":
            now.mark = ""
        elif tag in PRE:
            pre -= 1
        if (space := node.spacing()) is not None:
            now.end(space if not (tag in LISTS and lists) else 1)
    return "\n".join(page.done())


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The columns of ``pages`` but the markup, and ``out``."""
    rest = [c for c in pages.columns if c.lower() not in (html.lower(), out.lower())]
    rows = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html}`").alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, html):
            texts = [render(build(p or ""), len(p or "")) for p in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, out])

    schema = rows.schema
    schema = type(schema)([*schema.fields[:-1]]).add(out, "string")
    return rows.mapInArrow(run, schema)
