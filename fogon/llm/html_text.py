"""HTML extraction by layout-aware rendering.

A tree is built with the implied tags of HTML (paragraphs, list items, table rows and cells,
options and the like close and open by themselves; stray end tags are ignored; unclosed
elements end with the text). Visibility rules drop what a browser does not show: head,
script, style and similar elements, ``hidden``, hidden inputs, closed ``details`` and
``dialog``, ``display:none`` and ``visibility:hidden`` (a ``visible`` descendant shows again),
inline or through simple selectors (tag, .class, #id, tag.class) of the page's style sheets, in
cascade order (importance, inline style, specificity, place); another ``display`` shows again.
Rules for print are left out; of rules under a condition that depends on the screen or the browser
only those that show something count. Text of svg and math is shown but for definitions.
All other text is emitted: blocks on lines of their own with blank lines around paragraphs
and headings, list items with markers and indents, table cells in aligned columns (spans
included), ``pre`` verbatim, ``br`` and ``hr`` as lines, ``alt`` texts, values of buttons.

Tags are read as the standard's tokenizer does: a quote opens a value only right after ``=``, and
an unclosed one runs to the end of the page. Lines of a cell longer than 60 columns are wrapped at
blanks; what cannot be wrapped (long words, ``pre``, inner tables) stays whole and moves the rest
of its line to the right. Columns are aligned up to 480 places from the left; cells beyond follow
two blanks apart. So padding is bounded by the number of lines. Lists indent and tables align
down to a depth of 16; deeper ones are shown without more indents, a cell per line.

Defined cases: null or empty html gives the empty text; a truncated tag at the end is
dropped as a browser does; nesting of any depth is walked without recursion; a style sheet is
looked up by tag, class and id, so an element costs its classes, not the rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noembed noframes".split())
VERBATIM = set("xmp plaintext".split())
PLAIN = set("textarea title".split())
UNSEEN = set("head script style template noscript iframe object audio video canvas datalist title noembed noframes param area".split())
#: Not drawn inside svg or math.
FOREIGN_UNSEEN = set("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table ul "
    "tr td th thead tbody tfoot caption optgroup option xmp".split()
)
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing ol p plaintext pre table ul menu fieldset xmp".split())
PRE = set("listing plaintext pre xmp".split())
#: A start tag closes an open element of these (up to the boundary tags).
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"), "rp": ("rp rt", "ruby"), "rt": ("rp rt", "ruby"),
}
CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in CLOSES.items()}
CLOSES_P = BLOCKS - set("body html tr td th thead tbody tfoot caption option optgroup legend".split())
SCOPE = set("html table td th caption button object marquee template applet".split())
LISTS = set("ul ol menu dir".split())

CELL_WIDTH = 60
DEEP = 16

# Blanks of the standard. No quantifier gives anything back, so a tag costs its length.
_B = r"[ \t\n\f\r]"
_ATTRIBUTE = re.compile(
    rf"(?:{_B}|/)*+([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)"
    rf"(?:{_B}*+={_B}*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)|(?=>|\Z)))?+"
)
_INNER = re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE.pattern)
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?=[^A-Za-z])[^>]*+(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:{_INNER})*+(?:{_B}|/)*+)(>|\Z)",
    re.S,
)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.S)
_SIMPLE = re.compile(r"([a-z][\w-]*)?(?:([.#])([\w-]+))?\Z")


class Node:
    __slots__ = ("attributes", "children", "tag", "unseen")

    def __init__(self, tag: str, attributes: dict[str, str], unseen: bool = False):
        self.tag, self.attributes, self.children, self.unseen = tag, attributes, [], unseen


def build(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """(root, style sheets with their media) of a page."""
    root = Node("#root", {})
    stack, styles, at, n = [root], [], 0, len(html)
    open_: Counter = Counter()  # open elements by tag: a search starts only where it can succeed

    def cut(i: int) -> None:
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def close(tags: set, boundary: set) -> None:
        while any(open_[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    break
                if stack[i].tag in boundary:
                    return
            else:
                return

    def opened(tag: str, attributes: dict) -> None:
        foreign = open_["svg"] > 0 or open_["math"] > 0
        if foreign and tag == "text":
            stack[-1].children.append(" ")  # texts of a drawing have places of their own
        node = Node(tag, attributes, foreign and tag in FOREIGN_UNSEEN)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_[tag] += 1

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(unescape(raw))

    while at < n:
        found = _TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        if found[2] and not found[4]:
            break  # a tag cut off by the end of the page
        if found[1]:
            tag = found[2].lower()
            if tag == "p" and not open_["p"]:
                opened("p", {})
            if tag == "br":
                opened("br", {})
            for i in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "td", "th"):
                    break  # an end tag inside a cell closes nothing outside it
        elif found[2]:
            tag = found[2].lower()
            attributes: dict[str, str] = {}
            if found[3]:
                for m in _ATTRIBUTE.finditer(found[3]):
                    value = next((v for v in m.groups()[1:] if v is not None), "")
                    attributes.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
            if tag in ("html", "body", "head") and open_[tag] > 0:
                continue
            if tag == "body" or tag in BLOCKS and stack[-1].tag == "head":
                close({"head"}, set())
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                cut(len(stack) - 1)
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                opened("tr", {})
            opened(tag, attributes)
            if (found[3] or "").endswith("/") and (open_["svg"] > 0 or open_["math"] > 0) and stack[-1].tag == tag:
                cut(len(stack) - 1)  # only svg and math have empty elements of this form
                continue
            if tag in RAW or tag in PLAIN or tag in VERBATIM:
                end = re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I).search(html, at) if tag != "plaintext" else None
                stop = end.start() if end else n
                if tag == "style":
                    styles.append((attributes.get("media", ""), html[at:stop]))
                elif tag in PLAIN:
                    text(html[at:stop])
                elif tag in VERBATIM:
                    stack[-1].children.append(html[at:stop])
                at = stop
    return root, styles


def _applies(media: str) -> bool | None:
    """Whether a list of media queries holds on a screen; None if that depends on the screen."""
    answers = set()
    for query in media.lower().split(","):
        words = query.split()
        negated = words[:1] == ["not"]
        kind = next((w for w in words if w not in ("not", "only")), "all")
        if "(" in query:
            # Of a type that is no screen, whatever else is asked.
            known = kind.isalpha() and kind not in ("all", "screen")
            answers.add(negated if known else None)
        else:
            answers.add((kind in ("all", "screen")) != negated)
    return True if True in answers else None if None in answers else False


def hiding_rules(sheets: list[tuple[str, str]]) -> dict[tuple[str, str, str], dict]:
    """Rules that set display or visibility by selector (tag, kind, name).

    A selector has {(important, property): (rank in the cascade, value)}: of rules with one selector the last counts.
    """
    out: list[tuple] = []
    for media, sheet in sheets:
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S).replace("<!--", " ").replace("-->", " ")
        # Open blocks: (prelude, whether its rules apply, start of the body).
        blocks: list[tuple[str, bool | None, int]] = []
        applies, start = _applies(media), 0
        for m in _CSS.finditer(css):
            mark = m[0]
            if mark == "{":
                blocks.append((css[start : m.start()].strip(), applies, m.end()))
                prelude = blocks[-1][0]
                if prelude.startswith("@"):
                    name = re.match(r"@([\w-]*)", prelude)[1].lower()
                    if name == "media":
                        own = _applies(prelude[6:])
                    else:
                        own = True if name == "layer" else None if name in ("supports", "container", "scope") else False
                    applies = False if False in (own, applies) else None if None in (own, applies) else True
            elif mark == "}" and blocks:
                prelude, applies, begin = blocks.pop()
                if applies is not False and not prelude.startswith("@"):
                    _add_rules(out, prelude, css[begin : m.start()], applies)
            elif mark not in ("}", ";") or blocks and not blocks[-1][0].startswith("@"):
                continue  # a string, or the end of a declaration
            start = m.end()
    rules: dict[tuple[str, str, str], dict] = {}
    for rank, tag, kind, name, what, value in out:
        rules.setdefault((tag, kind, name), {})[rank[0], what] = rank, value
    return rules


def _add_rules(out: list, selectors: str, body: str, sure: bool | None) -> None:
    effects = [e for e in _effects(body) if sure or e[1] not in ("none", "hidden")]
    for s in selectors.split(",") if effects else ():
        s = s.strip()
        m = _SIMPLE.match(s.lower() if "." not in s and "#" not in s else s)
        if m and s:
            specific = (m[2] == "#", m[2] == ".", bool(m[1]))
            for name, value, important in effects:
                out.append(((important, *specific, len(out)), m[1] or "", m[2] or "", m[3] or "", name, value))


def _effects(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important): display ``none`` or ``shown``, visibility ``hidden`` or ``visible``."""
    out = []
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, important = name.strip(), "!important" in value.replace("! ", "!")
        value = value.partition("!")[0].strip()
        if name == "display" and value:
            out.append((name, "none" if value == "none" else "shown", important))
        elif name == "visibility" and value in ("hidden", "collapse", "visible", "initial"):
            out.append((name, "visible" if value in ("visible", "initial") else "hidden", important))
    return out


def _shown(node: Node, rules: dict, parent: Node) -> str:
    """Effect of an element on what is shown: ``none``, ``hidden``, ``visible`` or nothing."""
    a = node.attributes
    if node.tag in UNSEEN or node.unseen or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return "none"
    if parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary":
        return "none"
    own: dict[str, str] = {}
    # A style sheet can show what the browser's own one hides.
    if "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        own["display"] = "none"
    inline = _effects(a["style"]) if "style" in a else []
    last: list[tuple[str, str]] = []
    if rules:
        names = [("", ""), *((".", c) for c in set(a.get("class", "").split())), *([("#", a["id"])] if "id" in a else [])]
        found = [
            (*rule, what)
            for kind, name in names
            for tag in ({"", node.tag} if kind else {node.tag})
            for (_, what), rule in rules.get((tag, kind, name), {}).items()
        ]
        for rank, value, what in sorted(found):
            if rank[0]:
                last.append((what, value))
            else:
                own[what] = value
    own.update((what, value) for what, value, important in inline if not important)
    own.update(last)
    own.update((what, value) for what, value, important in inline if important)
    return "none" if own.get("display") == "none" else own.get("visibility", "")


def width(text: str) -> int:
    """Columns of a text on a fixed grid; wide East Asian characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class _Flow:
    """Lines of one block formatting context (the page or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.firm: set[int] = set()  # lines that are not wrapped
        self.fixed = False
        self.indents: list[list[str]] = []  # [marker, blanks of the lines after its own]
        self.ready = 0  # so many levels have written their marker

    def indent(self, marker: str) -> None:
        self.indents.append([marker, ""])

    def outdent(self) -> None:
        self.indents.pop()
        self.ready = min(self.ready, len(self.indents))

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            blanks = self.indents[self.ready - 1][1] if self.ready else ""
            self.now.append(blanks)
            for i in range(self.ready, len(self.indents)):
                level = self.indents[i]
                self.now.append(level[0])
                blanks += " " * len(level[0]) if i < DEEP else ""
                level[1] = blanks
            self.ready = len(self.indents)

    def text(self, raw: str) -> None:
        collapsed = _SPACE.sub(" ", raw)
        body = collapsed.strip(" ")
        if not body:
            self.space = self.space or bool(collapsed)
            return
        fresh = not self.now
        self._begin()
        if not fresh and (self.space or collapsed[0] == " "):
            self.now.append(" ")
        self.now.append(body)
        self.space = collapsed[-1] == " "

    def verbatim(self, raw: str) -> None:
        for i, line in enumerate(raw.replace("\r\n", "\n").split("\n")):
            if i:
                self.line(keep=True)
            if line:
                self._begin()
                self.now.append(line)
                self.fixed = True
        self.space = False

    def line(self, keep: bool = False) -> None:
        """End the line; with ``keep`` an empty one counts as well (br, pre)."""
        if self.now:
            if self.fixed:
                self.firm.add(len(self.lines))
            self.lines.append("".join(self.now).rstrip(" "))
        elif keep and self.lines and not self.gap:
            self.lines.append("")
        self.now, self.space, self.fixed = [], False, False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        for x in lines:
            self._begin()
            self.now.append(x)
            self.fixed = True
            self.line(keep=True)

    def wrapped(self) -> list[str]:
        """The lines, wrapped to the width of a cell."""
        out = []
        for i, line in enumerate(self.lines):
            out += [line] if i in self.firm or width(line) <= CELL_WIDTH else _wrap(line)
        return out


def _wrap(line: str) -> list[str]:
    """Pieces of a line of at most CELL_WIDTH columns, or one word; all start at its indent."""
    words = line.lstrip(" ")
    lead = line[: len(line) - len(words)]
    out, now, have = [], [], 0
    for word in words.split(" "):
        own = width(word)
        if now and len(lead) + have + 1 + own > CELL_WIDTH:
            out.append(lead + " ".join(now))
            now, have = [], 0
        have += own + bool(now)
        now.append(word)
    return [*out, lead + " ".join(now)]


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def lines(self) -> list[str]:
        """Cells in aligned columns, two blanks between them."""
        grid: list[dict[int, tuple[list[str], int]]] = []
        taken: list[tuple[int, int, int]] = []  # columns [first, stop) held by cells from above up to a row
        for r, row in enumerate(self.rows):
            held = sorted(t for t in taken if t[2] > r)
            taken = []
            for first, stop, end in held:
                if taken and taken[-1][1] == first and taken[-1][2] == end:
                    first = taken.pop()[0]
                taken.append((first, stop, end))
            placed, c, k = {}, 0, 0
            for lines, across, down in row:
                while k < len(held) and held[k][0] <= c:
                    c = max(c, held[k][1])
                    k += 1
                placed[c] = (lines, across)
                if down > 1:
                    taken.append((c, c + across, min(r + down, len(self.rows))))
                c += across
            grid.append(placed)
        widths: dict[int, int] = {}
        need = [[(c, across, min(CELL_WIDTH, max(map(width, lines), default=0))) for c, (lines, across) in placed.items()] for placed in grid]
        for row in need:
            for c, across, columns in row:
                if across == 1:
                    widths[c] = max(widths.get(c, 0), columns)
        for row in need:  # a spanning cell widens its last column if it needs more room
            for c, across, columns in row:
                if across > 1:
                    have = sum(widths[i] + 2 for i in range(c, c + across) if i in widths) - 2
                    if columns > have:
                        last = max((i for i in range(c, c + across) if i in widths), default=c)
                        widths[last] = widths.get(last, 0) + columns - max(have, 0)
        starts, at = {}, 0
        for c in sorted(widths):  # columns that no cell has of its own take no room
            starts[c] = min(at, 8 * CELL_WIDTH)
            at += widths[c] + 2
        out = []
        for placed in grid:
            for i in range(max((len(x) for x, _ in placed.values()), default=0)):
                parts, have = [], 0
                for c, (lines, _) in sorted(placed.items()):
                    if i < len(lines) and lines[i]:
                        gap = max(starts.get(c, 0) - have, 2 if parts else 0)
                        parts.append(" " * gap + lines[i])
                        have += gap + width(lines[i])
                out.append("".join(parts).rstrip(" "))
        return out


def _number(value: str | None, least: int, most: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", value or "")
    return min(most, max(least, int(m[1]))) if m else 1


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    root, sheets = build(html)
    rules = hiding_rules(sheets)
    flow = _Flow()
    flows: list[_Flow] = [flow]
    tables: list[_Table | None] = []  # None: too deep to be aligned
    counters: list[int | None] = []
    pre = 0
    # (node, parent, hidden by visibility) to enter; a tuple with None leaves.
    todo: list[tuple] = [(root, root, False)]
    while todo:
        item = todo.pop()
        if len(item) == 2:
            node, undo = item
            tag = node.tag
            if tag in ("td", "th") and undo:
                flow.line()
                cell = flows.pop()
                flow = flows[-1]
                tables[-1].rows[-1].append(
                    (cell.wrapped(), _number(node.attributes.get("colspan"), 1, 1000), _number(node.attributes.get("rowspan"), 1, 65534))
                )
            elif tag == "table":
                flow.block(1)
                table = tables.pop()
                if table:
                    flow.whole(table.lines())
                flow.block(1)
            elif tag == "li":
                flow.line()
                flow.outdent()
            elif tag in LISTS:
                counters.pop()
                flow.block(0 if counters else 1)
            elif tag in ("dd", "blockquote"):
                flow.block(tag == "blockquote")
                flow.outdent()
            elif tag in PRE:
                pre -= 1
                flow.block(1)
            elif tag in BLOCKS:
                flow.block(tag in SPACED)
            elif tag == "q":
                flow.text("”")
            continue
        node, parent, hidden = item
        if isinstance(node, str):
            closed = parent.tag == "details" and "open" not in parent.attributes
            if not hidden and not closed:
                flow.verbatim(node) if pre else flow.text(node)
            continue
        tag = node.tag
        effect = _shown(node, rules, parent)
        if effect == "none":
            continue
        hidden = effect != "visible" if effect else hidden
        undo = True
        if tag == "br":
            flow.line(keep=True)
        elif tag == "hr":
            flow.block(1)
        elif tag == "img" and not hidden and node.attributes.get("alt", "").strip():
            flow.text(f" {node.attributes['alt']} ")
        elif tag == "input" and not hidden and node.attributes.get("type", "").lower() in ("button", "submit", "reset"):
            flow.text(f" {node.attributes.get('value', '')} ")
        elif tag == "table":
            flow.block(1)
            tables.append(_Table() if len(tables) < DEEP else None)
        elif tag == "tr" and tables and tables[-1]:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables and tables[-1]:
            if not tables[-1].rows:
                tables[-1].rows.append([])
            flow = _Flow()
            flows.append(flow)
        elif tag in ("td", "th"):
            undo = False
            flow.text(" ")
        elif tag in LISTS:
            flow.block(0 if counters else 1)
            counters.append(_number(node.attributes.get("start"), -(10**9), 10**9) if tag == "ol" else None)
        elif tag == "li":
            flow.line()
            marker = "- "
            if counters and counters[-1] is not None:
                if "value" in node.attributes:
                    counters[-1] = _number(node.attributes["value"], -(10**9), 10**9)
                marker = f"{counters[-1]}. "
                counters[-1] += 1
            flow.indent(marker)
        elif tag in ("dd", "blockquote"):
            flow.block(tag == "blockquote")
            flow.indent("  ")
        elif tag in PRE:
            flow.block(1)
            pre += 1
        elif tag in BLOCKS:
            flow.block(tag in SPACED)
        elif tag == "q":
            flow.text("“")
        if tag not in VOID:
            todo.append((node, undo))
            todo += [(child, node, hidden) for child in reversed(node.children)]
    flow.line()
    return "\n".join(flows[0].lines).strip("\n")


def text_of(html: Column) -> Column:
    """Rendered text of an html column; null gives the empty text."""
    return F.pandas_udf(lambda s: s.map(render, na_action=None), "string")(html)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of (page_id, url, html), a row per row."""
    return pages.select("page_id", "url", text_of(F.col("html")).alias("text"))
