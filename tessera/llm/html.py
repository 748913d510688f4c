"""HTML extraction (operator 8): a tree with implied tags, visibility rules, and a layout of the visible text."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, pieces, small_batches, table

# Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist title meta link object audio video canvas".split())
#: Parts of svg and math that are not drawn where they stand, and tags that end svg and math.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HTML_INSIDE = ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")
#: Largest spans of a cell.
COLUMNS, ROWS = 1000, 65534
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp caption textarea".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir fieldset".split())
#: Start tags that end an open element, up to a boundary.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "tr": ("td th tr caption colgroup", "table"), "td": ("td th caption colgroup", "tr table"), "th": ("td th caption colgroup", "tr table"),
    "tbody": ("td th tr tbody thead tfoot caption colgroup", "table"), "thead": ("td th tr tbody thead tfoot caption colgroup", "table"), "tfoot": ("td th tr tbody thead tfoot caption colgroup", "table"),
    "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
P_BOUNDARY = frozenset("table td th caption button object template html".split())
#: An end tag doesn't reach beyond these unless it is theirs.
SCOPE = frozenset("table td th caption template html".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
IN_TABLE = frozenset("table template html".split())

TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/?+([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Tables nested deeper are laid out as blocks; columns are not padded for cells longer than WIDE.
DEEPEST, WIDE = 8, 60


class Node:
    __slots__ = ("kids", "name", "attrs")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.kids = name, attrs, []

    def attr(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def seen(self) -> bool:
        if self.name in HIDDEN:
            return False
        if not self.attrs:
            return True
        if self.attr("hidden") not in (None, "until-found") or UNSEEN.search(self.attr("style") or ""):
            return False
        return not (self.name == "dialog" and self.attr("open") is None)


def build(html: str) -> Node:
    """The tree of a page. Never fails: wrong end tags are ignored, what is open at the end is closed, and tags that
    may be left out (``p``, ``li``, ``dt``, ``dd``, ``option``, table rows and cells, ``head``) are implied."""
    root = Node("html")
    stack, at, n = Stack(root), 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if (m is None or m.start() > at) and stack.draws():
            stack[-1].kids.append(html[at : m.start() if m else n])
        if m is None:
            break
        at = m.end()
        if m[1] is None:
            continue
        name, attrs = m[1].lower(), m[2]
        if html[m.start() + 1] == "/":
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name in VOID:
                pass
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                stack.close(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE)
            elif not stack.close((name,), IN_TABLE if name in TABLE_PARTS else SCOPE) and name == "p":
                stack[-1].kids.append(Node("p"))
            continue
        foreign = stack.foreign()
        if foreign and name in BREAKOUT:
            while stack.foreign() and stack.close(("svg", "math"), ()):
                pass
            foreign = False
        if name in ("html", "body") and any(x.name == name for x in stack[:3]):
            continue
        if name in CLOSES:
            stack.close(*CLOSES[name], every=True)
        if name in ENDS_P:
            stack.close(("p",), P_BOUNDARY)
        node = Node(name, attrs)
        if foreign and (name in UNDRAWN or node.attr("display") == "none" or node.attr("visibility") in ("hidden", "collapse")):
            node.attrs = " hidden"
        stack[-1].kids.append(node)
        if name in VOID or foreign and attrs.rstrip().endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            text = html[at : end.start() if end else n]
            node.kids.append(text)
            at = n if end is None else (html.find(">", end.end()) + 1 or n)
        elif name == "plaintext":
            node.kids.append(Node("pre"))
            node.kids[0].kids.append(html[at:].replace("&", "&amp;"))
            break
        elif name not in ("svg", "math") or not attrs.rstrip().endswith("/"):
            stack.push(node)
    return root


class Stack(list):
    """Open elements, and how many there are of each name, so that looking for one that isn't open costs nothing."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.name] += 1

    def cut(self, i: int) -> None:
        for x in self[i:]:
            self.open[x.name] -= 1
        del self[i:]

    def foreign(self) -> bool:
        """Whether the next tag is one of svg or math."""
        return bool(self.open["svg"] or self.open["math"]) and not any(self.open[x] for x in HTML_INSIDE)

    def draws(self) -> bool:
        """Whether text here is shown: in svg only that of its text elements and of HTML in it."""
        return not self.open["svg"] or bool(self.open["text"] or self.open["foreignobject"] or self.open["math"])

    def close(self, names, boundary, every: bool = False) -> bool:
        """Close the innermost element of these names above any boundary, or with ``every`` the outermost."""
        if not any(self.open[x] for x in names):
            return False
        lowest = 0
        for i in range(len(self) - 1, 0, -1):
            if self[i].name in names:
                lowest = i
                if not every:
                    break
            elif self[i].name in boundary:
                break
        if lowest:
            self.cut(lowest)
        return lowest > 0


class Page:
    """Collects lines. Blank lines part what needs space around it; white space runs become one space outside ``pre``."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if "&" in s:
            s = unescape(s)
        s = s.replace("\xa0", " ") if pre else SPACE.sub(" ", s)
        if pre:
            first, *more = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.now.append(first)
            for x in more:
                self.line(keep=True)
                self.now.append(x)
        elif s and not (s == " " and (not self.now or self.now[-1].endswith(" "))):
            if s[0] == " " and (not self.now or self.now[-1].endswith(" ")):
                s = s[1:]
            self.now.append(s)

    def line(self, keep: bool = False) -> None:
        """End the line; without ``keep`` an empty one doesn't count."""
        s = "".join(self.now).rstrip()
        self.now = []
        if s or keep:
            if self.blank and self.lines and s:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent)
            if self.mark:
                lead, self.mark = "".join(self.indent[:-1]) + self.mark, ""
            self.lines.append((lead + s).rstrip())

    def space(self) -> None:
        self.line()
        self.blank = True


def _marker(kind: str, number: int) -> str:
    return f"{number}. " if kind == "ol" else "- "


def _number(s: str | None, otherwise: int) -> int:
    try:
        return max(-(10**9), min(10**9, int(s)))
    except (TypeError, ValueError):
        return otherwise


def render(root: Node, depth: int = 0, inside_pre: bool = False) -> list[str]:
    """Lines of the visible text below a node, in the order of the page."""
    page = Page()
    todo: list = [(root, None, inside_pre)]
    lists: list[list] = []
    while todo:
        node, leave, pre = todo.pop()
        if leave is not None:
            leave()
            continue
        if isinstance(node, str):
            page.text(node, pre)
            continue
        name = node.name
        if not node.seen():
            continue
        if name == "br":
            page.line(keep=True)
        elif name == "hr":
            page.space()
            page.now.append("---")
            page.space()
        elif name == "input":
            if (node.attr("type") or "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and node.attr("value"):
                page.text(" " + node.attr("value").replace("&", "&amp;") + " ", False)
        elif name == "table" and depth < DEEPEST:
            page.space()
            for x in _table(node, depth + 1, pre):
                page.now.append(x)
                page.line(keep=True)
            page.space()
        elif name in BLOCK:
            spaced = name in SPACED and not (name in ("ul", "ol") and lists)
            (page.space if spaced else page.line)()
            end = page.space if spaced else page.line
            if name in ("ul", "ol", "menu", "dir"):
                lists.append([name, _number(node.attr("start"), 1)])
                end = _both(page.space if spaced else page.line, lists.pop)
            elif name == "li":
                if not lists:
                    lists.append(["ul", 1])
                    end = _both(page.line, lists.pop)
                current = lists[-1]
                current[1] = _number(node.attr("value"), current[1])
                mark = _marker(*current)
                current[1] += 1
                page.mark = mark
                page.indent.append(" " * len(mark))
                end = _both(end, _unmark(page))
            elif name in ("dd", "blockquote"):
                page.indent.append("  ")
                end = _both(end, page.indent.pop)
            kids = node.kids
            pre = pre or name in ("pre", "xmp", "textarea")
            if name == "details" and node.attr("open") is None:  # closed: only its summary shows
                kids = [k for k in kids if isinstance(k, Node) and k.name == "summary"][:1]
            if pre and name == "pre" and kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids = [kids[0][1:], *kids[1:]]
            todo.append((None, end, pre))
            todo += [(k, None, pre) for k in reversed(kids)]
        else:
            if name in ("td", "th", "button", "select"):
                page.text(" ", False)
            elif name == "text":
                page.text(" ", False)
                todo.append((None, _gap(page), pre))
            todo += [(k, None, pre) for k in reversed(node.kids)]
    page.line()
    return page.lines


def _both(*steps):
    def run():
        for s in steps:
            s()

    return run


def _gap(page: Page):
    return lambda: page.text(" ", False)


def _unmark(page: Page):
    def run():
        page.mark = ""
        page.indent.pop()

    return run


def _table(node: Node, depth: int, pre: bool) -> list[str]:
    """Caption, then rows whose cells stand in columns two spaces apart; text outside cells comes before the table."""
    rows: list[list[list[str]]] = []
    before: list[str] = []
    todo = list(reversed(node.kids))
    row: list | None = None
    down: dict[int, int] = {}  # columns that cells of earlier rows reach into, and for how many rows
    taken: set[int] = set()

    def begin() -> list:
        nonlocal taken
        taken = set(down)
        for c in taken:
            down[c] -= 1
            if not down[c]:
                del down[c]
        rows.append([])
        return rows[-1]

    while todo:
        k = todo.pop()
        if k is None:
            row = None
            continue
        if isinstance(k, str):
            if k.strip():
                before += render(_wrap([k]), depth, pre)
            continue
        if not k.seen():
            continue
        if k.name in ("tbody", "thead", "tfoot"):
            down.clear()
            todo += reversed(k.kids)
        elif k.name == "tr":
            row = begin()
            todo.append(None)
            todo += reversed(k.kids)
        elif k.name in ("td", "th"):
            if row is None:
                row = begin()
            while len(row) in taken:
                row.append([])
            first = len(row)
            row.append(render(_wrap(k.kids), depth, pre))
            row += [[]] * (min(COLUMNS, _number(k.attr("colspan"), 1)) - 1)
            height = _number(k.attr("rowspan"), 1)
            if height > 1 or height == 0:
                down.update(dict.fromkeys(range(first, len(row)), min(ROWS, height or ROWS) - 1))
        elif k.name not in ("col", "colgroup"):
            before += render(_wrap([k] if k.name != "caption" else k.kids), depth, pre)
    wide: list[int] = []
    for r in rows:
        for c, cell in enumerate(r):
            if c == len(wide):
                wide.append(0)
            wide[c] = max([wide[c], *(len(x) for x in cell if len(x) <= WIDE)])
    out = before
    for r in rows:
        tall = max(map(len, r), default=0)
        for k in range(tall):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(wide[c]) for c, cell in enumerate(r)).rstrip())
    return out


def _wrap(kids: list) -> Node:
    n = Node("div")
    n.kids = kids
    return n


def extract(html: str | None) -> str:
    """All visible text of a page, laid out; empty for null, empty or invisible pages."""
    if not html:
        return ""
    lines = render(build(html.replace("\x00", "")))
    return "\n".join(lines).strip("\n")


TEXTS = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_lines`` of every row of ``page_id, html``: a map over Arrow batches, without a shuffle.

    Hidden are the elements whose own ``hidden``, ``style`` or name says so, and what closed ``details`` and ``dialog``
    hold; style sheets aren't applied. Layout, but no text, is given up in two cases: tables nested deeper than DEEPEST
    are laid out as blocks, and columns aren't padded for cells longer than WIDE.
    Null and empty html give empty text. Very long and very deep pages are walked without recursion. Rows that repeat
    give rows that repeat; an empty table gives none.
    """

    def run(batches):
        for b in pieces(batches, rows=64):
            texts = [extract(h) for h in b["html"].to_pylist()]
            yield batch(TEXTS, [b["page_id"], [t.encode("utf-8", "replace").decode() for t in texts], [t.count("\n") + 1 if t else 0 for t in texts]])

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_lines long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
