"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, then rendering of what is visible."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a head holds, and which of that have content.  Anything else ends a head whose end tag is left out.
HOLDERS = ("title", "script", "style", "noscript", "template", "noframes")
HEAD = frozenset((*HOLDERS, "base", "basefont", "bgsound", "link", "meta"))
UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas svg datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
ENDS_P = BLOCK - {"html", "body", "dd", "dt", "li", "legend", "summary"} | {"dd", "dt", "li"}
#: start tag -> elements it closes, and elements it does not look beyond
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption button object html body template".split())
STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SPACES = re.compile(r"[ \t\n\x0c\r]+")
#: Cells wider than this are not padded, so a table grows with its text, not with rows x widest cell.
WIDEST_PAD = 40


class Node:
    __slots__ = ("tag", "hidden", "start", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        style = {k.lower(): v.lower() for k, v in STYLE.findall(attrs.get("style") or "")}
        self.hidden = (
            tag in UNSEEN
            or "hidden" in attrs
            or style.get("display") == "none"
            or style.get("visibility") in ("hidden", "collapse")
            or tag == "input"
            or tag == "dialog" and "open" not in attrs
        )
        number = attrs.get("start") or ""
        self.start = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1


class Builder(HTMLParser):
    """Tree of a page.  End tags that the standard lets authors leave out are implied; stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", {}, None)
        self.open: dict[str, int] = {}

    def _leave(self, node: Node) -> None:
        """Close everything up to and with `node`."""
        while True:
            self.open[self.here.tag] = self.open.get(self.here.tag, 1) - 1
            closed, self.here = self.here, self.here.parent or self.root
            if closed is node or closed is self.root:
                return

    def _close(self, tags, stop) -> None:
        """Close the outermost of `tags` that is open inside the nearest of `stop`."""
        if not any(self.open.get(t) for t in tags):
            return
        found, node = None, self.here
        while node is not self.root and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self._leave(found)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in ("html", "body"):
            if tag == "body":
                self._close({"head"}, ())
            if "hidden" in attrs:
                self.root.hidden = True
            return
        if tag == "head":
            attrs = {}
        elif self.open.get("head") and (tag in BLOCK or tag not in HEAD and not self._held()):
            self._close({"head"}, ())  # it cannot be in the head
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("td", "th") and self.here.tag in ("table", "tbody", "thead", "tfoot"):
            self._enter(Node("tr", {}, self.here))
        node = Node(tag, attrs, self.here)
        if tag in VOID:
            self.here.children.append(node)
        else:
            self._enter(node)

    def _enter(self, node: Node) -> None:
        self.here.children.append(node)
        self.here = node
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.here.children.append(Node("br", {}, self.here))
        elif self.open.get(tag):
            node, stop = self.here, {"table", "td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else ()
            while node is not self.root and node.tag != tag and node.tag not in stop:
                node = node.parent
            if node is not self.root and node.tag == tag:
                self._leave(node)

    def _held(self) -> bool:
        """Inside an element of the head that has content of its own."""
        return any(self.open.get(t) for t in HOLDERS)

    def handle_data(self, data):
        if self.open.get("head") and data.strip(" \t\n\f\r") and not self._held():
            self._close({"head"}, ())  # text cannot be in the head
        self.here.children.append(data)


class Flow:
    """Lines of a block: inline text gathers with collapsed spaces, blocks break lines, spaced blocks leave a gap."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap, self.indent, self.mark = False, "", ""

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *more = data.split("\n")
            self.words.append(first)
            for line in more:
                self.end(force=True)
                self.words.append(line)
        else:
            data = SPACES.sub(" ", data)
            if data == " " or data.startswith(" "):
                if not self.words or self.words[-1].endswith(" "):
                    data = data[1:]
            if data:
                self.words.append(data)

    def end(self, force: bool = False) -> None:
        line = "".join(self.words).rstrip(" ")
        self.words = []
        if line or self.mark or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.mark + line).rstrip(" "))
            self.indent, self.mark = self.indent + " " * len(self.mark), ""

    def block(self, lines: list[str]) -> None:
        self.end()
        for line in lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((self.indent + self.mark + line).rstrip(" "))
            self.indent, self.mark = self.indent + " " * len(self.mark), ""


def _grid(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells, each a list of lines, with the columns aligned."""
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            wide = max((len(x) for x in cell), default=0)
            widths += [0] * (i + 1 - len(widths))
            if wide <= WIDEST_PAD:
                widths[i] = max(widths[i], wide)
    out = []
    for row in rows:
        for k in range(max((len(c) for c in row), default=0)):
            cells = [(c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths)]
            out.append(" | ".join(cells).rstrip(" |") if k else " | ".join(cells).rstrip(" "))
    return out


def render(page: str) -> str:
    """All visible text of a page, block by block."""
    builder = Builder()
    builder.feed(page)
    builder.close()
    flows = [Flow()]
    tables: list[list] = []
    lists: list[list] = []
    pre = 0
    work: list[tuple] = [("enter", builder.root)]
    while work:  # no recursion: pages nest as deep as they like
        step, node = work.pop()
        flow = flows[-1]
        if step == "enter":
            if isinstance(node, str):
                flow.text(node, pre > 0)
                continue
            tag = node.tag
            if node.hidden:
                continue
            if tag == "br":
                flow.end(force=True)
                continue
            state = None
            if tag in BLOCK:
                flow.end()
                flow.gap |= tag in SPACED and not lists
            if tag == "hr":
                continue
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", node.start])
            elif tag in ("li", "dd"):
                state = flow.indent
                if tag == "dd":
                    flow.indent += "  "
                elif lists and lists[-1][0]:
                    flow.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    flow.mark = "- "
            elif tag == "table":
                tables.append([])
                state = (lists, pre)
                lists, pre = [], 0
                flows.append(Flow())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Flow())
            work.append((("leave", state), node))
            work.extend(("enter", c) for c in reversed(node.children))
            continue
        tag, state = node.tag, step[1]
        if tag in ("td", "th", "caption") and tables:
            cell = flows.pop()
            cell.end()
            if tag == "caption":
                flows[-1].block(cell.lines)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append(cell.lines)
        elif tag == "table":
            loose = flows.pop()  # text of a table outside its cells comes before it
            loose.end()
            lists, pre = state
            flows[-1].block(loose.lines + _grid(tables.pop()))
            flows[-1].gap |= not lists
        elif tag in BLOCK:
            flow.end()
            flow.gap |= tag in SPACED and not lists
            if tag == "pre":
                pre -= 1
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                flow.gap |= not lists
            elif tag in ("li", "dd"):
                flow.indent, flow.mark = state, ""
    flows[0].end()
    return "\n".join(flows[0].lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of each page's whole HTML.

    Null HTML gives null text and no lines, a page without visible text an empty one.  Repeated rows each keep their row;
    no shuffle; other columns of `pages` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch, "html"):
                texts = [None if h is None else render(h) for h in part.column("html").to_pylist()]
                lines = [0 if not t else t.count("\n") + 1 for t in texts]
                yield frame({"page_id": (part.column("page_id"), None), "text": (texts, pa.string()), "n_lines": (lines, pa.int64())})

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, text string, n_lines long")
