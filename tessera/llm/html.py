"""Layout-aware rendering of HTML to text.

A tree builder with implied tags makes a tree of any input; a renderer walks it with an explicit stack (depth
has no limit) and writes the visible text: blocks on lines of their own, paragraphs and headings set off by an
empty line, list items marked and indented, table cells padded to columns, preformatted text as it is.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object svg math datalist audio video canvas select textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol section summary table tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure".split())
CLOSES_P = BLOCK | frozenset("p h1 h2 h3 h4 h5 h6 pre".split()) - frozenset(["body", "html", "caption", "tr"])
#: Start tags that end an open element (the key), unless one of the second set lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Start tags that leave an open head open; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_TOKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
#: Elements that an open paragraph is not seen through.
P_SCOPE = frozenset(["td", "th", "table", "li", "dd", "button", "object"])
#: Cells are padded to the longest one of their column, of those up to so many characters.
WIDE = 80
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def build(html: str) -> Node:
    """The tree of a page.  Unmatched end tags are dropped, open elements end where their parent ends.

    Of each open element is known which open paragraph it sees, and of each tag how many are open, so a tag that closes
    nothing costs no walk up the path.
    """
    root = Node("#root")
    path, paragraph, opened = [root], [0], Counter()
    at, size = 0, len(html)

    def push(node: Node) -> None:
        path[-1].children.append(node)
        paragraph.append(len(path) if node.tag == "p" else 0 if node.tag in P_SCOPE else paragraph[-1])
        path.append(node)
        opened[node.tag] += 1

    def cut(k: int) -> None:
        for node in path[k:]:
            opened[node.tag] -= 1
        del path[k:], paragraph[k:]

    def end_head() -> None:
        if path[-1].tag == "head":
            cut(len(path) - 1)

    def text(piece: str) -> None:
        if piece.strip(" \t\r\n\f"):
            end_head()
        if piece:
            path[-1].children.append(piece)

    def close(tags: frozenset, limits: frozenset) -> None:
        """End the open elements of these tags, as far as the first of the limits."""
        again = any(opened[t] for t in tags)
        while again:
            again = False
            for k in range(len(path) - 1, 0, -1):
                if path[k].tag in tags:
                    cut(k)
                    again = any(opened[t] for t in tags)
                    break
                if path[k].tag in limits:
                    break

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(unescape(html[at:]))
            break
        text(unescape(html[at:lt]))
        if html.startswith(("<!", "<?"), lt):
            mark = "-->" if html.startswith("<!--", lt) else ">"
            end = html.find(mark, lt + 2)
            at = end + len(mark) if end >= 0 else size
            continue
        m = _TOKEN.match(html, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "br":
                end_head()
                path[-1].children.append(Node("br"))
            elif tag == "p" and not opened["p"]:
                path[-1].children.append(Node("p"))
            elif opened[tag]:
                for k in range(len(path) - 1, 0, -1):
                    if path[k].tag == tag:
                        cut(k)
                        break
                    if path[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if tag not in IN_HEAD:
            end_head()
        if tag in CLOSES_P and paragraph[-1]:
            cut(paragraph[-1])
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and path[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr"))
        node = Node(tag, m.group(3) or "")
        if tag in VOID:
            path[-1].children.append(node)
        elif tag in RAW:
            path[-1].children.append(node)
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else size
            body = html[at:stop]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            gt = html.find(">", stop) if end else -1
            at = gt + 1 if gt >= 0 else size
        else:
            push(node)
    return root


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs or not node.attrs.strip(" /"):
        return True
    attrs = attributes(node.attrs)
    return "hidden" not in attrs and not _UNSEEN.search(attrs.get("style", ""))


class _Writer:
    """Lines of text with collapsed white space."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.mark = ""

    def text(self, s: str) -> None:
        flat = _WHITE.sub(" ", s)
        if flat.strip(" "):
            if self.gap and not self.line and self.lines:
                self.lines.append("")
            if not self.line:
                self.gap = False
                self.line.append(self.mark)
                self.mark = " " * len(self.mark)
                flat = flat.lstrip(" ")
            elif self.space:
                flat = " " + flat.lstrip(" ")
            self.line.append(flat.rstrip(" "))
            self.space = flat.endswith(" ")
        elif flat and self.line:
            self.space = True

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False

    def blank(self) -> None:
        self.newline()
        self.gap = bool(self.lines)

    def verbatim(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                if self.line:
                    self.newline()
                else:
                    self.lines.append("")
            if part:
                if self.gap and not self.line and self.lines:
                    self.lines.append("")
                self.gap = False
                self.line.append(part)

    def result(self) -> str:
        self.newline()
        return "\n".join(x.rstrip() for x in self.lines).strip("\n")


def _aligned(rows: list[list[str]]) -> list[str]:
    """Rows with their cells in columns; a cell of more than WIDE characters is whole, and pads no other."""
    widths: list[int] = []
    for row in rows:
        for j, cell in enumerate(row):
            if j == len(widths):
                widths.append(0)
            widths[j] = max(widths[j], len(cell) if len(cell) <= WIDE else 0)
    return [" | ".join(cell.ljust(widths[j]) for j, cell in enumerate(row)).rstrip() for row in rows]


def render(html: str | None) -> str | None:
    """Visible text of a page; null stays null."""
    if html is None:
        return None
    writers, tables, lists, pre = [_Writer()], [], [], 0
    stack: list = [(build(html), False)]
    while stack:
        node, leaving = stack.pop()
        out = writers[-1]
        if isinstance(node, str):
            if pre:
                out.verbatim(node)
            elif not (tables and len(tables) == len([w for w in writers if w is not None]) and not node.strip()):
                out.text(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if tag == "br":
                if out.line:
                    out.newline()
                continue
            if tag in SPACED:
                out.blank()
            elif tag in BLOCK:
                out.newline()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, 0, out.mark])
            elif tag == "li":
                kind, number, indent = lists[-1] if lists else ["ul", 0, out.mark]
                if lists:
                    lists[-1][1] = number + 1
                out.mark = indent + (f"{number + 1}. " if kind == "ol" else "- ")
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                writers.append(_Writer())
            stack.append((node, True))
            stack += [(child, False) for child in reversed(node.children)]
            continue
        if tag in ("td", "th") and tables and len(writers) > 1:
            cell = writers.pop().result()
            tables[-1][-1].append(" / ".join(x.strip() for x in cell.split("\n") if x.strip()))
            continue
        if tag == "table":
            rows = [r for r in tables.pop() if any(r)]
            out.blank()
            for line in _aligned(rows):
                out.verbatim(line)
                out.newline()
        if tag == "pre":
            pre -= 1
        if tag in ("ul", "ol", "menu", "dir") and lists:
            out.mark = lists.pop()[2]
        elif tag == "li":
            out.newline()
            out.mark = lists[-1][2] if lists else ""
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            out.blank()
        elif tag in BLOCK:
            out.newline()
    while len(writers) > 1:
        cell = writers.pop().result()
        writers[-1].text(cell)
    return writers[0].result()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; a null page has null text and no characters."""

    def run(batches):
        for batch in batches:
            texts = [render(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x or "") for x in texts], pa.int64())})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
