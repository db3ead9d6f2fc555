"""A forgiving HTML reader: a tree of block nodes, each with its own text runs, for extraction and conversion."""

from __future__ import annotations

import html
import re

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; title is read apart. Where the end tag is missing, the first go on
#: to the page's end, as in browsers; the others are then passed over.
ENDLESS = frozenset("script style textarea title xmp noembed noframes".split())
RAW_TEXT = ENDLESS | frozenset("iframe noscript template svg canvas audio video object".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr caption ul".split()
)
#: A start tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "thead": {"caption"}, "body": {"head"}}
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}, "option": {"select"}, "optgroup": {"select"}}
CLOSES_P = BLOCK - frozenset("html head body button option optgroup tbody td tfoot th thead tr caption".split())


class Node:
    __slots__ = ("attrs", "depth", "kids", "links", "parent", "pieces", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str) -> None:
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.kids: list = []  # Node, or a run of text as [text, text inside links]
        self.pieces = self.links = 0


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(raw)}


def parse(page: str) -> tuple[Node, str, list[tuple[str, str]]]:
    """The tree of block nodes, the title, and (tag, address) of every link; never fails."""
    root = at = Node("#root", None, "")
    stack = [root]
    title, links, run, linked, in_link, pos = "", [], [], 0, 0, 0
    size, search = len(page), TAG.search

    def flush() -> None:
        nonlocal linked
        if run:
            text = "".join(run)
            if not text.isspace():
                at.kids.append([text, linked])
            run.clear()
        linked = 0

    while pos < size:
        m = search(page, pos)
        if m is None:
            rest = page[pos:]
            run.append(rest)
            linked += len(rest) if in_link else 0
            break
        start = m.start()
        if start > pos:
            run.append(page[pos:start])
            if in_link:
                linked += start - pos
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag == "p" or tag in BLOCK:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == tag:
                        flush()
                        del stack[n:]
                        at = stack[-1]
                        break
            elif tag == "br":
                run.append("\n")
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[pos : end.start() if end else size]).split())
            if not m[3].endswith("/") and (end or tag in ENDLESS):
                pos = end.end() if end else size
            run.append(" ")
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                run.append("\n")
            continue
        if tag == "a":
            in_link = 1
        if m[3]:
            if tag in ("a", "area", "link"):
                if (to := attributes(m[3]).get("href")) is not None:
                    links.append((tag, to))
            elif tag in ("img", "embed", "source", "iframe") and (to := attributes(m[3]).get("src")) is not None:
                links.append((tag, to))
        if tag in BLOCK:
            flush()
            in_link = in_link and tag not in ("nav", "footer", "article", "main", "body")
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == "p":
                        del stack[n:]
                        break
                    if stack[n].tag in ("td", "th", "button", "caption", "table"):
                        break
            if tag in CLOSES:
                what, wall = CLOSES[tag], BARRIER.get(tag, ())
                n = len(stack) - 1
                while n > 0 and stack[n].tag not in wall:
                    if stack[n].tag in what:
                        del stack[n:]
                    n -= 1
            at = stack[-1]
            node = Node(tag, at, m[3])
            at.kids.append(node)
            if not (m[3].endswith("/") and tag not in ("p",)):
                stack.append(node)
                at = node
    flush()
    return root, title, links


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def plain_text(root: Node) -> str:
    """All text of the page, a line for each block."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            if line := clean(x[0]):
                out.append(line)
        else:
            todo.extend(reversed(x.kids))
    return "\n".join(out)
