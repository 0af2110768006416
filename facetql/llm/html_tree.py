"""A small, forgiving HTML reader: block elements as a tree, text as runs in page order.

Inline elements do not make nodes; their text belongs to the block around them, and what stands inside
links is counted.  Comments, scripts, styles and other raw-text elements are skipped.  Start tags close
what they imply (a block start closes a paragraph, an item closes an item, and so on); end tags close the
nearest open element of that name; what is still open at the end is closed there.
"""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Elements by role, after the HTML standard.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var picture audio video canvas map meter output progress object"
    " svg g text tspan math semantics annotation mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder mstyle mspace".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


class Node:
    __slots__ = ("tag", "parent", "names", "chars", "linked", "sentences")

    def __init__(self, tag: str, parent: int, names: str):
        self.tag, self.parent, self.names = tag, parent, names
        self.chars = self.linked = self.sentences = 0


def parse(source: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (a parent stands before its children), and runs of text as (node, text)."""
    nodes = [Node("html", -1, "")]
    runs: list[tuple[int, str]] = []
    if not source:
        return nodes, runs
    stack = [0]
    parts: list[str] = []
    links = pos = 0
    end = len(source)
    lowered = None

    def text(piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        parts.append(piece)
        if links:
            nodes[stack[-1]].linked += len(piece.strip())

    def flush() -> None:
        if parts:
            run = " ".join("".join(parts).split())
            parts.clear()
            if run:
                node = nodes[stack[-1]]
                node.chars += len(run)
                node.sentences += run[-1] in ".!?…:\"”»。"
                runs.append((stack[-1], run))

    while pos < end:
        m = TOKEN.search(source, pos)
        if m is None:
            text(source[pos:])
            break
        if m.start() > pos:
            text(source[pos : m.start()])
        pos = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if tag in INLINE:
                links -= tag == "a" and links > 0
            elif tag == "br":
                parts.append(" ")
            elif tag == "p" and all(nodes[i].tag != "p" for i in stack):
                flush()
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        flush()
                        del stack[depth:]
                        links = 0
                        break
            continue
        if tag in INLINE:
            links += tag == "a" and not links
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "hr", "img", "input"):
                parts.append("" if tag == "wbr" else " ")
            if tag == "hr":
                flush()
            continue
        rest = m.group(3) if m.group(2) else m.group(6)
        if tag in RAW:
            if not rest.endswith("/"):
                if lowered is None:
                    lowered = source.lower() if len(source.lower()) == end else re.sub("[A-Z]", lambda x: x[0].lower(), source)
                close = lowered.find(f"</{tag}", pos)
                stop = lowered.find(">", close) if close >= 0 else -1
                pos = stop + 1 if stop >= 0 else end
            parts.append(" ")
            continue
        flush()
        links = 0
        if tag == "html":
            continue
        if nodes[stack[-1]].tag == "p":
            stack.pop()
        if tag in CLOSES:
            closed, stops = CLOSES[tag], STOPS.get(tag, ())
            for depth in range(len(stack) - 1, 0, -1):
                own = nodes[stack[depth]].tag
                if own in stops:
                    break
                if own in closed:
                    del stack[depth:]
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
        names = " ".join(x[1] or x[2] or x[3] for x in ATTRIBUTE.findall(rest)) if "=" in rest else ""
        nodes.append(Node(tag, stack[-1], names))
        if not rest.endswith("/"):
            stack.append(len(nodes) - 1)
    flush()
    return nodes, runs


NAMED = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def title_and_links(source: str | None) -> tuple[str | None, list[str]]:
    """The first title outside drawings, and the href of links in page order; comments and raw text hold neither."""
    title, links, drawings, pos = None, [], 0, 0
    source = source or ""
    while m := TOKEN.search(source, pos):
        pos = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        closing = m.group(1) or m.group(4)
        rest = m.group(3) if m.group(2) else m.group(6) or ""
        if tag == "svg" and not rest.endswith("/"):
            drawings = max(0, drawings + (-1 if closing else 1))
        if closing or not tag:
            continue
        if tag in ("a", "area", "link"):
            href = next((x[2] or x[3] or x[4] or "" for x in NAMED.finditer(rest) if x[1].lower() == "href"), None)
            if href is not None:
                links.append(html.unescape(href))
        elif tag in RAW and not rest.endswith("/"):
            end = re.compile(f"</{re.escape(tag)}", re.I).search(source, pos)
            stop = end.start() if end else len(source)
            if tag == "title" and title is None and not drawings:
                title = " ".join(html.unescape(source[pos:stop]).split())
            pos = stop
    return title, links


def plain_text(source: str | None, separator: str = "\n") -> str:
    """All visible text, a line for each block."""
    return separator.join(run for _, run in parse(source)[1])
