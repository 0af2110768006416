"""Main-text extraction by a tree-structured graphical model over the DOM.

Each block element has a binary label, content or not.  Node potentials come from the element, the words
of its class, id and role, the length, link share and sentence ends of its text; edge potentials tie a child to
its parent and depend on the child's element.  Sum-product messages go up from the leaves and down from
the root; a run of text is kept where the marginal of its block says content.

Potentials are trained by smoothed counts on labelled pages.  Those pages are made from a rule
(``labelled_pages``): page furniture and articles are put together in many arrangements, with a label on
every element.  Their number is a parameter, so the cost of training does not depend on the input.

Null or empty pages give an empty text; a page without content gives an empty text; repeated rows are
extracted as often as they occur.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Node, parse

PAGES = 600
# Words of class, id and role attributes, by what they speak of.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager skip toc sitemap",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox adslot adsense outbrain taboola",
    "foot": "footer foot copyright legal colophon contentinfo disclaimer imprint",
    "side": "sidebar side aside related recommended widget widgets rail complementary trending popular more teaser tags tagcloud",
    "comment": "comment comments reply replies respond disqus discussion commentlist reader readers feedback thread",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall toast dialog banner message",
    "share": "share sharing social follow facebook twitter like buttons byline meta author date",
    "head": "header head masthead logo branding topbar top brand",
    "form": "form search searchbox login register input contact field",
    "content": "content article post entry story main body text maintext articlebody prose page hentry blogpost story",
}
KIND_OF = {w: kind for kind, words in WORDS.items() for w in words.split()}
GROUPS = {
    "p": "p", "pre": "p", "blockquote": "quote", "article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header",
    "footer": "footer", "aside": "aside", "dialog": "aside", "form": "form", "fieldset": "form", "button": "form", "legend": "form",
    "section": "section", "div": "div", "center": "div", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "row", "td": "cell", "th": "cell", "figure": "figure",
    "figcaption": "caption", "caption": "caption", "address": "address", "details": "section", "summary": "heading", "html": "root",
    "body": "root", "head": "headpart", "h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@functools.lru_cache(maxsize=20_000)
def kinds(names: str) -> tuple[str, ...]:
    return tuple(sorted({KIND_OF[w] for w in (x.lower() for x in NAME.findall(names)) if w in KIND_OF}))


def evidence(node: Node, chars: int, linked: int) -> list[str]:
    """The features of a node; ``chars`` and ``linked`` are of its whole subtree."""
    found = ["g:" + GROUPS.get(node.tag, "other")]
    if node.names:
        found += ["k:" + k for k in kinds(node.names)]
    found.append(f"n:{0 if not chars else 1 + (chars > 25) + (chars > 90) + (chars > 300)}")
    found.append(f"l:{-1 if not chars else (linked > 0.1 * chars) + (linked > 0.4 * chars) + (linked > 0.8 * chars)}")
    if node.chars:
        found.append(f"s:{int(node.sentences > 0)}{int(node.chars > 60)}")
    return found


def totals(nodes: list[Node]) -> tuple[list[int], list[int]]:
    chars, linked = [n.chars for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        linked[nodes[i].parent] += linked[i]
    return chars, linked


class TreeModel:
    """Log-odds of features, and log potentials of (parent label, child label) by the child's element."""

    def __init__(self, pages: list[tuple[list[Node], list[int]]], smooth: float = 0.5):
        seen: dict[str, list[float]] = {}
        edges: dict[str, list[list[float]]] = {}
        totals_of = [smooth, smooth]
        for nodes, labels in pages:
            chars, linked = totals(nodes)
            for i, node in enumerate(nodes):
                totals_of[labels[i]] += 1
                for f in evidence(node, chars[i], linked[i]):
                    seen.setdefault(f, [smooth, smooth])[labels[i]] += 1
                if i:
                    table = edges.setdefault(GROUPS.get(node.tag, "other"), [[1.0, 1.0], [1.0, 1.0]])
                    table[labels[node.parent]][labels[i]] += 1
        self.odds = {f: math.log(n[1] / totals_of[1]) - math.log(n[0] / totals_of[0]) for f, n in seen.items()}
        self.prior = math.log(totals_of[1] / totals_of[0])
        # An edge carries how much a child's label depends on its parent's, not the child's own frequency.
        self.edges = {}
        for group, t in edges.items():
            n = t[0][0] + t[0][1] + t[1][0] + t[1][1]
            child = [(t[0][y] + t[1][y]) / n for y in (0, 1)]
            self.edges[group] = [[t[x][y] / (t[x][0] + t[x][1]) / child[y] for y in (0, 1)] for x in (0, 1)]
        self.default = [[1.6, 0.4], [0.4, 1.6]]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each node, by sum-product over the tree."""
        chars, linked = totals(nodes)
        n = len(nodes)
        odds, prior = self.odds, self.prior
        own = [0.0] * n
        for i, node in enumerate(nodes):
            total = prior
            for f in evidence(node, chars[i], linked[i]):
                total += odds.get(f, 0.0)
            own[i] = total
        tables = [self.edges.get(GROUPS.get(node.tag, "other"), self.default) for node in nodes]
        # Upward: messages as log ratios; below[i] is all evidence in i's subtree.
        below, up = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            e = math.exp(max(-60.0, min(60.0, below[i])))
            t = tables[i]
            up[i] = math.log((t[1][0] + t[1][1] * e) / (t[0][0] + t[0][1] * e))
            below[nodes[i].parent] += up[i]
        # Downward: what the rest of the tree says about i.
        whole = below[:]
        for i in range(1, n):
            rest = whole[nodes[i].parent] - up[i]
            e = math.exp(max(-60.0, min(60.0, rest)))
            t = tables[i]
            whole[i] = below[i] + math.log((t[0][1] + t[1][1] * e) / (t[0][0] + t[1][0] * e))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in whole]


def labelled_pages(count: int = PAGES, seed: int = 11) -> Iterator[tuple[list[Node], list[int]]]:
    """Pages made by rule; elements of content carry the id word ``yy``, which is taken out again."""
    rnd = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(lo, hi)))

    def sentences(lo: int, hi: int) -> str:
        return " ".join(words(4, 16).capitalize() + "." for _ in range(rnd.randint(lo, hi)))

    def named(kind: str, most: float = 0.8) -> str:
        if rnd.random() > most:
            return ""
        word = rnd.choice(WORDS[kind].split())
        return f' {rnd.choice(["class", "id"])}="{word}{rnd.choice(["", "", "-box", " wrapper"])}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def furniture(kind: str) -> str:
        n = rnd.randint(2, 9)
        if kind == "menu":
            return rnd.choice([f"<nav{named(kind, 0.4)}>{links(n)}</nav>", f"<div{named(kind, 1)}>{links(n)}</div>", f"<nav>{words(1, 3)} <a href=x>{words(1, 2)}</a></nav>"])
        if kind == "head":
            return f"<header{named(kind, 0.5)}><div{named('head', 0.5)}>{words(1, 4)}</div>{rnd.choice(['', links(n), '<p>' + words(2, 6) + '</p>'])}</header>" if rnd.random() < 0.7 else f"<div{named(kind, 1)}>{words(1, 6)}</div>"
        if kind == "foot":
            return rnd.choice([f"<footer{named(kind, 0.4)}>&copy; {words(1, 4)} &middot; {words(2, 8)}.</footer>", f"<div{named(kind, 1)}><p>{words(3, 9)}.</p>{links(n)}</div>", f"<footer><p>{sentences(1, 2)}</p></footer>"])
        if kind == "side":
            return f"<aside{named(kind, 0.6)}><h3>{words(1, 3)}</h3>{rnd.choice([links(n), '<p>' + sentences(1, 2) + '</p>'])}</aside>" if rnd.random() < 0.6 else f"<div{named(kind, 1)}><h4>{words(1, 3)}</h4>{links(n)}</div>"
        if kind == "comment":
            return f"<{(t := rnd.choice(['section', 'div', 'ol']))}{named(kind, 1)}><h3>{words(1, 2)}</h3>" + "".join(f"<div{named('comment', 0.7)}><p>{sentences(1, 4)}</p></div>" for _ in range(n)) + f"</{t}>"
        if kind == "notice":
            return f"<div{named(kind, 1)}><p>{sentences(1, 3)}</p><button>{words(1, 2)}</button></div>" if rnd.random() < 0.6 else f"<div{named(kind, 1)}>{sentences(1, 3)}</div>"
        if kind == "form":
            return f"<form{named(kind, 0.4)}><p>{words(1, 8)}</p><input name=q><button>{words(1, 2)}</button></form>"
        if kind == "share":
            return f"<div{named(kind, 1)}>{rnd.choice([links(3), words(2, 6)])}</div>"
        return rnd.choice([f"<div{named('advert', 1)}>{sentences(1, 2)}</div>", f"<aside{named('advert', 1)}><a href=x>{words(3, 9)}</a></aside>", f"<div{named('advert', 1)}><p>{sentences(1, 3)}</p></div>"])

    def block() -> str:
        kind = rnd.random()
        if kind < 0.7:
            text = sentences(1, 6) if rnd.random() < 0.85 else words(1, 12)
            if rnd.random() < 0.2:
                text += f' <a href="x">{words(1, 3)}</a> {words(1, 5)}.'
            return f'<p id="yy">{text}</p>'
        if kind < 0.78:
            return f'<h2 id="yy">{words(2, 6)}</h2>'
        if kind < 0.86:
            return '<ul id="yy">' + "".join(f'<li id="yy">{words(3, 14)}{rnd.choice(["", "."])}</li>' for _ in range(rnd.randint(2, 6))) + "</ul>"
        if kind < 0.92:
            return f'<blockquote id="yy"><p id="yy">{sentences(1, 3)}</p></blockquote>'
        if kind < 0.96:
            return '<table id="yy">' + "".join(f'<tr id="yy"><td id="yy">{words(1, 4)}</td><td id="yy">{words(1, 4)}</td></tr>' for _ in range(3)) + "</table>"
        return f'<figure id="yy"><figcaption id="yy">{words(4, 12)}.</figcaption></figure>'

    for _ in range(count):
        inside = [f'<h1 id="yy">{words(3, 9)}</h1>'] * (rnd.random() < 0.9) + [block() for _ in range(rnd.randint(1, 14))]
        if rnd.random() < 0.3:
            inside.insert(rnd.randint(1, len(inside)), furniture(rnd.choice(["advert", "share", "side", "notice"])))
        if rnd.random() < 0.25:
            inside.append(furniture("comment"))
        shell = rnd.random()
        body = "".join(inside)
        if shell < 0.5:
            body = f'<article id="yy"{named("content", 0.3)}>{body}</article>'
        elif shell < 0.7:
            body = f'<main id="yy"><div id="yy"{named("content", 0.5)}>{body}</div></main>'
        else:
            body = f'<div id="yy"{named("content", 0.9)}>{body}</div>'
        before = [furniture(k) for k in ("notice", "menu", "head", "menu", "advert", "form", "side") if rnd.random() < 0.45]
        after = [furniture(k) for k in ("share", "side", "comment", "form", "menu", "advert", "notice", "foot") if rnd.random() < 0.4]
        rnd.shuffle(before)
        page = f'<html><head><title>{words(2, 6)}</title></head><body id="yy">{"".join(before)}{body}{"".join(after)}</body></html>'
        nodes, _ = parse(page)
        labels = []
        for node in nodes:
            own = node.names.split()
            labels.append(int("yy" in own))
            node.names = " ".join(w for w in own if w != "yy")
        labels[0] = 1
        yield nodes, labels


@functools.lru_cache(maxsize=4)
def trained(count: int = PAGES, seed: int = 11) -> TreeModel:
    return TreeModel(list(labelled_pages(count, seed)))


def main_text(source: str | None, model: TreeModel | None = None) -> str:
    nodes, runs = parse(source)
    if not runs:
        return ""
    marginal = (model or trained()).marginals(nodes)
    return " ".join(run for node, run in runs if marginal[node] >= 0.5)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the kept columns, text, n_chars."""
    columns = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).cast("string").alias("__html"))
    fields = [f"`{c}` {t}" for c, t in columns.dtypes if c != "__html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trained()
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    return columns.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
