"""HTML extraction (operator 2): gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant scanner builds a tree of block elements; text between block boundaries is a leaf. Each element and leaf gets
features: tag family, attribute tokens (own and inherited), subtree density (text, links, sentences, tags), depth, place
among siblings, shares of the parent's and the page's text. Boosted trees give the chance that a node belongs to, or
holds, the main text. Decoding takes the labelling of the whole tree of most likelihood in which a kept node's parent is
kept, so a choice for a node can't contradict those for its ancestors and descendants.

The trees are fitted on PAGES generated pages whose labels are known by construction: menus, headers, footers, sidebars,
notices, adverts, forms, comments and articles in varied containers, with and without telling tags and attributes.

Defined cases: null html counts as empty; no text left gives ""; scripts, styles, templates, head and form controls never
give text; unclosed and crossed tags are closed where their parents end; character references are decoded once; rows may
repeat; an empty table gives no rows; extract() keeps other columns, and replaces one that has the name of its result. Depth,
siblings and length have no bound.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.boosting import Boosted
from lodestone.llm.common import table

PAGES, SEED = 400, 7

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas object math".split())
DROPPED = RAW | frozenset("head button select option datalist".split())
#: Opening one of these closes an open one of the same list up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table div section article main aside nav header footer form body blockquote td th figure".split())

CELLS = ("td", "th")
FAMILIES = ("article main", "nav menu", "header", "footer", "aside", "form fieldset", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div section center", "table tbody thead tr td th", "figure figcaption", "body html", "#text")
_FAMILY = {t: k for k, names in enumerate(FAMILIES) for t in names.split()}
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget related recommended footer foot header masthead topbar toolbar comment comments "
    "respond reply replies disqus discussion share sharing social cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search form pagination pager tags copyright legal toc skip contentinfo complementary".split()
)
FOR = frozenset("article content main post entry story body text prose page document maincontent articlebody".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_SPLIT = re.compile(r"[^a-z]+")
_STOPS = re.compile(r"[.!?,;]")


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "kids", "text", "chars", "linked", "tags", "stops", "paragraphs", "linked_raw")

    def __init__(self, tag: str, parent: int, depth: int, tokens: list[str]):
        self.tag, self.parent, self.depth, self.tokens = tag, parent, depth, tokens
        self.kids, self.text = [], ""
        self.chars = self.linked = self.tags = self.stops = self.paragraphs = self.linked_raw = 0


def parse(source: str) -> list[Node]:
    """Nodes in document order, the root first; leaves have tag "#text" and their text, white space collapsed."""
    nodes = [Node("html", -1, 0, [])]
    stack = [0]
    places: dict[str, list[int]] = {}  # open tags -> their places on the stack, rising
    scopes: tuple[list[int], list[int]] = [], []  # places of open scopes: cells, others
    parts: list[str] = []
    linked = link_depth = 0
    inline_tags = 0

    def flush() -> None:
        nonlocal linked, inline_tags
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                leaf = Node("#text", stack[-1], len(stack), [])
                leaf.text, leaf.linked_raw, leaf.tags = text, linked, inline_tags
                nodes[stack[-1]].kids.append(len(nodes))
                nodes.append(leaf)
        linked = inline_tags = 0

    def close(k: int) -> None:
        """Closes what stands at place k and above."""
        for i in range(len(stack) - 1, k - 1, -1):
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            if tag in SCOPES:
                scopes[tag not in CELLS].pop()

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        run = source[at : m.start() if m else end]
        if run:
            parts.append(run)
            if link_depth:
                linked += len(run)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(_html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if closing else 1
            inline_tags += not closing
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            inline_tags += 1
            continue
        if closing:
            if places.get(tag):
                flush()
                link_depth = 0
                close(places[tag][-1])
            continue
        if tag in RAW:
            flush()
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = shut.end() if shut else end
            continue
        flush()
        link_depth = 0
        if tag == "html" or tag == "body" and places.get(tag):
            continue
        if tag == "body":
            close(1)
        # the lowest open element that this one closes, above the scope it stands in
        cells, others = scopes
        floor = max(others[-1] if others else 0, cells[-1] if cells and tag not in ("td", "th", "tr") else 0)
        low = [p[bisect_right(p, floor - 1)] for t in CLOSES.get(tag, {"p"}) if (p := places.get(t)) and p[-1] >= max(floor, 1)]
        low = [k for k in low if k > floor or nodes[stack[k]].tag in CLOSES.get(tag, {"p"})]
        if low:
            close(min(low))
        tokens = [t for a in _ATTR.findall(attrs) for t in _SPLIT.split("".join(a).lower()) if t] if attrs else []
        nodes[stack[-1]].kids.append(len(nodes))
        nodes.append(Node(tag, stack[-1], len(stack), tokens))
        stack.append(len(nodes) - 1)
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in SCOPES:
            scopes[tag not in CELLS].append(len(stack) - 1)
    flush()
    for n in reversed(nodes):
        if n.tag == "#text":
            n.chars, n.linked = len(n.text), min(n.linked_raw, len(n.text))
            n.stops = len(_STOPS.findall(n.text))
        n.paragraphs += n.tag in ("p", "blockquote") and n.chars > 0
        if n.parent >= 0:
            p = nodes[n.parent]
            p.chars, p.linked, p.tags, p.stops, p.paragraphs = p.chars + n.chars, p.linked + n.linked, p.tags + n.tags + (n.tag != "#text"), p.stops + n.stops, p.paragraphs + n.paragraphs
    return nodes


N_FEATURES = len(FAMILIES) * 2 + 24


def features(nodes: list[Node]):
    """One row per node."""
    import numpy as np

    x = np.zeros((len(nodes), N_FEATURES))
    total = max(nodes[0].chars, 1)
    above = [(False, False, False, False)] * len(nodes)  # ancestors: attributes against, for; boilerplate tag; article tag
    nav = {"nav", "footer", "aside", "form", "menu", "header"}
    base = len(FAMILIES) * 2
    place = {kid: (i, len(n.kids)) for n in nodes for i, kid in enumerate(n.kids)}
    alike = [Counter(nodes[s].tag for s in n.kids) for n in nodes]
    for k, n in enumerate(nodes):
        p = nodes[n.parent] if n.parent >= 0 else n
        x[k, _FAMILY.get(n.tag, 10)] = 1
        x[k, len(FAMILIES) + _FAMILY.get(p.tag, 10)] = 1
        against, for_ = sum(t in AGAINST for t in n.tokens), sum(t in FOR for t in n.tokens)
        up = above[n.parent] if n.parent >= 0 else (False,) * 4
        above[k] = (up[0] or against > 0, up[1] or for_ > 0, up[2] or n.tag in nav, up[3] or n.tag in ("article", "main"))
        i, many = place.get(k, (0, 1))
        same = alike[n.parent if n.parent >= 0 else k][n.tag]
        before = nodes[p.kids[i - 1]].chars if i else 0
        after = nodes[p.kids[i + 1]].chars if i + 1 < many else 0
        x[k, base:] = (
            against, for_, *map(float, up), bool(n.tokens), math.log1p(n.chars), n.linked / max(n.chars, 1), n.chars / (n.tags + 1), n.stops / max(n.chars, 1) * 100, math.log1p(n.tags), math.log1p(n.paragraphs), n.depth,
            i, i / many, many, same / many, n.chars / max(p.chars, 1), n.chars / total, p.linked / max(p.chars, 1), math.log1p(p.paragraphs), math.log1p(before), math.log1p(after),
        )
    return x


def decode(nodes: list[Node], margin) -> list[bool]:
    """Labels of most likelihood with every kept node's parent kept. margin: log-odds of each node."""
    gain = [0.0] * len(nodes)  # of keeping the node and the best part below it, against dropping all of it
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].tag in DROPPED or not nodes[k].chars:
            gain[k] = -math.inf
        else:
            gain[k] = float(margin[k]) + sum(g for kid in nodes[k].kids if (g := gain[kid]) > 0)
    keep = [False] * len(nodes)
    keep[0] = nodes[0].chars > 0
    for k in range(1, len(nodes)):  # parents come first
        keep[k] = keep[nodes[k].parent] and gain[k] > 0
    return keep


def main_text(sources: list[str], trees: Boosted | None = None) -> list[str]:
    """Main text of each page, by the fitted trees."""
    import numpy as np

    pages = [parse(s) for s in sources]
    if not pages:
        return []
    margins = (trees or model()).margin(np.concatenate([features(p) for p in pages]))
    out, at = [], 0
    for nodes in pages:
        keep = decode(nodes, margins[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(n.text for n, y in zip(nodes, keep, strict=True) if y and n.tag == "#text"))
    return out


# --- Generated training pages -------------------------------------------------------------------------------------


def _words(r: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, r.randint(1, 18))
        s = [r.choice("the of and on wind river stone light house early paper under after small green letter morning table wide open road sing er tion ando elle schen ing".split()) + r.choice(("", "", "er", "ing", "s", "an")) for _ in range(k)]
        out.append(s[0].capitalize() + "".join(" " + w for w in s[1:]) + r.choice((".", ".", ".", "!", "?", ",")))
        n -= k
    text, odd = " ".join(out), r.random()
    if odd < 0.04:  # odd prose is prose as well: one word again and again, shouting, signs, bars
        return " ".join([text.split()[0]] * len(text.split()))
    if odd < 0.08:
        return text.upper().replace(" ", "!! ")
    if odd < 0.12:
        return text.replace(" ", r.choice(("%% ", "$$ ", " | ")))
    return text


def generated(seed: int) -> tuple[str, list[str]]:
    """A page and the leaves of its main text in order."""
    r = random.Random(seed)
    kept: list[str] = []
    said = r.random()  # how telling tags and attributes are on this page

    def attr(names: str) -> str:
        if r.random() > 0.35 + 0.6 * said:
            return r.choice(("", "", f' class="c{r.randint(1, 99)}"'))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names.split())}{r.choice(("", "", "-box", " col-2", "-1"))}"'

    def article_text(n: int) -> str:
        t = _words(r, n)
        kept.append(t)
        return t

    def links(n: int) -> str:
        return "".join(r.choice(('<li><a href="/{0}">{0}</a></li>', '<a href="/{0}">{0}</a> ')).format(_words(r, r.randint(1, 2)).strip(".,!?")) for _ in range(n))

    def menu() -> str:
        tag = r.choice(("nav", "nav", "div", "ul"))
        inner = links(r.randint(3, 9))
        inner = f"<ul>{inner}</ul>" if tag != "ul" and r.random() < 0.7 else inner
        return f"<{tag}{attr('nav menu navbar navigation breadcrumb')}>{inner}</{tag}>"

    def advert() -> str:
        tag = r.choice(("div", "div", "aside", "section"))
        inner = _words(r, r.randint(3, 25))
        return f"<{tag}{attr('ad ads advert sponsored promo banner') or ' class=\"ad\"'}>{inner if r.random() < 0.6 else f'<p>{inner}</p>'}</{tag}>"

    def notice() -> str:
        return f"<div{attr('cookie-notice notice consent alert popup newsletter') or ' class=\"notice\"'}><p>{_words(r, r.randint(5, 30))}</p>{r.choice(('', '<button>OK</button>', '<a href=\"#\">more</a>'))}</div>"

    def form() -> str:
        return f"<form{attr('search login signup subscribe')}><label>{_words(r, 2)}</label><input name=q>{r.choice(('', f'<p>{_words(r, 6)}</p>'))}<button>Go</button></form>"

    def sidebar() -> str:
        tag = r.choice(("aside", "aside", "div"))
        return f"<{tag}{attr('sidebar widget related side') if tag == 'aside' else ' class=\"sidebar\"'}><h3>{_words(r, 2)}</h3>{'<ul>' + links(r.randint(2, 7)) + '</ul>' if r.random() < 0.7 else f'<p>{_words(r, r.randint(5, 40))}</p>'}</{tag}>"

    def comments() -> str:
        each = "".join(f"<{t}{c}>{r.choice(('', '<h4>' + _words(r, 1) + '</h4>'))}<p>{_words(r, r.randint(3, 60))}</p></{t}>" for t, c in [(r.choice(("div", "li", "article")), r.choice(("", ' class="comment"', ' class="comment reply"')))] * r.randint(1, 6))
        return f"<{(t := r.choice(('section', 'div', 'ol')))} {r.choice(('class', 'id'))}=\"{r.choice(('comments', 'comment-list', 'discussion', 'replies', 'disqus-comments'))}\"><h3>{_words(r, 2)}</h3>{each}</{t}>"

    def body() -> str:
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{article_text(r.randint(2, 9))}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind, n = r.random(), r.choice((1, 2, 5, 15, 30, 60, 120, 250))
            if kind < 0.62:
                t = article_text(n)
                if r.random() < 0.3 and " " in t:
                    a, _, b = t.partition(" ")
                    t = r.choice((f"<b>{a}</b> {b}", f'<a href="/x">{a}</a> {b}', f"{a}<br>{b}", f"<b>{a} {b}"))
                out.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}<br>", "<div>{}</div>")).format(t))
            elif kind < 0.72:
                out.append(f"<h2>{article_text(r.randint(1, 6))}</h2>")
            elif kind < 0.82:
                out.append(f"<ul>{''.join(f'<li>{article_text(r.randint(2, 14))}</li>' for _ in range(r.randint(2, 6)))}</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{article_text(n)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table>{''.join(f'<tr><td>{article_text(r.randint(1, 4))}</td><td>{article_text(r.randint(1, 4))}</td></tr>' for _ in range(r.randint(1, 4)))}</table>")
            else:
                out.append(r.choice((advert, notice))())
        return "".join(out)

    wrap = r.choice(("article", "article", "main", "div", "div", "section"))
    inner = body()
    head = f"<header{attr('header masthead topbar')}><a href=/>{_words(r, 2)}</a>{r.choice(('', f'<p>{_words(r, 5)}</p>'))}{r.choice(('', menu()))}</header>"
    content = f"<{wrap}{attr('article content post entry story main') if wrap != 'div' or r.random() < 0.4 else r.choice((' class=\"content\"', ' id=\"main\"', ' class=\"post-body\"', ''))}>{inner}{r.choice(('', '', comments()))}</{wrap}>"
    before = [f() for f in (menu, advert, notice, form, sidebar) if r.random() < 0.45]
    after = [f() for f in (comments, sidebar, advert, form, menu) if r.random() < 0.35]
    foot = r.choice((f"<footer{attr('footer copyright')}>&copy; {_words(r, r.randint(2, 14))}{r.choice(('', menu()))}</footer>", f'<div class="footer"><p>{_words(r, 8)}</p></div>', ""))
    r.shuffle(before)
    page = (head if r.random() < 0.5 else "") + "".join(before) + content + "".join(after) + foot
    if r.random() < 0.3:
        page = f"<div{attr('page wrapper container')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{page}{r.choice(('</body></html>', ''))}", kept


def labels(nodes: list[Node], kept: list[str]) -> list[int]:
    """1 for leaves of the main text and for all their ancestors. Leaves are matched in order, so equal texts elsewhere don't count."""
    y, at = [0] * len(nodes), 0
    flat = [" ".join(t.split()) for t in kept]
    for k, n in enumerate(nodes):
        if n.tag == "#text" and at < len(flat) and n.text == flat[at]:
            at += 1
            while k >= 0 and not y[k]:
                y[k] = 1
                k = nodes[k].parent
    return y


@cache
def model() -> Boosted:
    """Fitted once per process; generation and fit are deterministic."""
    import numpy as np

    xs, ys = [], []
    for seed in range(PAGES):
        source, kept = generated(SEED * 100_003 + seed)
        nodes = parse(source)
        xs.append(features(nodes))
        ys.append(labels(nodes, kept))
    return Boosted(trees=40, depth=4, rate=0.25, bins=24).fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, html: str = "html", into: str = "main_text") -> DataFrame:
    """pages with the main text of a column appended."""
    held = pages.sparkSession.sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def extracted(source: pd.Series) -> pd.Series:
        out: list[str] = []
        for lo in range(0, len(source), 64):
            out += main_text([s or "" for s in source[lo : lo + 64]], held.value)
        return pd.Series(out, dtype="object")

    return pages.withColumn(into, extracted(F.coalesce(F.col(html), F.lit(""))))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), into="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_html_extract": op2_html_extract}
ORACLES: dict[str, str] = {}
