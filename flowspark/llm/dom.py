"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements; each node is content or not. A node's features (link share, length, sentence ends,
what its class and id say) speak for either; a potential for each tag ties a node to its parent. Sum-product messages, first
from the leaves upward, then from the root downward, give each node's marginal; the text of nodes above one half is kept.

The potentials are counted on labelled pages: pages with an ``article`` or ``main`` element mark their own content, less the
parts whose tag names something else. Pseudo-counts carry what is known beforehand, and give way to counts: children mostly follow
their parent, also those of tags no page has shown; menus, asides, forms, notices, adverts and comments are no content. What the names of an
element say is evidence about that element alone; an element that holds an article is never put aside for its name.

Defined cases: a null or empty page has no text; broken markup is read as far as it goes (missing end tags, stray end tags,
an unclosed comment); a page without text gives the empty text; without labelled pages the pseudo-counts decide alone;
repeated rows each give a row; an empty table gives an empty result; other columns are kept. No page is cut.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose inside is never shown as text.
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea datalist".split())
RAW = frozenset("script style title textarea iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BLOCKS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary address nav header footer aside form fieldset dialog menu center button hgroup search other".split()
OTHER_PARTS = frozenset("nav header footer aside form dialog menu button search fieldset".split())
BAD = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice alert subscribe subscription newsletter signup login register share sharing social related recommended recommendations sidebar side aside widget menu nav navigation navbar breadcrumb breadcrumbs toolbar header masthead footer copyright legal disclaimer comment comments commentlist disqus reply replies respond discussion reviews pagination pager tags meta byline toc skip search form".split())
GOOD = frozenset("article content post entry main story body text prose maincontent articlebody".split())

#: Words that say nothing about what an element holds, and words that say what a page has or lacks elsewhere.
NEUTRAL = frozenset("site page main left right top bottom box block blocks list lists item items wrap wrapper container area section slot bar link links inner outer global primary secondary post posts story article articles content column col row panel button buttons group unit holder region the a new more js mobile desktop fixed sticky".split())
ELSEWHERE = frozenset("has no with without is not".split())

_TOKEN = re.compile(r"<!--(?:.*?-->|.*$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_NAME = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    hint: str
    runs: list[tuple[int, str]] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    apart: bool = False  # names something else than content
    within: bool = False  # below an element that does

    @property
    def bond(self) -> str:
        """Name of the potential that ties the node to its parent."""
        return f"{self.tag}/apart" if self.apart else f"{self.tag}/within" if self.within else self.tag


def _hint(tag: str, attrs: str) -> str:
    """What the names of an element say about itself: every word of a name must agree that it is no content."""
    if not attrs.strip() or tag in ("html", "body", "main", "article"):
        return "none"
    bad = False
    for name, value in _ATTR.findall(attrs):
        if name.lower() not in ("class", "id", "role", "itemprop", "aria-label"):
            continue
        for one in html.unescape(value).strip("\"'").split():
            said = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
            if any(w in ELSEWHERE for w in said):
                continue
            if any(w in GOOD for w in said) and not any(w in BAD for w in said):
                return "good"
            bad |= any(w in BAD for w in said) and all(w in BAD or w in NEUTRAL or w in GOOD for w in said)
    return "bad" if bad else "none"


def _settle(nodes: list[Node]) -> None:
    """Which nodes name something else than content. What holds an article or main element is no such part, whatever its name."""
    holds = [False] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        holds[nodes[i].parent] |= holds[i] or nodes[i].tag in ("article", "main")
    for i, node in enumerate(nodes[1:], 1):
        above = nodes[node.parent]
        node.apart = (node.tag in OTHER_PARTS or node.hint == "bad") and not holds[i]
        node.within = not node.apart and (above.apart or above.within) and node.tag not in ("article", "main")


def parse(page: str | None) -> list[Node]:
    """Block nodes in page order; each holds its text runs with their order in the page."""
    nodes = [Node("html", -1, "none")]
    stack: list[tuple[str, int]] = [("html", 0)]
    parts: list[str] = []
    state = {"run": 0, "links": 0, "link_chars": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            node = nodes[stack[-1][1]]
            node.runs.append((state["run"], text))
            node.chars += len(text)
            node.linked += min(state["link_chars"], len(text))
            state["run"] += 1
        parts.clear()
        state["link_chars"] = 0

    page = page or ""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, tag, attrs, text = m.groups()
        if text is not None:
            said = html.unescape(text)
            parts.append(said)
            if state["links"]:
                state["link_chars"] += len(said.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not closing and tag in HIDDEN:
            if attrs.rstrip().endswith("/") and tag not in RAW:
                continue
            if tag in ("head", "svg", "math", "object", "canvas", "audio", "video", "select", "datalist", "template"):
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)" + (r"|(?=<body\b)" if tag == "head" else ""), re.I)
            else:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I)
            end = stop.search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            state["links"] = 0 if closing else 1
            continue
        if tag in INLINE:
            if tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        if tag in HIDDEN:
            continue
        flush()
        state["links"] = 0
        if tag == "html":
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        while stack[-1][0] == "p" and len(stack) > 1:
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPE.get(tag, ()):
                    break
        nodes.append(Node(tag if tag in BLOCKS else "other", stack[-1][1], _hint(tag, attrs)))
        stack.append((tag, len(nodes) - 1))
    flush()
    _settle(nodes)
    return nodes


def features(node: Node) -> tuple[str, ...]:
    """The discrete features of a node, each with its kind."""
    if not node.chars:
        return (f"hint={node.hint}",)
    share = node.linked / node.chars
    size = sum(node.chars >= x for x in (20, 80, 250))
    ends = sum(t[-1] in ".!?:…\"”»" for _, t in node.runs) * 2 >= len(node.runs)
    return f"hint={node.hint}", f"links={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}", f"size={size}", f"ends={int(ends)}"


KINDS = {"hint": 3, "links": 4, "size": 4, "ends": 2}
#: Pseudo-counts (of 0, of 1) known before any page is seen; they don't grow with the pages and give way to them.
PRIOR = {"hint=bad": (60.0, 0.2), "hint=good": (0.5, 4.0), "links=3": (8.0, 0.5), "size=3": (1.0, 4.0), "size=2": (1.0, 2.0), "ends=1": (1.0, 3.0)}
STAY, CHANGE = 300.0, 1.0
#: Share of an even distribution in what the pages teach about the text of a single node: a short line or a list item that no page had in its article stays possible.
EVEN = 0.3
#: Elements that may begin the content inside something else; for all others, and below elements that name something else, that is ``SETTLED`` times less likely.
CONTAINERS = frozenset("body main article section div other td table center".split())
BEGIN, SETTLED = 30.0, 100.0


@dataclass
class Model:
    """Logarithms: ``unary[feature] = (not content, content)``, ``pair[bond][parent][own]``, ``root``."""

    unary: dict[str, tuple[float, float]]
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of content for each node by one upward and one downward sweep."""
        n = len(nodes)
        own = [[0.0, 0.0] for _ in range(n)]
        for i, node in enumerate(nodes):
            for f in features(node):
                u = self.unary.get(f, (0.0, 0.0))
                own[i][0] += u[0]
                own[i][1] += u[1]
        own[0][0] += self.root[0]
        own[0][1] += self.root[1]
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            t = self.pair[nodes[i].bond]
            up[i] = (_sum(own[i][0] + t[0][0], own[i][1] + t[0][1]), _sum(own[i][0] + t[1][0], own[i][1] + t[1][1]))
            p = own[nodes[i].parent]
            p[0] += up[i][0]
            p[1] += up[i][1]
        # own[i] now holds a node with all below it; full[i] also has all above
        full = [tuple(own[0])] + [(0.0, 0.0)] * (n - 1)
        for i in range(1, n):
            t, above, mine = self.pair[nodes[i].bond], full[nodes[i].parent], up[i]
            a, b = above[0] - mine[0], above[1] - mine[1]
            x, y = own[i][0] + _sum(a + t[0][0], b + t[1][0]), own[i][1] + _sum(a + t[0][1], b + t[1][1])
            top = max(x, y)
            full[i] = (x - top, y - top)
        return [1.0 / (1.0 + math.exp(min(700.0, f[0] - f[1]))) for f in full]

    def text(self, page: str | None) -> str:
        """Kept runs in page order, joined by two line feeds."""
        nodes = parse(page)
        kept = [run for node, m in zip(nodes, self.marginals(nodes)) if m > 0.5 for run in node.runs]
        return "\n\n".join(t for _, t in sorted(kept))


def _sum(a: float, b: float) -> float:
    top = a if a > b else b
    return top + math.log1p(math.exp(-abs(a - b)))


def own_labels(nodes: list[Node]) -> list[int] | None:
    """Content marks of a page that names its article; None for others."""
    found, marks = False, [0] * len(nodes)
    for i, node in enumerate(nodes):
        starts = node.tag in ("article", "main")
        found |= starts
        inside = starts or (node.parent >= 0 and marks[node.parent] == 1)
        marks[i] = int(inside and (node.tag not in OTHER_PARTS or starts))
    return marks if found else None


def model_from(counts: dict[tuple[str, str, int, int], int]) -> Model:
    """Smoothed logarithms of the counts (kind, name, parent or 0, own)."""
    unary = {}
    for kind, n in KINDS.items():
        names = [f"{kind}={v}" for v in (("bad", "good", "none") if kind == "hint" else range(n))]
        both = {f: [float(counts.get(("f", f, 0, y), 0)) + 1.0 + PRIOR.get(f, (0.0, 0.0))[y] for y in (0, 1)] for f in names}
        total = [sum(v[y] for v in both.values()) for y in (0, 1)]
        even = 0.0 if kind == "hint" else EVEN
        unary |= {f: tuple(math.log((1 - even) * v[y] / total[y] + even / len(names)) for y in (0, 1)) for f, v in both.items()}
    pair = {}
    for tag in BLOCKS:
        for bond in (tag, f"{tag}/apart", f"{tag}/within"):
            rows = []
            for above in (0, 1):
                if bond.endswith("/apart"):
                    prior = [STAY, 0.03]
                elif above:
                    prior = [CHANGE, STAY]
                elif tag in ("article", "main"):
                    prior = [CHANGE, BEGIN]
                elif tag in CONTAINERS and bond == tag:
                    prior = [BEGIN, CHANGE]
                else:
                    prior = [BEGIN * SETTLED, CHANGE]
                c = [float(counts.get(("t", bond, above, y), 0)) + prior[y] for y in (0, 1)]
                rows.append((math.log(c[0] / sum(c)), math.log(c[1] / sum(c))))
            pair[bond] = (rows[0], rows[1])
    return Model(unary, pair, (math.log(0.95), math.log(0.05)))


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = 20_000) -> Model:
    """Count the potentials on about ``max_pages`` pages that label themselves, chosen by a hash of the page.

    The counts have one row per feature, tag and marks, a number fixed by the lists above.
    """
    page = F.col(html_col)
    labelled = pages.where(F.lower(page).rlike("<(article|main)[\\s>]")).select(page.alias("html"))
    have = labelled.count()
    if not have:
        return model_from({})
    draw = F.pmod(F.xxhash64("html"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for page in b["html"]:
                nodes = parse(page)
                marks = own_labels(nodes)
                if marks is None:
                    continue
                for node, y in zip(nodes, marks):
                    for f in features(node):
                        seen["f", f, 0, y] += 1
                    if node.parent >= 0:
                        seen["t", node.bond, marks[node.parent], y] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "name", "above", "own", "n"])

    rows = labelled.where(draw < min(1.0, max_pages / have)).mapInPandas(count, "kind string, name string, above int, own int, n long")
    return model_from({(r["kind"], r["name"], r["above"], r["own"]): r["n"] for r in rows.groupBy("kind", "name", "above", "own").agg(F.sum("n").alias("n")).collect()})


def extract(pages: DataFrame, model: Model, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page."""

    def texts(page: pd.Series) -> pd.Series:
        return pd.Series([model.text(p) for p in page], dtype=object)

    return pages.withColumn(out_col, F.pandas_udf(texts, "string")(F.col(html_col)))
