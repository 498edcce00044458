"""Content marginals against enumeration, extraction of the given pages, broken and odd pages."""

import html
import itertools
import math
import os
import random
import re

import pytest

from flowspark.llm import dom
from flowspark.llm.common import table

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    """What one plain page teaches, many times over."""
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=ad>Buy this.</div><article><h1>Title of it</h1><p>" + "A sentence of some length. " * 8 + "</p><p>Short one.</p></article><footer>About us.</footer></body></html>"
    nodes = dom.parse(page)
    marks = dom.own_labels(nodes)
    counts = {}
    for node, y in zip(nodes, marks):
        for f in dom.features(node):
            counts["f", f, 0, y] = counts.get(("f", f, 0, y), 0) + 500
        if node.parent >= 0:
            counts["t", node.bond, marks[node.parent], y] = counts.get(("t", node.bond, marks[node.parent], y), 0) + 500
    return dom.model_from(counts)


def test_marginals_equal_enumeration(model):
    rng = random.Random(6)
    for _ in range(30):
        nodes = [dom.Node("html", -1, "none")]
        for i in range(1, 8):
            text = "words " * rng.randrange(60) + "."
            nodes.append(dom.Node(rng.choice(["div", "p", "article", "nav", "li", "other"]), rng.randrange(i), rng.choice(["none", "bad", "good"]), [(i, text)], len(text), rng.choice([0, len(text)])))
        weight, hit = 0.0, [0.0] * len(nodes)
        for marks in itertools.product((0, 1), repeat=len(nodes)):
            w = model.root[marks[0]] + sum(model.unary[f][y] for n, y in zip(nodes, marks) for f in dom.features(n)) + sum(model.pair[n.bond][marks[n.parent]][y] for n, y in zip(nodes[1:], marks[1:]))
            weight += math.exp(w)
            for i, y in enumerate(marks):
                hit[i] += y * math.exp(w)
        assert model.marginals(nodes) == pytest.approx([h / weight for h in hit], abs=1e-9)


LONG = "This sentence is part of the story and it is long enough to be read as text. " * 3


def test_parts_that_are_no_content(model):
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header class="site-header"><h1>Site</h1><p>{LONG}</p></header>
    <nav><a href=a>A</a></nav><div id="cookie-notice"><p>{LONG}</p></div><main><article><h1>Head &amp; line</h1><p>One &lt;b&gt;\n two&nbsp;three.<br>four</p>
    <div class="advert">Buy &gt; now</div><ul><li>{LONG}<li>second item</ul><form><p>{LONG}</p><input value=x></form><script>var t = "</p>";</script><!-- <p>no</p> -->
    <blockquote>said <i>so</i></blockquote><section class="comments"><h2>Comments</h2><div><p>{LONG}</p></div></section></article></main><aside><p>{LONG}</p></aside><footer><p>{LONG}</p></footer></body></html>"""
    assert model.text(page) == "\n\n".join(["Head & line", "One <b> two three. four", LONG.strip(), "second item", "said so"])


def test_page_without_an_article_element(model):
    page = f'<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="post-content"><h2>Story</h2><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div>'
    assert model.text(page) == "\n\n".join(["Story", LONG.strip(), LONG.strip()])


BODY = f"<h1>Head</h1><p>{LONG}</p><p>Short one.</p>"
WANT = "\n\n".join(["Head", LONG.strip(), "Short one."])
AROUND = f'<nav><a href=1>Home</a></nav>%s<footer><p>{LONG}</p></footer>'


@pytest.mark.parametrize("page", [
    f'<body class="right-sidebar">{AROUND % f"<article>{BODY}</article>"}</body>', f'<body>{AROUND % f"<main class=&quot;content has-sidebar&quot;>{BODY}</main>".replace("&quot;", chr(34))}</body>',
    f'<body>{AROUND % f"<article class=@post category-legal tag-share@>{BODY}</article>".replace("@", chr(34))}</body>', f'<body><div id="page" class="no-sidebar">{AROUND % f"<article>{BODY}</article>"}</div></body>',
    f'<body><form id="aspnetForm">{AROUND % f"<article>{BODY}</article>"}</form></body>', f'<body><div class="sidebar-left widget">{AROUND % f"<main>{BODY}</main>"}</div></body>',
    f'<body>{AROUND % f"<article><div class=@legal-analysis@>{BODY}</div></article>".replace("@", chr(34))}</body>', f'<body>{AROUND % f"<article><section id=@comments-on-war@>{BODY}</section></article>".replace("@", chr(34))}</body>',
    f'<body>{AROUND % f"<div class=@entry-content@>{BODY}</div>".replace("@", chr(34))}</body>', f'<body><div><div>{AROUND % f"<main><article>{BODY}</article></main>"}</div></div></body>',
])
def test_layouts_keep_their_article(model, page):
    assert model.text(page) == WANT


@pytest.mark.parametrize("inner, want", [
    ("<ul><li>One</li><li>200 g flour</li></ul>", ["One", "200 g flour"]), ("<table><tr><td>12</td><td>kg</td></tr></table>", ["12", "kg"]), ("<dl><dt>Term</dt><dd>What it means</dd></dl>", ["Term", "What it means"]),
    ("<figure><img src=x><figcaption>A picture</figcaption></figure>", ["A picture"]), ("<details><summary>More</summary>Inside</details>", ["More", "Inside"]), ("<p><a href=x>The whole report</a></p>", ["The whole report"]),
    ("<blockquote>so</blockquote>", ["so"]), ("<pre>x = 1</pre>", ["x = 1"]), ("<h2>Next</h2>", ["Next"]), ("<ol><li><a href=x>Source</a></li></ol>", ["Source"]),
])
def test_blocks_inside_an_article_stay(model, inner, want):
    page = AROUND % f"<article><h1>Head</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article>"
    assert model.text(page) == "\n\n".join(["Head", LONG.strip(), *want, LONG.strip()])


@pytest.mark.parametrize("part", [
    '<div class="advert">Buy now.</div>', '<div class="ad-slot"><p>%s</p></div>', '<section class="comments"><div><div><p>%s</p><p>%s</p></div><div><p>%s</p></div></div></section>', '<aside><p>%s</p></aside>',
    '<form><p>%s</p></form>', '<div id="cookie-notice"><p>%s</p></div>', '<div class="related-posts"><ul><li><a href=1>%s</a></li></ul></div>', '<nav><p>%s</p></nav>', '<div class="share-buttons">Share this.</div>',
])
def test_other_parts_inside_an_article_go(model, part):
    page = AROUND % f"<article><h1>Head</h1><p>{LONG}</p>{part.replace('%s', LONG)}<p>Short one.</p></article>"
    assert model.text(page) == WANT


def test_broken_and_empty_pages(model):
    assert [model.text(p) for p in (None, "", "   ", "<", "<!-- open", "<p", "</p></div>", "<script>x")] == [""] * 3 + [model.text("<"), "", "", "", ""]
    assert model.text("<article><p><b>First line.<br><p>Second one &am</p>") == "First line.\n\nSecond one &am"
    deep = "<div>" * 20000 + "x"
    assert isinstance(model.text("<article>" + deep), str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
def test_given_pages(spark):
    pages = table(spark, DIR, "pages")
    out = dom.extract(pages, dom.fit(pages)).collect()
    for r in out:
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<p>" + "x " * 200000, None)], "page_id long, html string, name string")
    m = dom.fit(df)
    assert sorted(len(r.text) for r in dom.extract(df, m).collect()) in ([0, 0, 0], [0, 0, 399999])
    assert dom.extract(df.limit(0), m).count() == 0
