"""Main text without the names of classes and article tags, against a plain version of the ratios, and odd markup."""

import math
import re
import time
from collections import Counter, defaultdict

import pytest

from ballotlake.llm import html
from ballotlake.llm.common import table


def f1(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def bare(page):
    return re.sub(r"</?(article|main)\b[^>]*>", "", re.sub(r'\s(class|id|role)="[^"]*"', "", page))


@pytest.fixture(scope="module")
def pages(spark, data):
    return [r.html for r in table(spark, data.replace("sf0.001", "sf0.01"), "pages").collect() if r.html]


def test_ratios_find_the_article_without_names(pages):
    scores = [f1(html.main_text(bare(p)), html.main_text(p)) for p in pages]
    assert sum(scores) / len(scores) >= 0.9


def plain(page):
    """The same choice by dictionaries of path names; weights of names are the module's own."""
    tree, found = html.blocks(page)
    names = ["/"]
    for p in range(1, len(tree.tag)):
        names.append(f"{names[tree.parent[p]]}{tree.tag[p]}#{p}/")
    weight = dict(zip(names, tree.weight))
    of = defaultdict(list)
    for i, (p, *_) in enumerate(found):
        of[names[p]].append(i)
    size = [len(t) for _, t, _ in found]
    free = [max(0, n - min(n, k)) for n, (*_, k) in zip(size, found)]
    marks = [len(re.findall(r"[.,;:!?…。，]", t)) for _, t, _ in found]
    mean = lambda x, p: sum(x[i] for i in of[p]) / len(of[p])
    at = [names[p] for p, *_ in found]

    def smooth(x):
        near = lambda i: min(max(i, 0), len(x) - 1)
        return [sum(w * x[near(i + k)] for k, w in zip(range(-2, 3), (0.05, 0.2, 0.5, 0.2, 0.05))) for i in range(len(x))]

    length = smooth([math.log1p(mean(free, p)) * weight[p] for p in at])
    points = smooth([math.log1p(mean(marks, p)) * min(weight[p], 1) for p in at])
    fused = {p: mean(length, p) * (1 + mean(points, p)) * mean(free, p) / mean(size, p) * math.sqrt(min(1, weight[p])) for p in of}
    mass = {p: fused[p] * sum(free[i] for i in of[p]) for p in of}
    whole = max(1e-12, sum(mass.values()))
    inside = lambda box: sum(m for p, m in mass.items() if p.startswith(box) and p != box) / whole
    box = max((p for p in names if p == "/" or inside(p) >= html.MOST), key=lambda p: p.count("/"))
    article = sum(fused[p] * mass[p] for p in of) / whole
    keep = [fused[p] > (html.WITHIN if p.startswith(box) else html.BESIDE) * article and fused[p] > html.FLOOR for p in at]
    out = []
    for i, (p, t, k) in enumerate(found):
        head = tree.tag[p] in ("h1", "h2", "h3", "h4") and tree.weight[p] >= 1 and min(k, size[i]) < 0.7 * size[i] and i + 1 < len(keep) and keep[i + 1]
        if keep[i] or head:
            out.append(t)
    return "\n".join(out)


def test_equals_a_plain_version(pages):
    for p in pages[:120]:
        assert html.main_text(p) == plain(p) and html.main_text(bare(p)) == plain(bare(p))


def test_layouts():
    body = "".join(f"<p>Paragraph {i} tells, with some words, what happened next in the story; it is long enough.</p>" for i in range(6))
    said = "\n".join(f"Paragraph {i} tells, with some words, what happened next in the story; it is long enough." for i in range(6))
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    side = '<div class="sidebar"><h3>Related</h3><p>Another story, which is not this one, is told here at some length.</p></div>'
    for page in (
        f"<body>{menu}<div id=wrap><div class=post-content><h1>Title</h1>{body}</div>{side}</div><footer>Imprint, contact.</footer>",
        f"<body><div>{menu}</div><div><div><h1>Title</h1>{body}</div></div><div><a href=/x>More</a> <a href=/y>news</a></div>",
        f"<body><article class='post has-sidebar'><h1>Title</h1>{body}</article><section class=comments><p>I, a reader, think that this was, on the whole, a good text.</p></section>",
        f"<body><form><p>Your name, please.</p><input></form><main><h1>Title</h1>{body}<aside><p>By the way, buy this.</p></aside></main>",
    ):
        assert html.main_text(page) == f"Title\n{said}"
    assert html.main_text(f"<nav>{menu}</nav><footer>Nothing, but a footer.</footer>") == ""
    assert html.main_text("<div class=ad>Buy this, now, it is good. Buy more of it.</div>") == ""
    assert html.main_text("<p>Hi") == "Hi"


def test_nothing_of_the_article_is_dropped():
    said = html.main_text("<article><p>A formula <math><mi>x</mi></math> stays.</p><noscript><p>So does this text.</p></noscript><object><p>And that one.</p></object></article>")
    assert said == "A formula x stays.\nSo does this text.\nAnd that one."
    assert html.main_text('<article><p>See <a href="foo>the link</a> and more.</p></article>') == "See the link and more."


def test_deep_and_long_pages_take_linear_time():
    begin = time.process_time()
    html.main_text("<div>" * 100_000 + "deep, at last")
    html.main_text("".join(f"<div><b>word, {i}</div>" for i in range(40_000)))
    assert time.process_time() - begin < 20


def _article(inner: str) -> str:
    story = "".join(f"<p>Some words of a story, told at length. It goes on, and on, with commas, {k}.</p>" for k in range(6))
    return f"<html><body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article><h1>Title</h1>{story}{inner}</article><div><a href=c>More from us</a></div><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    "inner, lines",
    [
        ("<h2>References</h2><ul><li><a href=1>First source, 2019</a></li><li><a href=2>Second source</a></li></ul>", ["References", "First source, 2019", "Second source"]),
        ("<table><tr><td><a href=1>cell one</a></td><td><a href=2>cell two</a></td></tr></table>", ["cell one", "cell two"]),
        ("<p><a href=1>Only a link.</a></p>", ["Only a link."]),
        ("<ul class=related><li><a href=1>Another story</a></li></ul>", []),
    ],
)
def test_links_within_an_article_are_its_text(inner, lines):
    text = html.main_text(_article(inner)).split("\n")
    assert text[0] == "Title" and text[7:] == lines


def test_an_article_of_links_alone():
    page = "<html><body><nav><a href=a>Menu</a></nav><article><p><a href=x>linked text only</a></p><p><a href=y>and more</a></p></article><footer>foot</footer></body></html>"
    assert html.main_text(page) == "linked text only\nand more"
