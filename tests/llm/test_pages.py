"""Main text by minimum cut: cuts and whole pages against all labellings, pages of several shapes, held-out pages without marks."""

import html
import itertools
import os
import random
import re
import time

import pytest

from depotlane.llm import pages as p

PLAIN = p.Model(p.fit_weights([]), {})
#: Edges as strong as a fit makes those whose ends always agree.
STRONG = p.Model(PLAIN.weights, p.fit_edges({(d, same, False): (1000, 0) for d in range(p.STEPS) for same in (False, True)}))


def cost(unary, links, keep):
    return sum(max(0, u) if not k else max(0, -u) for u, k in zip(unary, keep)) + sum(w for a, b, w in links if keep[a] != keep[b])


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(120):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-4, 4) for _ in range(n)]
        links = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(cost(unary, links, k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(unary, links, p.content_side(unary, links)) - best) < 1e-6


PROSE = "A long sentence of the article, which says something. And another one, too, for good measure. "
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='ads-free page'>"
    "<header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>About &amp; more</a></ul></nav><div class='cookie-notice'>We use cookies.</div>"
    "<article><h1>Title &lt;1&gt;</h1><p>One <b>bo</b>ld\n  text &eacute;&#233;<br>two<p>" + PROSE + "<div class=ad>Buy!</div><form>Name<input></form><p>Last.</p>"
    "<section id='comments'><p>" + PROSE + "</p></section></article><aside><p>" + PROSE + "</p></aside><footer>&copy; me</footer>"
)


def test_page():
    text = p.main_text(PAGE, PLAIN)
    assert text == "Title <1> One bold text éé two " + PROSE.strip() + " Last."


def test_frame(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + PROSE * 3), (4, "w", "<nav>only menu</nav>"), (5, "z", "< & <<p x='")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in p.extract(df).collect()}
    assert got[1].startswith("Title <1> One") and got[2] == got[None] == got[4] == "" and len(got) == 6
    assert p.extract(df.limit(0)).count() == 0


def made(rng, depth=0):
    """Markup of a random tree, and its blocks as (path of element numbers, text)."""
    count = itertools.count(1)

    def grow(path, depth):
        tag = rng.choice(["div", "section", "ul", "aside", "article"] if depth < 4 else ["p"])
        here, out, found = (*path, next(count)), "", []
        if tag == "p":
            text = rng.choice(["One.", "menu", PROSE.strip(), PROSE.strip() * 3])
            return f"<p>{text}</p>", [(here, text)]
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.6:
                leaf, text = (*here, next(count)), rng.choice(["Two.", "click", PROSE.strip()])
                out, found = out + f"<p>{text}</p>", [*found, (leaf, text)]
            else:
                more, blocks = grow(here, depth + 1)
                out, found = out + more, found + blocks
        return f"<{tag}>{out}</{tag}>", found

    parts = [grow((), 0) for _ in range(rng.randint(1, 3))]
    return "".join(m for m, _ in parts), [b for _, found in parts for b in found]


def test_pages_against_all_labellings():
    rng, changed = random.Random(4), 0
    for _ in range(150):
        markup, blocks = made(rng)
        if len(blocks) > 10:
            continue
        page = p.parse(markup)
        assert [b.text() for b in page.blocks] == [t for _, t in blocks]
        wanted = {}
        for i, (a, _) in enumerate(blocks):
            for j in {i - 1, max((k for k in range(i) if blocks[k][0][:-1] == a[:-1]), default=-1)} - {-1}:
                b = blocks[j][0]
                wanted[j, i] = min(p.STEPS - 1, max(0, len(a) + len(b) - 2 * sum(x == y for x, y in zip(a, b)) - 2))
        assert {(a, b): d for a, b, d in page.edges} == wanted
        unary, links = p.costs(page, STRONG)
        ways = sorted((cost(unary, links, k), k) for k in itertools.product((False, True), repeat=len(blocks)))
        if len(ways) > 1 and ways[1][0] - ways[0][0] > 1e-6:
            assert p.main_text(markup, STRONG) == " ".join(t for (_, t), k in zip(blocks, ways[0][1]) if k)
            changed += any((u > 0) != k for u, k in zip(unary, ways[0][1]))
    assert changed > 5  # edges outweigh a block's own costs


def test_deep_markup_in_linear_time():
    for markup in ("<div>x" * 100_000, "<b>" * 100_000 + "<li></li>x" * 100_000, "<div>" * 100_000 + "x" + "</section></b>" * 100_000):
        began = time.perf_counter()
        p.main_text(markup, PLAIN)
        assert time.perf_counter() - began < 40


def _inside(page):
    """What the article element of a made page holds, by plain text replacement."""
    part = re.sub(r"</?b>", "", page.split("<article>")[1].split("</article>")[0])
    return " ".join(html.unescape(re.sub(r"<(?:/?p|br|h1|/h1)>", " ", part)).split())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_pages(spark):
    """Fitted on half of the pages; the others as they are, without article and main, and without any mark."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = p.fit(table.where("page_id % 2 = 0"))
    held = [r.html for r in table.where("page_id % 2 = 1").select("html").collect()]
    plain = lambda h: re.sub(r"<(/?)(?:article|main)\b", r"<\1div", h)
    bare = lambda h: re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:nav|aside|footer|header)\b", r"<\1div", plain(h)))
    for view, least in ((lambda h: h, 1.0), (plain, 1.0), (bare, 0.9)):
        assert sum(p.main_text(view(h), model) == _inside(h) for h in held) >= least * len(held)
