import html as lib
import itertools
import random
import re
import time

import pytest

from barloom.llm import mainhtml
from barloom.session import ship

PAGE = """<html><head><title>T</title></head><body><header class="top"><h1>Site</h1><p>Welcome to our site of many things.</p></header><nav><a href=x>Home</a></nav>
<div class="cookie-banner">We use cookies on this site.</div><main><article><h1>Title &amp; more</h1><p>First <i>para</i>graph<br>line&nbsp;two.<p>Second &eacute; para<ul><li>one<li>two</ul>
<div class="ad">Buy now! Best deal ever for you.</div><table><tr><td>1<td>2</table><p>End   of
it.</p><section class="comments"><h2>Comments</h2><p>Nice article, I liked it very much.</p></section></article><aside><h3>Related</h3><p>Another story about other things.</p></aside>
<form><label>Email</label><input><p>Sign up for our letter</p></form></main><footer><p>Copyright 2020 by the site.</p></footer><script>var x="<p>no</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    return spark


def test_min_cut_matches_brute_force():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 7)
        a, b = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        edges = [(i, j, r.random() * 2) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda x: sum(b[i] if x[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(mainhtml.min_cut(a, b, edges)) - best) < 1e-6


def test_long_chain_is_cut():
    n = 3000
    r = random.Random(2)
    a, b = [r.random() for _ in range(n)], [r.random() for _ in range(n)]
    edges = [(i, i + 1, 0.3) for i in range(n - 1)]
    got = mainhtml.min_cut(a, b, edges)
    best = [0.0, 0.0]  # dynamic programme over the chain
    for i in range(n):
        w = edges[i - 1][2] if i else 0
        best = [min(best[0], best[1] + w) + a[i], min(best[1], best[0] + w) + b[i]]
    cost = sum(b[i] if got[i] else a[i] for i in range(n)) + sum(w for i, j, w in edges if got[i] != got[j])
    assert abs(cost - min(best)) < 1e-6


def test_article_without_boilerplate():
    assert mainhtml.main_text(PAGE) == "Title & more\nFirst paragraph line two.\nSecond é para\none\ntwo\n1\n2\nEnd of it."
    assert mainhtml.main_text("just text") == "just text"


def test_head_without_end_tag():
    article = "<article><h1>A walk</h1><p>We left the house early, before the sun was up.</p></article>"
    want = "A walk\nWe left the house early, before the sun was up."
    head = "<html><head><meta charset=utf-8><title>T</title><style>p {}</style><noscript><link href=x></noscript>"
    for page in (f"{head}<body>{article}", f"{head}{article}", f"{head}</head><body>{article}", f"<head><template><p>no</p></template><link href=x />{article}"):
        assert mainhtml.main_text(page) == want
    assert mainhtml.main_text("<head><title>T</title> just text") == "just text"


def test_self_closed_svg_has_no_content():
    for svg in ("<svg/>", '<svg class="icon" />', "<svg><path d='M0'/><title/><text>no</text></svg>"):
        page = f"<article><h1>A walk</h1><p>We left the house {svg}early, before the sun was up.</p><p>Rain fell until the evening.</p></article>"
        assert mainhtml.main_text(page) == "A walk\nWe left the house early, before the sun was up.\nRain fell until the evening."


def plain(page):
    """The article element's paragraphs, by patterns that hold for the generated pages only."""
    m = re.search(r"(?s)<article>(.*)</article>", page)
    parts = [" ".join(lib.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", m[1])]
    return "\n".join(x for x in parts if x)


def test_query_form(session):
    pages = session.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rows = [(r.page_id, r.url, r.html, 1) for r in pages] + [(None, None, None, 1), (7, "u", "", 1), (7, "u", PAGE, 1), (7, "u", PAGE, 1), (8, "v", "<p>" + "word " * 60000, 1)]
    df = session.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = mainhtml.extracted(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert [r.text for r in got[: len(pages)]] == [plain(r.html) for r in pages]
    assert [r.text for r in got[len(pages) :]] == ["", "", mainhtml.main_text(PAGE), mainhtml.main_text(PAGE), ("word " * 60000).strip()]
    assert all(r.n_chars == len(r.text) for r in got)
    assert mainhtml.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>text {} here.", "<b><i>text {} here.</u>", "<ul><li>text {} here.", "<section><p>text {} here.</article></td>"])
def test_deep_nesting_costs_in_proportion(page):
    n = 20_000
    start = time.time()
    found = mainhtml.blocks("".join(page.format(k) for k in range(n)))
    mainhtml.labels(found)
    assert time.time() - start < 20
    assert sum(b.text.count("here.") for b in found) == n
