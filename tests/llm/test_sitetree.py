from __future__ import annotations

import html
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyrus.llm import queries, sitetree

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article><header><h1>A  title &amp; more</h1></header><p>One <b>two</b>three<br>four<p>Five&nbsp;six &#233; &lt;x&gt;<aside>side</aside><form>Name <input></form>
<div class="share">Share</div><section class="comments"><p>A comment</section></article><article class="comment">Reader</article>
<div class="sidebar">More</div><footer>End &copy; <p>x</footer></body></html>"""


def text(page):
    return " ".join(sitetree.main_blocks(page))


def test_main_text_of_a_page():
    assert text(PAGE) == "A title & more One twothree four Five six é <x>"


def test_broken_markup():
    for page in ("", "<", "<p", "plain & text", "<article><p>a<div>b", "</p></article>x", "<!-- open <p>x", "<script>never closed <p>x", "<a href='>'>q</a>"):
        text(page)
    assert text("plain &amp; text") == "plain & text"
    assert text("<article><p>a<div>b") == "a b"


def test_article_parts_with_telling_names_stay():
    page = "<body><article><div class='article-header'><h1>T</h1></div><section class='related-work'>r</section><div class='search-results notice'>s</div><div id='social-history'>h</div><math><mi>x</mi></math></article></body>"
    assert text(page) == "T r s h x"


@pytest.mark.parametrize("page", ["<div>" * 10_000 + "x", "<b>" * 10_000 + "x<p>y" * 5000, "<a " * 300_000 + '"', '<a "' * 250_000, "<a href='x " * 100_000, "<script></script " * 60_000, "<div>a " * 10_000, "<p><button>" + "<b><div></div>" * 20_000])
def test_deep_and_badly_quoted_markup(page):
    began = time.process_time()
    text(page)
    assert len(sitetree.style_rows(page)) <= 2 * 10_001
    assert time.process_time() - began < 5


def test_unclosed_quote_keeps_the_text():
    assert text('<p>a <a href="x>b</a> c</p>') == "a b c"


def importances(pages):
    """The style tree's importances from their definition; pages: lists of (path, layout), (path, text) for each page."""
    out = {}
    paths = {p for page in pages for p, _ in page}
    for path in paths:
        on = [page for page in pages if any(p == path for p, _ in page)]
        m = len(on)
        shown = Counter(tuple(sorted({x for p, x in page if p == path and isinstance(x, tuple)})) for page in on)
        presentation = -sum(n / m * math.log(n / m) for n in shown.values()) / math.log(m)
        under = [q for q in paths if q[: len(path)] == path]
        novel = mass = 0.0
        for q in under:
            deep = [page for page in pages if any(p == q for p, _ in page)]
            seen = Counter(t for page in deep for t in {x for p, x in page if p == q and isinstance(x, str)})
            for t, n in seen.items():
                mass += n * len(t.split())
                novel += n * len(t.split()) * (1 - math.log(n) / math.log(len(deep)))
        out[path] = (m, presentation, novel, mass)
    return out


def test_importance_by_its_definition(spark):
    rng, rows, pages = random.Random(3), [], []
    for k in range(12):
        own, ad, menu = " ".join(rng.choice("abcdefgh") * 3 + str(k) for _ in range(30)), f"buy {rng.randint(0, 3)}", ["home", "news", "more"][: rng.randint(1, 3)]
        rows.append((1, f"<html><body><div class=menu-{k}>{''.join(f'<a>{x}</a>' for x in menu)}</div><div id=text>{own}</div><div class=box>{ad}</div></body></html>"))
        top, step = ("html", "body"), ("div[class=menu-#]", "div[id=text]", "div[class=box]")
        page = [(("html",), ("body",)), (top, step), ((*top, step[0]), ("a",) * len(menu)), ((*top, step[0], "a"), ("#",)), ((*top, step[1]), ("#",)), ((*top, step[2]), ("#",))]
        pages.append(page + [((*top, step[0], "a"), x) for x in menu] + [((*top, step[1]), own), ((*top, step[2]), ad)])
    want = importances(pages)

    def key(path):
        at = sitetree._key("")
        for step in path:
            at = sitetree._key(step, at & (1 << 64) - 1)
        return at

    found = {r["path"]: r for r in sitetree.importance(spark.createDataFrame(rows, "host long, html string")).collect()}
    assert set(found) == {key(p) for p in want}
    for path, (m, presentation, novel, _) in want.items():
        most = max(v[2] / v[0] for p, v in want.items() if p[:-1] == path[:-1] and len(p) == len(path))
        got = found[key(path)]
        assert got["n_pages"] == m
        assert (got["presentation"], got["content"]) == pytest.approx((presentation, novel / m / most), abs=1e-9)


def test_counts_alone_remove_what_no_tag_or_name_tells(spark, sf_dir):
    """Neutral names, no main element: the counts remove the same branches that the given pages' tags and names tell of."""
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect():
        page = r["html"].replace("<article>", "<div class=xa>").replace("</article>", "</div>").replace('class="ad"', "class=xb")
        for tag, name in (("nav", "xc"), ("footer", "xd")):
            page = page.replace(f"<{tag}>", f"<div class={name}>").replace(f"</{tag}>", "</div>")
        rows.append((r["page_id"], "http://one.example/", page))
    found = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {r["page_id"]: r["text"] for r in queries.op5_site_style_tree(spark, sf_dir).collect()}
    assert found == want


def test_salted_join_gives_the_same(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("url", F.lit("http://h/"))
    want = sorted(map(tuple, sitetree.main_text(pages, priors=False).collect()))
    monkeypatch.setattr(sitetree, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, sitetree.main_text(pages, priors=False).collect())) == want


def test_query_by_brute_force(spark, sf_dir):
    """The given pages: what stands in the article element, block by block."""
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}
    found = {r["page_id"]: r for r in queries.op5_site_style_tree(spark, sf_dir).collect()}
    assert set(found) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner.replace("<b>", "").replace("</b>", ""))).split())
        assert found[i]["text"] == want and found[i]["n_chars"] == len(want)


def test_repeated_branches_of_a_host_go(spark):
    """Pages without an article element: what a host's pages share goes by importance, what differs stays, copies included."""
    rng = random.Random(1)
    rows = []
    for k in range(30):
        own = " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(40))
        rows.append((k, f"https://x.example/{k}", f"<html><body><div class='top'>Welcome to the site</div><div class='main-text'><p>{own}</p></div><div class='low'>All rights here</div></body></html>", None))
    rows += [(100 + k, f"https://x.example/c{k}", rows[0][2], None) for k in range(60)]
    rows.append((200, "https://y.example/", rows[1][2], None))
    found = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    bodies = {r[0]: re.search("<p>(.*)</p>", r[2])[1] for r in rows}
    assert all(found[i] == bodies[i] for i in bodies if i != 200)
    assert found[200] == f"Welcome to the site {bodies[200]} All rights here"


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, path string"
    rows = [(1, None, None, "h", None), (None, "u", "<p>a", None, "p"), (2, "http://a", "", "h", "p"), (2, "http://a", "", "h", "p"), (3, "http://a", "<p>" + "word " * 100_000, "h", "p")]
    found = sitetree.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in found) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 499_999)]
    assert sitetree.main_text(spark.createDataFrame([], schema)).count() == 0


def test_class_words_are_whole_names():
    """Names that only hold a telling word stay, inside and outside of articles; names made of it and of where it stands go."""
    for name in ("share-price", "comments-on-law", "footer-note", "navigation-history-of-ships", "cookie-recipes"):
        assert text(f"<body><article><p>a</p><div class='{name}'>kept</div></article></body>") == "a kept"
    assert text("<body><div class='related-work'>kept</div><div class='menu-prices'>too</div></body>") == "kept too"
    for name in ("share", "site-footer", "post-comments", "comments_list", "ad-slot", "share-buttons", "sidebar left", "cookie-banner", "breadcrumbs"):
        assert text(f"<body><article><p>a</p><div class='{name}'>gone</div></article></body>") == "a"


def test_importance_overrules_a_class_word_but_not_comments(spark):
    """On a host whose articles stand in a box called 'share', the counts keep it; comments go although their texts are as new."""
    rng, rows = random.Random(2), []
    for k in range(12):
        own, said = (" ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(40)) for _ in range(2))
        rows.append((k, f"https://x.example/{k}", f"<body><div class='share'><p>{own}</p></div><div class='comments'><p>{said}</p></div><div class='sidebar'>Same on every page</div></body>"))
    found = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {r[0]: re.search("<p>(.*?)</p>", r[2])[1] for r in rows}
