"""HTML extraction: the generated pages, made sites, and the reader itself."""

import html
import re
import time

import pyarrow.parquet as pq
import pytest

from twinfold.llm import siteextract
from twinfold.llm.dom import parse
from twinfold.llm.queries import op4_html_extraction
from twinfold.llm.siteextract import Page, extract_text, low_branches, style_tree


def article(page):
    """The text of a generated page, read by patterns that know its template."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h\d)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if x)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = {p["page_id"]: article(p["html"]) for p in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = op4_html_extraction(spark, sf).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    "markup, text",
    [
        ("", ""),
        ("plain text < 3 &amp; more", "plain text < 3 & more"),
        ("<p>a<b>b</b>c<p>d <br>e", "abc d e"),
        ("<p>x</p><script>if (a < b) '</p>'</script><style>p{}</style><p>y", "x y"),
        ("<nav>n</nav><header>h</header><p>t</p><footer>f</footer><aside>s</aside><form>q</form>", "t"),
        ("<div class='cookie-notice'>c</div><div id='sidebar2'>s</div><p>t</p><section class=comments><p>troll</section>", "t"),
        ("<body class='has-sidebar'><div class='content-with-ads'><article><p>t</article></div>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<!-- <p>no --><p title='a > b'>x &lt;y&gt; &eacute;&nbsp;z</p>", "x <y> é z"),
        ("<div hidden>a</div><div style='display: none'>b</div><p aria-hidden=true>c</p><p>d", "d"),
        ("<title>t</title><textarea>f</textarea><p>x", "x"),
        ("<p>cut off <a href='x", "cut off"),
        ("<main><h1>T</h1><p>x</main><p>outside", "T x"),
        ("<article><p>one</article><div class=ad>ad</div><article><p>two</article>", "one two"),
        ("<article class=comment><p>c</article><p>x", "x"),
        # an article element that is not the article
        (
            "<div class=main><article>Teaser A</article></div><div id=story><p>The story itself begins here and goes on.</p><p>It ends there.</div>",
            "Teaser A The story itself begins here and goes on. It ends there.",
        ),
        ("<div class='sidebar'><article>Teaser</article></div><div id=story><p>The story</p></div>", "The story"),
        # class names that mention a frame without being one
        ("<article class='post share-enabled'><p>t</article>", "t"),
        ("<div class='no-sidebar'><p>x</div>", "x"),
        ("<div class=comment-free>y</div>", "y"),
        ("<article><p>a<p class='related-work'>b<p class='social-history'>c</article>", "a b c"),
        ("<div class='site-footer'>f</div><div class='comment-list'>c</div><p>x", "x"),
        # a page with content is not emptied
        ("<form><nav>n</nav><p>The page</p><input></form>", "The page"),
        ("<div class=widget><p>" + "all of it " * 40 + "</div><div class=ad>a</div>", "all of it " * 39 + "all of it"),
        ("<nav>n</nav><footer>f</footer>", ""),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T x"),
        ("<p>a <span class=share>Share!</span>b<span>c</span>", "a bc"),
    ],
)
def test_markup(markup, text):
    assert Page(markup).text(set()) == text


def test_reader_takes_linear_time():
    for markup in ("<div>" * 100_000 + "x", "<p>x" * 50_000, '<a b="' * 50_000, "<!-- " * 50_000, "<b></i>" * 30_000, "<" * 100_000):
        began = time.time()
        parse(markup)
        Page(markup).text(set())
        assert time.time() - began < 20
    assert len(Page("<p>x" * 50_000).text(set())) == 99_999


def site(n, host="site.org"):
    """Pages with a repeated, unmarked frame that only comparison can tell."""
    frame = "<div class='q7'>All our readers like to say this</div><div class='z3'><span>Rights are ours</span></div>"
    return [
        (i, f"http://{host}/{i}", f"<body>{frame}<div class='m'><p>Story {i} tells of {i * 7} things</p><p>and ends at {i}</p></div></body>")
        for i in range(n)
    ]


def want(i):
    return f"Story {i} tells of {i * 7} things and ends at {i}"


def test_frame_of_a_site_goes(spark):
    pages = spark.createDataFrame(site(30), "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got == {i: want(i) for i in range(30)}
    # too few pages are no evidence
    few = {r.page_id: r.text for r in extract_text(pages.where("page_id < 3")).collect()}
    assert all(t.startswith("All our readers") and t.endswith(f"ends at {i}") for i, t in few.items())


def test_the_tree_decides(spark):
    """The same pages with and without comparison, by plain markup and by names
    that alone would not be enough."""
    rows = [
        (i, f"http://t.org/{i}", f"<body><div class='k1'>Seen on all</div><article><p class='social-note'>Read our terms</p><p>Story {i}</p></article></body>")
        for i in range(12)
    ]
    plain = [(100 + i, f"http://p.org/{i}", f"<body><div class='k1'>Seen on all</div><p>Story {i}</p></body>") for i in range(12)]
    pages = spark.createDataFrame(rows + plain, "page_id long, url string, html string")
    alone = {r.page_id: r.text for r in extract_text(pages, tree=False).collect()}
    assert alone == {i: f"Read our terms Story {i}" for i in range(12)} | {100 + i: f"Seen on all Story {i}" for i in range(12)}
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got == {i: f"Story {i}" for i in range(12)} | {100 + i: f"Story {i}" for i in range(12)}


def test_frames_of_the_generated_sites_are_low(spark):
    """The tree finds menus, adverts and footers without their names; articles not."""
    from twinfold.llm.urlfilter import host

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    tree = style_tree(pages.select(host(pages.url).alias("host"), "html"))
    low = {n for r in low_branches(tree).collect() for n in r.low}
    found, articles = set(), set()
    for p in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        page = Page(p["html"])
        for at in range(1, len(page.node)):
            path = page.path(at)
            if page.article[at]:
                articles.add(page.node[at])
            elif page.node[at] in low and page.judged[at] and articles.isdisjoint(path):
                found.add(page.node[at])
    assert found and low.isdisjoint(articles)


def test_deep_pages_have_deep_nodes(spark):
    """A notice below 40 elements goes without the article beside it."""
    wrap = lambda x: "<div>" * 40 + x + "</div>" * 40
    rows = [(i, f"http://d.org/{i}", wrap(f"<div class=v2>Always the same</div><p>Story {i}</p>")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == {i: f"Story {i}" for i in range(12)}


def test_copies_of_a_page_are_no_frame(spark):
    rows = [(i, f"http://h.org/{i}", "<body><div class='m'><p>The very same story</p></div></body>") for i in range(40)]
    rows += [(100 + i, f"http://h.org/x{i}", f"<body><div class='m'><p>The very same story</p><p>edit {i}</p></div></body>") for i in range(3)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"The very same story", *[f"The very same story edit {i}" for i in range(3)]}


def layouts(n, first=0.6, others=30):
    """Pages whose articles hang in one of many child sequences, most in the first."""
    kinds = [0 if i < first * n else 1 + i % others for i in range(n)]
    return [
        (i, f"http://many.org/{i}", f"<body><div class='f9'>Rights are ours</div><div class='m'><p>Story {i}</p>{'<i>+</i><b>+</b>' * k}</div></body>")
        for i, k in enumerate(kinds)
    ]


def test_articles_of_many_layouts_stay(spark):
    rows = layouts(1500, first=0.7)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert len(got) == 1500 and all(t.startswith(f"Story {i}") for i, t in got.items())


def test_many_layouts_at_any_size(spark):
    from math import log

    def row(pages, styles, content):
        """An element as style_tree() gives it: 60 % of its pages in one style, the others even."""
        rest = 0.4 / (styles - 1)
        look = -(0.6 * log(0.6) + (styles - 1) * rest * log(rest)) / log(pages)
        weight = 0.9**styles
        return f"h{pages}", int(content * 10), True, pages, pages, styles, look, content, (1 - weight) * look + weight * content

    columns = "host string, node long, removable boolean, site_pages long, pages long, styles long, presentation double, content double, importance double"
    rows = [row(n, s, c) for n, s in ((1000, 40), (1_000_000, 100)) for c in (1.0, 0.0)]
    low = {r.host: r.low for r in low_branches(spark.createDataFrame(rows, columns)).collect()}
    assert low == {"h1000000": [0]}  # the repeated texts of the large host, no article


@pytest.mark.parametrize("most", [512, 0])
def test_rare_frame_of_a_large_host_goes(spark, monkeypatch, most):
    """A notice on less than 1 % of the pages, by lists of hosts and of pages."""
    monkeypatch.setattr(siteextract, "LIST", most)
    rows = [
        (i, f"http://big.org/{i}", f"<body>{'<div class=q7>Only some pages say this</div>' * (i < 9)}<div class='m'><p>Story {i}</p></div></body>")
        for i in range(1000)
    ]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in extract_text(pages).collect()]
    assert sorted(got) == sorted([(i, f"Story {i}") for i in range(1000)] + [(0, "Story 0")])


def test_importance(spark):
    from twinfold.llm.urlfilter import host

    pages = spark.createDataFrame(site(20), "page_id long, url string, html string")
    tree = style_tree(pages.select(host(pages.url).alias("host"), "html"))
    rows = tree.collect()
    assert all(r.site_pages == 20 and 0 <= r.importance <= 1 for r in rows)
    assert len(low_branches(tree).first()["low"]) == 3


def test_odd_pages(spark):
    rows = [(1, None, "<p>a"), (2, "http://x.org", None), (3, "no url", "<p>b"), (4, "http://x.org", ""), (4, "http://x.org", "")]
    rows += [(None, "http://x.org/y", "<p>" + "long words " * 50_000)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, TEXT int")
    out = extract_text(pages)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted([(r.page_id or 0, r.n_chars) for r in out.collect()])
    assert got == [(0, 549_999), (1, 1), (2, 0), (3, 1), (4, 0), (4, 0)]
    assert extract_text(pages.where("false")).count() == 0
