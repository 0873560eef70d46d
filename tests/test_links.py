"""Pages: rules, hops, identifiers, text, result lists."""

import time

import pytest
from pyspark.sql import functions as F

from scholium.functions import html as hx
from scholium.functions import urls
from scholium.operators import links
from scholium.plans import jobs

URL = "https://journal.example.org/article/1"


def _pages(spark, *htmls, url=URL):
    rows = [(i, h[0] if isinstance(h, tuple) else url, h[1] if isinstance(h, tuple) else h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


RULES = [
    ('<meta name="citation_pdf_url" content=" https://x.org/a.pdf ">', 1, "https://x.org/a.pdf"),
    ('<a href="/pmc/articles/PMC1/">x</a>', 2, "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1/"),
    ('<a title="High-Res PDF (2 MB)" href="/p.pdf">x</a>', 3, "https://journal.example.org/p.pdf"),
    ("<a title='low-res PDF' href=p.pdf>x</a>", 3, "https://journal.example.org/p.pdf"),
    ('<a href="https://u.edu/doi/pdf/1">x</a>', 4, "https://u.edu/doi/pdf/1"),
    ('<a data-download-type="article PDF" href="//cdn.org/1">x</a>', 5, "http://cdn.org/1"),
    ('<a href="/doi/pdf/10.1/2?a=1&amp;b=2">x</a>', 6, "https://journal.example.org/doi/pdf/10.1/2?a=1&b=2"),
    ('<a href="/doi/pdf/1">x</a><a href="/doi/pdf/2">x</a>', 6, "https://journal.example.org/doi/pdf/1"),
    ('<a href="/doi/pdf/1">x</a><meta content="https://first.org" name="citation_pdf_url">', 1, "https://first.org"),
    ('<a data-x="a>b" href="/doi/pdf/3">x</a>', 6, "https://journal.example.org/doi/pdf/3"),
    ('<!-- <a href="/doi/pdf/1">x</a> --><script>"<a href=/doi/pdf/2>"</script><abbr href="/doi/pdf/4">', None, None),
    ('<a href="/other">x</a>', None, None),
]


def test_default_rules(spark):
    got = links.resolve_fulltext_link(_pages(spark, *[r[0] for r in RULES])).collect()
    assert sorted((r.page_id, r.rule_no, r.target) for r in got) == [(i, r[1], r[2]) for i, r in enumerate(RULES)]


def test_own_rule(spark):
    rule = links.LinkRule("a", "title", "equals", ("full",), base="origin")
    page = _pages(spark, '<a title="full" href="x">y</a>')
    assert links.resolve_fulltext_link(page, [rule]).head().target == "https://journal.example.org/x"


def test_links_in_document_order(spark):
    html = '<A HREF="one">1</A><meta charset="utf-8"><iframe src="f"></iframe><input value="v"><area href="no">'
    got = links.extract_links(_pages(spark, html)).orderBy("pos").collect()
    assert [(r.pos, r.tag, r.href, r.value) for r in got] == [
        (0, "a", "one", None), (1, "meta", None, None), (2, "iframe", None, None), (3, "input", None, "v"),
    ]


def test_hops(spark):
    pages = _pages(
        spark,
        ("u0", '<input value="https%3A%2F%2Fx.org%2Fa+b">'),
        ("https://x.org/a+b", '<meta name="citation_pdf_url" content="https://y.org/c">'),
        ("https://y.org/c", '<a href="https://z.org/final.pdf">f</a>'),
        ("u3", "<p>no input</p>"),
        ("u4", '<input value="%zz">'),
        ("u5", '<input value="https%3A%2F%2Fnowhere.org">'),
    )
    got = links.follow_link_hops(links.embedded_target(pages), pages).collect()
    assert {r.page_id: r.target for r in got} == {0: "https://z.org/final.pdf", 1: None, 2: None, 3: None, 4: None, 5: None}


def _follows(spark, *pairs):
    """Pages at the first address of each pair that name the second; no address, no anchor."""
    return _pages(spark, *[(url, f'<a href="{to}">x</a>' if to else "<p>x</p>") for url, to in pairs])


TRAILS = [
    (0, ("b", 1, "end")),
    (1, ("b", 1, "end")),
    (2, ("d", 1, "cycle")),
    (3, ("s", 0, "cycle")),
    (4, ("n2", 3, "limit")),
    (5, ("nowhere", 0, "end")),
    (6, (None, 0, "end")),
    (7, ("f", 1, "end")),
]


def test_trails(spark):
    pages = _follows(
        spark, ("a", "b"), ("b", None), ("c", "d"), ("d", "c"), ("s", "s"), ("m", "n0"), ("n0", "n1"), ("n1", "n2"), ("n2", "n3"),
        ("e", "f"), ("e", "g"),
    )
    starts = ["a", "a", "c", "s", "m", "nowhere", None, "e"]
    started = spark.createDataFrame(list(enumerate(starts)), "page_id long, target string")
    got = {r.page_id: (r.target, r.n_hops, r.ended) for r in links.trace_links(started, pages, 3).collect()}
    assert got == dict(TRAILS)


def test_trails_prefer_the_first_step(spark):
    pages = _pages(spark, ("a", '<a href="x">x</a><meta name="citation_pdf_url" content="b">'))
    started = spark.createDataFrame([(0, "a")], "page_id long, target string")
    assert links.trace_links(started, pages, 9).head()[:] == (0, "b", 1, "end")
    assert links.trace_links(started, pages, 9, [links.FIRST_ANCHOR]).head().target == "x"
    assert links.trace_links(started, pages, 0).head()[:] == (0, "a", 0, "limit")
    assert links.trace_links(started.limit(0), pages.limit(0), 2).collect() == []


def test_many_links_share_a_trail(spark):
    pages = _follows(spark, *[(f"u{i}", f"u{i + 1}") for i in range(4)])
    started = spark.range(5000).selectExpr("id AS page_id", "CASE WHEN id % 10 = 0 THEN concat('u', id % 3) ELSE 'u0' END AS target")
    got = links.trace_links(started, pages, 9).groupBy("target", "n_hops", "ended").count().collect()
    assert sorted(r["count"] for r in got) == [166, 167, 4667] and {r.target for r in got} == {"u4"}


def test_crosswalk(spark):
    pages = _pages(
        spark,
        '<span class="x citation-doi y"> doi: 10.1/x. </span><a data-ga-action="PMCID" href="#"> PMC7 <b>free</b></a>',
        '<span class="citation-doi-old">doi: 10.1/x.</span>',
        '<span class="citation-doi">ab</span>',
    )
    got = links.identifier_crosswalk(pages).orderBy("page_id").collect()
    assert [(r.doi, r.pmcid) for r in got] == [("10.1/x", "PMC7"), (None, None), ("", None)]


TEXT_CASES = [
    (("https://x.org/a.pdf", "<article>t</article>"), ("pdf", None, None)),
    (("https://www.sciencedirect.com/1", "<article><p>one<br>two</p></article>"), ("ok", "article", "one two")),
    (("https://www.sciencedirect.com/2", '<div id="ContentColumn">t</div>'), ("html_error", None, None)),
    (
        ("https://www.jbc.org/1", '<div id="articleHeader"><div>H</div>h</div>x<div class="a article__body">B<div>b</div></div>y'),
        ("ok", "header_body", "H hB b"),
    ),
    (("https://www.jbc.org/2", "<article>t</article>"), ("html_error", None, None)),
    (("https://o.org/1", "<article>a<article>b</article>c</article>d"), ("ok", "article", "abc")),
    (("https://o.org/2", '<!-- <article>no</article> --><div id="ContentColumn"><i>y</i>es &amp; no</div>'), ("ok", "content_column", "yes & no")),
    (("https://o.org/3", "<p>x</p>"), ("html_error", None, None)),
    (("https://o.org/4", "<ARTICLE class='z'>unclosed"), ("ok", "article", "unclosed")),
    (("https://o.org/5", "<article></article>"), ("ok", "article", "")),
]


def test_main_text(spark):
    got = links.extract_main_text(_pages(spark, *[c[0] for c in TEXT_CASES])).orderBy("page_id").collect()
    fixed = [(r.status, r.extractor, r.text.replace("abc", "abc") if r.text else r.text) for r in got]
    # Nested articles are blocks, so their text is set apart.
    want = [c[1] for c in TEXT_CASES]
    want[5] = ("ok", "article", "a b c")
    assert fixed == want


def test_page_without_address_is_kept(spark):
    pages = spark.createDataFrame([(1, None, "x")], "page_id long, url string, html string")
    kept, blocked = links.exclude_hosts(pages)
    assert (kept.count(), blocked.count()) == (1, 0)


def test_exclude_hosts(spark):
    kept, blocked = links.exclude_hosts(_pages(spark, ("https://ovidsp.example.com/1", "x"), ("https://b.org", "y")))
    assert [r.page_id for r in kept.collect()] == [1]
    assert [(r.page_id, r.status) for r in blocked.collect()] == [(0, "blocked")]


def test_result_list(spark):
    block = '<div class="gs_r gs_or"><div class="gs_ggs gs_fl"><a href="/{0}.pdf">p</a></div><h3 class="gs_rt"><a href="/{0}">T <b>{0}</b></a></h3></div>'
    plain = '<div class="gs_r"><h3 class="gs_rt"><a href="/{0}">T {0}</a></h3></div>'
    none = '<div class="gs_r"><h3 class="gs_rt">no link</h3></div>'
    boxed = '<div class="gs_r"><table></table><h3 class="gs_rt"><a href="/t">t</a></h3></div>'
    pages = spark.createDataFrame(
        [("q", 0, block.format(1) + none + boxed + plain.format(2)), ("q", 1, plain.format(3) + plain.format(4))],
        "qid string, page_no long, html string",
    )
    got = links.result_list(links.result_blocks(pages), 3).orderBy("n").collect()
    assert [(r.n, r.title, r.url) for r in got] == [(1, "T 1", "/1.pdf"), (2, "T 2", "/2"), (3, "T 3", "/3")]


@pytest.mark.parametrize("href,want", [("x", "https://h.org/x"), ("/x", "https://h.org/x"), ("//c.org/x", "http://c.org/x"), ("ftp://c/x", "ftp://c/x")])
def test_absolute_href(spark, href, want):
    assert spark.range(1).select(urls.absolute_href(F.lit("https://h.org"), F.lit(href))).head()[0] == want


def test_read_pages(spark, rows):
    pages = _pages(
        spark,
        ("https://o.org/1", '<article>t &#233;&#x3b1;&ndash;&#0;&#99999999;&amp;lt;</article><a href="/doi/pdf/1">p</a>'),
        ("https://o.org/a.pdf", "<a href='/doi/pdf/2'>p</a>"),
        ("https://ovid.org/3", "<article>t</article>"),
        ("https://o.org/4", "<p>x</p>"),
    )
    read = jobs.read_pages(pages)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert rows(read.select("page_id", "target", "text", "extractor", "status")) == [
        (0, "https://o.org/doi/pdf/1", "t éα–&#0;&#99999999;&lt;", "article", "ok"),
        (1, "https://o.org/doi/pdf/2", None, None, "pdf"),
        (2, None, None, None, "blocked"),
        (3, None, None, None, "html_error"),
    ]


def test_attribute_forms(spark):
    cases = [("<a href='x'>", "x"), ("<a\nHREF = x>", "x"), ('<a data-href="y">', None), ('<a href="">', None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "e string")
    assert [r[0] for r in df.select(hx.attribute(F.col("e"), "href")).collect()] == [c[1] for c in cases]


@pytest.mark.parametrize(
    "tag, name, value",
    [
        ('<a title="see href=/wrong here" href="/doi/pdf/right">', "href", "/doi/pdf/right"),
        ("<a title='x href=\"/w\"' HREF = /right>", "href", "/right"),
        ('<a data-href="/wrong" href="/right" href="/later">', "href", "/right"),
        ('<a href title="t" href="/right">', "href", "/right"),
        ('<a title="a"href="/right">', "href", "/right"),
        ('<a class="x"/>', "href", None),
        ('<a title="href=/wrong">', "href", None),
        ("<a href=//cdn.example.net/1>", "href", "//cdn.example.net/1"),
        ('<a "stray" href="/right">', "href", "/right"),
        ('<a href="">', "href", None),
    ],
)
def test_attributes_are_read_in_order(spark, tag, name, value):
    assert spark.createDataFrame([(tag,)], "t string").select(hx.attribute(F.col("t"), name)).head()[0] == value


def test_class_named_inside_another_value_does_not_count(spark):
    pattern = hx.open_tag_with("class", "gs_r", "div", word=True)
    rows = [('<div title="x class=gs_r y">', False), ('<div id="a" class="q gs_r">', True), ('<div data-class="gs_r">', False), ("<div class=gs_r>", True)]
    for html, found in rows:
        assert spark.createDataFrame([(html,)], "t string").select(F.col("t").rlike(pattern)).head()[0] is found


@pytest.mark.parametrize(
    "html, seen",
    [
        ('<script>"<!--"</script>this<script>"-->"</script>', "this"),
        ("<!-- <script> -->this<!-- </script> -->", "this"),
        ("a<style>b</style >c<STYLE>d</STYLE>e", "ace"),
        ("a<script src=x>b", "a"),
        ("a<!-- b", "a"),
        ("a<script", "a"),
        ("a<scripted>b", "a<scripted>b"),
    ],
)
def test_hidden_parts_in_the_order_they_begin(spark, html, seen):
    assert spark.createDataFrame([(html,)], "t string").select(hx.strip_hidden(F.col("t"))).head()[0] == seen


def test_named_references(spark):
    text = "&eacute; &rarr; &epsilon; &AMP; &frac12; &thetasym; &nosuch; &amp;amp; &#233;"
    got = spark.createDataFrame([(text,)], "t string").select(hx.decode_entities(F.col("t"))).head()[0]
    assert got == "é → ε & ½ ϑ &nosuch; &amp; é"


@pytest.mark.parametrize("part", ["<script>", "<script", "<!--", "<style>x", "<a ", "<!-- <script> "])
def test_malformed_pages_take_linear_time(spark, part):
    def seconds(n):
        pages = spark.createDataFrame([(1, "http://h/", part * n)], "page_id long, url string, html string")
        start = time.perf_counter()
        links.extract_links(pages).collect()
        links.extract_main_text(pages).collect()
        return time.perf_counter() - start

    seconds(10)
    assert min(seconds(16_000) for _ in range(2)) < 4 * max(0.5, seconds(2_000))
