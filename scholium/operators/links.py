"""Links, identifiers and text out of collected pages.

One page is one row and is read by expressions inside that row. Only following a link to another
page and ordering result lists shuffle anything.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.functions import html as hx
from scholium.functions import urls
from scholium.functions.arrays import bind, compute_once, unnest
from scholium.plans import skew
from scholium.plans.storage import materialize

LINK_TAGS = ("a", "meta", "iframe", "frame", "input")
LINK_ATTRIBUTES = {
    "href": "href",
    "title": "title",
    "download_type": "data-download-type",
    "name": "name",
    "content": "content",
    "value": "value",
}


def extract_links(pages: DataFrame) -> DataFrame:
    """``links(page_id, pos, tag, href, title, download_type, name, content, value)`` in document order."""
    found = hx.elements(hx.strip_hidden(F.col("html")), *LINK_TAGS)
    exploded = unnest(pages, ["page_id"], found, "element", "pos")
    element = F.col("element")
    values = F.transform(F.array(*[hx.attribute(element, attr) for attr in LINK_ATTRIBUTES.values()]), hx.decode_entities)
    read = compute_once(exploded, ["page_id", "pos", hx.tag_name(element).alias("tag")], values, "v")
    return read.select(
        "page_id", "pos", "tag", *[F.get("v", F.lit(i)).alias(out) for i, out in enumerate(LINK_ATTRIBUTES)]
    )


@dataclass(frozen=True)
class LinkRule:
    """One way to find the full text on a page.

    An element ``tag`` matches when its ``attribute`` equals or contains ``needles`` (``match`` is
    ``equals``, ``all`` or ``any``). The value of ``take`` is the link: as it is, or below ``base``,
    which is a fixed host or ``"origin"``.
    """

    tag: str
    attribute: str
    match: str
    needles: tuple[str, ...]
    take: str = "href"
    base: str | None = None
    ignore_case: bool = False

    def _may_match(self, element: Column) -> Column:
        """A cheap test that all matching elements pass, to be made before attributes are read."""
        plain = [n for n in self.needles if not set(n) & set("&<>\"'")]
        if len(plain) < len(self.needles):
            return F.lit(True)
        held = F.lit(False)
        for needle in plain:
            held = held | F.contains(F.lower(element), F.lit(needle.lower()))
        return held

    def test(self, element: Column) -> Column:
        value = hx.attribute(element, self.attribute)
        value = F.lower(value) if self.ignore_case else value
        if self.match == "equals":
            hit = value.isin(*self.needles)
        else:
            tests = [F.contains(value, F.lit(needle)) for needle in self.needles]
            hit = tests[0]
            for test in tests[1:]:
                hit = hit & test if self.match == "all" else hit | test
        return self._may_match(element) & (hx.tag_name(element) == self.tag) & hit

    def link(self, element: Column, page_url: Column) -> Column:
        value = hx.attribute(element, self.take)
        if self.base is None:
            return value
        base = urls.origin(page_url) if self.base == "origin" else F.lit(self.base)
        return urls.absolute_href(base, value)


# The default rules, first rule first.
DEFAULT_RULES = (
    LinkRule("meta", "name", "equals", ("citation_pdf_url",), take="content"),
    LinkRule("a", "href", "any", ("/pmc/articles",), base="https://www.ncbi.nlm.nih.gov"),
    LinkRule("a", "title", "any", ("high-res pdf", "low-res pdf"), base="origin", ignore_case=True),
    LinkRule("a", "href", "all", ("pdf", ".edu/doi/"), base="origin"),
    LinkRule("a", "data-download-type", "equals", ("article pdf",), base="origin", ignore_case=True),
    LinkRule("a", "href", "any", ("/doi/pdf",), base="origin"),
)


def fulltext_link(url: Column, html: Column, rules: Sequence[LinkRule] = DEFAULT_RULES) -> Column:
    """``struct<rule_no, pos, target>``: the first rule that matches, at its first match on the page.

    ``html`` is free of hidden parts. Null when no rule matches.
    """
    elements = hx.elements(html, *sorted({rule.tag for rule in rules}))

    def by_rule(number: int, rule: LinkRule, element: Column, pos: Column) -> Column:
        target = F.when(rule.test(element), rule.link(element, url))
        place = (F.lit(number).alias("rule_no"), pos.alias("pos"))
        return bind(target, lambda t: F.when(t.isNotNull(), F.struct(*place, t.alias("target"))))

    def candidate(element: Column, pos: Column) -> Column:
        return F.coalesce(*[by_rule(number, rule, element, pos) for number, rule in enumerate(rules, 1)])

    def decoded(best: Column) -> Column:
        target = F.trim(hx.decode_entities(best["target"])).alias("target")
        return F.when(best.isNotNull(), F.struct(best["rule_no"].alias("rule_no"), best["pos"].alias("pos"), target))

    return bind(F.array_min(F.transform(elements, candidate)), decoded)


def resolve_fulltext_link(pages: DataFrame, rules: Sequence[LinkRule] = DEFAULT_RULES) -> DataFrame:
    """``(page_id, rule_no, target)``, nulls for pages without a match.

    The lowest (rule, position) of a page is found inside its row, so nothing is shuffled.
    """
    best = fulltext_link(F.col("url"), hx.strip_hidden(F.col("html")), rules)
    return compute_once(pages, ["page_id"], best, "best").select("page_id", "best.rule_no", "best.target")


def embedded_target(pages: DataFrame) -> DataFrame:
    """``(page_id, target)``: the decoded value of the first input element; null when there is none."""
    first = F.get(hx.elements(hx.strip_hidden(F.col("html")), "input"), 0)
    value = bind(hx.attribute(first, "value"), hx.decode_entities)
    return pages.select("page_id", urls.percent_decode(value).alias("target"))


# How the next address is read off a page: (tag, attribute that selects, its value, attribute taken).
CITATION_META = ("meta", "name", "citation_pdf_url", "content")
FIRST_ANCHOR = ("a", None, None, "href")


def _next_link(html: Column, step: tuple) -> Column:
    tag, attribute, value, take = step
    found = hx.elements(hx.strip_hidden(html), tag)
    if attribute is not None:
        found = F.filter(found, lambda e: hx.attribute(e, attribute) == value)
    return bind(hx.attribute(F.get(found, 0), take), hx.decode_entities)


def follow_link_hops(
    links: DataFrame, pages: DataFrame, steps: Sequence[tuple] = (CITATION_META, FIRST_ANCHOR)
) -> DataFrame:
    """``(page_id, target)`` after following ``links(page_id, target)`` once per step.

    The next addresses of all steps are read in one pass over the pages and written as a small
    table, one row per url. Each hop then looks up the target's address there. A target that very
    many links share is joined by broadcast, see ``skew.lookup``. A hop that leads nowhere gives
    null.
    """
    names = [f"next{i}" for i in range(len(steps))]
    found = [_next_link(F.col("html"), step).alias(name) for step, name in zip(steps, names)]
    first = pages.select("url", F.struct("page_id", *found).alias("n")).groupBy("url").agg(F.min("n").alias("n"))
    addresses = materialize(first.select(F.col("url").alias("target"), *[f"n.{name}" for name in names]), "hops")
    for name in names:
        links = materialize(links.select("page_id", "target"), "links")
        table = addresses.select("target", F.col(name).alias("next")).filter(F.col("next").isNotNull())
        hot = table.join(F.broadcast(skew.frequent_keys(links, "target")), "target", "left_semi")
        followed = skew.lookup(links, table, hot, "target")
        links = followed.select("page_id", F.col("next").alias("target"))
    return links


def trace_links(
    links: DataFrame, pages: DataFrame, hops: int, steps: Sequence[tuple] = (CITATION_META, FIRST_ANCHOR)
) -> DataFrame:
    """``(page_id, target, n_hops, ended)``: the last address that each of ``links(page_id, target)`` leads to.

    The next address of a page is the first that one of ``steps`` finds on it. A trail is at its
    ``end`` where no page has the address or the page names no other. It also ends before an
    address that it has visited (``cycle``) and after ``hops`` pages (``limit``). A link without a
    target is at its end.

    Links with the same target share one trail. Each round moves the trails that still run by one
    page and writes them as a table, with the addresses visited: at most ``hops`` for each. An
    address where many trails meet is joined by broadcast, see ``skew.lookup``.
    """
    found = F.coalesce(*[_next_link(F.col("html"), step) for step in steps]).alias("next")
    first = pages.select("url", F.struct("page_id", found).alias("n")).groupBy("url").agg(F.min("n").alias("n"))
    addresses = materialize(first.filter("n.next IS NOT NULL").select(F.col("url").alias("at"), "n.next"), "addresses")
    links = materialize(links.select("page_id", "target"), "links")
    start = F.col("target")
    targets = links.select("target").filter(start.isNotNull()).distinct()
    running = materialize(targets.select(start.alias("start"), start.alias("at"), F.array(start).alias("visited")), "trails")

    def stopped(trails: DataFrame, ended: Column) -> DataFrame:
        n_hops = (F.size("visited") - 1).alias("n_hops")
        return trails.select(F.col("start").alias("target"), F.col("at").alias("last"), n_hops, ended.alias("ended"))

    parts = []
    for _ in range(hops):
        hot = addresses.join(F.broadcast(skew.frequent_keys(running, "at")), "at", "left_semi")
        moved = skew.lookup(running, addresses, hot, "at", null_keys=False)
        ended = F.when(F.col("next").isNull(), "end").when(F.array_contains("visited", F.col("next")), "cycle")
        moved = materialize(moved.withColumn("ended", ended), "trails")
        parts.append(stopped(moved.filter("ended IS NOT NULL"), F.col("ended")))
        visited = F.array_append("visited", F.col("next")).alias("visited")
        running = moved.filter("ended IS NULL").select("start", F.col("next").alias("at"), visited)
        if running.isEmpty():
            break
    trails = stopped(running, F.lit("limit"))
    for part in parts:
        trails = trails.unionByName(part)
    trails = materialize(trails, "trails")
    hot = trails.join(F.broadcast(skew.frequent_keys(links, "target")), "target", "left_semi")
    return skew.lookup(links, trails, hot, "target").select(
        "page_id",
        F.col("last").alias("target"),
        F.coalesce("n_hops", F.lit(0)).alias("n_hops"),
        F.coalesce("ended", F.lit("end")).alias("ended"),
    )


# Where identifiers stand on a landing page, and what surrounds a doi there.
DOI_CLASS = "citation-doi"
PMCID_ACTION = "PMCID"
DOI_LEAD, DOI_TAIL = 5, 1


def identifier_crosswalk(pages: DataFrame) -> DataFrame:
    """``(page_id, doi, pmcid)``, null where a page names none."""
    html = hx.strip_hidden(F.col("html"))

    def first_text(opening: str) -> Column:
        pattern = F.lit(f"{opening}([^<]*)")
        found = F.regexp_extract_all(html, pattern, F.lit(1))
        return _strip(bind(F.get(found, 0), hx.decode_entities))

    doi = first_text(hx.open_tag_with("class", DOI_CLASS, "span", word=True))
    kept = F.greatest(F.length(doi) - (DOI_LEAD + DOI_TAIL), F.lit(0))
    return pages.select(
        "page_id",
        F.substring(doi, F.lit(DOI_LEAD + 1), kept).alias("doi"),
        first_text(hx.open_tag_with("data-ga-action", PMCID_ACTION, "a")).alias("pmcid"),
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# How landing pages are told apart by address, and where their text stands.
PDF_MARK = "pdf"
ARTICLE_ONLY_MARK = "sciencedirect"
HEADER_BODY_MARK = "jbc"
HEADER_ID, BODY_CLASS, COLUMN_ID = "articleHeader", "article__body", "ContentColumn"


def main_text(url: Column, html: Column) -> Column:
    """``struct<extractor, text>``, null where there is no text. ``html`` is free of hidden parts.

    The address decides: a pdf has no text here, two publishers have a layout of their own, all
    others are read from ``article`` or else from the content column.
    """
    article_only = F.contains(url, F.lit(ARTICLE_ONLY_MARK))
    header_body = F.contains(url, F.lit(HEADER_BODY_MARK)) & ~article_only

    def found(name: str, *openings: str) -> Column:
        """The named extractor with the parts of the page it reads; null unless all are there."""
        parts = F.array(*[hx.inner_html(html, opening) for opening in openings])
        whole = lambda p: F.when(~F.array_contains(F.transform(p, F.isnull), True), p)
        row = lambda p: F.when(p.isNotNull(), F.struct(F.lit(name).alias("extractor"), p.alias("parts")))
        return bind(bind(parts, whole), row)

    def shown(c: Column) -> Column:
        text = F.array_join(F.transform(c["parts"], hx.text_of), "")
        return F.when(c.isNotNull(), F.struct(c["extractor"].alias("extractor"), text.alias("text")))

    article = found("article", hx.open_tag("article"))
    both = found("header_body", hx.open_tag_with("id", HEADER_ID), hx.open_tag_with("class", BODY_CLASS, word=True))
    column = found("content_column", hx.open_tag_with("id", COLUMN_ID))
    chosen = (
        F.when(is_pdf(url), F.lit(None))
        .when(header_body, both)
        .when(article_only, article)
        .otherwise(F.coalesce(article, column))
    )
    return bind(chosen, shown)


def is_pdf(url: Column) -> Column:
    return F.contains(url, F.lit(PDF_MARK))


def text_status(url: Column, found: Column) -> Column:
    return F.when(is_pdf(url), "pdf").when(found.isNull(), "html_error").otherwise("ok")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, text, extractor, status)`` with status ``ok``, ``pdf`` or ``html_error``."""
    found = bind(hx.strip_hidden(F.col("html")), lambda html: main_text(F.col("url"), html))
    return compute_once(pages, ["page_id", "url"], found, "c").select(
        "page_id", "c.text", "c.extractor", text_status(F.col("url"), F.col("c")).alias("status")
    )


# Fixed value: vendors whose pages cannot be read.
BLOCKED_HOSTS = ("ovid",)


def exclude_hosts(pages: DataFrame, patterns: Sequence[str] = BLOCKED_HOSTS) -> tuple[DataFrame, DataFrame]:
    """``(kept, blocked)``: pages to go on with, and ``blocked(page_id, status)``."""
    blocked = F.lit(False)
    for pattern in patterns:
        blocked = blocked | F.contains(F.col("url"), F.lit(pattern))
    # A page without an address is blocked by no pattern.
    blocked = F.coalesce(blocked, F.lit(False))
    return pages.filter(~blocked), pages.filter(blocked).select("page_id", F.lit("blocked").alias("status"))


# The parts of a result page, and the default length of a result list.
RESULT_CLASS, RESULT_PDF_CLASS, RESULT_TITLE_CLASS = "gs_r", "gs_ggs gs_fl", "gs_rt"
DEFAULT_RESULTS = 10


def result_blocks(pages: DataFrame) -> DataFrame:
    """``(qid, page_no, pos, title, pdf_href, title_href)`` of result ``pages(qid, page_no, html)``.

    Blocks that hold a table are not results.
    """
    starts = hx.open_tag_with("class", RESULT_CLASS, "div", word=True)
    pieces = F.split(hx.strip_hidden(F.col("html")), f"(?={starts})")
    blocks = unnest(pages, ["qid", "page_no"], pieces, "piece", "pos")
    place = ["qid", "page_no", "pos"]
    block = compute_once(blocks, place, hx.inner_html(F.col("piece"), starts), "block")
    block = block.filter(F.col("block").isNotNull() & ~F.col("block").rlike(hx.open_tag("table")))
    pdf = hx.inner_html(F.col("block"), hx.open_tag_with("class", RESULT_PDF_CLASS, "div"))
    title = hx.inner_html(F.col("block"), hx.open_tag_with("class", RESULT_TITLE_CLASS, "h3", word=True))

    def first_href(html: Column) -> Column:
        return bind(hx.attribute(F.get(hx.elements(html, "a"), 0), "href"), hx.decode_entities)

    parts = compute_once(block, place, F.struct(pdf.alias("pdf"), title.alias("title")), "p")
    links_ = F.struct(
        hx.text_of(F.col("p.title")).alias("title"),
        first_href(F.col("p.pdf")).alias("pdf_href"),
        first_href(F.col("p.title")).alias("title_href"),
    )
    return compute_once(parts, place, links_, "r").select(*place, "r.title", "r.pdf_href", "r.title_href")


def result_list(blocks: DataFrame, limit: int = DEFAULT_RESULTS) -> DataFrame:
    """``(qid, n, title, url)``: the first ``limit`` results of each query, pdf links preferred."""
    url = F.coalesce("pdf_href", "title_href")
    usable = blocks.select("qid", "page_no", "pos", "title", url.alias("url")).filter(F.col("url").isNotNull())
    order = [F.col("page_no"), F.col("pos")]
    return skew.top_n_per_key(usable, ["qid"], order, limit, ["page_no", "pos"], out="n").select(
        "qid", "n", "title", "url"
    )
