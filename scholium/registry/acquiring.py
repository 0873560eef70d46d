"""Page and acquisition work.

The given pages have no publisher markup, so the queries that need it add some to every page. What
is added depends on the page's own id; each page is used.
"""

from pyspark.sql import functions as F

from scholium.operators import acquire, links
from scholium.registry.tables import ARTIFACTS_SQL, artifacts, ids, table, texts

# The same expressions run on both engines.
LANDING = """
CASE page_id % 8
  WHEN 0 THEN concat('<meta name="citation_pdf_url" content=" https://cdn.example.org/', page_id, '.pdf?a=1&amp;b=2 ">')
  WHEN 1 THEN concat('<a class="x" href="/pmc/articles/PMC', page_id, '/">free copy</a>')
  WHEN 2 THEN concat('<a title="High-Res PDF" href="/hr/', page_id, '">pdf</a>')
  WHEN 3 THEN concat('<a href="https://u.edu/doi/', page_id, '/pdf">pdf</a>')
  WHEN 4 THEN concat('<a data-download-type="Article PDF" href=//cdn.example.net/', page_id, '>pdf</a>')
  WHEN 5 THEN concat('<a href="/doi/pdf/10.1/', page_id, '">pdf</a><meta name="citation_pdf_url" content="https://first.example.org/', page_id, '">')
  WHEN 6 THEN concat('<!-- <a href="/doi/pdf/', page_id, '">hidden</a> --><a href="doi/pdf/', page_id, '">pdf</a><a href="/doi/pdf/', page_id, '">pdf</a>')
  ELSE '' END"""
LANDING_HTML = f"concat(html, {LANDING})"

HOP_URL = "concat('https://hop.example.org/a+b/', {0})"
HOP_HTML = """concat(html,
  CASE WHEN page_id % 3 = 0 THEN ''
       ELSE concat('<input type="hidden" value="https%3A%2F%2Fhop.example.org%2Fa+b%2F', page_id + 1, '">') END,
  CASE WHEN page_id % 5 = 0 THEN ''
       ELSE concat('<meta name="citation_pdf_url" content="https://hop.example.org/a+b/', page_id + 2, '">') END)"""

# Each page leads to the next one, every seventh three pages back; every fifth has only the links of its own.
TRAIL_HOPS = 4
TRAIL_HTML = """concat(html, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat(
  '<meta name="citation_pdf_url" content="https://hop.example.org/a+b/',
  CASE WHEN page_id % 7 = 6 THEN page_id - 3 ELSE page_id + 1 END, '">') END)"""
TRAIL_START = f"CASE WHEN page_id % 11 <> 0 THEN {HOP_URL.format('page_id - page_id % 2')} END"

CROSSWALK_HTML = """concat(html,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('<span class="id citation-doi"> doi: 10.1000/', page_id, '. </span>') END,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('<a href="/pmc" data-ga-action="PMCID"> PMC', page_id, ' <b>open</b></a>') END)"""

LAYOUT_URL = """CASE page_id % 6
  WHEN 0 THEN concat(url, '.pdf') WHEN 1 THEN concat('https://www.sciencedirect.com/', page_id)
  WHEN 2 THEN concat('https://www.jbc.org/', page_id) ELSE url END"""
LAYOUT_HTML = """CASE page_id % 6
  WHEN 2 THEN replace(replace(html, '<article>', concat('<div id="articleHeader"><div>H', page_id, '</div></div><div class="x article__body">')), '</article>', '</div>')
  WHEN 3 THEN replace(replace(html, '<article>', '<div class="y" id="ContentColumn">'), '</article>', '</div>')
  WHEN 4 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section><!-- <article>no</article> -->')
  ELSE html END"""


def _pages(spark, sf, url="url", html="html"):
    return texts(spark, sf, "pages").select("page_id", F.expr(url).alias("url"), F.expr(html).alias("html"))


def _hop_pages(spark, sf):
    return _pages(spark, sf, HOP_URL.format("page_id"), HOP_HTML)


def pending_ids(spark, sf):
    return acquire.pending_ids(ids(spark, sf), artifacts(spark, sf), ("pdf", "html")).select("pmid")


def route_identifiers(spark, sf):
    forms = F.expr("""stack(4, url, concat('https://files.example.org/', page_id, '.pdf'),
                             cast(page_id as string), concat('10.1000/', page_id)) AS identifier""")
    return acquire.route_identifiers(table(spark, sf, "pages").select("page_id", forms))


def identifier_class_counts(spark, sf):
    return acquire.count_by(route_identifiers(spark, sf), "id_class")


def extract_links(spark, sf):
    return links.extract_links(_pages(spark, sf, html=LANDING_HTML))


def resolve_fulltext_link(spark, sf):
    return links.resolve_fulltext_link(_pages(spark, sf, html=LANDING_HTML))


def follow_link_hops(spark, sf):
    pages = _hop_pages(spark, sf)
    return links.follow_link_hops(links.embedded_target(pages), pages)


def trace_links(spark, sf):
    pages = _pages(spark, sf, HOP_URL.format("page_id"), TRAIL_HTML)
    started = table(spark, sf, "pages").select("page_id", F.expr(TRAIL_START).alias("target"))
    return links.trace_links(started, pages, TRAIL_HOPS)


def identifier_crosswalk(spark, sf):
    return links.identifier_crosswalk(_pages(spark, sf, html=CROSSWALK_HTML))


def extract_main_text(spark, sf):
    return links.extract_main_text(texts(spark, sf, "pages"))


def _layouts(spark, sf):
    return links.extract_main_text(_pages(spark, sf, LAYOUT_URL, LAYOUT_HTML))


def page_outcome_counts(spark, sf):
    return acquire.page_outcome_counts(_layouts(spark, sf))


SOURCES = list(acquire.SOURCE_ORDER)


def first_source_wins(spark, sf):
    d = table(spark, sf, "documents")
    pmid = F.col("doc_id").cast("string").alias("pmid")
    names = F.lit(SOURCES)

    def tried(number):
        n = F.expr(number).cast("int")
        return d.select(pmid, F.get(names, n).alias("source"), F.when(n < 3, "pdf").otherwise("txt").alias("kind"))

    candidates = tried("n_chars % 5").unionByName(tried("doc_id % 5"))
    return acquire.first_source_wins(candidates, artifacts(spark, sf))


def backfill_abstracts(spark, sf):
    d = table(spark, sf, "documents")
    text = F.expr("CASE WHEN lang = 'es' THEN NULL WHEN source = 'src7' THEN '' ELSE text END")
    abstracts = d.select(F.col("doc_id").cast("string").alias("pmid"), text.alias("abstract"))
    filled = acquire.backfill_abstracts(ids(spark, sf), abstracts, artifacts(spark, sf), 100)
    return filled.select("pmid", "batch_no", F.md5("abstract").alias("digest"))


def acquisition_report(spark, sf):
    return acquire.acquisition_report(ids(spark, sf), artifacts(spark, sf))


def failed_and_done_ids(spark, sf):
    i, a = ids(spark, sf), artifacts(spark, sf)
    failed = acquire.failed_ids(i, a).withColumn("list", F.lit("failed"))
    return failed.unionByName(acquire.done_ids(i, a).withColumn("list", F.lit("done")))


def content_key(spark, sf):
    viewed = _pages(spark, sf, "concat(url, CASE WHEN page_id % 2 = 0 THEN '#view=fit' ELSE '' END)")
    return acquire.content_key(viewed, "html").select("page_id", "content_key")


def content_key_collisions(spark, sf):
    d = table(spark, sf, "documents").select("text", F.concat(F.lit("https://x.example.org/"), "lang").alias("url"))
    return acquire.content_key_collisions(acquire.content_key(d, "text"))


BLOCKED = ("ovid", "cheap-pills")


def exclude_hosts(spark, sf):
    kept, blocked = links.exclude_hosts(table(spark, sf, "pages"), BLOCKED)
    return kept.select("page_id", F.lit("kept").alias("status")).unionByName(blocked)


def _result_pages(spark, sf):
    """Every page as a result page: its menu entries become results of a query named by its host."""
    entry = "<li><a href=\"([^\"]*)\">([^<]*)</a></li>"
    block = (
        '<div class="gs_r x"><div class="gs_ggs gs_fl"><div><a href="/pdf$1">[pdf]</a></div></div>'
        '<h3 class="gs_rt"><a href="$1"><b>$2</b></a></h3></div>'
    )
    plain = '<div class="gs_r"><h3 class="gs_rt"><a href="$1">$2</a></h3></div>'
    table_block = '<div class="gs_r"><table><tr><td></td></tr></table><h3 class="gs_rt"><a href="/none">none</a></h3></div>'
    html = F.when(
        F.col("page_id") % 2 == 0, F.regexp_replace("html", entry, block)
    ).otherwise(F.concat(F.regexp_replace("html", entry, plain), F.lit(table_block)))
    return texts(spark, sf, "pages").select(
        F.substring_index("url", "/", 3).alias("qid"), F.col("page_id").alias("page_no"), html.alias("html")
    )


def result_blocks(spark, sf):
    return links.result_blocks(_result_pages(spark, sf)).drop("pos")


def result_list(spark, sf):
    return links.result_list(links.result_blocks(_result_pages(spark, sf)))


QUERIES = {
    "pending_ids": pending_ids,
    "route_identifiers": route_identifiers,
    "identifier_class_counts": identifier_class_counts,
    "extract_links": extract_links,
    "resolve_fulltext_link": resolve_fulltext_link,
    "follow_link_hops": follow_link_hops,
    "trace_links": trace_links,
    "identifier_crosswalk": identifier_crosswalk,
    "extract_main_text": extract_main_text,
    "extract_main_text_layouts": _layouts,
    "page_outcome_counts": page_outcome_counts,
    "first_source_wins": first_source_wins,
    "backfill_abstracts": backfill_abstracts,
    "acquisition_report": acquisition_report,
    "failed_and_done_ids": failed_and_done_ids,
    "content_key": content_key,
    "content_key_collisions": content_key_collisions,
    "exclude_hosts": exclude_hosts,
    "result_blocks": result_blocks,
    "result_list": result_list,
}

_HIDDEN = r"regexp_replace(regexp_replace({0}, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script\b[^>]*>.*?</script|style\b[^>]*>.*?</style)\s*>', '', 'g')"
_ELEMENT = r"""'(?i)<(?:{0})\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>'"""


def _attr(name):
    pattern = r"""'(?i)\s{0}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))'""".format(name)
    parts = " || ".join(f"regexp_extract(element, {pattern}, {n})" for n in (1, 2, 3))
    return f"nullif(replace({parts}, '&amp;', '&'), '')"


def _elements(pages_sql, tags):
    return f"""
pages_x AS ({pages_sql}),
arrays AS (SELECT page_id, url, regexp_extract_all({_HIDDEN.format('html')}, {_ELEMENT.format(tags)}) AS els FROM pages_x),
elements AS (SELECT page_id, url, CAST(generate_subscripts(els, 1) - 1 AS INTEGER) AS pos, unnest(els) AS element FROM arrays),
links AS (
  SELECT page_id, url, pos, lower(regexp_extract(element, '^<([A-Za-z0-9]+)', 1)) AS tag, {_attr('href')} AS href,
         {_attr('title')} AS title, {_attr('data-download-type')} AS download_type, {_attr('name')} AS name,
         {_attr('content')} AS content, {_attr('value')} AS value
  FROM elements)"""


_LANDING_LINKS = _elements(
    f"SELECT page_id, url, {LANDING_HTML} AS html FROM pages", "a|meta|iframe|frame|input"
)
_HOP_LINKS = _elements(
    f"SELECT page_id, {HOP_URL.format('page_id')} AS url, {HOP_HTML} AS html FROM pages", "a|meta|input"
)
_TRAIL_LINKS = _elements(
    f"SELECT page_id, {HOP_URL.format('page_id')} AS url, {TRAIL_HTML} AS html FROM pages", "a|meta"
)
_BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|"
    "main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)


def _visible(html):
    flat = rf"regexp_replace(regexp_replace({html}, '(?i)</?(?:{_BLOCK_TAGS})(?:[\s/][^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        flat = f"replace({flat}, '&{entity};', '{char}')"
    return rf"trim(regexp_replace({flat}, '\s+', ' ', 'g'))"


_ARTICLE = _visible(rf"regexp_extract({_HIDDEN.format('html')}, '(?is)<article(?:[\s/][^>]*)?>(.*?)</article\s*>', 1)")

_LAYOUTS = f"""
layouts AS (
  SELECT page_id, {LAYOUT_URL} AS url, page_id % 6 AS layout, {_ARTICLE} AS body FROM pages),
outcomes AS (
  SELECT page_id,
         CASE WHEN contains(url, 'pdf') OR layout = 4 THEN NULL WHEN layout = 2 THEN 'H' || page_id || body ELSE body END AS text,
         CASE WHEN contains(url, 'pdf') OR layout = 4 THEN NULL WHEN layout = 2 THEN 'header_body'
              WHEN layout = 3 THEN 'content_column' ELSE 'article' END AS extractor,
         CASE WHEN contains(url, 'pdf') THEN 'pdf' WHEN layout = 4 THEN 'html_error' ELSE 'ok' END AS status
  FROM layouts)"""

_SOURCES_SQL = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"

_BLOCKS = r"""
pieces AS (
  SELECT array_to_string(string_split(url, '/')[1:3], '/') AS qid, page_id AS page_no,
         regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS hrefs,
         regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS titles FROM pages),
blocks AS (
  SELECT qid, page_no, unnest(hrefs) AS title_href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS pos FROM pieces),
results AS (
  SELECT qid, page_no, pos, trim(title) AS title, CASE WHEN page_no % 2 = 0 THEN '/pdf' || title_href END AS pdf_href, title_href
  FROM blocks)"""

ORACLES = {
    "pending_ids": f"""
WITH {ARTIFACTS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS pmid FROM documents
WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT pmid FROM artifacts WHERE kind IN ('pdf', 'html'))""",
    "route_identifiers": """
SELECT page_id, url AS identifier, CASE WHEN suffix(url, 'pdf') THEN 'url-direct' ELSE 'url-non-direct' END AS id_class FROM pages
UNION ALL SELECT page_id, 'https://files.example.org/' || page_id || '.pdf', 'url-direct' FROM pages
UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), 'pmid' FROM pages
UNION ALL SELECT page_id, '10.1000/' || page_id, 'doi' FROM pages""",
    "identifier_class_counts": """
SELECT id_class, count(*) AS n FROM (
  SELECT CASE WHEN suffix(url, 'pdf') THEN 'url-direct' ELSE 'url-non-direct' END AS id_class FROM pages
  UNION ALL SELECT 'url-direct' FROM pages UNION ALL SELECT 'pmid' FROM pages UNION ALL SELECT 'doi' FROM pages)
GROUP BY id_class""",
    "extract_links": f"WITH {_LANDING_LINKS} SELECT page_id, pos, tag, href, title, download_type, name, content, value FROM links",
    "resolve_fulltext_link": rf"""
WITH {_LANDING_LINKS},
matches AS (
  SELECT page_id, pos, 1 AS rule_no, content AS target FROM links WHERE tag = 'meta' AND name = 'citation_pdf_url'
  UNION ALL SELECT page_id, pos, 2, 'https://www.ncbi.nlm.nih.gov' || href FROM links WHERE tag = 'a' AND contains(href, '/pmc/articles')
  UNION ALL SELECT page_id, pos, 3, array_to_string(string_split(url, '/')[1:3], '/') || href FROM links
    WHERE tag = 'a' AND regexp_matches(lower(title), '(high|low)-res pdf')
  UNION ALL SELECT page_id, pos, 4, href FROM links WHERE tag = 'a' AND contains(href, 'pdf') AND contains(href, '.edu/doi/')
  UNION ALL SELECT page_id, pos, 5, 'http:' || href FROM links WHERE tag = 'a' AND lower(download_type) = 'article pdf'
  UNION ALL SELECT page_id, pos, 6, array_to_string(string_split(url, '/')[1:3], '/') || href FROM links WHERE tag = 'a' AND contains(href, '/doi/pdf')),
best AS (SELECT page_id, CAST(rule_no AS INTEGER) AS rule_no, trim(target) AS target FROM matches
         QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rule_no, pos) = 1)
SELECT page_id, rule_no, target FROM pages LEFT JOIN best USING (page_id)""",
    "follow_link_hops": f"""
WITH {_HOP_LINKS},
start AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN {HOP_URL.format('page_id + 1')} END AS target FROM pages),
metas AS (SELECT url, content AS next FROM links WHERE tag = 'meta' AND name = 'citation_pdf_url'
          QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1),
anchors AS (SELECT url, href AS next FROM links WHERE tag = 'a'
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1)
SELECT s.page_id, a.next AS target
FROM start s LEFT JOIN metas m ON m.url = s.target LEFT JOIN anchors a ON a.url = m.next""",
    "trace_links": f"""
WITH RECURSIVE {_TRAIL_LINKS},
start AS (SELECT page_id, {TRAIL_START} AS target FROM pages),
metas AS (SELECT url, content AS next FROM links WHERE tag = 'meta' AND name = 'citation_pdf_url'
          QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1),
anchors AS (SELECT url, href AS next FROM links WHERE tag = 'a'
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1),
nexts AS (SELECT url, coalesce(m.next, a.next) AS next FROM metas m FULL JOIN anchors a USING (url)
          WHERE coalesce(m.next, a.next) IS NOT NULL),
walk AS (
  SELECT page_id, target, [target] AS visited, 0 AS n FROM start WHERE target IS NOT NULL
  UNION ALL
  SELECT page_id, next, list_append(visited, next), n + 1 FROM walk w JOIN nexts ON url = target
  WHERE n < {TRAIL_HOPS} AND NOT list_contains(visited, next)),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1)
SELECT s.page_id, l.target, CAST(coalesce(n, 0) AS INTEGER) AS n_hops,
       CASE WHEN n = {TRAIL_HOPS} THEN 'limit' WHEN next IS NOT NULL THEN 'cycle' ELSE 'end' END AS ended
FROM start s LEFT JOIN last l USING (page_id) LEFT JOIN nexts x ON x.url = l.target""",
    "identifier_crosswalk": """
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN '10.1000/' || page_id END AS doi,
       CASE WHEN page_id % 4 <> 0 THEN 'PMC' || page_id END AS pmcid
FROM pages""",
    "extract_main_text": f"""
SELECT page_id, CASE WHEN contains(url, 'pdf') THEN NULL ELSE {_ARTICLE} END AS text,
       CASE WHEN contains(url, 'pdf') THEN NULL ELSE 'article' END AS extractor,
       CASE WHEN contains(url, 'pdf') THEN 'pdf' ELSE 'ok' END AS status
FROM pages""",
    "extract_main_text_layouts": f"WITH {_LAYOUTS} SELECT page_id, text, extractor, status FROM outcomes",
    "page_outcome_counts": f"WITH {_LAYOUTS} SELECT status, count(*) AS n FROM outcomes GROUP BY status",
    "first_source_wins": f"""
WITH {ARTIFACTS_SQL},
tried AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid, n_chars % 5 AS i FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id % 5 FROM documents),
allowed AS (
  SELECT pmid, i FROM tried t WHERE NOT EXISTS (
    SELECT 1 FROM artifacts a WHERE a.pmid = t.pmid AND (a.kind IN ('pdf', 'html') OR (a.kind = 'txt' AND t.i >= 3))))
SELECT pmid, ({_SOURCES_SQL})[min(i) + 1] AS source, CASE WHEN min(i) < 3 THEN 'pdf' ELSE 'txt' END AS kind
FROM allowed GROUP BY pmid""",
    "backfill_abstracts": f"""
WITH {ARTIFACTS_SQL},
numbered AS (
  SELECT CAST(doc_id AS VARCHAR) AS pmid, text, lang, source, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_no
  FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT pmid FROM artifacts WHERE kind = 'txt'))
SELECT pmid, CAST(batch_no AS BIGINT) AS batch_no, md5(text) AS digest
FROM numbered WHERE lang <> 'es' AND source <> 'src7' AND text <> ''""",
    "acquisition_report": f"""
WITH {ARTIFACTS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS pmid,
       CASE WHEN CAST(doc_id AS VARCHAR) IN (SELECT pmid FROM artifacts) THEN 'done' ELSE 'failed' END AS status
FROM documents""",
    "failed_and_done_ids": f"""
WITH {ARTIFACTS_SQL}
SELECT CAST(doc_id AS VARCHAR) AS pmid,
       CASE WHEN CAST(doc_id AS VARCHAR) IN (SELECT pmid FROM artifacts) THEN 'done' ELSE 'failed' END AS list
FROM documents""",
    "content_key": r"""
SELECT page_id, md5(html) || '-' || right(regexp_replace(string_split(
         url || CASE WHEN page_id % 2 = 0 THEN '#view=fit' ELSE '' END, '/')[-1], '#view=(.+)', '', 'g'), 20) AS content_key
FROM pages""",
    "content_key_collisions": """
SELECT md5(text) || '-' || lang AS content_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "exclude_hosts": """
SELECT page_id, CASE WHEN contains(url, 'ovid') OR contains(url, 'cheap-pills') THEN 'blocked' ELSE 'kept' END AS status
FROM pages""",
    "result_blocks": f"WITH {_BLOCKS} SELECT qid, page_no, title, pdf_href, title_href FROM results",
    "result_list": f"""
WITH {_BLOCKS}
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY page_no, pos) AS INTEGER) AS n, title,
       coalesce(pdf_href, title_href) AS url
FROM results QUALIFY n <= 10""",
}
