"""Feeds, outlines, crawl rules, site maps and what markup holds; literal inputs beside the pages, which have few of these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import graph
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import table

_HTML = Literal("marked", "page_id long, url string, html string", (
    (-1, "https://a.example/x/y.html", '<link rel="alternate" type="application/rss+xml" href="feed.xml"><link type=\'application/atom+xml\' href=\'/atom\'><link rel="alternate" type="application/rss+xml" href="feed.xml"><img alt="A red house" src=1><img src=2 alt="logo"><img alt="cat">'),
    (-2, "https://b.example/", '<link rel="canonical" href="https://b.example/real"><link type="application/rss+xml" title="none"><img alt=\'Avatar\'><img alt="  Two dogs  ">'),
    (-3, "https://c.example/p/", '<link href="https://c.example/p" rel="canonical"><p>no images</p>'),
    (-4, "https://d.example/q", '<link rel="canonical" href="https://d.example/q">'),
))
_PAGES_SQL = f"{_HTML.sql}, web AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM marked)"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(_HTML.frame(spark))


@query(
    "feed_discovery",
    f"""WITH {_PAGES_SQL}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(<link\\b[^>]*type=["'']application/(?:rss|atom)\\+xml["''][^>]*>)', 1)) AS tag FROM web), h AS (SELECT DISTINCT page_id, regexp_extract(tag, '(?i)href=["'']([^"'']+)["'']', 1) AS href FROM t)
 SELECT page_id, CASE href WHEN 'feed.xml' THEN 'https://a.example/x/feed.xml' WHEN '/atom' THEN 'https://a.example/atom' ELSE href END AS feed FROM h WHERE href <> ''""",
)
def feed_discovery(spark, sf_dir):
    """Absolute addresses of the feeds that pages link to."""
    rows = _pages(spark, sf_dir).select("page_id", "url", F.explode(markup.feed_links(F.col("html"))).alias("href"))
    return rows.select("page_id", graph.resolved(F.col("href"), F.col("url")).alias("feed")).distinct()


_CANON = """coalesce(nullif(regexp_extract(html, '(?i)<link\\s[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)<link\\s[^>]*href=["'']([^"'']+)["''][^>]*rel=["'']canonical["'']', 1), ''))"""


@query("canonical_redirects", f"WITH {_PAGES_SQL}, c AS (SELECT page_id, url, {_CANON} AS canonical FROM web) SELECT page_id, canonical FROM c WHERE canonical IS NOT NULL AND canonical <> url AND canonical <> rtrim(url, '/')")
def canonical_redirects(spark, sf_dir):
    """Pages that name another address as theirs: they go, and that address is queued."""
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    canonical = F.coalesce(one(r"""(?i)<link\s[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["']"""), one(r"""(?i)<link\s[^>]*href=["']([^"']+)["'][^>]*rel=["']canonical["']"""))
    rows = _pages(spark, sf_dir).select("page_id", "url", canonical.alias("canonical"))
    return rows.filter((F.col("canonical") != F.col("url")) & (F.col("canonical") != F.rtrim(F.col("url"), F.lit("/")))).select("page_id", "canonical")


@query("image_texts", f"""WITH {_PAGES_SQL}, a AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?i)<img\\b[^>]*\\balt=["'']([^"'']{{3,200}})["'']', 1))) AS alt FROM web) SELECT page_id, alt FROM a WHERE length(alt) > 3 AND lower(alt) NOT IN ({', '.join(f"'{x}'" for x in markup.PLACEHOLDERS)})""")
def image_texts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(markup.image_texts(F.col("html"))).alias("alt"))


@query("plain_markup", "SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ') AS plain FROM pages")
def plain_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.plain(F.col("html")).alias("plain"))


_ROBOTS = Literal("robots", "domain string, body string", (
    ("a.example", "User-agent: *\nDisallow: /private\nAllow: /\nCrawl-delay: 2.5\nSitemap: https://a.example/s1.xml\nsitemap: https://a.example/s2.xml\nCrawl-delay: 9"),
    ("b.example", "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow:\n"),
    ("c.example", ""),
    ("d.example", "User-agent: *\r\nDisallow: /\r\n"),
))


_RULES_SQL = "'User-agent: *' || chr(10) || 'Disallow: /' || page_id || chr(10) || 'Crawl-delay: ' || page_id % 7 || chr(10) || 'Sitemap: ' || url || '/map.xml'"


def _rules(spark, sf_dir):
    """Crawl rules of some domains, and one domain for each page, which forbids the page's number."""
    body = F.concat(F.lit("User-agent: *\nDisallow: /"), F.col("page_id").cast("string"), F.lit("\nCrawl-delay: "), (F.col("page_id") % 7).cast("string"), F.lit("\nSitemap: "), "url", F.lit("/map.xml"))
    return _ROBOTS.frame(spark).unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".example")).alias("domain"), body.alias("body")))


@query("robots_directives", f"WITH {_ROBOTS.sql.replace('robots AS', 'few AS')}, robots AS (SELECT * FROM few UNION ALL SELECT 'p' || page_id || '.example', {_RULES_SQL} FROM pages) SELECT domain, array_to_string(regexp_extract_all(body, '(?im)^\\s*Sitemap:\\s*(\\S+)', 1), ' ') AS site_maps, nullif(regexp_extract(body, '(?im)^\\s*Crawl-delay:\\s*(\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE AS crawl_delay FROM robots")
def robots_directives(spark, sf_dir):
    return _rules(spark, sf_dir).select("domain", F.array_join(markup.site_maps(F.col("body")), " ").alias("site_maps"), markup.crawl_delay(F.col("body")).alias("crawl_delay"))


_PATHS = Literal("paths", "domain string, path string", (("a.example", "/private/x"), ("a.example", "/public"), ("b.example", "/any"), ("c.example", "/any"), ("d.example", "/any"), ("e.example", "/any")))


@query("robots_allowed", f"WITH {_PATHS.sql} SELECT domain, path, NOT (domain = 'a.example' AND path = '/private/x' OR domain = 'd.example') AS allowed FROM paths UNION ALL SELECT 'p' || page_id || '.example', p.path, NOT p.no FROM pages, LATERAL (VALUES ('/' || page_id || '/x', true), ('/x/' || page_id, false)) p(path, no)")
def robots_allowed(spark, sf_dir):
    """Whether the rules of a domain let all agents crawl a path; a domain without rules lets them."""
    number = F.col("page_id").cast("string")
    ways = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), number, F.lit(".example")).alias("domain"), F.explode(F.array(F.concat(F.lit("/"), number, F.lit("/x")), F.concat(F.lit("/x/"), number))).alias("path"))
    rows = _PATHS.frame(spark).unionByName(ways).join(_rules(spark, sf_dir), "domain", "left")
    return rows.select("domain", "path", F.coalesce(~markup.forbidden(F.col("body"), F.col("path")), F.lit(True)).alias("allowed"))


_MAPS = Literal("maps", "domain string, body string", (("a.example", "<urlset><url><loc> https://a.example/1 </loc></url><url><LOC>http://a.example/2</LOC></url><loc>ftp://no</loc></urlset>"), ("b.example", "<urlset/>")))


@query("site_map_urls", f"WITH {_MAPS.sql} SELECT DISTINCT domain, unnest(regexp_extract_all(body, '(?i)<loc>\\s*(https?://[^<]+?)\\s*</loc>', 1)) AS url FROM maps")
def site_map_urls(spark, sf_dir):
    """Addresses of site maps that no page has yet."""
    rows = _MAPS.frame(spark).select("domain", F.explode(markup.locations(F.col("body"))).alias("url")).distinct()
    return rows.join(table(spark, sf_dir, "pages").select("url").distinct(), "url", "left_anti").select("domain", "url")


_OPML = Literal("opml", "id long, body string", ((1, '<opml><outline text="All"><outline text=" One " xmlUrl="https://a/f" /><outline title=\'Two\' xmlUrl=\'https://b/f\'/><outline text="" title="T" xmlUrl="https://c/f"/><outline text="Again" xmlUrl="https://a/f"/></outline></opml>'), (2, "<opml/>")))


@query("opml_feeds", "SELECT * FROM (VALUES (1::BIGINT, 'https://a/f', 'One'), (1, 'https://b/f', 'Two'), (1, 'https://c/f', '')) v(id, url, label) UNION ALL SELECT -doc_id - 1, 'https://' || source || '/' || doc_id, source FROM documents")
def opml_feeds(spark, sf_dir):
    """Feeds of outlines: some of every kind, and one a document."""
    body = F.concat(F.lit('<opml><outline text="'), "source", F.lit('" xmlUrl="https://'), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit('"/></opml>'))
    listed = _OPML.frame(spark).unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), body.alias("body")))
    return listed.select("id", F.inline(markup.outlines(F.col("body"))))


_CODE = Literal("code", "id long, html string", ((1, '<pre class=x><code class="language-Python">a = 1\nb &lt; 2</code></pre><pre><code>one line</code></pre><code>no\npre</code>'), (2, "<pre> <code>x\ny\nz</code></pre>"), (3, "none")))


@query("code_blocks", "SELECT * FROM (VALUES (1::BIGINT, 'python', 'a = 1' || chr(10) || 'b < 2', 2), (2, '', 'x' || chr(10) || 'y' || chr(10) || 'z', 3)) v(id, language, code, lines) UNION ALL SELECT -doc_id - 1, coalesce(lang, ''), text, length(text) - length(replace(text, chr(10), '')) + 1 FROM documents WHERE contains(text, chr(10))")
def code_blocks(spark, sf_dir):
    """Code blocks of some pages, and of one page for each document, whose text is its code."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<p>x</p><pre><code"), F.coalesce(F.concat(F.lit(' class="language-'), "lang", F.lit('"')), F.lit("")), F.lit(">"), escaped, F.lit("</code></pre>"))
    written = _CODE.frame(spark).unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), html.alias("html")))
    return written.select("id", F.inline(markup.code_blocks(F.col("html"))))


_TABLES = Literal("tables", "id long, html string", ((1, "<table><tr><th>k</th><th>v</th></tr><tr><td>a &amp; b</td><td><b>1</b></td></tr><tr><td>c</td></tr></table><p>x</p><table><tr><td>z</td></tr></table>"), (2, "<p>none</p>")))


def _tables(spark, sf_dir):
    """Pages with tables: some, and one for every ten customers."""
    row = F.format_string("<tr><td>%d</td><td>%d</td></tr>", F.col("c_custkey"), F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").groupBy((-F.floor(F.col("c_custkey") / 10) - 1).alias("id")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", row.alias("r")))).alias("l"))  # ten at most
    html = F.concat(F.lit("<table><tr><th>key</th><th>nation</th></tr>"), F.array_join(F.transform("l", lambda x: x["r"]), ""), F.lit("</table>"))
    return _TABLES.frame(spark).unionByName(rows.select("id", html.alias("html")))


@query("table_csv", """SELECT * FROM (VALUES (1::BIGINT, 0, '"k","v"' || chr(10) || '"a & b","1"' || chr(10) || '"c"'), (1, 1, '"z"')) v(id, pos, csv) UNION ALL SELECT -(c_custkey // 10) - 1, 0, '"key","nation"' || chr(10) || string_agg('"' || c_custkey || '","' || c_nationkey || '"', chr(10) ORDER BY c_custkey) FROM customer GROUP BY 1""")
def table_csv(spark, sf_dir):
    """Tables of some pages and of the customers, ten in a table."""
    return _tables(spark, sf_dir).select("id", F.posexplode(F.transform(markup.table_cells(F.col("html")), markup.csv)).alias("pos", "csv"))


@query("table_records", """SELECT * FROM (VALUES (1::BIGINT, 0, '{"k":"a & b","v":"1"}'), (1, 0, '{"k":"c","v":""}')) v(id, pos, record) UNION ALL SELECT -(c_custkey // 10) - 1, 0, '{"key":"' || c_custkey || '","nation":"' || c_nationkey || '"}' FROM customer""")
def table_records(spark, sf_dir):
    """Rows of the tables by the names in their first."""
    tables = _tables(spark, sf_dir).select("id", F.posexplode(markup.table_cells(F.col("html"))).alias("pos", "cells"))
    return tables.select("id", "pos", F.explode(markup.records(F.col("cells"))).alias("r")).select("id", "pos", F.to_json("r").alias("record"))


_LD = Literal("ld", "id long, html string", ((1, '<script type="application/ld+json">{"@type": "Article", "name": "N"}</script><script type="application/ld+json">{broken</script>'), (2, "<script>var x</script>")))


@query("json_ld", "SELECT * FROM (VALUES (1::BIGINT, 'Article', 'N')) v(id, type, name) UNION ALL SELECT -doc_id - 1, lang, source FROM documents")
def json_ld(spark, sf_dir):
    """What scripts of some pages say, and those of one page for each document."""
    html = F.concat(F.lit("<script type='application/ld+json'>"), F.to_json(F.struct(F.col("lang").alias("@type"), F.col("source").alias("name"))), F.lit("</script>"))
    pages = _LD.frame(spark).unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), html.alias("html")))
    rows = pages.select("id", F.explode(markup.json_ld(F.col("html"))).alias("j"))
    return rows.select("id", F.get_json_object("j", "$['@type']").alias("type"), F.get_json_object("j", "$.name").alias("name"))
