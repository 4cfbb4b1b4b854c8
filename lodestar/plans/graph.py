"""Corpus aggregates and the link graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quality, text
from ..operators import graph
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, NOW, documents, table
from .quality import JS_SQL

_LINKED = Literal("linked", "url string, html string", (
    ("https://a.example/x/y/z.html", '<a href="b.html">1</a><a href="../c?d=1#e">2</a><a class=k href=\'./\'>3</a><a href="//h.example/q">4</a><a href="mailto:a@b.c">5</a><a href="#top">6</a><a href="../../../up">7</a><a href="?p=2">8</a>'),
    ("http://b.example", '<a href="one/two">1</a><a href="/three/../four/.">2</a><a href="HTTP://C.example/File.PDF">3</a><a href="javascript:void(0)">4</a><a href="song.mp3?x=1">5</a><a href="page.pdf.html">6</a>'),
))
# Dot segments go one by one in the twin: first single dots, then the first pair of a name and two dots, often enough for the pages.
_STEPS = "regexp_replace(regexp_replace(full_path, '/(\\./)+', '/', 'g'), '/\\.$', '/')"
for _ in range(8):
    _STEPS = f"regexp_replace(regexp_replace(regexp_replace({_STEPS}, '^(/\\.\\.)+(/|$)', '/'), '/[^/]+/\\.\\.(/)', '/'), '/[^/]+/\\.\\.$', '/')"
LINKS_SQL = rf"""{_LINKED.sql}, hr AS (SELECT url AS source_url, trim(unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"''#][^"'']*)', 1)))) AS h FROM (SELECT url, html FROM pages UNION ALL SELECT * FROM linked)),
pt AS (SELECT source_url, regexp_replace(h, '#.*$', '') AS h, regexp_extract(source_url, '^([a-zA-Z]+://[^/?#]*)', 1) AS base, regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM hr),
fp AS (SELECT *, regexp_extract(h, '(\?.*)$', 1) AS q, CASE WHEN regexp_extract(h, '^([^?]*)', 1) = '' THEN path WHEN starts_with(h, '/') THEN regexp_extract(h, '^([^?]*)', 1) ELSE '/' || regexp_extract(path, '^/?(.*/)?[^/]*$', 1) || regexp_extract(h, '^([^?]*)', 1) END AS full_path FROM pt),
fu AS (SELECT DISTINCT source_url, CASE WHEN regexp_matches(h, '^(?i)https?://') THEN h WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL WHEN starts_with(h, '//') THEN regexp_extract(source_url, '^([a-zA-Z]+):', 1) || ':' || h WHEN base <> '' THEN base || CASE WHEN full_path = '' THEN '/' ELSE {_STEPS} END || q END AS target_url FROM fp),
links AS (SELECT *, lower(regexp_extract(source_url, '://([^/?#]*)', 1)) AS source_domain, lower(regexp_extract(target_url, '://([^/?#]*)', 1)) AS target_domain FROM fu WHERE target_url IS NOT NULL AND lower(regexp_extract(target_url, '://([^/?#]*)', 1)) <> ''
 AND NOT regexp_matches(lower(regexp_extract(target_url, '://[^/?#]*([^?#]*)', 1)), '({"|".join(x.replace(".", chr(92) + ".") for x in graph.SKIPPED)})$'))"""


def linked(spark, sf_dir):
    """All pages, and two literal ones with links of every kind."""
    return table(spark, sf_dir, "pages").select("url", "html").unionByName(_LINKED.frame(spark))


@query("extract_links", f"WITH {LINKS_SQL} SELECT source_url, target_url FROM links")
def extract_links(spark, sf_dir):
    return graph.links(linked(spark, sf_dir)).select("source_url", "target_url")


#: Pages link only within their host, so every page also votes for the next page's host here.
CITED_SQL = f"""{LINKS_SQL}, cited AS (SELECT source_domain, target_domain FROM links UNION ALL SELECT lower(regexp_extract(a.url, '://([^/?#]*)', 1)), lower(regexp_extract(b.url, '://([^/?#]*)', 1)) FROM pages a JOIN pages b ON b.page_id = (a.page_id * 7) % 50)"""


def cited(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = lambda c: F.lower(F.regexp_extract(c, "://([^/?#]*)", 1))
    a = p.select(host(F.col("url")).alias("source_domain"), ((F.col("page_id") * 7) % 50).alias("k"))
    b = p.select(host(F.col("url")).alias("target_domain"), F.col("page_id").alias("k"))
    return graph.links(linked(spark, sf_dir)).select("source_domain", "target_domain").unionByName(a.join(b, "k").select("source_domain", "target_domain"))


@query(
    "link_degree",
    f"""WITH {CITED_SQL}, e AS (SELECT DISTINCT source_domain s, target_domain t FROM cited WHERE source_domain <> target_domain), n AS (SELECT source_domain AS domain FROM cited UNION SELECT target_domain FROM cited)
 SELECT domain, (SELECT count(*) FROM e WHERE t = domain) AS n_in, (SELECT count(*) FROM e WHERE s = domain) AS n_out FROM n""",
)
def link_degree(spark, sf_dir):
    return graph.degrees(cited(spark, sf_dir))


_RANK_STEPS = "".join(
    f", r{i + 1} AS (SELECT domain, 0.15::DOUBLE / (SELECT count(*) FROM names) + 0.85::DOUBLE * coalesce(sum(share * score), 0) AS score FROM names LEFT JOIN (SELECT t, share, score FROM sh JOIN r{i} ON s = r{i}.domain) x ON t = names.domain GROUP BY domain)" for i in range(graph.ROUNDS)
)


@query(
    "domain_authority",
    f"""WITH {CITED_SQL}, w AS (SELECT source_domain s, target_domain t, CASE WHEN source_domain = target_domain THEN count(*) * 0.1::DOUBLE ELSE count(*) END AS wt FROM cited GROUP BY source_domain, target_domain),
 sh AS MATERIALIZED (SELECT s, t, wt / sum(wt) OVER (PARTITION BY s) AS share FROM w), names AS MATERIALIZED (SELECT source_domain AS domain FROM cited UNION SELECT target_domain FROM cited),
 r0 AS (SELECT domain, 1.0::DOUBLE / (SELECT count(*) FROM names) AS score FROM names){_RANK_STEPS} SELECT domain, round(score / (SELECT max(score) FROM r{graph.ROUNDS}), 6) AS score FROM r{graph.ROUNDS}""",
)
def domain_authority(spark, sf_dir):
    return graph.authority(cited(spark, sf_dir))


@query("corpus_stats", f"WITH {DOCUMENTS_SQL} SELECT count(*) AS n_docs, count(*) FILTER (crawled_at >= {NOW} - 3600) AS last_hour, max(crawled_at) AS latest, count(DISTINCT domain) AS domains FROM docs")
def corpus_stats(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.agg(F.count("*").alias("n_docs"), F.count_if(F.col("crawled_at") >= NOW - 3600).alias("last_hour"), F.max("crawled_at").alias("latest"), F.count_distinct("domain").alias("domains"))


@query("top_domains", f"WITH {DOCUMENTS_SQL} SELECT domain, count(*) AS n FROM docs GROUP BY domain ORDER BY n DESC, domain LIMIT 7")
def top_domains(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(7)


_SCRIPTED = Literal("scripted", "url string, html string", (
    ("https://app.example/1", "<html><body><div id='root'></div><script>var a = 1; var b = 2; var c = 3; document.write(a + b + c); document.title = 'x';</script></body></html>"),
    ("https://app.example/2", "<html><body><p>This page has a lot of plain text that anybody can read without any script at all, and then some more of it.</p></body></html>"),
    ("https://spa.example/", "<html><body><div id='app'></div><noscript>You need to enable JavaScript to run this app.</noscript></body></html>"),
))


@query("js_domains", f"WITH {_SCRIPTED.sql}, {JS_SQL.replace('page_id', 'url').replace('FROM pages', 'FROM (SELECT url, html FROM pages UNION ALL SELECT * FROM scripted)')}, p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS domain, (confidence >= 0.5)::INT AS js FROM s) SELECT domain, count(*) AS n, sum(js) AS n_js, round(sum(js) / count(*)::DOUBLE, 6) AS ratio FROM p GROUP BY domain HAVING sum(js) > 0")
def js_domains(spark, sf_dir):
    """Share of the pages of a domain that need JavaScript."""
    pages = table(spark, sf_dir, "pages").select("url", "html").unionByName(_SCRIPTED.frame(spark))
    p = pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("domain"), (quality.js_score(F.col("html")) >= 0.5).cast("int").alias("js"))
    return p.groupBy("domain").agg(F.count("*").alias("n"), F.sum("js").alias("n_js"), F.round(F.avg("js"), 6).alias("ratio")).filter("n_js > 0")


_BUCKET = f"CASE WHEN {NOW} - crawled_at < 0 THEN 'unknown' WHEN {NOW} - crawled_at <= 86400 THEN 'today' WHEN {NOW} - crawled_at <= 604800 THEN 'week' WHEN {NOW} - crawled_at <= 2592000 THEN 'month' WHEN {NOW} - crawled_at <= 31536000 THEN 'year' ELSE 'older' END"


@query("facets", f"WITH {DOCUMENTS_SQL}, d AS (SELECT domain, {_BUCKET} AS bucket FROM docs), a AS (SELECT 'domain' AS facet, domain AS value, count(*) AS n FROM d GROUP BY domain ORDER BY n DESC, domain LIMIT 20) SELECT * FROM a UNION ALL SELECT 'date', bucket, count(*) FROM d GROUP BY bucket")
def facets(spark, sf_dir):
    age = F.lit(NOW) - F.col("crawled_at")
    bucket = F.when(age < 0, "unknown").otherwise(quality.ladder(age, [(86400.0, "today"), (604800.0, "week"), (2592000.0, "month"), (31536000.0, "year")], "older", least=False))
    both = documents(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("domain").alias("facet"), F.col("domain").alias("value")), F.struct(F.lit("date").alias("facet"), bucket.alias("value")))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value")))
    return ranked.filter("facet = 'date' or r <= 20").drop("r")


_ASCII = r"regexp_extract_all(lower(text), '([a-z][a-z0-9]+)', 1)"
_STOP = ", ".join(f"'{w}'" for w in ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "at", "by", "an", "be"))
KEYWORDS_SQL = f"""tk AS (SELECT doc_id, unnest({_ASCII}) AS term, generate_subscripts({_ASCII}, 1) AS pos FROM documents),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first) AS rank FROM (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM tk WHERE term NOT IN ({_STOP}) GROUP BY doc_id, term)) WHERE rank <= 50)"""


def keywords(spark, sf_dir, most: int = 50):
    """The most frequent ASCII words of every document, stop words aside, ties by first appearance."""
    stop = [w.strip(" '") for w in _STOP.split(",")]
    toks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9]+)"), 1)).alias("pos", "term")).filter(~F.col("term").isin(stop))
    counts = toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "first"))).filter(F.col("rank") <= most)


@query("keywords_tf", f"WITH {KEYWORDS_SQL} SELECT doc_id, term, tf, rank FROM kw")
def keywords_tf(spark, sf_dir):
    return keywords(spark, sf_dir).select("doc_id", "term", "tf", "rank")


@query("inverted_index", f"WITH {KEYWORDS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM kw) SELECT term, count(*) AS pointers, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM p WHERE r <= 100 GROUP BY term")
def inverted_index(spark, sf_dir):
    """Up to 100 pointers a keyword, in document order."""
    rows = keywords(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter("r <= 100")
    lists = rows.groupBy("term").agg(F.count("*").alias("pointers"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return lists.select("term", "pointers", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["tf"].cast("string"))), " ").alias("postings"))


@query(
    "dht_query",
    f"""WITH {KEYWORDS_SQL}, {{docs}}, q AS (SELECT * FROM (VALUES ('tion'), ('onen'), ('aux')) v(term)), p AS (SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM kw JOIN q USING (term))
 SELECT source AS peer, doc_id, sum(tf) AS score FROM p JOIN docs USING (doc_id) WHERE r <= 100 GROUP BY ALL""".replace("{docs}", DOCUMENTS_SQL),
)
def dht_query(spark, sf_dir):
    """Pointers of three keywords summed by peer and document."""
    q = spark.createDataFrame([("tion",), ("onen",), ("aux",)], "term string")
    rows = keywords(spark, sf_dir).join(F.broadcast(q), "term").withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter("r <= 100")
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("peer"))
    return rows.join(d, "doc_id").groupBy("peer", "doc_id").agg(F.sum("tf").alias("score"))


@query(
    "dht_merge",
    f"""WITH {KEYWORDS_SQL}, {DOCUMENTS_SQL}, p AS (SELECT term, source AS peer, doc_id, tf, doc_id AS place FROM kw JOIN docs USING (doc_id)),
 u AS (SELECT term, peer, doc_id, tf + 1 AS score, place, 0 AS old FROM p WHERE doc_id % 3 = 0 UNION ALL SELECT term, peer, doc_id, tf, place, 1 FROM p WHERE doc_id % 2 = 0), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY term, peer, doc_id ORDER BY old, place) = 1)
 SELECT term, peer, doc_id, score, row_number() OVER (PARTITION BY term ORDER BY old, place, peer, doc_id) AS place FROM f QUALIFY row_number() OVER (PARTITION BY term ORDER BY old, place, peer, doc_id) <= 50""",
)
def dht_merge(spark, sf_dir):
    """Two lists of pointers of every keyword as one: what even documents gave, and newer ones from every third."""
    rows = keywords(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("source").alias("peer")), "doc_id")
    rows = rows.select("term", "peer", "doc_id", F.col("tf").alias("score"), F.col("doc_id").alias("place"))
    new = rows.filter("doc_id % 3 = 0").withColumn("score", F.col("score") + 1)
    return graph.merged_pointers(rows.filter("doc_id % 2 = 0"), new, 50)
