"""Content quality, safety and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text
from ..registry import query
from ..sources.tables import DOCUMENTS_SQL, NOW, documents, table

_WORDS, _SPLIT = text.words_sql("text"), text.chunks_of_space_sql("text")
_TOXIC = ", ".join(f"'{w}'" for w in q.TOXIC)


@query("toxicity", f"SELECT doc_id, round(CASE WHEN len({_SPLIT}) = 0 THEN 0 ELSE least(1.0::DOUBLE, len(list_filter({_WORDS}, lambda w: w IN ({_TOXIC}))) / len({_SPLIT}) * 10) END, 6) AS toxicity FROM documents")
def toxicity(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(q.toxicity(text.words(t), F.size(text.chunks_of_space(t))), 6).alias("toxicity"))


@query("cjk_ratio", f"SELECT doc_id, round(len(regexp_extract_all(text, '{q.CJK}', 0)) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0)::DOUBLE, 6) AS cjk_ratio FROM documents")
def cjk_ratio(spark, sf_dir):
    dense = F.length(F.regexp_replace("text", r"\s", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.regexp_count("text", F.lit(q.CJK)) / F.nullif(dense, F.lit(0)), 6).alias("cjk_ratio"))


def _vis(e: str) -> str:
    return f"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({e}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), chr(32) || chr(10) || chr(9) || chr(13)), '\\s+', ' ', 'g')"


_ROOT = q.SPA_ROOT.replace("'", "''")


JS_SQL = f"""f AS (SELECT page_id, html, length({_vis('html')}) / length(html)::DOUBLE AS ratio, length({_vis("regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1)")}) AS body,
 array_to_string(regexp_extract_all(html, '(?is)<noscript[^>]*>(.*?)</noscript>', 1), chr(10)) AS notes FROM pages),
 s AS (SELECT page_id, round(least(1.0::DOUBLE, CASE WHEN regexp_matches(html, '{_ROOT}') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(html, '{q.SPA_DATA}') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(notes, '{q.NEEDS_JS}') THEN 0.3::DOUBLE ELSE 0 END
 + CASE WHEN ratio < 0.02 THEN 0.35::DOUBLE WHEN ratio < 0.05 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN body < 50 THEN 0.3::DOUBLE ELSE 0 END), 2) AS confidence FROM f)"""


@query("js_detect", f"WITH {JS_SQL} SELECT page_id, confidence, confidence >= 0.5 AS js_required FROM s")
def js_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", q.js_score(F.col("html")).alias("confidence")).withColumn("js_required", F.col("confidence") >= 0.5)


_URLS = ["http://localhost/a", "http://10.1.2.3:80/x", "ftp://example.org/", "https://172.20.0.1/", "https://172.32.0.1/", "http://printer.local/", "https://8.8.8.8/dns", "http:///nohost", "https://user@192.168.1.1/"]
URLS_SQL = "urls AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, '{u}')" for i, u in enumerate(_URLS)) + ") v(id, url))"


def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(spark.createDataFrame([(-i - 1, u) for i, u in enumerate(_URLS)], "id long, url string"))


@query(
    "url_safety",
    f"""WITH {URLS_SQL}, h AS (SELECT id, url, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1), ':\\d*$', '')) AS host FROM urls),
 n AS (SELECT *, CASE WHEN regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') THEN split_part(host, '.', 1)::BIGINT * 16777216 + split_part(host, '.', 2)::BIGINT * 65536 + split_part(host, '.', 3)::BIGINT * 256 + split_part(host, '.', 4)::BIGINT END AS ip FROM h)
 SELECT id, length(url) <= 4096 AND regexp_matches(url, '^(?i)https?://') AND host <> '' AND NOT regexp_matches(host, '{q.LOCAL_HOST}') AND NOT ({' OR '.join(f'coalesce(ip BETWEEN {a} AND {b}, false)' for a, b in q.NETS)}) AS safe FROM n""",
)
def url_safety(spark, sf_dir):
    return urls(spark, sf_dir).select("id", q.url_safe(F.col("url")).alias("safe"))


@query("in_scope", "SELECT page_id, regexp_extract(url, '://([^/]*)', 1) = (SELECT regexp_extract(url, '://([^/]*)', 1) FROM pages WHERE page_id = 0) AND starts_with(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/') AS in_scope FROM pages")
def in_scope(spark, sf_dir):
    """Pages of the first page's host under its root path."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "://([^/]*)", 1)
    scope = p.filter("page_id = 0").select(host.alias("scope"))
    return p.join(F.broadcast(scope)).select("page_id", ((host == F.col("scope")) & F.startswith(F.regexp_extract("url", "://[^/]*([^?#]*)", 1), F.lit("/"))).alias("in_scope"))


def _age():
    return F.lit(NOW) - F.col("crawled_at")


_TIERS = [(3600.0, "hot"), (86400.0, "warm"), (604800.0, "cold")]
_GRADES = [(86400.0, "A"), (7 * 86400.0, "B"), (30 * 86400.0, "C"), (90 * 86400.0, "D")]


@query("freshness_tier", f"WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN doc_id * 3600.0 <= 3600 THEN 'hot' WHEN doc_id * 3600.0 <= 86400 THEN 'warm' WHEN doc_id * 3600.0 <= 604800 THEN 'cold' ELSE 'stale' END AS tier FROM docs")
def freshness_tier(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", q.ladder(_age(), _TIERS, "stale", least=False).alias("tier"))


@query(
    "freshness_grade",
    f"""WITH a AS (SELECT doc_id, {NOW} - ({NOW} - doc_id * 3600.0) AS age FROM documents) SELECT doc_id, CASE WHEN age < 86400 THEN 'A' WHEN age < 604800 THEN 'B' WHEN age < 2592000 THEN 'C' WHEN age < 7776000 THEN 'D' ELSE 'F' END AS grade,
 CASE WHEN age < 3600 THEN floor(age / 60)::BIGINT || ' minutes ago' WHEN age < 86400 THEN floor(age / 3600)::BIGINT || CASE WHEN floor(age / 3600) = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE floor(age / 86400)::BIGINT || CASE WHEN floor(age / 86400) = 1 THEN ' day ago' ELSE ' days ago' END END AS label FROM a""",
)
def freshness_grade(spark, sf_dir):
    a = _age()
    grade = F.when(a < 86400, "A").when(a < 604800, "B").when(a < 2592000, "C").when(a < 7776000, "D").otherwise("F")
    said = lambda unit, name: F.concat(F.floor(a / unit).cast("string"), F.when(F.floor(a / unit) == 1, f" {name} ago").otherwise(f" {name}s ago"))
    label = F.when(a < 3600, F.concat(F.floor(a / 60).cast("string"), F.lit(" minutes ago"))).when(a < 86400, said(3600, "hour")).otherwise(said(86400, "day"))
    return documents(spark, sf_dir).select("doc_id", grade.alias("grade"), label.alias("label"))


@query("recrawl_interval", "SELECT doc_id, CASE WHEN f = 0 THEN 2592000 WHEN f < 0.1 THEN 604800 WHEN f <= 0.5 THEN 86400 ELSE 21600 END AS seconds FROM (SELECT doc_id, (doc_id % 20) / 20.0::DOUBLE AS f FROM documents)")
def recrawl_interval(spark, sf_dir):
    """Recrawl period from the change frequency, here a twentieth of the document number's remainder."""
    f = F.pmod(F.col("doc_id"), F.lit(20)) / 20.0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(f == 0, 2592000).when(f < 0.1, 604800).when(f <= 0.5, 86400).otherwise(21600).alias("seconds"))


_NUMBERS = "regexp_extract_all({}, '(\\b\\d+(?:\\.\\d+)?\\b)', 1)"


@query("novel_numbers", f"WITH d AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda _, i: i % 2 = 1), chr(10)) AS head FROM documents) SELECT doc_id, len(list_filter(list_distinct({_NUMBERS.format('text')}), lambda x: NOT list_contains({_NUMBERS.format('head')}, x))) AS novel FROM d")
def novel_numbers(spark, sf_dir):
    """Distinct numbers of a text that its summary, here every other line, lacks."""
    n = lambda c: F.regexp_extract_all(c, F.lit(r"(\b\d+(?:\.\d+)?\b)"), 1)
    head = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: i % 2 == 0), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_except(n(F.col("text")), n(head))).cast("long").alias("novel"))


@query(
    "fact_score",
    r"""WITH s AS (SELECT doc_id, pos, s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS s, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS pos FROM documents))
 SELECT doc_id, pos, round(CASE WHEN regexp_matches(s, '(^|[^\p{L}\p{N}_])\d+') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(s, '\d+%') THEN 0.5::DOUBLE ELSE 0 END + least(1.0::DOUBLE, len(list_filter(regexp_extract_all(regexp_replace(s, '^[A-Z][a-z]+', 'x'), '[\p{L}\p{N}_]+', 0), lambda w: regexp_matches(w, '^[A-Z][a-z]+'))) * 0.3::DOUBLE)
 + CASE WHEN len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) BETWEEN 8 AND 30 THEN 0.5::DOUBLE ELSE 0 END, 6) AS score FROM s""",
)
def fact_score(spark, sf_dir):
    """Factuality of every line."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).alias("pos"), F.round(q.fact_score(F.col("s")), 6).alias("score"))
