"""Extraction queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, extraction
from ..registry import query
from ..sources.tables import DOCUMENTS_SQL, documents, table

_W = r"[^\p{L}\p{N}_]"


def _bounded(p: str) -> str:
    return p.replace("'", "''")


@query("meta_tags", r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, substr(lower(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']*)', 1)), 1, 2) AS lang,
 regexp_extract(html, '(?i)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)', 1) AS description, regexp_extract(html, '(?i)<link\s+rel=["'']canonical["'']\s+href=["'']([^"'']*)', 1) AS canonical, regexp_extract(html, '(?i)<meta\s+property=["'']og:title["'']\s+content=["'']([^"'']*)', 1) AS og_title FROM pages""")
def meta_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in extraction.meta_tags(F.col("html")).items()])


_CITED = [
    "see 10.1234/abc.def and arXiv:2301.00001v2", "RFC 7231 replaces rfc2616, https://example.org/a?b=1 and 978-3-16-148410-0", "2301.00001 twice 2301.00001", "nothing here", "Python and Rust by Ada Lovelace Byron and Alan Turing with Docker",
]
CITED_SQL = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, '{t}')" for i, t in enumerate(_CITED)) + ") v(doc_id, text))"


def texts(spark, sf_dir):
    """All documents, and literal texts with citations and names under negative ids."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(_CITED)], "doc_id long, text string"))


_FOUND = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{n}' AS type, unnest(regexp_extract_all(text, '{_bounded(p)}', 1)) AS identifier FROM texts" for i, (n, p) in enumerate(extraction.CITATIONS))


@query("citations", f"WITH {CITED_SQL}, f AS ({_FOUND}) SELECT doc_id, type, identifier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, identifier ORDER BY i) AS r FROM f) WHERE r = 1")
def citations(spark, sf_dir):
    return extraction.citations(texts(spark, sf_dir))


_TECH = "|".join(extraction.TECH)


# The twin's word borders know ASCII alone, so other letters, which no name here holds, become word characters that it knows.
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
_CAPITALS = f"regexp_extract_all({_ASCII}, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b', 1)"


@query("entities", f"WITH {CITED_SQL}, f AS (SELECT doc_id, 'TECH' AS type, unnest(regexp_extract_all({_ASCII}, '\\b({_TECH})\\b', 1)) AS name FROM texts UNION ALL SELECT doc_id, 'NAME', unnest(list_filter({_CAPITALS}, lambda x: length(x) < 30)) FROM texts) SELECT doc_id, type, name, count(*) AS n FROM f GROUP BY ALL")
def entities(spark, sf_dir):
    return extraction.entities(texts(spark, sf_dir))


_SPOKEN = [
    "한국어로 쓴 문장은 스무 글자보다 길어야 합니다 그렇죠", "これは日本語のテキストです。ひらがなとカタカナがあります", "这是一个用中文写的句子它应该比二十个字符更长一些才可以", "日本語漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字漢字の", "это предложение на русском языке и оно не короткое", "هذه جملة مكتوبة باللغة العربية الفصحى",
    "यह हिंदी में लिखा गया एक वाक्य है जो छोटा नहीं", "นี่คือประโยคภาษาไทยที่ยาวกว่ายี่สิบตัวอักษร", "123 456 789 101112 131415 1617", "!!! ... ??? --- ;;; ::: ((( )))", "bu bir cümle ve çok uzun değil ama için yeterli", "não foi mais do que uma coisa para os seus dias", "short", "dengan ini adalah untuk yang tidak dari pada", "một người không có được các điều này trong đời",
]
_SPOKEN_SQL = "spoken AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, '{t}')" for i, t in enumerate(_SPOKEN)) + ") v(doc_id, text))"
_SCORES = ", ".join(f"len(list_intersect(d, [{', '.join(repr(x) for x in v)}])) AS {k}_" for k, v in extraction.COMMON_WORDS.items())
_TOP = "greatest(" + ", ".join(f"{k}_" for k in extraction.COMMON_WORDS) + ")"
_COUNTED = ", ".join(f"len(regexp_extract_all(text, '[{r}]')) AS n_{k}" for k, r in extraction.SCRIPTS.items())
_ALL = "".join(extraction.SCRIPTS.values())
_MOST = "greatest(n_Latin, " + ", ".join(f"n_{k}" for k in extraction.SCRIPTS) + ")"


@query(
    "lang_detect",
    f"""WITH {_SPOKEN_SQL}, c AS (SELECT doc_id, text, length(text) AS n, {text.words_sql('text')} AS w, list_distinct({text.words_sql('text')}) AS d, {_COUNTED}, len(regexp_extract_all(regexp_replace(text, '[{_ALL}]', '', 'g'), '\\p{{L}}')) AS n_Latin FROM spoken),
 s AS (SELECT *, {_SCORES}, CASE WHEN n < 20 OR {_MOST} = 0 THEN 'Unknown' {' '.join(f"WHEN n_{k} = {_MOST} THEN '{k}'" for k in extraction.SCRIPTS)} ELSE 'Latin' END AS script FROM c)
 SELECT doc_id, script, CASE WHEN n < 20 THEN 'en' {' '.join(f"WHEN script = '{k}' THEN '{code}'" for k, (code, _) in extraction.BY_SCRIPT.items())} WHEN script = 'CJK' THEN CASE WHEN n_Kana > 0 THEN 'ja' ELSE 'zh' END WHEN len(w) = 0 THEN 'en' {' '.join(f'WHEN {k}_ = {_TOP} THEN {k!r}' for k in extraction.COMMON_WORDS)} END AS language,
 CASE WHEN n < 20 THEN 0::DOUBLE {' '.join(f"WHEN script = '{k}' THEN {sure}::DOUBLE" for k, (_, sure) in extraction.BY_SCRIPT.items())} WHEN script = 'CJK' THEN 0.85::DOUBLE WHEN len(w) = 0 THEN 0.1::DOUBLE ELSE round(least({_TOP} / least(len(w), 50)::DOUBLE * 5, 0.95::DOUBLE), 3) END AS confidence FROM s""",
)
def lang_detect(spark, sf_dir):
    spoken = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(_SPOKEN)], "doc_id long, text string")
    return extraction.language(table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spoken)).select("doc_id", "script", "language", "confidence")


_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|footer|head|aside|form)[^>]*>.*?</(script|style|nav|footer|head|aside|form)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("html_extract", f"WITH x AS (SELECT page_id, {_VISIBLE} AS text FROM pages) SELECT page_id, text, length(text) AS n_chars FROM x WHERE length(text) >= 50")
def html_extract(spark, sf_dir):
    """Visible text without navigation, head, footer and scripts; pages with less than 50 characters go."""
    gone = r"(?is)<(script|style|nav|footer|head|aside|form)[^>]*>.*?</(script|style|nav|footer|head|aside|form)>"
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", gone, " "), r"<[^>]+>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("text")).withColumn("n_chars", F.length("text")).filter("n_chars >= 50")


@query("page_content")
def page_content(spark, sf_dir):
    """Title, language, own text, digests and image texts of every page, by a scan of its tags with a stack of open elements."""
    return extraction.page_contents(table(spark, sf_dir, "pages"))


@query(
    "feed_items",
    f"""WITH {DOCUMENTS_SQL} SELECT url, 0 AS pos, regexp_replace(title, '<[^>]+>', '', 'g') AS title, url || '/item' AS link, trim(substr(trim(regexp_replace(text, '<[^>]+>', '', 'g')), 1, 500)) AS summary FROM docs WHERE NOT contains(text, ']]>') AND NOT contains(text, '<')""",
)
def feed_items(spark, sf_dir):
    """Every document rendered as a one-item feed and parsed again."""
    d = documents(spark, sf_dir).filter("not contains(text, ']]>') and not contains(text, '<')")
    xml = F.concat(F.lit("<rss version=\"2.0\"><channel><item><title>"), "title", F.lit("</title><link>"), "url", F.lit("/item</link><description><![CDATA["), "text", F.lit("]]></description></item><item><title>no link</title></item></channel></rss>"))
    items = extraction.feed_items(d.select("url", xml.alias("xml")))
    return items.withColumns({"title": F.col("title"), "summary": F.trim("summary")})


@query(
    "warc_export",
    """WITH h AS (SELECT *, sha256(url || ':2024-01-31T00:00:00Z') AS h FROM pages) SELECT page_id, sha256('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-31T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS record_sha256 FROM h""",
)
def warc_export(spark, sf_dir):
    return extraction.warc_records(table(spark, sf_dir, "pages"), "2024-01-31T00:00:00Z").select("page_id", F.sha2("record", 256).alias("record_sha256"))


@query(
    "wet_import_stats",
    """WITH t AS (SELECT doc_id, trim(text, chr(32) || chr(10) || chr(13) || chr(9)) AS body FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY substr(body, 1, 102400) ORDER BY doc_id) AS r FROM t WHERE length(body) >= 50)
 SELECT CASE WHEN r = 1 THEN 'imported' ELSE 'duplicate' END AS outcome, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'too_short', count(*) FROM t WHERE length(body) < 50""",
)
def wet_import_stats(spark, sf_dir):
    """Every document rendered as a WET conversion record, parsed, and sorted into imported, duplicate and too short."""
    d = documents(spark, sf_dir)
    record = F.concat(F.lit("WARC/1.0\nWARC-Type: conversion\nWARC-Target-URI: "), "url", F.lit("\nContent-Type: text/plain\n\n"), "text")
    parsed = extraction.wet_records(d.select(record.alias("content")), least=0)
    rows = parsed.withColumn("doc_id", F.regexp_extract("target", r"/(\d+)$", 1).cast("long"))
    long = rows.filter(F.length("body") >= 50).withColumn("h", F.sha2("body", 256))
    kept = long.groupBy("h").agg(F.count("*").alias("n"))
    counts = kept.agg(F.count("*").alias("imported"), F.sum(F.col("n") - 1).alias("duplicate")).crossJoin(rows.agg(F.count_if(F.length("body") < 50).alias("too_short")))  # one row each
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("outcome"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for c in ("imported", "duplicate", "too_short")])))
