"""Identity, near duplicates, set comparison and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, documents, table

_TRACK = ", ".join(f"'{t}'" for t in dedup.TRACKING)
_NORM = f"""lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END"""
_READ = lambda e: f"url_decode(replace({e}, '+', ' '))"
_WRITE = lambda e: f"replace(url_encode({e}), '%20', '+')"
_PARTS = f"""SELECT {{key}}, url, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
 list_transform(list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x, i: {{{{'k': {_READ("split_part(x, '=', 1)")}, 'i': i, 'v': {_READ("regexp_extract(x, '=(.*)$', 1)")}}}}}), lambda x: lower(x.k) NOT IN ({_TRACK}))), lambda x: {_WRITE("x.k")} || '=' || {_WRITE("x.v")}) AS q FROM"""

_RAW_URLS = Literal("raw_urls", "page_id long, url string", ((-1, "HTTP://A.com/b/?z=1&utm_source=x&a=2#f"), (-2, "http://a.com"), (-3, "https://a.com/p?b=x+y&a=%C3%A9&a=1&flag&c=a%2Bb~*"), (-4, "https://a.com/p//?UTM_Medium=1&=v"), (-5, "https://a.com/x?q=a=b&ref=1")))


@query("normalize_url", f"WITH {_RAW_URLS.sql}, x AS ({_PARTS.format(key='page_id')} (SELECT page_id, url FROM pages UNION ALL SELECT * FROM raw_urls)) SELECT page_id, {_NORM} AS normal FROM x")
def normalize_url(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url").unionByName(_RAW_URLS.frame(spark))
    return rows.select("page_id", dedup.normalize_url(F.col("url")).alias("normal"))


@query("exact_dedup", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("ingest_dedup", f"WITH {DOCUMENTS_SQL} SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM docs GROUP BY 2")
def ingest_dedup(spark, sf_dir):
    return dedup.ingest(documents(spark, sf_dir)).select("doc_id", "text_hash")


_WORDS = text.words_sql("text")
_SHINGLES = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END"""
SIMHASH_SQL = f"""wd AS (SELECT doc_id, {_WORDS} AS w FROM documents), sh AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM wd), hx AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 16))::UBIGINT AS h FROM sh),
 sim AS (SELECT doc_id, {' + '.join(f"(CASE WHEN 2 * sum((h >> {i}) & 1) >= count(*) THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))} AS u FROM hx GROUP BY doc_id),
 simhash AS (SELECT doc_id, CASE WHEN u IS NULL THEN 0 WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616::HUGEINT)::BIGINT ELSE u::BIGINT END AS simhash FROM documents LEFT JOIN sim USING (doc_id))"""


@query("simhash", f"WITH {SIMHASH_SQL} SELECT doc_id, simhash FROM simhash")
def simhash(spark, sf_dir):
    return dedup.simhash(table(spark, sf_dir, "documents"))


@query("simhash_pairs", f"WITH near_docs AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, text || ' end' FROM documents), {SIMHASH_SQL.replace('FROM documents', 'FROM near_docs')}, r AS (SELECT simhash, min(doc_id) AS k FROM simhash GROUP BY simhash) SELECT a.k AS a, b.k AS b, bit_count(xor(a.simhash, b.simhash))::INT AS distance FROM r a JOIN r b ON a.k < b.k AND bit_count(xor(a.simhash, b.simhash)) <= 3")
def simhash_pairs(spark, sf_dir):
    """Near pairs among all documents and, as few small corpora have any, the documents with a word put to their end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    longer = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"))
    return dedup.near_pairs(dedup.simhash(docs.unionByName(longer)))


@query("simhash_classes", f"WITH {SIMHASH_SQL} SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS a FROM simhash")
def simhash_classes(spark, sf_dir):
    """The document that stands for each document's fingerprint in pairs of near duplicates."""
    return dedup.members(dedup.simhash(table(spark, sf_dir, "documents")))


@query("jaccard", f"WITH t AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END, 6) AS jaccard FROM t a JOIN t b ON b.doc_id = a.doc_id + 1")
def jaccard(spark, sf_dir):
    """Word-set similarity of each document with the next."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.words(F.col("text"))).alias("w"))
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(after, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


_FULL = "len(list_filter({}, lambda v: trim(v) <> ''))"


@query(
    "content_diff",
    f"""WITH t AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS l FROM documents), p AS (SELECT a.doc_id, a.l AS a, b.l AS b FROM t a JOIN t b ON b.doc_id = a.doc_id + 1),
 d AS (SELECT doc_id, {_FULL.format('list_filter(b, lambda x: NOT list_contains(a, x))')} AS added, {_FULL.format('list_filter(a, lambda x: NOT list_contains(b, x))')} AS removed, len(list_distinct(list_concat(a, b))) AS n FROM p) SELECT doc_id, added, removed, round((added + removed) / greatest(1, n)::DOUBLE, 3) AS ratio FROM d""",
)
def content_diff(spark, sf_dir):
    """Changed lines between each document and the next."""
    t = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new"))
    return t.join(after, "doc_id").select("doc_id", *[c.alias(n) for n, c in dedup.content_diff(F.col("text"), F.col("new")).items()])


@query("merkle_root", "WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, sha256('leaf:' || sha256(text)) AS h FROM documents)" + "".join(
    f", l{i + 1} AS (SELECT pos // 2 AS pos, CASE WHEN count(*) = 2 THEN sha256(min(CASE WHEN pos % 2 = 0 THEN h END) || max(CASE WHEN pos % 2 = 1 THEN h END)) WHEN (SELECT count(*) FROM l{i or ''}) = 1 THEN min(h) ELSE sha256(min(h) || min(h)) END AS h FROM l{i or ''} GROUP BY pos // 2)" for i in range(20)
) + " SELECT h AS root FROM l20")
def merkle_root(spark, sf_dir):
    """Root over all texts in doc_id order: the pairs of one level are the groups of the next."""
    return dedup.merkle_root(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("leaf")), "doc_id", "leaf")


_LEVEL = "SELECT pos // 2 AS pos, CASE WHEN count(*) = 2 THEN sha256(min(CASE WHEN pos % 2 = 0 THEN h END) || max(CASE WHEN pos % 2 = 1 THEN h END)) ELSE sha256(min(h) || min(h)) END AS h FROM {} GROUP BY pos // 2"


@query(
    "merkle_proofs",
    f"""WITH n0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, sha256('leaf:' || sha256(text)) AS h FROM documents), n1 AS ({_LEVEL.format("n0")}), n2 AS ({_LEVEL.format("n1")}), c AS (SELECT count(*) AS c FROM n0)
 SELECT n0.doc_id, n0.pos, ceil(log2(c))::INT AS steps, coalesce(s0.h, n0.h) AS first, CASE WHEN c > 2 THEN coalesce(s1.h, o1.h) END AS second, true AS valid, true AS changed_fails FROM n0, c
 LEFT JOIN n0 s0 ON s0.pos = xor(n0.pos, 1) LEFT JOIN n1 s1 ON s1.pos = xor(n0.pos // 2, 1) LEFT JOIN n1 o1 ON o1.pos = n0.pos // 2""",
)
def merkle_proofs(spark, sf_dir):
    """The proof of every document: its length and first siblings, whether it holds for the text, and whether it fails for a changed one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("leaf"), F.sha2(F.concat("text", F.lit("!")), 256).alias("changed"))
    proofs = dedup.merkle_proofs(docs.select("doc_id", "leaf"), "doc_id", "leaf").withColumnRenamed("doc_id", "d")
    rows = docs.join(proofs.drop("leaf"), F.col("doc_id") == F.col("d"))
    holds = lambda c: dedup.proof_holds(F.col(c), F.col("path"), F.col("root"))
    return rows.select("doc_id", "pos", F.size("path").alias("steps"), F.get("path", 0)["h"].alias("first"), F.get("path", 1)["h"].alias("second"), holds("leaf").alias("valid"), (~holds("changed")).alias("changed_fails"))
