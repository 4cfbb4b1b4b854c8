"""Results shown, explained, merged and packed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, shaping, text
from ..operators import graph, results, search
from ..registry import ORACLES, query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, EVENTS_SQL, NOW, documents, events, queries, table
from .graph import cited
from .search import FEATURES_SQL, RANKED_SQL, VECTOR_SQL, nearest_vectors, ranked_search
from .trust import trust_of

_SIGNALS_SQL = f"""sig AS (SELECT doc_id, {scores.freshness_sql('crawled_at', NOW)} AS freshness, (doc_id % 10) / 10.0::DOUBLE AS bm25, (doc_id % 7) / 7.0::DOUBLE AS trust, (doc_id % 5) / 5.0::DOUBLE AS authority, (doc_id % 4) / 4.0::DOUBLE AS title, (doc_id % 3) / 3.0::DOUBLE AS url FROM docs)"""
_W = scores.WEIGHTS
_NOTE = ", ".join(f"CASE WHEN {n} {op} {at} THEN '{t}' END" for n, op, at, t in shaping.NOTES)
_TOPMOST = "greatest(" + ", ".join(f"w_{n}" for n in _W) + ")"


def _signals(spark, sf_dir):
    """Ranking signals made of doc_id beside the freshness, to explain all kinds of scores."""
    part = lambda n: (F.col("doc_id") % n) / float(n)
    return documents(spark, sf_dir).select("doc_id", scores.freshness(F.col("crawled_at"), NOW).alias("freshness"), part(10).alias("bm25"), part(7).alias("trust"), part(5).alias("authority"), part(4).alias("title"), part(3).alias("url"))


@query(
    "score_explanation",
    f"WITH {DOCUMENTS_SQL}, {_SIGNALS_SQL}, w AS (SELECT *, {', '.join(f'round({n} * {v}::DOUBLE, 6) AS w_{n}' for n, v in _W.items())} FROM sig) SELECT doc_id, {', '.join(f'w_{n}' for n in _W)}, CASE {' '.join(f'WHEN w_{n} = {_TOPMOST} THEN {n!r}' for n in _W)} END AS dominant, array_to_string(list_filter([{_NOTE}], lambda x: x IS NOT NULL), '; ') AS notes FROM w",
)
def score_explanation(spark, sf_dir):
    parts = shaping.explanation({n: F.col(n) for n in _W})
    return _signals(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in parts.items()])


_HIT_SQL = f"{RANKED_SQL}, hit AS (SELECT query_id, rank, url, title, substr(text, 1, 300) AS snippet, combined FROM ranked JOIN docs USING (doc_id, url))"


def _hits(spark, sf_dir):
    return ranked_search(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "title", "text", "crawled_at"), "doc_id").withColumn("snippet", F.substring("text", 1, 300))


@query("result_text", f"WITH {_HIT_SQL} SELECT query_id, rank, format('[{{}}] {{}}' || chr(10) || '    Source: {{}}' || chr(10) || '    Domain: {{}}' || chr(10) || '    Score: {{:.4f}} (all={{:.3f}})' || chr(10) || '    {{}}' || chr(10), rank, title, url, regexp_extract(url, '://([^/]*)', 1), round(combined, 4), round(combined, 3), substr(snippet, 1, 200)) AS shown FROM hit")
def result_text(spark, sf_dir):
    shown = shaping.result_text(F.col("rank"), F.col("title"), F.col("url"), F.col("snippet"), F.col("combined"), {"all": F.col("combined")})
    return _hits(spark, sf_dir).select("query_id", "rank", shown.alias("shown"))


@query("result_json", f"WITH {_HIT_SQL} SELECT query_id, rank, url, title, regexp_extract(url, '://([^/]*)', 1) AS domain, substr(snippet, 1, 200) AS snippet, round(combined, 4) AS score FROM hit")
def result_json(spark, sf_dir):
    """Results as JSON, read again: what a reader of the JSON gets."""
    shown = shaping.result_json(F.col("url"), F.col("title"), F.col("snippet"), F.col("combined"), {"all": F.col("combined")})
    parsed = F.from_json(shown, "url string, title string, domain string, snippet string, score double, scores struct<all:double>")
    return _hits(spark, sf_dir).select("query_id", "rank", parsed.alias("r")).select("query_id", "rank", "r.url", "r.title", "r.domain", "r.snippet", "r.score")


@query("fetched_text", f"""WITH {DOCUMENTS_SQL} SELECT doc_id, format('# {{}}' || chr(10) || 'Source: {{}}' || chr(10) || 'Domain: {{}}' || chr(10) || 'is_cached: true' || chr(10) || 'cache_age: {{:.1f}} days' || chr(10) || 'crawl_timestamp: {{:.0f}}' || chr(10), title, url, domain, ({NOW}::DOUBLE - crawled_at) / 86400, crawled_at)
 || CASE WHEN {NOW}::DOUBLE - crawled_at > 604800 THEN 'stale_warning: true (cached content older than TTL)' || chr(10) ELSE '' END || chr(10) || text AS page FROM docs""")
def fetched_text(spark, sf_dir):
    """Cached pages as readers get them."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", shaping.fetched_text(F.col("title"), F.col("url"), F.col("text"), F.col("crawled_at"), NOW).alias("page"))


_CUT = Literal("cut", "doc_id long, text string", ((-1, "ééééé"), (-2, "日本語テキスト"), (-3, "a😀b😀c"), (-4, ""), (-5, "abcdefghijklmnop"), (-6, "ab日"), (-7, "abcé")))


@query("truncate_bytes", "SELECT * FROM (VALUES (-1::BIGINT, 'ééé'), (-2, '日本'), (-3, 'a😀b'), (-4, ''), (-5, 'abcdefg'), (-6, 'ab日'), (-7, 'abcé')) v(doc_id, head) UNION ALL SELECT doc_id, left(text, list_max(list_filter(range(0, 8), lambda k: strlen(left(text, k::INT)) <= 7))::INT) FROM documents")
def truncate_bytes(spark, sf_dir):
    """At most 7 bytes of each text, no character broken."""
    return _CUT.frame(spark).unionByName(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", shaping.truncated(F.col("text"), 7).alias("head"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shaping.tokens_estimated(F.col("text")).alias("tokens"))


@query("query_hash", "SELECT conv_id, turn, sha256(lower(trim(text))) AS hash FROM conversations")
def query_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.lower(F.trim("text")), 256).alias("hash"))


_SENT = Literal("said", "doc_id long, text string", ((-1, "First one is here. Second follows it! no capital? Third says more.  Short. 这是一个比较长的中文句子哦。"), (-2, "tiny"), (-3, "")))


@query("sentences", "SELECT * FROM (VALUES (-1::BIGINT, 'First one is here.', 0), (-1, 'Second follows it! no capital?', 19), (-1, 'Third says more.', 50), (-1, '这是一个比较长的中文句子哦。', 75)) v(doc_id, sentence, \"offset\") UNION ALL SELECT doc_id, sentence, start FROM (SELECT doc_id, unnest(list_transform(p, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS sentence, unnest(list_transform(p, lambda x, i: coalesce(list_sum(list_transform(p[:i - 1], lambda y: length(y))), 0)::INT)) AS start FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\\s+)([A-Z\\x{4e00}-\\x{9fff}])', '\\1\\2' || chr(2) || '\\3', 'g'), chr(2)) AS p FROM documents)) WHERE length(sentence) > 10")
def sentences(spark, sf_dir):
    """Sentences of some texts and of all documents, with their places."""
    texts = _SENT.frame(spark).unionByName(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return texts.select("doc_id", F.inline(shaping.sentences(F.col("text"))))


_ANSWERS = Literal("answers", "id long, response string, n int", ((1, "[3, 1, 2]", 4), (2, "order: [2,2,9,0] ok", 3), (3, "none", 2), (4, "[]", 3), (5, "[ 5 ]", 2)))


@query("rerank_order", "SELECT * FROM (VALUES (1::BIGINT, '3,1,2,4'), (2, '2,1,3'), (3, NULL), (4, '1,2,3'), (5, '1,2')) v(id, places) UNION ALL SELECT -conv_id * 1000 - turn - 1, CASE turn WHEN 1 THEN '2,1,3' WHEN 2 THEN '3,1,2' ELSE '1,2,3' END FROM conversations")
def rerank_order(spark, sf_dir):
    """The orders in answers: some, and one before each turn of the conversations."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit(", 1] "), "text")
    answers = _ANSWERS.frame(spark).unionByName(c.select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("id"), said.alias("response"), F.lit(3).alias("n")))
    return answers.select("id", F.array_join(shaping.order_of(F.col("response"), F.col("n")), ",").alias("places"))


@query("adaptive_timeout", f"WITH {EVENTS_SQL}, p AS (SELECT peer, avg(value) FILTER (event_type <> 'error') AS latency FROM ev GROUP BY peer) SELECT peer, round(CASE WHEN coalesce(latency, 0) = 0 THEN 2000::DOUBLE ELSE greatest(500::DOUBLE, least(2000 * latency / 200, 5000::DOUBLE)) END, 6) AS timeout FROM p")
def adaptive_timeout(spark, sf_dir):
    latency = F.avg(F.when(F.col("event_type") != "error", F.col("value")))
    return events(spark, sf_dir).groupBy("peer").agg(latency.alias("latency")).select("peer", F.round(shaping.adaptive_timeout(F.col("latency")), 6).alias("timeout"))


@query("work_proof", f"WITH d AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents), z AS (SELECT doc_id, length(h) - length(ltrim(h, '0')) AS n, ltrim(h, '0') AS r FROM d), b AS (SELECT doc_id, (n * 4 + CASE WHEN r[1] IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 0 WHEN r[1] IN ('4', '5', '6', '7') THEN 1 WHEN r[1] IN ('2', '3') THEN 2 ELSE 3 END)::INT AS bits FROM z) SELECT doc_id, bits, bits >= 5 AS enough FROM b")
def work_proof(spark, sf_dir):
    """Leading zero bits of a hash, and whether they are enough work; the hash of doc_id stands for that of a key and its nonce."""
    bits = shaping.leading_zero_bits(F.sha2(F.col("doc_id").cast("string"), 256))
    return table(spark, sf_dir, "documents").select("doc_id", bits.alias("bits")).withColumn("enough", F.col("bits") >= 5)


_IPS = Literal("ips", "ip string", (("10.1.2.3",), ("192.168.0.255",), ("2001:db8::1",), ("2001:0db8:0001:2::5",), ("::1",), ("fe80:0:0:1:2:3:4:5",)))


@query("subnets", "SELECT * FROM (VALUES ('10.1.2.3', '10.1.2.0/24'), ('192.168.0.255', '192.168.0.0/24'), ('2001:db8::1', '2001:db8::/48'), ('2001:0db8:0001:2::5', '2001:db8:1::/48'), ('::1', '::/48'), ('fe80:0:0:1:2:3:4:5', 'fe80::/48')) v(ip, subnet) UNION ALL SELECT '2001:db8:' || printf('%x', c_custkey % 65535 + 1) || '::' || printf('%x', c_nationkey + 1), '2001:db8:' || printf('%x', c_custkey % 65535 + 1) || '::/48' FROM customer")
def subnets(spark, sf_dir):
    """Networks of some addresses, and of one for each customer."""
    hexed = lambda c: F.lower(F.hex(c.cast("long")))
    ip = F.concat(F.lit("2001:db8:"), hexed(F.col("c_custkey") % 65535 + 1), F.lit("::"), hexed(F.col("c_nationkey") + 1))
    return _IPS.frame(spark).unionByName(table(spark, sf_dir, "customer").select(ip.alias("ip"))).select("ip", shaping.subnet(F.col("ip")).alias("subnet"))


_TOLD = {"bm25": "score / (score + top)", "freshness": scores.freshness_sql("crawled_at", NOW), "trust": "0.5::DOUBLE", "authority": "0::DOUBLE", "title": "CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q)::DOUBLE END", "url": "CASE WHEN len(q) = 0 OR p = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(p, x))) / len(q)::DOUBLE END"}


@query("explained_search", f"WITH {FEATURES_SQL}, told AS (SELECT *, {', '.join(f'round({v} * {_W[n]}::DOUBLE, 6) AS w_{n}' for n, v in _TOLD.items())} FROM feat), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({' + '.join(f'{_W[n]}::DOUBLE * ({v})' for n, v in _TOLD.items())}, 6) DESC, bm25_rank) AS rank FROM told) SELECT query_id, rank, doc_id, {', '.join(f'w_{n}' for n in _W)} FROM o WHERE rank <= 10")
def explained_search(spark, sf_dir):
    """The weighted signals that ranked the results of each query."""
    rows = search.ranked(documents(spark, sf_dir), queries(spark, sf_dir), 10, NOW, explain=True)
    parts = shaping.explanation({n: F.col(f"signals.{n}") for n in _W})
    return rows.select("query_id", "rank", "doc_id", *[parts[f"w_{n}"].alias(f"w_{n}") for n in _W])


_REMOTE = "remote AS (SELECT query_id, 'https://remote/' || doc_id AS url, round(combined * 1.1, 6) AS score, rank FROM ranked WHERE rank % 2 = 0 UNION ALL SELECT query_id, url, 2.0, rank FROM ranked WHERE rank % 2 = 1)"


@query(
    "merge_remote",
    f"WITH {RANKED_SQL}, {_REMOTE}, u AS (SELECT query_id, url, combined AS score, 0 AS src, rank FROM ranked UNION ALL SELECT query_id, url, score, 1, rank FROM remote), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY src, rank) AS n FROM u) SELECT query_id, url, score, src, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, url) AS place FROM f WHERE n = 1",
)
def merge_remote(spark, sf_dir):
    """Local results, and remote ones for addresses that are not among them, by score."""
    local = ranked_search(spark, sf_dir)
    even = local.filter("rank % 2 = 0").select("query_id", F.concat(F.lit("https://remote/"), F.col("doc_id").cast("string")).alias("url"), F.round(F.col("combined") * 1.1, 6).alias("score"), "rank")
    odd = local.filter("rank % 2 = 1").select("query_id", "url", F.lit(2.0).alias("score"), "rank")
    return results.merged(local.select("query_id", "url", F.col("combined").alias("score"), "rank"), even.unionByName(odd))


_AUTH = "auth AS (SELECT source AS domain, count(*) / (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source))::DOUBLE AS authority FROM documents GROUP BY source), tru AS (SELECT source AS peer, avg(quality)::DOUBLE AS trust FROM labels JOIN documents USING (doc_id) GROUP BY source)"


@query(
    "ranked_by_authority",
    f"""WITH {FEATURES_SQL}, {_AUTH},
 full_ AS (SELECT feat.*, coalesce(authority, 0) AS authority, coalesce(trust, 0.5) AS trust FROM feat LEFT JOIN auth ON auth.domain = lower(regexp_extract(url, '://([^/?#]*)', 1)) LEFT JOIN tru ON tru.peer = regexp_extract(url, '://([^/?#]*)', 1)),
 scored AS (SELECT *, round(0.40::DOUBLE * (score / (score + top)) + 0.15::DOUBLE * {scores.freshness_sql('crawled_at', NOW)} + 0.10::DOUBLE * trust + 0.15::DOUBLE * authority
 + 0.15::DOUBLE * CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END + 0.05::DOUBLE * CASE WHEN len(q) = 0 OR p = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(p, x))) / len(q) END, 6) AS combined FROM full_)
 SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, bm25_rank) AS rank, doc_id, url, combined FROM scored) WHERE rank <= 10""",
)
def ranked_by_authority(spark, sf_dir):
    """Two-stage search with the authority of a result's domain (0 if unknown) and the trust of its peer (one half)."""
    docs = documents(spark, sf_dir)
    sizes = docs.groupBy("domain").agg(F.count("*").alias("n"))
    authority = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("top")))).select("domain", (F.col("n") / F.col("top")).alias("authority"))  # one row
    trust = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("peer")).agg(F.avg("quality").alias("trust"))
    return search.ranked(docs, queries(spark, sf_dir), 10, NOW, authority, trust)


_AT = "(SELECT url FROM pages WHERE page_id = doc_id % (SELECT count(*) FROM pages)) || '/' || doc_id AS url"
_SCORED = f"""full_ AS (SELECT feat.*, coalesce(authority, 0) AS authority, coalesce(trust, 0.5) AS trust FROM feat JOIN docs USING (doc_id) LEFT JOIN auth ON auth.domain = lower(regexp_extract(feat.url, '://([^/?#]*)', 1)) LEFT JOIN tru ON tru.peer = source),
 scored AS (SELECT *, round(0.40::DOUBLE * (score / (score + top)) + 0.15::DOUBLE * {scores.freshness_sql('full_.crawled_at', NOW)} + 0.10::DOUBLE * trust + 0.15::DOUBLE * authority
 + 0.15::DOUBLE * CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END + 0.05::DOUBLE * CASE WHEN len(q) = 0 OR p = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(p, x))) / len(q) END, 6) AS combined FROM full_)"""


@query(
    "ranked_by_links_and_trust",
    f"""WITH {FEATURES_SQL.replace("'https://' || source || '/' || doc_id AS url", _AT)}, auth AS (SELECT domain, score AS authority FROM ({ORACLES["domain_authority"]})), tru AS (SELECT 'src' || peer AS peer, trust FROM ({ORACLES["trust_score"]})), {_SCORED}
 SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, bm25_rank) AS rank, doc_id, url, combined FROM scored) WHERE rank <= 10""",
)
def ranked_by_links_and_trust(spark, sf_dir):
    """Two-stage search with the authority that links give the domain of a result, and the trust score of the peer that sent it; documents lie at the addresses of the pages, sources are numbered as peers."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("at"))
    n = pages.agg(F.count("*").alias("n"))  # one row
    docs = documents(spark, sf_dir).drop("url").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("doc_id") % F.col("n"))
    docs = docs.join(pages, "page_id", "left").withColumn("url", F.concat("at", F.lit("/"), F.col("doc_id").cast("string"))).drop("at", "n", "page_id")
    authority = graph.authority(cited(spark, sf_dir)).withColumnRenamed("score", "authority")
    trust = trust_of(spark, sf_dir).select(F.concat(F.lit("src"), F.col("peer").cast("string")).alias("peer"), "trust")
    return search.ranked(docs, queries(spark, sf_dir), 10, NOW, authority, trust)


_ENTRY = "struct<url:string,title:string,domain:string,snippet:string,score:double,scores:struct<bm25:double,freshness:double,trust:double,authority:double,title_match:double,url_path:double>,crawled_at:double,peer_id:string>"
_SIGNED = {"bm25": "bm25", "freshness": "freshness", "trust": "trust", "authority": "authority", "title": "title_match", "url": "url_path"}


@query(
    "answer_json",
    f"WITH {FEATURES_SQL}, told AS (SELECT *, {', '.join(f'{v} AS s_{n}' for n, v in _TOLD.items())} FROM feat), o AS (SELECT *, round({' + '.join(f'{_W[n]}::DOUBLE * s_{n}' for n in _TOLD)}, 6) AS combined FROM told), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, bm25_rank) AS place FROM o), l AS (SELECT * FROM k WHERE place <= 10) SELECT query_id, (count(*) OVER (PARTITION BY query_id))::INT AS total, place::INT AS place, url, regexp_extract(url, '://([^/]*)', 1) AS domain, round(combined, 4) AS score, {', '.join(f'round(s_{n}, 4)::DOUBLE AS {c}' for n, c in _SIGNED.items())}, l.crawled_at FROM l",
)
def answer_json(spark, sf_dir):
    """The whole answer to each query as JSON with all signals, read again."""
    rows = search.ranked(documents(spark, sf_dir), queries(spark, sf_dir), 10, NOW, explain=True)
    rows = rows.join(documents(spark, sf_dir).select("doc_id", "title", "text", "crawled_at"), "doc_id")
    entry = shaping.ranked_entry(F.col("url"), F.col("title"), F.col("text"), F.col("combined"), {n: F.col(f"signals.{n}") for n in _SIGNED}, F.col("crawled_at"), F.lit(None).cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"])  # ten at most
    said = rows.groupBy("query_id").agg(listed.alias("l")).select("query_id", shaping.answer_json(F.col("l"), F.lit(12.34), F.lit("local")).alias("j"))
    parsed = said.select("query_id", F.from_json("j", f"total int, elapsed_ms double, source string, results array<{_ENTRY}>").alias("a"))
    each = parsed.select("query_id", "a.total", F.posexplode("a.results").alias("p", "r"))
    return each.select("query_id", "total", (F.col("p") + 1).alias("place"), "r.url", "r.domain", "r.score", *[f"r.scores.{c}" for c in _SIGNED.values()], "r.crawled_at")


@query(
    "hybrid_json",
    f"""WITH {RANKED_SQL}, {VECTOR_SQL}, f AS (SELECT (query_id + 5) * 100 AS query_id, doc_id, rank AS fr, combined FROM ranked), g AS (SELECT query_id, doc_id, rank AS vr, score FROM vec),
 u AS (SELECT query_id, doc_id, CASE WHEN vr IS NULL THEN 'fts' WHEN fr IS NULL THEN 'vector' ELSE 'hybrid' END AS source, combined, score, round(coalesce(1.0::DOUBLE / (60 + fr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0), 6) AS rrf FROM f FULL JOIN g USING (query_id, doc_id))
 SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id))::INT AS place, d.url, u.source, round(combined, 4) AS bm25, round(score, 4) AS vector, round(rrf, 4) AS rrf FROM u JOIN docs d USING (doc_id)""",
)
def hybrid_json(spark, sf_dir):
    """Fused answers as JSON, with the scores that each result has, read again."""
    hits = ranked_search(spark, sf_dir).withColumn("query_id", (F.col("query_id") + 5) * 100)
    near = nearest_vectors(spark, sf_dir)
    fused = search.rrf(hits, near).join(hits.select("query_id", "doc_id", F.col("combined").alias("fts")), ["query_id", "doc_id"], "left")
    fused = fused.join(near.select("query_id", "doc_id", F.col("score").alias("vector")), ["query_id", "doc_id"], "left")
    rows = fused.join(documents(spark, sf_dir).select("doc_id", "url", "title", "text"), "doc_id")
    entry = shaping.merged_entry(F.col("url"), F.col("title"), F.col("text"), F.col("source"), F.col("fts"), F.col("vector"), F.col("combined_score"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("combined_score")).alias("s"), "doc_id", entry.alias("e")))), lambda x: x["e"])  # twenty at most
    said = rows.groupBy("query_id").agg(listed.alias("l")).select("query_id", shaping.answer_json(F.col("l"), F.lit(12.34), F.lit("hybrid")).alias("j"))
    kind = "total int, results array<struct<url:string,source:string,scores:struct<bm25:double,vector:double,rrf:double>>>"
    each = said.select("query_id", F.from_json("j", kind).alias("a")).select("query_id", F.posexplode("a.results").alias("p", "r"))
    return each.select("query_id", (F.col("p") + 1).alias("place"), "r.url", "r.source", "r.scores.*")


@query("work_verified", "WITH h AS (SELECT event_id, sha256(unhex(sha256('key' || user_id) || lpad(printf('%x', event_id), 16, '0'))) AS h FROM events), z AS (SELECT event_id, length(h) - length(ltrim(h, '0')) AS n, ltrim(h, '0') AS r FROM h), b AS (SELECT event_id, (n * 4 + CASE WHEN r[1] IN ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') THEN 0 WHEN r[1] IN ('4', '5', '6', '7') THEN 1 WHEN r[1] IN ('2', '3') THEN 2 ELSE 3 END)::INT AS bits FROM z) SELECT event_id, bits, bits >= 6 AS enough FROM b")
def work_verified(spark, sf_dir):
    """The work in a key and a nonce: every event offers its number as a nonce for its user's key."""
    key = F.sha2(F.concat(F.lit("key"), F.col("user_id").cast("string")), 256)
    return table(spark, sf_dir, "events").select("event_id", shaping.work_bits(key, F.col("event_id")).alias("bits")).withColumn("enough", F.col("bits") >= 6)


@query("dedup_results")
def dedup_results(spark, sf_dir):
    """The results of each query without those whose title and snippet resemble a better one."""
    return results.without_look_alikes(_hits(spark, sf_dir).select("query_id", "rank", "url", "title", "snippet")).select("query_id", "rank", "url")


_SNIP = text.chunks_of_space_sql("lower(substr(text, 1, 200))")


@query("snippet_mismatch", f"WITH {_HIT_SQL}, s AS (SELECT query_id, rank, list_distinct({_SNIP.replace('text', 'snippet')}) AS w FROM hit) SELECT a.query_id, a.rank AS a, b.rank AS b FROM s a JOIN s b ON a.query_id = b.query_id AND a.rank < b.rank WHERE CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END < 0.2")
def snippet_mismatch(spark, sf_dir):
    """Pairs of results of one query, by rank, whose snippets hardly share a word: what peers report on one subject. A query has ten results at most."""
    rows = _hits(spark, sf_dir).select("query_id", "rank", F.array_distinct(text.chunks_of_space(F.lower(F.substring("snippet", 1, 200)))).alias("w"))
    return results.mismatches(rows, "query_id", "rank", "w", 0.2).select(F.col("s").alias("query_id"), "a", "b")


_DENSE = f"""{_HIT_SQL}, x AS (SELECT query_id, rank, {text.chunks_of_space_sql('d.text')} AS w, {text.ascii_tokens_sql('query')} AS q FROM ranked JOIN docs d USING (doc_id, url) JOIN queries USING (query_id)),
 p AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS p FROM x), h AS (SELECT query_id, rank, unnest(list_filter(list_transform(p, lambda v, i: {{'i': i - 1, 'v': v}}), lambda s: list_contains(q, s.v))) AS s FROM p),
 n AS (SELECT a.query_id, a.rank, a.s.i AS i, count(DISTINCT b.s.v) AS n, max(b.s.i) AS last FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank = b.rank AND b.s.i BETWEEN a.s.i AND a.s.i + 39 GROUP BY a.query_id, a.rank, a.s.i),
 best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) = 1), spot AS (SELECT p.*, coalesce(n, 0) AS n_terms, greatest(coalesce(i - (40 - (last - i + 1)) // 2, 0), 0) AS start FROM p LEFT JOIN best USING (query_id, rank))"""


@query(
    "dense_snippet",
    f"""WITH {_DENSE} SELECT query_id, rank, n_terms::INT AS n_terms, start::INT AS start, CASE WHEN start > 0 THEN '...' ELSE '' END || array_to_string(list_transform(list_slice(w, start + 1, start + 40), lambda x, i: CASE WHEN list_contains(q, p[start + i]) THEN '<b>' || x || '</b>' ELSE x END), ' ') || CASE WHEN len(w) > start + 40 THEN '...' ELSE '' END AS snippet FROM spot""",
)
def dense_snippet(spark, sf_dir):
    """The forty words of each result that hold the most different terms of its query."""
    rows = _hits(spark, sf_dir).select("query_id", "rank", "text").join(queries(spark, sf_dir).select("query_id", text.ascii_tokens(F.col("query")).alias("terms")), "query_id")
    return results.dense_snippets(rows, ["query_id", "rank"])


@query(
    "summary_prompt",
    f"""WITH {_HIT_SQL}, e AS (SELECT query_id, rank, '[' || rank || '] ' || title || chr(10) || snippet AS entry FROM hit), c AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e)
 SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context FROM c WHERE used <= 1500 GROUP BY query_id""",
)
def summary_prompt(spark, sf_dir):
    """The best results of a query that fit 1500 characters, in order, as the context of a prompt."""
    entry = F.format_string("[%d] %s\n%s", F.col("rank"), F.col("title"), F.col("snippet"))
    rows = _hits(spark, sf_dir).select("query_id", "rank", entry.alias("entry"))
    return results.packed(rows, 1500)


@query(
    "snippet_enhanced",
    f"""WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN length(title) >= 80 AND len(list_intersect({text.ascii_tokens_sql('title')}, ['the', 'of'])) > 0 THEN title WHEN length(substr(text, 1, 200)) > length(title) THEN substr(text, 1, 200) ELSE title END AS snippet FROM docs""",
)
def snippet_enhanced(spark, sf_dir):
    """Titles stand for short snippets: a long one that shares a word with the query stays, else a longer passage takes its place."""
    docs = documents(spark, sf_dir)
    fits = F.arrays_overlap(text.ascii_tokens(F.col("title")), text.ascii_tokens(F.lit("the of")))
    passage = F.substring("text", 1, 200)
    return docs.select("doc_id", F.when((F.length("title") >= 80) & fits, F.col("title")).when(F.length(passage) > F.length("title"), passage).otherwise(F.col("title")).alias("snippet"))


@query("enhanced_snippets")
def enhanced_snippets(spark, sf_dir):
    """The snippets of results, and the best passages where those are short or hold no word of the query."""
    asked = queries(spark, sf_dir).select("query_id", text.ascii_tokens(F.col("query")).alias("wanted"))
    hits = _hits(spark, sf_dir).select("query_id", "rank", "title", "text").join(asked, "query_id")
    rows = hits.select("query_id", "rank", "text", "wanted", F.col("title").alias("snippet"))
    return results.enhanced(rows, ["query_id", "rank"]).select("query_id", "rank", "snippet")


_WORDS = text.chunks_of_space_sql("text")


@query(
    "window_snippet",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS p FROM w),
 f AS (SELECT *, greatest(coalesce(least(nullif(list_position(p, 'the'), 0), nullif(list_position(p, 'tion'), 0)), 1) - 1 - 5, 0) AS start FROM p)
 SELECT doc_id, CASE WHEN start > 0 THEN '...' ELSE '' END || array_to_string(list_transform(list_slice(w, start + 1, start + 40), lambda x, i: CASE WHEN p[start + i] IN ('the', 'tion') THEN '<b>' || x || '</b>' ELSE x END), ' ') || CASE WHEN len(w) > start + 40 THEN '...' ELSE '' END AS snippet FROM f""",
)
def window_snippet(spark, sf_dir):
    """Forty words of each document around the first that a fixed query asks for."""
    terms = F.array(F.lit("the"), F.lit("tion"))
    return table(spark, sf_dir, "documents").select("doc_id", shaping.window_snippet(F.col("text"), terms).alias("snippet"))


_MERGED = Literal("merged", "id long, fts double, vec double, rrf double", ((1, 0.25, 0.5, 0.03125), (2, None, 0.75, 0.015), (3, 1.5, None, 0.016), (4, None, None, 0.0)))


@query("merged_scores", f"WITH {_MERGED.sql.replace('merged AS', 'few AS')}, merged AS (SELECT * FROM few UNION ALL SELECT -event_id - 1, CASE WHEN event_id % 3 > 0 THEN floor(value) / 8 END, CASE WHEN event_id % 5 > 0 THEN (event_id % 8) / 8.0::DOUBLE END, (event_id % 16) / 16.0::DOUBLE FROM events) SELECT id, coalesce(nullif(concat_ws(', ', CASE WHEN fts IS NOT NULL THEN format('BM25={{:.3f}}', fts) END, CASE WHEN vec IS NOT NULL THEN format('sim={{:.3f}}', vec) END), ''), 'N/A') || format(' (RRF={{:.4f}})', round(rrf, 4)) AS shown FROM merged")
def merged_scores(spark, sf_dir):
    """Scores of hybrid results as text: some, and one made of each event."""
    e = table(spark, sf_dir, "events")
    made = e.select((-F.col("event_id") - 1).alias("id"), F.when(F.col("event_id") % 3 > 0, F.floor("value") / 8).alias("fts"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 8) / 8).alias("vec"), ((F.col("event_id") % 16) / 16).alias("rrf"))
    return _MERGED.frame(spark).unionByName(made).select("id", shaping.merged_parts(F.col("fts"), F.col("vec"), F.col("rrf")).alias("shown"))


@query("answer_text", f"WITH {RANKED_SQL}, g AS (SELECT query_id, list(url ORDER BY rank) AS l, count(*) AS n FROM ranked GROUP BY query_id) SELECT query_id, 'Found ' || n || ' results (12ms, local)' || chr(10) || '  Local: ' || n || ', Remote: 0' || chr(10) || chr(10) || array_to_string(l, chr(10)) AS answer FROM g")
def answer_text(spark, sf_dir):
    """The whole answer to each query; its results are their addresses here."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])
    rows = ranked_search(spark, sf_dir).groupBy("query_id").agg(listed.alias("l"))  # ten results at most
    return rows.select("query_id", shaping.answer_text(F.col("l"), F.lit(12.3), F.lit("local"), F.size("l"), F.lit(0)).alias("answer"))
