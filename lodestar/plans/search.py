"""Search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import search, segments, vectors
from ..registry import query
from ..sources.tables import DOCUMENTS_SQL, NOW, QUERIES_SQL, documents, queries, table
from ..storage import new_path

LIMIT = 10
BM25_SQL = f"""{DOCUMENTS_SQL}, {QUERIES_SQL},
toks AS (SELECT doc_id, {text.index_tokens_sql("concat_ws(' ', title, text)")} AS tokens FROM docs),
corpus AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_len FROM toks),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS term FROM toks) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS times, count(*) OVER (PARTITION BY query_id) AS n_terms FROM
 (SELECT query_id, unnest({text.index_tokens_sql("query")}) AS term FROM queries) GROUP BY query_id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf, avg_len FROM dfs, corpus),
bm AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avg_len))) AS score
 FROM post JOIN qt USING (term) JOIN w USING (term) GROUP BY query_id, doc_id HAVING count(*) = any_value(n_terms))"""


@query("bm25_search", f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_search(spark, sf_dir):
    return search.bm25(documents(spark, sf_dir), queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


_TITLE = text.ascii_tokens_sql("title")
_QUERY = text.ascii_tokens_sql("query")
_PATH = "array_to_string(regexp_extract_all(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '([a-z0-9]+)', 1), ' ')"
FEATURES_SQL = f"""{BM25_SQL},
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS bm25_rank FROM bm) WHERE bm25_rank <= {2 * LIMIT}),
feat AS (SELECT c.*, d.url, d.crawled_at, max(score) OVER (PARTITION BY query_id) AS top, list_distinct({_QUERY}) AS q, {_TITLE} AS t, {_PATH} AS p
 FROM cand c JOIN queries USING (query_id) JOIN docs d USING (doc_id))"""
RANKED_SQL = f"""{FEATURES_SQL},
comb AS (SELECT *, round(0.40::DOUBLE * (score / (score + top)) + 0.15::DOUBLE * {scores.freshness_sql("crawled_at", NOW)} + 0.05::DOUBLE
 + 0.15::DOUBLE * CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END
 + 0.05::DOUBLE * CASE WHEN len(q) = 0 OR p = '' THEN 0 ELSE len(list_filter(q, lambda x: contains(p, x))) / len(q) END, 6) AS combined FROM feat),
ranked AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, bm25_rank) AS rank, doc_id, url, combined FROM comb) WHERE rank <= {LIMIT})"""


@query("ranked_search", f"WITH {RANKED_SQL} SELECT * FROM ranked")
def ranked_search(spark, sf_dir):
    return search.ranked(documents(spark, sf_dir), queries(spark, sf_dir), LIMIT, NOW)


@query("indexed_search", f"WITH {RANKED_SQL} SELECT * FROM ranked")
def indexed_search(spark, sf_dir):
    """ranked_search from a written index, which is built first."""
    docs, path = documents(spark, sf_dir), new_path(spark, "index")
    search.build_index(docs, path)
    return search.ranked(docs, queries(spark, sf_dir), LIMIT, NOW, index=path)


_LIVING = BM25_SQL.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")


def _changed_index(spark, sf_dir):
    """An index with a history: the titles of all documents, then four crawls of their texts, of which each replaces its titles, then the toxic ones deleted."""
    docs = documents(spark, sf_dir)
    index = segments.Index(spark, new_path(spark, "segments"), buckets=16, slices=2)
    index.add(docs.withColumn("text", F.lit("")))
    for crawl in range(4):
        index.add(docs.filter(F.pmod("doc_id", F.lit(4)) == crawl))
    index.delete(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))
    return index


@query("segmented_search", f"WITH {_LIVING} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def segmented_search(spark, sf_dir):
    """BM25 over all segments of an index with updates and deletions equals that over the documents left."""
    return _changed_index(spark, sf_dir).bm25(queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("merged_search", f"WITH {_LIVING} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def merged_search(spark, sf_dir):
    """The same after segments of like size are merged and the dead ones of the old versions are gone."""
    index = _changed_index(spark, sf_dir)
    index.merge()
    index.vacuum()
    return index.bm25(queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "suggest",
    f"WITH {DOCUMENTS_SQL} SELECT title, max(crawled_at) AS crawled_at FROM docs WHERE contains(lower(title), 'tion') AND title <> '' GROUP BY title ORDER BY crawled_at DESC, title LIMIT 10",
)
def suggest(spark, sf_dir):
    return search.suggest(documents(spark, sf_dir), "ti%on")


_COSINE = "round(list_dot_product(embedding::DOUBLE[], probe::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(probe::DOUBLE[], probe::DOUBLE[])), 4)"
VECTOR_SQL = f"""probes AS (SELECT vec_id AS query_id, embedding AS probe FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT query_id, vec_id AS doc_id, {_COSINE} AS score FROM embeddings, probes WHERE vec_id <> query_id),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near WHERE score >= 0) WHERE rank <= {LIMIT})"""


def nearest_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("probe")), LIMIT)


@query("vector_topk", f"WITH {VECTOR_SQL} SELECT query_id, doc_id, score, rank FROM vec")
def vector_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 is a query against all."""
    return nearest_vectors(spark, sf_dir)


@query(
    "rrf_hybrid",
    f"""WITH {RANKED_SQL}, {VECTOR_SQL}, f AS (SELECT (query_id + 5) * 100 AS query_id, doc_id, rank AS fr FROM ranked), g AS (SELECT query_id, doc_id, rank AS vr FROM vec)
 SELECT query_id, doc_id, CASE WHEN vr IS NULL THEN 'fts' WHEN fr IS NULL THEN 'vector' ELSE 'hybrid' END AS source,
 round(coalesce(1.0::DOUBLE / (60 + fr), 0) + coalesce(1.0::DOUBLE / (60 + vr), 0), 6) AS combined_score FROM f FULL JOIN g USING (query_id, doc_id)""",
)
def rrf_hybrid(spark, sf_dir):
    hits = ranked_search(spark, sf_dir).withColumn("query_id", (F.col("query_id") + 5) * 100)
    return search.rrf(hits, nearest_vectors(spark, sf_dir))


@query("freshness", f"WITH {DOCUMENTS_SQL} SELECT doc_id, round({scores.freshness_sql('crawled_at', NOW)}, 9) AS freshness FROM docs")
def freshness(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(scores.freshness(F.col("crawled_at"), NOW), 9).alias("freshness"))


def _probe(column: str):
    """A fixed query of two words against a text column."""
    return text.ascii_tokens(F.lit("the tion"))


@query("title_match", f"WITH {DOCUMENTS_SQL} SELECT doc_id, CASE WHEN len({_TITLE}) = 0 THEN 0::DOUBLE ELSE len(list_intersect(['the', 'tion'], {_TITLE})) / 2::DOUBLE END AS title_match FROM docs")
def title_match(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", scores.token_share(_probe("title"), text.ascii_tokens(F.col("title"))).cast("double").alias("title_match"))


@query("url_path", f"SELECT page_id, CASE WHEN {_PATH} = '' THEN 0::DOUBLE ELSE (contains({_PATH}, 'en')::INT + contains({_PATH}, '7')::INT) / 2::DOUBLE END AS url_path FROM pages")
def url_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scores.path_share(text.ascii_tokens(F.lit("en 7")), F.col("url")).cast("double").alias("url_path"))


_TOKENS = text.ascii_tokens_sql("text")


@query(
    "passage_score",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS p FROM documents) SELECT doc_id, round(CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(['the', 'of'], p)) / 2::DOUBLE
 + 0.1::DOUBLE * len(list_filter(p, lambda x: x = 'the' OR x = 'of')) / len(p) END, 6) AS passage_score FROM t""",
)
def passage_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scores.passage_score(text.ascii_tokens(F.col("text")), text.ascii_tokens(F.lit("the of"))), 6).alias("passage_score"))


@query(
    "highlight",
    # The SQL twin marks the end of every delimiter, as its patterns know no look-around.
    r"""SELECT doc_id, replace(regexp_replace(regexp_replace(text, '([^\p{L}\p{N}_])', '\1' || chr(2), 'g'), '(?i)(^|\x02)(tion|the|of)($|[^\p{L}\p{N}_])', '\1<b>\2</b>\3', 'g'), chr(2), '') AS highlighted FROM documents""",
)
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?i)\b(tion|the|of)\b", "<b>$1</b>").alias("highlighted"))


@query(
    "related_searches",
    f"""WITH t AS (SELECT row_number() OVER () AS turn, list_distinct({_TOKENS}) AS w FROM conversations WHERE role = 'user'), e AS (SELECT turn, unnest(w) AS term FROM t), o AS (SELECT term FROM e GROUP BY term HAVING count(*) > 1), d AS (SELECT * FROM e SEMI JOIN o USING (term))
 SELECT a.term AS term_a, b.term AS term_b, count(*) AS times FROM d a JOIN d b ON a.turn = b.turn AND a.term < b.term GROUP BY ALL HAVING count(*) > 1""",
)
def related_searches(spark, sf_dir):
    """Term pairs that more than one query shares; every user turn is a query, all its distinct terms count.

    A term of one query only cannot be in a shared pair, so those go before terms are paired.
    """
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.array_distinct(text.ascii_tokens(F.col("text"))).alias("w"))
    return search.shared_pairs(turns, "w")
