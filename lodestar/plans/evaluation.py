"""Evaluation of rankings and page-level reordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, search
from ..registry import query
from ..sources.tables import documents, queries, table
from .search import RANKED_SQL, ranked_search

_AB_SQL = f"""{RANKED_SQL}, rel AS (SELECT doc_id, max(quality) AS relevance FROM labels GROUP BY doc_id),
la AS (SELECT query_id, bm25_rank AS rank, coalesce(relevance, 0) AS relevance FROM cand LEFT JOIN rel USING (doc_id) WHERE bm25_rank <= 10), lb AS (SELECT query_id, rank, coalesce(relevance, 0) AS relevance FROM ranked LEFT JOIN rel USING (doc_id)),
ia AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS ideal FROM la), ib AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS ideal FROM lb),
na AS (SELECT query_id, coalesce(sum(relevance / log2(rank + 1.0::DOUBLE)) / nullif(sum(relevance / log2(ideal + 1.0::DOUBLE)), 0), 0) AS ndcg FROM ia GROUP BY query_id),
nb AS (SELECT query_id, coalesce(sum(relevance / log2(rank + 1.0::DOUBLE)) / nullif(sum(relevance / log2(ideal + 1.0::DOUBLE)), 0), 0) AS ndcg FROM ib GROUP BY query_id)"""


def _relevance(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("relevance"))


def _judged(spark, sf_dir, hits):
    return hits.select("query_id", "rank", "doc_id").join(_relevance(spark, sf_dir), "doc_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


@query("ndcg", f"WITH {_AB_SQL} SELECT query_id, round(ndcg, 4) AS ndcg FROM nb")
def ndcg(spark, sf_dir):
    return ranking.ndcg(_judged(spark, sf_dir, ranked_search(spark, sf_dir))).withColumn("ndcg", F.round("ndcg", 4))


@query("mrr", f"WITH {_AB_SQL}, f AS (SELECT query_id, min(CASE WHEN relevance > 0 THEN rank END) AS first FROM lb GROUP BY query_id) SELECT count(*) AS queries, round(sum(coalesce(1.0::DOUBLE / first, 0)) / count(*), 6) AS mrr FROM f")
def mrr(spark, sf_dir):
    """Mean reciprocal rank of the first relevant result; queries without one count 0."""
    first = _judged(spark, sf_dir, ranked_search(spark, sf_dir)).groupBy("query_id").agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("queries"), F.round(F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"))


@query(
    "ab_test",
    f"WITH {_AB_SQL}, won AS (SELECT CASE WHEN b.ndcg - a.ndcg > 0.01 THEN 'B' WHEN b.ndcg - a.ndcg < -0.01 THEN 'A' ELSE 'tie' END AS winner, CASE WHEN a.ndcg > 0 THEN round((b.ndcg - a.ndcg) / a.ndcg * 100, 2) ELSE 0 END AS pct FROM na a JOIN nb b USING (query_id)) SELECT count(*) AS total, count(*) FILTER (winner = 'A') AS a_wins, count(*) FILTER (winner = 'B') AS b_wins, count(*) FILTER (winner = 'tie') AS ties, round(avg(pct), 2) AS avg_improvement FROM won",
)
def ab_test(spark, sf_dir):
    """BM25 order (A) against the combined order (B)."""
    plain = search.top_k(search.bm25(documents(spark, sf_dir), queries(spark, sf_dir)).withColumn("r6", F.round("score", 6)), 10, "r6")
    a = ranking.ndcg(_judged(spark, sf_dir, plain)).withColumnRenamed("ndcg", "a")
    b = ranking.ndcg(_judged(spark, sf_dir, ranked_search(spark, sf_dir))).withColumnRenamed("ndcg", "b")
    w = a.join(b, "query_id").select(ranking.winner(F.col("a"), F.col("b")).alias("winner"), F.when(F.col("a") > 0, F.round((F.col("b") - F.col("a")) / F.col("a") * 100, 2)).otherwise(0.0).alias("pct"))
    return w.agg(F.count("*").alias("total"), F.count_if(F.col("winner") == "A").alias("a_wins"), F.count_if(F.col("winner") == "B").alias("b_wins"), F.count_if(F.col("winner") == "tie").alias("ties"), F.round(F.avg("pct"), 2).alias("avg_improvement"))


def _page(spark, sf_dir):
    return ranked_search(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "domain", "title", "text"), "doc_id")


@query("domain_clusters", f"WITH {RANKED_SQL}, c AS (SELECT r.*, domain, title, row_number() OVER (PARTITION BY query_id, domain ORDER BY rank) AS n FROM ranked r JOIN docs USING (doc_id)) SELECT query_id, domain, arg_min(title, rank) AS title, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS docs FROM c WHERE n <= 3 GROUP BY ALL")
def domain_clusters(spark, sf_dir):
    return ranking.domain_clusters(_page(spark, sf_dir))


@query("diversify")
def diversify(spark, sf_dir):
    return ranking.diversify(_page(spark, sf_dir))


@query("keyword_clusters")
def keyword_clusters(spark, sf_dir):
    rows = _page(spark, sf_dir).select("query_id", "rank", "doc_id", F.concat_ws(" ", "title", "text").alias("content"), F.col("combined").alias("score"))
    return ranking.keyword_clusters(rows)


