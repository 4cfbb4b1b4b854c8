"""The client, tools and plugins as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api.client import Client
from ..api.plugins import Plugins, Point, default_tokens
from ..registry import query
from ..sources.tables import DOCUMENTS_SQL, NOW, documents, table


@query("plugin_chain", "SELECT doc_id, upper(lang) AS lang, length(text) AS n FROM documents WHERE lang <> 'de' AND length(text) >= 100")
def plugin_chain(spark, sf_dir):
    """Documents through a chain of hooks: a filter, one that fails and is skipped, one on rows, and a change."""
    plugins = Plugins()
    plugins.hook(Point.PRE_INDEX)(lambda df: df.filter("lang <> 'de'"))
    plugins.hook(Point.PRE_INDEX)(lambda df: df.select("no such column"))
    plugins.rows(Point.PRE_INDEX)(lambda row: row if len(row["text"] or "") >= 100 else None)
    plugins.hook(Point.PRE_INDEX)(lambda df: df.withColumn("lang", F.upper("lang")))
    rows = plugins.run(Point.PRE_INDEX, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return rows.select("doc_id", "lang", F.length("text").alias("n"))


@query("plugin_tokens", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]+)', 1), lambda w: length(w) >= 2)) AS words, len(string_split(text, ' ')) AS pieces FROM documents")
def plugin_tokens(spark, sf_dir):
    """Tokens by the default tokenizer and by one that a plugin registers."""
    plugins = Plugins()
    plugins.hook(Point.CUSTOM_TOKENIZER)(lambda c: F.split(c, " "))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(default_tokens(F.col("text"))).alias("words"), F.size(plugins.tokens(F.col("text"))).alias("pieces"))


@query("client_stats", f"WITH {DOCUMENTS_SQL} SELECT count(*) AS n_docs, count(DISTINCT domain) AS domains, max(crawled_at) AS latest FROM docs")
def client_stats(spark, sf_dir):
    return Client(spark, documents(spark, sf_dir), NOW).stats()


@query("client_batch")
def client_batch(spark, sf_dir):
    """A batch of queries through the client; ranked_search has the twin of the ranking."""
    return Client(spark, documents(spark, sf_dir), NOW).search(["the of and", "de la", "tion"], 10).select("query", "rank", "doc_id", "combined")


@query("client_crawl", "WITH p AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, 'added' AS outcome FROM (SELECT page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS i, row_number() OVER (PARTITION BY t ORDER BY page_id) AS j FROM p) WHERE i = 1 AND j = 1")
def client_crawl(spark, sf_dir):
    """Pages that the client takes in as new documents."""
    return Client(spark, documents(spark, sf_dir), NOW).crawl(table(spark, sf_dir, "pages")).filter("outcome = 'added'").select("page_id", "outcome")
