"""Evaluation and reordering of ranked lists (query_id, rank, ...)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(rows: DataFrame, k: int = 10, relevance: str = "relevance") -> DataFrame:
    """query_id, ndcg at k of ranked rows (query_id, rank from 1, relevance); the ideal order comes from all rows."""
    gain = lambda r, i: r / F.log2(i + F.lit(1.0))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(relevance), "rank"))
    r = rows.withColumn("ideal", ideal)
    s = r.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain(F.col(relevance), F.col("rank")))).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain(F.col(relevance), F.col("ideal")))).alias("idcg"))
    return s.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def winner(a: Column, b: Column, margin: float = 0.01) -> Column:
    return F.when(b - a > margin, "B").when(b - a < -margin, "A").otherwise("tie")


def domain_clusters(rows: DataFrame, most: int = 3) -> DataFrame:
    """query_id, domain, title of the domain's first result, and its first `most` documents."""
    w = Window.partitionBy("query_id", "domain").orderBy("rank")
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return first.groupBy("query_id", "domain").agg(F.min_by("title", "rank").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("docs"))


def diversify(rows: DataFrame, most: int = 3) -> DataFrame:
    """query_id, rank, doc_id: one result of each domain a turn, `most` a domain.

    A list is at most a page of results, so each query's goes to one Python call. When a
    domain leaves, the turn moves on past the next one, as earlier engines did.
    """

    def turns(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[str, deque] = defaultdict(deque)
        for r in pdf.sort_values("rank").itertuples():
            waiting[r.domain].append(r.doc_id)
        ring, taken, out, at = list(waiting), Counter(), [], 0
        while ring:
            domain = ring[at % len(ring)]
            out.append(waiting[domain].popleft())
            taken[domain] += 1
            if not waiting[domain] or taken[domain] >= most:
                ring.remove(domain)
            at = (at + 1) % len(ring) if ring else 0
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "rank": range(1, len(out) + 1), "doc_id": out})

    return rows.select("query_id", "rank", "domain", "doc_id").groupBy("query_id").applyInPandas(turns, "query_id long, rank long, doc_id long")


def keyword_clusters(rows: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """query_id, label, docs, score: greedy exclusive clusters of a page of results around its most common words.

    rows: query_id, rank, doc_id, content, score. Seeds are the 3 * most commonest words
    of more than three letters that `least` results share, ties in order of appearance.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        bags = [dict.fromkeys(w for w in re.findall(r"\w+", c.lower()) if len(w) > 3) for c in pdf["content"]]
        counts = Counter(w for b in bags for w in b)
        free, found = set(range(len(bags))), []
        for word, n in counts.most_common(3 * most):
            members = [i for i in sorted(free) if word in bags[i]]
            if n >= least and len(members) >= least and len(found) < most:
                free -= set(members)
                part = pdf.iloc[members]
                found.append((pdf["query_id"].iloc[0], word, ",".join(map(str, part["doc_id"])), float(part["score"].mean())))
        return pd.DataFrame(found, columns=["query_id", "label", "docs", "score"])

    return rows.groupBy("query_id").applyInPandas(group, "query_id long, label string, docs string, score double")
