"""Ranking signals as column expressions; `now` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the combined score and the freshness curve.
WEIGHTS = {"bm25": 0.40, "freshness": 0.15, "trust": 0.10, "authority": 0.15, "title": 0.15, "url": 0.05}
HALF_LIFE, LEAST_FRESH, LOCAL_TRUST = 604800.0, 0.05, 0.5
K1, B = 1.2, 0.75


def freshness(crawled_at: Column, now: float) -> Column:
    """1 now or in the future, half after a week, never below 0.05."""
    return F.greatest(F.lit(LEAST_FRESH), F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), F.lit(now) - crawled_at) / HALF_LIFE))


def freshness_sql(crawled_at: str, now: float) -> str:
    return f"greatest(0.05::DOUBLE, pow(2.0::DOUBLE, -greatest(0.0::DOUBLE, {now}::DOUBLE - {crawled_at}) / 604800.0::DOUBLE))"


def normal_bm25(score: Column, top: Column) -> Column:
    """score / (score + top): the best candidate gets one half."""
    return F.when(score <= 0, 0.0).otherwise(score / (score + top))


def combined(weights: dict[str, float] | None = None, **signals: Column) -> Column:
    total = F.lit(0.0)
    for name, weight in (weights or WEIGHTS).items():
        total = total + weight * signals[name]
    return total


def token_share(query_tokens: Column, tokens: Column) -> Column:
    """Share of the distinct query tokens that are among tokens."""
    q = F.array_distinct(query_tokens)
    return F.when((F.size(q) == 0) | (F.size(tokens) == 0), 0.0).otherwise(F.size(F.array_intersect(q, tokens)) / F.size(q))


def path_share(query_tokens: Column, url: Column) -> Column:
    """Share of the distinct query tokens that the words of the URL's path contain, anywhere in them."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    text = F.array_join(F.regexp_extract_all(path, F.lit("([a-z0-9]+)"), 1), " ")
    q = F.array_distinct(query_tokens)
    return F.when((F.size(q) == 0) | (text == ""), 0.0).otherwise(F.size(F.filter(q, lambda t: F.contains(text, t))) / F.size(q))


def passage_score(tokens: Column, query_tokens: Column) -> Column:
    """Coverage of the query's tokens plus a tenth of their density."""
    q = F.array_distinct(query_tokens)
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(q, t)))
    return F.when((F.size(q) == 0) | (F.size(tokens) == 0), 0.0).otherwise(F.size(F.array_intersect(q, tokens)) / F.size(q) + 0.1 * hits / F.size(tokens))
