"""Tools by name with JSON arguments, as assistants call them; every answer is JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requests, text
from ..operators import search
from .client import Client

#: Rows of an answer, the next of which its argument `page` asks for, and queries of a batch.
MOST, BATCH = 50, 10


def filters_of(args: dict, now: float) -> dict:
    """The search filters in a call's arguments, for operators.search.keep."""
    out: dict = {}
    if isinstance(args.get("language"), str) and args["language"]:
        out["language"] = args["language"]
    if args.get("recency_days") is not None:
        days = int(args["recency_days"]) if str(args["recency_days"]).lstrip("-").isdigit() else 0
        if days > 0:
            out["date_from"] = now - days * 86400
    elif args.get("date_from") is not None:
        out["date_from"] = float(args["date_from"])
    if args.get("date_to") is not None:
        out["date_to"] = float(args["date_to"])
    for name, new, old in (("include", "domain_allowlist", "include_domains"), ("exclude", "domain_blocklist", "exclude_domains")):
        listed = args.get(new) or args.get(old)
        if isinstance(listed, list) and listed:
            out[name] = listed
    return out


class Tools:
    """The five tools, and older ones under their names; an unknown one is an error in the answer."""

    def __init__(self, client: Client):
        self.client, self.history = client, []

    def call(self, name: str, args: dict, role: str | None = None) -> str:
        f = getattr(self, f"tool_{name}", None)
        if f is None:
            return json.dumps({"error": f"unknown tool: {name}"})
        if role is not None and role not in requests.TOOL_ROLES.get(name, [role]):
            return json.dumps({"error": f"role {role} may not use {name}"})
        try:
            answer = f(args)
        except (KeyError, TypeError, ValueError) as e:
            return json.dumps({"error": f"bad arguments: {e}"})
        self.history.append((name, args.get("query")))
        if isinstance(answer, DataFrame):
            page = max(0, int(args.get("page") or 0))
            rows = [r.asDict(recursive=True) for r in answer.offset(page * MOST).limit(MOST + 1).collect()]
            answer = {"results": rows[:MOST]} | ({"next_page": page + 1} if len(rows) > MOST else {})
        return json.dumps(answer, ensure_ascii=False, default=str)

    @staticmethod
    def _limit(args: dict, default: int = 10, most: int = MOST) -> int:
        return max(1, min(int(args.get("limit", args.get("top_k", default))), most))

    def tool_web_search(self, args):
        query = args["query"].strip()
        if not query:
            raise ValueError("empty query")
        return self.client.search(query, self._limit(args), max(0, int(args.get("offset", 0))), **filters_of(args, self.client.now)).orderBy("rank")

    tool_search = tool_search_local = tool_web_search

    def tool_fetch_page(self, args):
        return self.client.fetch_page(args["url"])

    def tool_crawl_url(self, args):
        """Takes in the pages that the caller fetched: [{page_id, url, html}]."""
        pages = self.client.spark.createDataFrame([(p["page_id"], p["url"], p["html"]) for p in args["pages"]], "page_id long, url string, html string")
        return self.client.crawl(pages).select("page_id", "url", "outcome").orderBy("page_id")

    def tool_fact_check(self, args):
        """A claim against its own results: they support it if they hold enough of its words."""
        hits = self.client.search(args["claim"], self._limit(args, 5)).join(self.client.docs.select("doc_id", "text"), "doc_id")
        terms = lambda c: F.array_distinct(text.chunks_of_space(F.lower(c)))
        share = F.size(F.array_intersect(terms(F.lit(args["claim"])), terms(F.col("text")))) / F.greatest(F.lit(1), F.size(terms(F.lit(args["claim"]))))
        found = hits.agg(F.count("*").alias("total"), F.count_if(share >= 0.3).alias("supporting")).first()
        total, good = found["total"], found["supporting"]
        verdict = "unverified" if good == 0 else "supported" if good >= total * 0.5 else "disputed"
        return {"verdict": verdict, "supporting": good, "contradicting": total - good, "confidence": round(good / total, 3) if good else 0.1}

    def tool_status(self, args):
        return {"status": "ok", **self.client.stats().first().asDict()}

    tool_network_stats = tool_status

    def tool_suggest(self, args):
        return self.client.suggest(args.get("prefix", ""), self._limit(args))

    def tool_batch_search(self, args):
        queries = list(args["queries"])
        if len(queries) > BATCH:
            raise ValueError(f"{len(queries)} queries, at most {BATCH} in one call")
        return self.client.search(queries, self._limit(args, 5)).orderBy("query_id", "rank")

    def tool_search_rag(self, args):
        return self.client.chunks(args["query"], self._limit(args, 5), int(args.get("chunk_size", 500))).orderBy("rank", "chunk")

    def tool_explain(self, args):
        return self.client.explain(args["query"], self._limit(args)).orderBy("rank")

    def tool_search_history(self, args):
        return {"history": [{"tool": t, "query": q} for t, q in reversed(self.history[-self._limit(args, 20) :])]}

    def tool_ping(self, args):
        return {"pong": True}

    def tool_analytics(self, args):
        counts: dict[str, int] = {}
        for name, _ in self.history:
            counts[name] = counts.get(name, 0) + 1
        return {"calls": counts}


#: Routes of an admin service and the tools that answer them; a web server is the caller's.
ROUTES = {"/health": "ping", "/readiness": "ping", "/search": "web_search", "/status": "status", "/index/stats": "status", "/analytics": "analytics", "/analytics/tools": "analytics", "/suggest": "suggest"}


def route(tools: Tools, path: str, args: dict) -> tuple[int, str]:
    """Status code and body of a request."""
    if path not in ROUTES:
        return 404, json.dumps({"error": "not found"})
    body = tools.call(ROUTES[path], args)
    return (400 if '"error"' in body[:9] else 200), body
