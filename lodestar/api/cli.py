"""Command line: python -m lodestar.api.cli DATA_DIR search|suggest|stats|export|import|tool ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..sources.tables import NOW, documents
from .client import Client
from .tools import Tools


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    p.add_argument("data")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=10)
    s.add_argument("--offset", type=int, default=0)
    s.add_argument("--language")
    for name in ("suggest", "export", "import"):
        sub.add_parser(name).add_argument("value")
    sub.add_parser("stats")
    t = sub.add_parser("tool")
    t.add_argument("name")
    t.add_argument("args", help="JSON")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs one command; its answer is printed and returned."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    docs = documents(spark, a.data)
    tools = Tools(Client(spark, docs, NOW))
    if a.command == "search":
        out = tools.call("web_search", {"query": a.query, "limit": a.limit, "offset": a.offset, "language": a.language})
    elif a.command == "suggest":
        out = tools.call("suggest", {"prefix": a.value})
    elif a.command == "stats":
        out = tools.call("status", {})
    elif a.command == "export":
        maintenance.write_snapshot(docs, a.value)
        out = json.dumps({"exported": docs.count()})
    elif a.command == "import":
        hashed = lambda d: d.withColumn("text_hash", F.sha2("text", 256))
        out = json.dumps({"new": maintenance.imported(hashed(docs), hashed(maintenance.read_snapshot(spark, a.value))).count()})
    else:
        out = tools.call(a.name, json.loads(a.args))
    print(out)
    return out


if __name__ == "__main__":
    main()
