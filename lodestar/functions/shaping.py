"""How results are shown, explained and packed for readers and models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scores

# The notes of an explanation and the bounds from which they hold.
NOTES = [
    ("bm25", ">", 0.8, "Strong keyword match"),
    ("freshness", ">", 0.8, "Recently crawled"),
    ("freshness", "<", 0.2, "Stale content — may need recrawl"),
    ("trust", ">", 0.8, "High-trust peer"),
    ("authority", ">", 0.5, "High domain authority"),
    ("title", ">", 0.5, "Query matches title"),
    ("url", ">", 0.3, "Query matches URL path"),
]


def explanation(signals: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The weighted parts of a combined score, the largest of them and notes."""
    weighted = {n: F.round(c * (weights or scores.WEIGHTS)[n], 6) for n, c in signals.items()}
    parts = F.array(*[F.struct(w.alias("w"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, w) in enumerate(weighted.items())])
    notes = [F.when(signals[n] > at if op == ">" else signals[n] < at, F.lit(text)) for n, op, at, text in NOTES]
    return {**{f"w_{n}": w for n, w in weighted.items()}, "dominant": F.array_max(parts)["n"], "notes": F.array_join(F.array_compact(F.array(*notes)), "; ")}


def _rounded(number: Column, digits: int) -> Column:
    """A score as doubles round it: what counts is the product with the power of ten, not the digits as written."""
    return F.round(number * 10.0**digits) / 10.0**digits


def result_json(url: Column, title: Column, snippet: Column, score: Column, parts: dict[str, Column], most: int = 200) -> Column:
    """One result as JSON; scores are rounded to 4, snippets cut."""
    inner = F.struct(*[_rounded(c, 4).alias(n) for n, c in parts.items()])
    return F.to_json(F.struct(url.alias("url"), title.alias("title"), F.regexp_extract(url, "://([^/]*)", 1).alias("domain"), F.substring(snippet, 1, most).alias("snippet"), _rounded(score, 4).alias("score"), inner.alias("scores")))


def answer_json(results: Column, elapsed: Column, source: Column, local: Column | None = None, remote: Column | None = None) -> Column:
    """A whole answer as JSON: how many results, how long it took, where they are from, and the results (structs) in order; local and remote numbers for a distributed one."""
    counts = [] if local is None else [local.alias("local_count"), remote.alias("remote_count")]
    return F.to_json(F.struct(F.size(results).alias("total"), F.round(elapsed, 1).alias("elapsed_ms"), source.alias("source"), *counts, results.alias("results")))


def ranked_entry(url: Column, title: Column, snippet: Column, score: Column, signals: dict[str, Column], crawled_at: Column, peer: Column, most: int = 200) -> Column:
    """A ranked result of an answer, with the signals that ranked it."""
    names = {"title": "title_match", "url": "url_path"}
    inner = F.struct(*[_rounded(c, 4).alias(names.get(n, n)) for n, c in signals.items()])
    return F.struct(url.alias("url"), title.alias("title"), F.regexp_extract(url, "://([^/]*)", 1).alias("domain"), F.substring(snippet, 1, most).alias("snippet"), _rounded(score, 4).alias("score"), inner.alias("scores"), crawled_at.alias("crawled_at"), peer.alias("peer_id"))


def merged_entry(url: Column, title: Column, snippet: Column, source: Column, fts: Column, vector: Column, rrf: Column, most: int = 200) -> Column:
    """A fused result of an answer, with the scores that it has."""
    scores = F.struct(_rounded(fts, 4).alias("bm25"), _rounded(vector, 4).alias("vector"), _rounded(rrf, 4).alias("rrf"))
    return F.struct(url.alias("url"), title.alias("title"), F.regexp_extract(url, "://([^/]*)", 1).alias("domain"), F.substring(snippet, 1, most).alias("snippet"), source.alias("source"), scores.alias("scores"))


def work_bits(key: Column, nonce: Column) -> Column:
    """Leading zero bits of the SHA-256 of a key (hex digits of its bytes) and a nonce of eight bytes, highest first."""
    return leading_zero_bits(F.sha2(F.unhex(F.concat(key, F.lpad(F.hex(nonce.cast("long")), 16, "0"))), 256))


def result_text(rank: Column, title: Column, url: Column, snippet: Column, score: Column, parts: dict[str, Column], most: int = 200) -> Column:
    """One result as lines of text."""
    listed = F.concat_ws(", ", *[F.format_string(f"{n}=%.3f", _rounded(c, 3)) for n, c in parts.items()])
    return F.format_string("[%d] %s\n    Source: %s\n    Domain: %s\n    Score: %.4f (%s)\n    %s\n", rank, title, url, F.regexp_extract(url, "://([^/]*)", 1), _rounded(score, 4), listed, F.substring(snippet, 1, most))


def _fixed(number: Column, pattern: str) -> Column:
    """A number by a pattern; what lies halfway goes to the even digit, as the number is and not as it is written."""
    return F.call_function("format_number", number.cast("double"), F.lit(pattern))


def fetched_text(title: Column, url: Column, text: Column, crawled_at: Column, now: float, ttl: float = 604800.0) -> Column:
    """A cached page with what a reader should know of it."""
    age = F.lit(now) - crawled_at
    head = F.format_string("# %s\nSource: %s\nDomain: %s\nis_cached: true\ncache_age: %s days\ncrawl_timestamp: %s\n", title, url, F.regexp_extract(url, "://([^/]*)", 1), _fixed(age / 86400, "0.0"), _fixed(crawled_at, "0"))
    return F.concat(head, F.when(age > ttl, "stale_warning: true (cached content older than TTL)\n").otherwise(""), F.lit("\n"), text)


def truncated(text: Column, most: int) -> Column:
    """The longest start of a text that has at most so many UTF-8 bytes."""
    head = F.substring(text.cast("binary"), 1, most)
    # A cut character ends in a first byte and too few that follow; without them the rest decodes.
    hexed = F.hex(head)
    cut = F.regexp_replace(hexed, "(C[0-9A-F]|D[0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$", "")
    # Only whole bytes may match: the pattern is sought at an even place.
    even = F.length(cut) % 2 == 0
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(F.when(even, cut).otherwise(hexed)), "UTF-8"))


def tokens_estimated(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def sentences(text: Column, least: int = 10) -> Column:
    """(sentence, offset) of sentences longer than so many characters; they end before a capital or an ideograph."""
    marked = F.regexp_replace(text, r"(?<=[.!?])(\s+)(?=[A-Z\u4e00-\u9fff])", "$1\x02")
    pieces = F.split(marked, "\x02")
    starts = F.aggregate(pieces, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    # The starts are one more; what stands beside the last is null and goes.
    rows = F.zip_with(pieces, starts, lambda x, s: F.struct(F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("sentence"), s.alias("offset")))
    return F.filter(rows, lambda r: F.length(r["sentence"]) > least)


def order_of(response: Column, n: Column) -> Column:
    """The order of n results in a model's answer: the first list of numbers in it, from 1, unknown and repeated ones skipped, missing ones appended; null without a list."""
    listed = F.regexp_extract(response, r"\[([\d\s,]*)\]", 1)
    given = F.transform(F.filter(F.split(listed, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))
    every = F.sequence(F.lit(1), n)
    kept = F.array_distinct(F.filter(given, lambda x: (x >= 1) & (x <= n)))
    return F.when(F.rlike(response, F.lit(r"\[[\d\s,]*\]")), F.concat(kept, F.array_except(every, kept)))


def adaptive_timeout(latency: Column, base: float = 2000.0) -> Column:
    """Milliseconds to wait for a peer of an average latency: in proportion to it, from 500 to 5000; the base for an unknown one."""
    return F.when(latency.isNull() | (latency == 0), F.lit(base)).otherwise(F.greatest(F.lit(500.0), F.least(F.lit(base) * latency / 200.0, F.lit(5000.0))))


def leading_zero_bits(hex_digest: Column) -> Column:
    zeros = F.length(hex_digest) - F.length(F.ltrim(hex_digest, F.lit("0")))
    first = F.conv(F.substr(hex_digest, zeros + 1, F.lit(1)), 16, 10).cast("int")
    return (zeros * 4 + F.when(first >= 8, 0).when(first >= 4, 1).when(first >= 2, 2).when(first >= 1, 3).otherwise(0)).cast("int")


def subnet(ip: Column) -> Column:
    """/24 of an IPv4 address, /48 of a full or shortened IPv6 one."""
    four = F.concat(F.regexp_extract(ip, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24"))
    head = F.split(F.split_part(ip, F.lit("::"), F.lit(1)), ":")
    tail = F.filter(F.split(F.when(F.contains(ip, F.lit("::")), F.split_part(ip, F.lit("::"), F.lit(2))).otherwise(""), ":"), lambda x: x != "")
    heads = F.filter(head, lambda x: x != "")
    groups = F.concat(heads, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(heads) - F.size(tail))), tail)
    short = F.transform(F.slice(groups, 1, 3), lambda x: F.coalesce(F.nullif(F.ltrim(F.lower(x), F.lit("0")), F.lit("")), F.lit("0")))
    # Trailing zero groups are left out, as in the shortest form.
    six = F.concat(F.regexp_replace(F.array_join(short, ":"), "(:0)+$", ""), F.lit("::/48"))
    return F.when(F.contains(ip, F.lit(":")), F.when(F.array_join(short, ":") == "0:0:0", "::/48").otherwise(six)).otherwise(four)


def merged_parts(text_score: Column, vector_score: Column, fused: Column) -> Column:
    """The scores of a result of two searches as text; a search that missed it is left out."""
    parts = F.array_compact(F.array(F.when(text_score.isNotNull(), F.format_string("BM25=%.3f", F.round(text_score, 3))), F.when(vector_score.isNotNull(), F.format_string("sim=%.3f", F.round(vector_score, 3)))))
    return F.concat(F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("N/A"), F.format_string(" (RRF=%.4f)", F.round(fused, 4)))


def answer_text(results: Column, elapsed_ms: Column, source: Column, local: Column | None = None, remote: Column | None = None) -> Column:
    """A whole answer as text: a head of what was found where, then the results; one line without any."""
    head = F.format_string("Found %d results (%.0fms, %s)", F.size(results), elapsed_ms, source)
    if local is not None:
        head = F.concat(head, F.format_string("\n  Local: %d, Remote: %d\n", local, remote))
    else:
        head = F.concat(head, F.lit(":\n"))
    return F.when(F.size(results) == 0, "No results found.").otherwise(F.concat(head, F.lit("\n"), F.array_join(results, "\n")))


def hits(text: Column, terms: Column) -> Column:
    """(pos, term) of the words of a text that are among terms, without case and marks, in order."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "").alias("term")))
    return F.filter(plain, lambda x: F.array_contains(terms, x["term"]))


def shown_window(text: Column, terms: Column, start: Column, size: int) -> Column:
    """`size` words from one on, terms marked, dots where the text goes on."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    part = F.slice(words, start + 1, size)
    marked = F.transform(part, lambda w: F.when(F.array_contains(terms, F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(F.size(words) > start + size, "...").otherwise(""))


def window_snippet(text: Column, terms: Column, size: int = 40, before: int = 5) -> Column:
    """The words around the first one that holds a term, terms marked, dots where the text goes on; the start of a text without any."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    # The case and the marks around a word do not matter.
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    first = F.coalesce(F.array_min(F.transform(F.filter(F.transform(plain, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(terms, x["w"])), lambda x: x["i"])), F.lit(0))
    start = F.greatest(first - before, F.lit(0))
    shown = F.zip_with(F.slice(words, start + 1, size), F.slice(plain, start + 1, size), lambda w, x: F.when(F.array_contains(terms, x), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(F.size(words) > start + size, "...").otherwise(""))
