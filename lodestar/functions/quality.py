"""Grades, safety rules and text-quality measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word list and patterns whose results must agree with earlier engines.
TOXIC = "hate kill violence racist sexist porn gambling drugs scam phishing malware".split()
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{3000}-\x{303F}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{0E00}-\x{0E7F}]"
SPA_ROOT = r"""(?i)<div\s+id=["'](?:root|app|__next|__nuxt|__vue)["']"""
SPA_DATA = r"(?i)__NEXT_DATA__|__NUXT__|window\.__INITIAL_STATE__|window\.webpackJsonp|window\.__remixContext"
NEEDS_JS = r"(?i)enable\s+javascript|javascript\s+(?:is\s+)?required|(?:need|requires?)\s+javascript|must\s+enable\s+javascript|activate\s+javascript|turn\s+on\s+javascript"
PRIVATE_NETS = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
LOCAL_HOST = r"^(localhost|.*\.local|.*\.internal|.*\.intranet)$"
MOST_URL = 4096


def ladder(value: Column, steps: list[tuple[float, str]], rest: str, least: bool = True) -> Column:
    """The name of the first step that value reaches (or stays below)."""
    out = F.lit(rest)
    for bound, name in reversed(steps):
        out = F.when(value >= bound if least else value <= bound, name).otherwise(out)
    return out


def toxicity(words: Column, n_words: Column) -> Column:
    """Ten times the share of toxic words, at most 1; words are the lower-cased word tokens, n_words the pieces between spaces."""
    hits = F.size(F.filter(words, lambda w: w.isin(TOXIC)))
    return F.when(n_words == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / n_words * 10))


def visible(html: Column) -> Column:
    """Text without scripts, styles and tags, blanks squeezed."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"<[^>]+>", ""), F.lit(" \n\t\r")), r"\s+", " ")


def js_score(html: Column) -> Column:
    """How likely a page needs JavaScript: mount points, data blobs, noscript notes, little text, an empty body."""
    ratio = F.length(visible(html)) / F.length(html)
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    notes = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<noscript[^>]*>(.*?)</noscript>"), 1), "\n")
    when = lambda c, w: F.when(c, w).otherwise(0.0)
    score = when(F.rlike(html, F.lit(SPA_ROOT)), 0.25) + when(F.rlike(html, F.lit(SPA_DATA)), 0.20) + when(F.rlike(notes, F.lit(NEEDS_JS)), 0.30)
    return F.round(F.least(F.lit(1.0), score + F.when(ratio < 0.02, 0.35).when(ratio < 0.05, 0.15).otherwise(0.0) + when(F.length(visible(body)) < 50, 0.30)), 2)


def ip_number(host: Column) -> Column:
    """The number of a dotted quad, else null."""
    p = F.split(host, r"\.")
    quad = F.rlike(host, F.lit(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"))
    return F.when(quad, F.aggregate(F.transform(p, lambda x: F.try_to_number(x, F.lit("999")).cast("long")), F.lit(0).cast("long"), lambda s, x: s * 256 + x))


def _quad(a: str) -> int:
    out = 0
    for x in a.split("."):
        out = out * 256 + int(x)
    return out


NETS = [(_quad(a), _quad(a) + (1 << (32 - n)) - 1) for a, n in PRIVATE_NETS]


def url_safe(url: Column) -> Column:
    """http or https, of bounded length, with a public host."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), r":\d*$", ""))
    number = ip_number(host)
    private = F.lit(False)
    for lo, hi in NETS:
        private = private | F.coalesce(number.between(lo, hi), F.lit(False))
    return (F.length(url) <= MOST_URL) & F.rlike(url, F.lit("^(?i)https?://")) & (host != "") & ~F.rlike(host, F.lit(LOCAL_HOST)) & ~private


def fact_score(s: Column) -> Column:
    """Numbers, percentages, capitalised words after the start, and a medium length make a sentence factual."""
    caps = F.regexp_count(F.regexp_replace(s, r"^[A-Z][a-z]+", "x"), F.lit(r"\b[A-Z][a-z]+"))
    n = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return F.when(F.rlike(s, F.lit(r"\b\d+")), 1.0).otherwise(0.0) + F.when(F.rlike(s, F.lit(r"\d+%")), 0.5).otherwise(0.0) + F.least(F.lit(1.0), caps * 0.3) + F.when(n.between(8, 30), 0.5).otherwise(0.0)
