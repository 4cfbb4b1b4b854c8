"""What pages and texts contain: metadata, citations, entities, languages, feeds, records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pages as markup

# Citation patterns in their order of precedence, technology names, and common words of languages.
CITATIONS = [
    ("doi", r"\b(10\.\d{4,}/[^\s]+)\b"),
    ("isbn", r"\b((?:978|979)[-\s]?\d[-\s]?\d{2,7}[-\s]?\d{1,7}[-\s]?\d)\b"),
    ("arxiv", r"(?i)\b((?:arXiv:)?\d{4}\.\d{4,5}(?:v\d+)?)\b"),
    ("rfc", r"(?i)\b(RFC\s*\d{1,5})\b"),
    ("url", r"""(https?://[^\s<>"')\]]+)"""),
]
TECH = "Python JavaScript TypeScript Rust Go Java Ruby Swift Kotlin React Vue Angular Django Flask FastAPI Docker Kubernetes PostgreSQL MySQL Redis MongoDB SQLite AWS Azure GCP Linux macOS Windows GitHub GitLab npm pip cargo".split()
NAMES = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
# Languages that their script tells have no words here.
COMMON_WORDS = {
    "en": "the is are was were have has been will would could should can this that with from they which not but for and".split(),
    "es": "el la de en los las un una por con es que del para como más fue pero".split(),
    "de": "der die das und ist von den mit ein eine auf dem für nicht auch sich als noch".split(),
    "fr": "le la les des de un une du est et en que qui dans pour pas sur par avec".split(),
    "pt": "de da do em os as um uma que por com para foi mais não como mas seu sua".split(),
    "ru": "и в на с не что он как это по но из от за для все был она так его".split(),
    "tr": "bir ve bu da de için ile olan gibi daha çok var ama olarak sonra kadar".split(),
    "vi": "của và là có trong được cho không này với các những một để từ đã".split(),
    "id": "dan di yang untuk dengan ini itu dari pada adalah atau tidak juga akan ke oleh".split(),
}
# Character ranges of the scripts, and language and confidence of those that tell it.
SCRIPTS = {"CJK": "\u4e00-\u9fff\u3400-\u4dbf\u3001-\u303f", "Hangul": "\uac00-\ud7af\u1100-\u11ff\u3130-\u318f", "Kana": "\u3040-\u30ff", "Cyrillic": "\u0400-\u04ff", "Arabic": "\u0600-\u06ff", "Devanagari": "\u0900-\u097f", "Thai": "\u0e00-\u0e7f"}
BY_SCRIPT = {"Hangul": ("ko", 0.95), "Kana": ("ja", 0.95), "Arabic": ("ar", 0.90), "Devanagari": ("hi", 0.90), "Thai": ("th", 0.95)}
TYPE_ORDER = {name: i for i, (name, _) in enumerate(CITATIONS)}


def citations(docs: DataFrame) -> DataFrame:
    """doc_id, type, identifier: every identifier once a document, under the first type that finds it."""
    found = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("type"), F.regexp_extract_all("text", F.lit(p), 1).alias("ids")) for i, (n, p) in enumerate(CITATIONS)])
    rows = docs.select("doc_id", F.inline(found)).select("doc_id", "i", "type", F.explode("ids").alias("identifier"))
    return rows.groupBy("doc_id", "identifier").agg(F.min(F.struct("i", "type")).alias("m")).select("doc_id", "m.type", "identifier")


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, type, name, n: technology names, and runs of capitalised words shorter than 30 characters."""
    tech = F.transform(F.regexp_extract_all("text", F.lit(r"\b(" + "|".join(TECH) + r")\b"), 1), lambda x: F.struct(F.lit("TECH").alias("type"), x.alias("name")))
    names = F.transform(F.filter(F.regexp_extract_all("text", F.lit(NAMES), 1), lambda x: F.length(x) < 30), lambda x: F.struct(F.lit("NAME").alias("type"), x.alias("name")))
    return docs.select("doc_id", F.inline(F.concat(tech, names))).groupBy("doc_id", "type", "name").agg(F.count("*").alias("n"))


def language(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with language, confidence and script.

    The most frequent script decides where it tells the language, with kana for Japanese;
    else common words do, the first language at a tie. Short texts are English without confidence.
    """
    t = F.col(text)
    letters = {name: F.regexp_count(t, F.lit(f"[{r}]")) for name, r in SCRIPTS.items()} | {"Latin": F.regexp_count(t, F.lit(f"[\\p{{L}}&&[^{''.join(SCRIPTS.values())}]]"))}
    # Most texts hold Latin letters alone, which one search tells.
    plain = ~F.rlike(t, F.lit(f"[{''.join(SCRIPTS.values())}]"))
    out = docs.withColumn("_n", F.when(plain, F.lit(None)).otherwise(F.array(*letters.values())))
    names = F.array(*map(F.lit, letters))
    some = F.when(F.array_max("_n") > 0, F.element_at(names, F.array_position("_n", F.array_max("_n")).cast("int"))).otherwise("Unknown")
    out = out.withColumn("script", F.when(F.length(t) < 20, "Unknown").when(plain, F.when(F.rlike(t, F.lit(r"\p{L}")), "Latin").otherwise("Unknown")).otherwise(some))
    out = out.withColumn("_w", F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    out = out.withColumns({"_d": F.array_distinct("_w"), "_least": F.least(F.size("_w"), F.lit(50))})
    lists = F.array(*[F.array(*map(F.lit, v)) for v in COMMON_WORDS.values()])
    out = out.withColumn("_h", F.transform(lists, lambda v: F.size(F.array_intersect(F.col("_d"), v))))
    out = out.withColumn("_top", F.array_max("_h"))
    best = F.element_at(F.array(*map(F.lit, COMMON_WORDS)), F.array_position("_h", F.col("_top")).cast("int"))
    lang, sure = F.when(F.length(t) < 20, "en"), F.when(F.length(t) < 20, 0.0)
    for name, (code, confidence) in BY_SCRIPT.items():
        lang, sure = lang.when(F.col("script") == name, code), sure.when(F.col("script") == name, confidence)
    lang = lang.when(F.col("script") == "CJK", F.when(F.rlike(t, F.lit("[" + SCRIPTS["Kana"] + "]")), "ja").otherwise("zh")).when(F.size("_w") == 0, "en").otherwise(best)
    sure = sure.when(F.col("script") == "CJK", 0.85).when(F.size("_w") == 0, 0.1).otherwise(F.round(F.least(F.col("_top") / F.col("_least") * 5, F.lit(0.95)), 3))
    return out.withColumns({"language": lang, "confidence": sure}).drop("_n", "_w", "_d", "_least", "_h", "_top")


def meta_tags(html: Column) -> dict[str, Column]:
    """title, lang, description, canonical and og_title of a page; missing ones are empty."""
    both = lambda a, b: F.coalesce(F.nullif(F.regexp_extract(html, a, 1), F.lit("")), F.regexp_extract(html, b, 1))
    return {
        "title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "lang": F.substring(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\slang=["']([^"']*)""", 1)), 1, 2),
        "description": both(r"""(?i)<meta\s+name=["']description["']\s+content=["']([^"']*)""", r"""(?i)<meta\s+content=["']([^"']*)["']\s+name=["']description["']"""),
        "canonical": both(r"""(?i)<link\s+rel=["']canonical["']\s+href=["']([^"']*)""", r"""(?i)<link\s+href=["']([^"']*)["']\s+rel=["']canonical["']"""),
        "og_title": both(r"""(?i)<meta\s+property=["']og:title["']\s+content=["']([^"']*)""", r"""(?i)<meta\s+content=["']([^"']*)["']\s+property=["']og:title["']"""),
    }


#: Characters below which a page says nothing, and confidence above which a guessed language counts.
LEAST_TEXT, SURE = 50, 0.3


def page_contents(pages: DataFrame) -> DataFrame:
    """page_id, url, title, language, text, raw_hash, text_hash and alts of every page that says at least LEAST_TEXT characters.

    The language is that of the page's root element, else the detected one where it is
    sure enough, else null. Null and empty pages say nothing; repeated rows have a result each.
    """

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                found = [markup.parse(x) for x in part.column(2).to_pylist()]
                columns = [pa.array([f[c] for f in found], pa.list_(pa.string()) if c == "alts" else pa.string()) for c in ("title", "lang", "text", "alts")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *columns], ["page_id", "url", "raw_hash", "title", "lang", "text", "alts"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2("html", 256).alias("raw_hash"))
    parsed = rows.mapInArrow(run, "page_id long, url string, raw_hash string, title string, lang string, text string, alts array<string>").filter(F.length("text") >= LEAST_TEXT)
    guessed = F.when(F.col("confidence") > SURE, F.col("language"))
    told = language(parsed).withColumn("language", F.coalesce(F.nullif("lang", F.lit("")), guessed))
    return told.select("page_id", "url", "title", "language", "text", "raw_hash", F.sha2("text", 256).alias("text_hash"), "alts")


def feed_items(feeds: DataFrame) -> DataFrame:
    """url, title, link, summary of the items or entries of feeds (url, xml); items without a link go, summaries end at 500."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"<[^>]+>", ""))
    item = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry)[\s>](.*?)</(?:item|entry)>"), 1)
    rows = feeds.select("url", F.posexplode(item).alias("pos", "i"))
    tag = lambda t: plain(F.regexp_extract("i", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1))
    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("i", r"""(?i)<link[^>]*href=["']([^"']*)""", 1), F.lit("")))
    summary = F.coalesce(F.nullif(tag("description"), F.lit("")), tag("summary"))
    return rows.select("url", "pos", tag("title").alias("title"), link.alias("link"), F.substring(summary, 1, 500).alias("summary")).filter("link is not null")


def warc_records(pages: DataFrame, at: str) -> DataFrame:
    """page_id, record: one WARC response record a page; the id is derived from the hash of address and time."""
    h = F.sha2(F.concat_ws(":", "url", F.lit(at)), 256)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {at}\r\nWARC-Target-URI: "), "url", F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(head, "html", F.lit("\r\n\r\n")).alias("record"))


def wet_records(files: DataFrame, least: int = 50, most: int = 102400) -> DataFrame:
    """target, body of the conversion records of WET files (content); bodies are cut at `most`, those below `least` go."""
    rows = files.select(F.explode(F.split("content", r"WARC/1\.0\r?\n")).alias("r")).filter(F.rlike("r", F.lit(r"(?i)WARC-Type:\s*conversion")))
    body = F.trim(F.regexp_extract("r", r"(?s)^.*?\r?\n\r?\n(.*)$", 1), F.lit(" \r\n\t"))
    rows = rows.select(F.regexp_extract("r", r"(?i)WARC-Target-URI:\s*(\S+)", 1).alias("target"), F.substring(body, 1, most).alias("body"))
    return rows.filter((F.col("target") != "") & (F.length("body") >= least))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_r = 1").drop("_r")
