"""What a query asks for: intent, dates, domains, languages, other words for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and word lists whose results must agree with earlier engines.
INTENT3 = {
    "navigational": [r"(?i)\b(login|signin|sign\s+in|homepage|official)\b", r"(?i)\b(go\s+to|open|visit|navigate)\b", r"^[a-zA-Z0-9.-]+\.(com|org|net|io|dev|edu|gov)$"],
    "transactional": [r"(?i)\b(download|install|buy|purchase|subscribe|pricing)\b", r"(?i)\b(free|trial|demo|signup|register)\b"],
}
INTENT6 = {
    "how_to": [r"\bhow\s+(?:to|do|can|does)\b", r"\btutorial\b", r"\bguide\b", r"\bstep.by.step\b"],
    "definition": [r"\bwhat\s+is\b", r"\bdefin(?:e|ition)\b", r"\bmeaning\s+of\b"],
    "comparison": [r"\bvs\.?\b", r"\bversus\b", r"\bcompare\b", r"\bdifference\s+between\b", r"\bor\b.*\bwhich\b"],
    "error_debug": [r"\berror\b", r"\bexception\b", r"\btraceback\b", r"\bfailed?\b", r"\bnot\s+work", r"\bbug\b"],
    "api_reference": [r"\bapi\b", r"\bfunction\b.*\bsignature\b", r"\bmethod\b.*\bparameter", r"\breturn\s+type\b"],
    "navigational": [r"\blogin\b", r"\bofficial\b", r"\bhomepage\b", r"\bdownload\b", r"\.(?:com|org|io|dev)$"],
}
TEMPORAL = [(r"\b(?:today|tonight)\b", 1), (r"\byesterday\b", 2), (r"\bthis\s+week\b", 7), (r"\blast\s+week\b", 14), (r"\bthis\s+month\b", 30), (r"\blast\s+month\b", 60), (r"\bthis\s+year\b", 365), (r"\blast\s+year\b", 730)]
DATES = [(r"\brecent(?:ly)?\b", 7), (r"\blast\s+(\d+)\s+days?\b", None), (r"\blast\s+week\b", 7), (r"\blast\s+month\b", 30), (r"\blast\s+year\b", 365), (r"\btoday\b", 1), (r"\byesterday\b", 2), (r"\bthis\s+week\b", 7), (r"\bthis\s+month\b", 30), (r"\bthis\s+year\b", 365)]
DOMAIN = r"\bsite:(\S+)\b|\bfrom\s+([\w.-]+\.(?:com|org|net|io|dev|edu|gov))\b"
LANGUAGES = {"english": "en", "korean": "ko", "japanese": "ja", "chinese": "zh", "spanish": "es", "german": "de", "french": "fr", "portuguese": "pt", "russian": "ru", "arabic": "ar", "hindi": "hi", "thai": "th", "turkish": "tr", "vietnamese": "vi", "indonesian": "id", "malay": "ms"}
SYNONYMS = {
    "error": ["exception", "bug", "issue", "fault"],
    "bug": ["error", "defect", "issue"],
    "api": ["endpoint", "interface", "service"],
    "database": ["db", "datastore", "storage"],
    "db": ["database", "datastore"],
    "function": ["method", "procedure", "routine"],
    "method": ["function", "procedure"],
    "server": ["backend", "service", "host"],
    "client": ["frontend", "consumer", "user"],
    "config": ["configuration", "settings", "options"],
    "configuration": ["config", "settings"],
    "test": ["spec", "unittest", "testing"],
    "deploy": ["release", "ship", "publish"],
    "install": ["setup", "configure"],
    "search": ["query", "find", "lookup"],
    "async": ["asynchronous", "concurrent"],
    "sync": ["synchronous", "blocking"],
    "cache": ["buffer", "memoize"],
    "auth": ["authentication", "authorization", "login"],
    "docs": ["documentation", "manual", "guide"],
    "performance": ["speed", "latency", "throughput"],
}
DOMAIN_CATEGORIES = {"tech-docs": ["docs.", "documentation", "readthedocs", "devdocs", "developer.", "api."], "news": ["news", "bbc", "reuters", "cnn", "nytimes"], "academic": ["arxiv", "scholar", "academic", "ieee", "springer", "pubmed"]}
#: Keywords by language and their English terms, in order; the engine takes any such table.
TRANSLATIONS = {
    "ko": {"설치": "install", "사용법": "usage", "오류": "error", "설정": "configuration", "검색": "search", "파일": "file", "서버": "server", "데이터베이스": "database", "네트워크": "network", "보안": "security", "성능": "performance", "테스트": "test", "배포": "deploy", "업데이트": "update", "삭제": "delete"},
    "ja": {"インストール": "install", "エラー": "error", "設定": "configuration", "検索": "search", "ファイル": "file", "サーバー": "server", "データベース": "database", "ネットワーク": "network", "セキュリティ": "security"},
    "zh": {"安装": "install", "错误": "error", "配置": "configuration", "搜索": "search", "文件": "file", "服务器": "server", "数据库": "database", "网络": "network", "安全": "security", "性能": "performance"},
    "ar": {"تثبيت": "install", "خطأ": "error", "إعدادات": "configuration", "بحث": "search", "ملف": "file", "خادم": "server", "قاعدة بيانات": "database", "شبكة": "network", "أمان": "security"},
    "hi": {"स्थापित": "install", "त्रुटि": "error", "सेटिंग": "configuration", "खोज": "search", "फ़ाइल": "file", "सर्वर": "server", "डेटाबेस": "database", "नेटवर्क": "network", "सुरक्षा": "security"},
    "th": {"ติดตั้ง": "install", "ข้อผิดพลาด": "error", "การตั้งค่า": "configuration", "ค้นหา": "search", "ไฟล์": "file", "เซิร์ฟเวอร์": "server", "ฐานข้อมูล": "database", "เครือข่าย": "network"},
    "tr": {"kurulum": "install", "hata": "error", "ayarlar": "configuration", "arama": "search", "dosya": "file", "sunucu": "server", "veritabanı": "database", "ağ": "network", "güvenlik": "security"},
    "vi": {"cài đặt": "install", "lỗi": "error", "cấu hình": "configuration", "tìm kiếm": "search", "tập tin": "file", "máy chủ": "server", "cơ sở dữ liệu": "database", "mạng": "network", "bảo mật": "security"},
    "id": {"instalasi": "install", "kesalahan": "error", "pengaturan": "configuration", "pencarian": "search", "berkas": "file", "server": "server", "basis data": "database", "jaringan": "network", "keamanan": "security"},
}
#: English words without weight for matching. For other languages frequent_words finds such words in the corpus.
STOP_WORDS_EN = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can "
    "this that these those it its i me my we our you your he she him her they them their what which who whom how when where why if then so no not as up about into through during before after above below "
    "between same than too very just also more most other some such only own each every all any both few many much over under again further once here there out off"
).split()


def frequent_words(docs: DataFrame, least: float = 0.5, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, word, share: the words that at least a share of a language's documents hold, which say little about any of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words.alias("w"))
    n = rows.groupBy("lang").agg(F.count("*").alias("n"))
    found = rows.select("lang", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("held"))
    return found.join(F.broadcast(n), "lang").select("lang", "word", (F.col("held") / F.col("n")).alias("share")).filter(F.col("share") >= least)  # one row a language


def intent3(q: Column) -> Column:
    """navigational before transactional, else informational."""
    out = F.lit("informational")
    for name in reversed(list(INTENT3)):
        hit = F.lit(False)
        for p in INTENT3[name]:
            hit = hit | F.rlike(q, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def intent6(q: Column) -> tuple[Column, Column, Column]:
    """First matching intent; the intent with the most matching patterns, the first at a tie; its confidence."""
    counts = {name: sum((F.rlike(q, F.lit("(?i)" + p)).cast("int") for p in patterns), F.lit(0)) for name, patterns in INTENT6.items()}
    first, best = F.lit("informational"), F.lit("informational")
    top = F.greatest(*counts.values())
    for name in reversed(list(counts)):
        first = F.when(counts[name] > 0, name).otherwise(first)
        best = F.when((counts[name] > 0) & (counts[name] == top), name).otherwise(best)
    return first, best, F.when(top == 0, 0.3).otherwise(F.round(F.least(F.lit(1.0), top / 3.0), 2))


def temporal_days(q: Column, year: int) -> Column:
    """Days of recency that the first matching pattern asks for, or null."""
    tests = [F.when(F.rlike(q, F.lit("(?i)" + p)), F.lit(d)) for p, d in TEMPORAL]
    days = F.regexp_extract(q, r"(?i)\blast\s+(\d+)\s+days?\b", 1)
    tests += [F.when(days != "", days.cast("int")), F.when(F.rlike(q, F.lit(r"(?i)\b(?:latest|newest|recent)\b")), F.lit(7))]
    named = F.regexp_extract(q, r"\b(20[2-3]\d)\b", 1)
    tests.append(F.when(named != "", F.greatest(F.lit(1), (F.lit(year) - named.cast("int") + 1) * 365)))
    return F.coalesce(*tests)


def parse(q: Column, now: float) -> dict[str, Column]:
    """cleaned_query, date_from, include_domains and language.

    Every date pattern is removed once, in order, and the last that matches decides.
    """
    text, start = q, F.lit(None).cast("double")
    for pattern, days in DATES:
        p = F.lit("(?i)" + pattern)
        n = F.regexp_extract(text, "(?i)" + pattern, 1).cast("int") if days is None else F.lit(days)
        start = F.when(F.rlike(text, p), F.lit(now) - n * 86400.0).otherwise(start)
        text = _cut(text, pattern)
    domains = F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?i)(" + DOMAIN + ")"), 1), lambda m: F.coalesce(F.nullif(F.regexp_extract(m, "(?i)site:(.*)", 1), F.lit("")), F.regexp_extract(m, r"(?i)from\s+(.*)", 1))), lambda d: d != "")
    text = F.regexp_replace(text, "(?i)" + DOMAIN, "")
    spoken = r"\bin\s+(" + "|".join(LANGUAGES) + r")\b"
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    language = F.element_at(codes, F.lower(F.regexp_extract(text, "(?i)" + spoken, 1)))
    return {"cleaned_query": F.trim(F.regexp_replace(_cut(text, spoken), r"\s+", " ")), "date_from": start, "include_domains": domains, "language": language}


def _cut(text: Column, pattern: str) -> Column:
    """The text without the first match."""
    return F.regexp_replace(text, "(?is)^(.*?)" + pattern, "$1")


def expansions(q: Column, most: int = 3) -> Column:
    """Up to `most` synonyms of each token that the query lacks, twice as many in all, in order."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v[:most]]))])
    tokens = F.filter(F.split(F.lower(q), r"\s+"), lambda w: w != "")
    found = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))
    return F.slice(F.array_except(found, tokens), 1, 2 * most)


def domain_category(url: Column) -> Column:
    out = F.lit("default")
    for name in reversed(list(DOMAIN_CATEGORIES)):
        hit = F.lit(False)
        for part in DOMAIN_CATEGORIES[name]:
            hit = hit | F.contains(F.lower(url), F.lit(part))
        out = F.when(hit, name).otherwise(out)
    return out
