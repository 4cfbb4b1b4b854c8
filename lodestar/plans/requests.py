"""Lookups, filters and access rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality, requests
from ..operators import search
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, NOW, documents, queries, table
from .search import BM25_SQL
from .understanding import ASKED_SQL, asked


@query("documents_by_key", f"WITH {DOCUMENTS_SQL} SELECT doc_id, url, title FROM docs WHERE doc_id IN (SELECT user_id FROM events)")
def documents_by_key(spark, sf_dir):
    """Point lookups by doc_id; the users of events stand for the ids asked for."""
    asked_for = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return documents(spark, sf_dir).select("doc_id", "url", "title").join(asked_for, "doc_id", "left_semi")


@query("documents_by_url", f"WITH {DOCUMENTS_SQL}, asked_for AS (SELECT DISTINCT 'https://src' || user_id % 20 || '/' || user_id AS url FROM events UNION SELECT url FROM docs JOIN labels USING (doc_id)) SELECT doc_id, docs.url FROM docs JOIN asked_for USING (url)")
def documents_by_url(spark, sf_dir):
    """Lookups by exact URL."""
    docs = documents(spark, sf_dir).select("doc_id", "url")
    made = table(spark, sf_dir, "events").select(F.concat(F.lit("https://src"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("url"))
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("url")
    return docs.join(made.unionByName(known).distinct(), "url", "left_semi").select("doc_id", "url")


@query("publish_page", f"WITH {DOCUMENTS_SQL} SELECT doc_id, url, title, sha256(text) AS text_hash FROM docs ORDER BY doc_id LIMIT 50 OFFSET 100")
def publish_page(spark, sf_dir):
    """One page of documents in order of doc_id."""
    rows = documents(spark, sf_dir).select("doc_id", "url", "title", F.sha2("text", 256).alias("text_hash"))
    return search.page(rows, ["doc_id"], 50, 100)


@query("export_documents", f"WITH {DOCUMENTS_SQL} SELECT doc_id, url, title, text, lang, sha256(text) AS text_hash, crawled_at FROM docs")
def export_documents(spark, sf_dir):
    """All documents in order, with what an export holds of them."""
    return documents(spark, sf_dir).select("doc_id", "url", "title", "text", "lang", F.sha2("text", 256).alias("text_hash"), "crawled_at").orderBy("doc_id")


def _filtered(spark, sf_dir, **given):
    keep = search.keep(**given)
    hits = search.bm25(documents(spark, sf_dir), queries(spark, sf_dir))
    return hits.join(documents(spark, sf_dir).filter(keep).select("doc_id"), "doc_id", "left_semi").withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score")


def _filtered_sql(condition: str) -> str:
    return f"WITH {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score FROM bm WHERE doc_id IN (SELECT doc_id FROM docs WHERE {condition})"


@query("search_language", _filtered_sql("lang = 'fr'"))
def search_language(spark, sf_dir):
    return _filtered(spark, sf_dir, language="fr")


@query("search_dates", _filtered_sql(f"crawled_at >= {NOW}::DOUBLE - 360000 AND crawled_at <= {NOW}::DOUBLE - 3600"))
def search_dates(spark, sf_dir):
    return _filtered(spark, sf_dir, date_from=NOW - 360000, date_to=NOW - 3600)


@query("search_domains", _filtered_sql("domain IN ('src1', 'src2', 'src3') AND domain NOT IN ('src2')"))
def search_domains(spark, sf_dir):
    return _filtered(spark, sf_dir, include=["src1", "src2", "src3"], exclude=["src2"])


@query("search_page", f"WITH {BM25_SQL} SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank BETWEEN 6 AND 15")
def search_page(spark, sf_dir):
    """Results 6 to 15 of every query: an offset of 5 and a limit of 10."""
    hits = search.bm25(documents(spark, sf_dir), queries(spark, sf_dir)).withColumn("r6", F.round("score", 6))
    return search.top_k(hits, 15, "r6").filter("rank > 5").select("query_id", "doc_id", "rank")


@query("url_domain", "SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("domain"))


CALLS = Literal(
    "calls",
    "id long, args string",
    (
        (1, '{"language": "en", "recency_days": 7, "date_from": 5}'), (2, '{"date_from": 100.5, "date_to": 200}'), (3, '{"recency_days": "x", "date_from": 5}'), (4, '{"recency_days": -1}'),
        (5, '{"domain_allowlist": ["a.org", "b.org"], "include_domains": ["c.org"]}'), (6, '{"domain_allowlist": [], "include_domains": ["c.org"], "exclude_domains": ["d.org"]}'), (7, '{"domain_blocklist": ["e.org"], "exclude_domains": ["d.org"]}'), (8, "{}"), (9, '{"language": ""}'),
    ),
)


def _list(new: str, old: str) -> str:
    one = lambda k: f"CASE WHEN json_array_length(args, '$.{k}') > 0 THEN array_to_string(from_json(json_extract(args, '$.{k}'), '[\"VARCHAR\"]'), ',') END"
    return f"coalesce({one(new)}, {one(old)})"


@query(
    "extract_filters",
    f"""WITH {CALLS.sql.replace("calls AS", "few AS")}, calls AS (SELECT * FROM few UNION ALL SELECT -doc_id - 1, json_object('language', lang, 'recency_days', doc_id % 30 - 5, 'date_from', doc_id, 'include_domains', [source])::VARCHAR FROM documents) SELECT id, nullif(json_extract_string(args, '$.language'), '') AS language, CASE WHEN json_extract_string(args, '$.recency_days') IS NOT NULL
 THEN CASE WHEN TRY_CAST(json_extract_string(args, '$.recency_days') AS INT) > 0 THEN {NOW}::DOUBLE - TRY_CAST(json_extract_string(args, '$.recency_days') AS INT) * 86400.0::DOUBLE END
 ELSE json_extract_string(args, '$.date_from')::DOUBLE END AS date_from, json_extract_string(args, '$.date_to')::DOUBLE AS date_to,
 {_list('domain_allowlist', 'include_domains')} AS include, {_list('domain_blocklist', 'exclude_domains')} AS exclude FROM calls""",
)
def extract_filters(spark, sf_dir):
    """The filters of calls: some of every kind, and one for each document that asks for its language, source and age."""
    asked_for = F.to_json(F.struct(F.col("lang").alias("language"), (F.col("doc_id") % 30 - 5).alias("recency_days"), F.col("doc_id").alias("date_from"), F.array("source").alias("include_domains")))
    calls = CALLS.frame(spark).unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), asked_for.alias("args")))
    return calls.withColumn("f", requests.filters(F.col("args"), NOW)).select("id", "f.*")


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(substr(q, 1, 1000), '["()*{}^:]', ' ', 'g'), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
_PLAIN = r"""substr(trim(regexp_replace(regexp_replace(substr(q, 1, 1000), '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), 1, 100)"""
_RAW = Literal("raw", "id long, q string", ((-101, 'title:"a b" AND (c* OR d)'), (-102, "NOT near"), (-103, '"" ** ()'), (-104, "nearly notable"), (-105, "a^2 {x}"), (-106, "OR")))


@query("sanitize_query", f"WITH {ASKED_SQL}, {_RAW.sql}, every AS (SELECT * FROM asked UNION ALL SELECT * FROM raw) SELECT id, CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} WHEN {_PLAIN} <> '' THEN {_PLAIN} ELSE '' END AS clean FROM every")
def sanitize_query(spark, sf_dir):
    return asked(spark, sf_dir).unionByName(_RAW.frame(spark)).select("id", requests.sanitized(F.col("q")).alias("clean"))


_WEIGHTS = Literal("profiles", "profile string, bm25 double, freshness double, trust double, authority double, title double, url_weight double", tuple((n, *w.values()) for n, w in requests.PROFILES.items()))
_WANTED = Literal("wanted", "id long, name string", ((1, "news"), (2, "tech-docs"), (3, "academic"), (4, "default"), (5, "unknown"), (6, None)))


@query("ranking_profile", f"WITH {_WEIGHTS.sql}, {_WANTED.sql.replace('wanted AS', 'few AS')}, wanted AS (SELECT * FROM few UNION ALL SELECT -doc_id - 1, CASE doc_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'academic' WHEN 2 THEN source END FROM documents) SELECT id, p.* FROM wanted JOIN profiles p ON p.profile = CASE WHEN name IN (SELECT profile FROM profiles) THEN name ELSE 'default' END")
def ranking_profile(spark, sf_dir):
    """The weights of a named profile, those of the default one for any other name; documents ask for one by their number or source."""
    of = F.when(F.col("doc_id") % 4 == 0, "news").when(F.col("doc_id") % 4 == 1, "academic").when(F.col("doc_id") % 4 == 2, F.col("source"))
    wanted = _WANTED.frame(spark).unionByName(table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("id"), of.alias("name")))
    p = F.broadcast(_WEIGHTS.frame(spark))
    name = F.when(F.col("name").isin(*requests.PROFILES), F.col("name")).otherwise("default")
    return wanted.withColumn("profile", name).drop("name").join(p, "profile").select("id", *p.columns)


_LOCKED = Literal("locked", "doc_id long, text string", ((-1, "Please SUBSCRIBE to Continue reading"), (-2, "Sign in to read this"), (-3, "free account"), (-4, None)))


@query("paywall", f"WITH {_LOCKED.sql}, every AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM locked) SELECT doc_id, {' OR '.join(f'contains(lower(text), {chr(39)}{s}{chr(39)})' for s in requests.PAYWALL)} AS paywall FROM every")
def paywall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_LOCKED.frame(spark))
    return rows.select("doc_id", requests.paywalled(F.col("text")).alias("paywall"))


_CJK_TEXTS = Literal("cjk", "doc_id long, text string", ((-1, "한국어 문장 abc"), (-2, "日本語のテキスト"), (-3, "plain latin text with 字"), (-4, "")))
_RATIO = f"len(regexp_extract_all(text, '{quality.CJK}', 0)) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0)::DOUBLE"


@query("tokenizer_choice", f"WITH {_CJK_TEXTS.sql}, every AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM cjk) SELECT doc_id, CASE WHEN coalesce({_RATIO}, 0) >= 0.2 THEN 'trigram' ELSE 'unicode61' END AS tokenizer FROM every")
def tokenizer_choice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_CJK_TEXTS.frame(spark))
    ratio = F.regexp_count("text", F.lit(quality.CJK)) / F.nullif(F.length(F.regexp_replace("text", r"\s", "")), F.lit(0))
    return rows.select("doc_id", F.when(F.coalesce(ratio, F.lit(0.0)) >= 0.2, "trigram").otherwise("unicode61").alias("tokenizer"))


_USES = Literal("uses", "id long, tool string, role string, ip string", ((1, "analytics", "reader", "10.0.0.1"), (2, "analytics", "admin", "10.0.0.2"), (3, "search", "crawler", "10.0.0.3"), (4, "other", "nobody", "10.0.0.1"), (5, "search", "nobody", "10.0.0.9"), (6, "crawl_url", None, "10.0.0.2"), (7, "fetch_page", "crawler", "10.0.0.4")))
_TOOLS = Literal("tool_roles", "tool string, role string", tuple((t, r) for t, roles in requests.TOOL_ROLES.items() for r in roles))
_LISTED = Literal("listed", "ip string, list string", (("10.0.0.1", "allow"), ("10.0.0.2", "allow"), ("10.0.0.3", "allow"), ("10.0.0.2", "block"), ("10.0.0.4", "block")))


@query(
    "access",
    f"""WITH {_USES.sql.replace("uses AS", "few AS")}, {_TOOLS.sql}, {_LISTED.sql}, uses AS (SELECT * FROM few UNION ALL SELECT -event_id - 1, ['search', 'fetch_page', 'crawl_url', 'analytics', 'other'][event_id % 5 + 1], ['admin', 'reader', 'crawler', NULL][user_id % 4 + 1], '10.0.0.' || user_id % 6 FROM events) SELECT id, role IS NULL OR tool NOT IN (SELECT tool FROM tool_roles) OR EXISTS (SELECT 1 FROM tool_roles t WHERE t.tool = u.tool AND t.role = u.role) AS role_ok,
 NOT EXISTS (SELECT 1 FROM listed l WHERE l.ip = u.ip AND list = 'block') AND (NOT EXISTS (SELECT 1 FROM listed WHERE list = 'allow') OR EXISTS (SELECT 1 FROM listed l WHERE l.ip = u.ip AND list = 'allow')) AS ip_ok FROM uses u""",
)
def access(spark, sf_dir):
    """Whether a call's role may use its tool, and whether its address may call: blocked ones never, others if listed or none is. Every event is a call, its user's number tells role and address."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    calls = table(spark, sf_dir, "events").select((-F.col("event_id") - 1).alias("id"), pick(["search", "fetch_page", "crawl_url", "analytics", "other"], F.col("event_id") % 5).alias("tool"), pick(["admin", "reader", "crawler", None], F.col("user_id") % 4).alias("role"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 6).cast("string")).alias("ip"))
    listed = _LISTED.frame(spark)
    marks = listed.groupBy("ip").agg(F.bool_or(F.col("list") == "block").alias("blocked"), F.bool_or(F.col("list") == "allow").alias("allowed"))
    none = listed.agg((F.count_if(F.col("list") == "allow") == 0).alias("all"))
    rows = _USES.frame(spark).unionByName(calls).join(F.broadcast(marks), "ip", "left").crossJoin(F.broadcast(none))  # one row
    ok = ~F.coalesce("blocked", F.lit(False)) & (F.col("all") | F.coalesce("allowed", F.lit(False)))
    return rows.select("id", requests.may_use(F.col("tool"), F.col("role")).alias("role_ok"), ok.alias("ip_ok"))


_SETTINGS = Literal("settings", "name string, value string", (("listen_port", "0"), ("listen_port", "8080"), ("politeness_delay", "75.5"), ("log_level", "INFO"), ("log_level", "loud"), ("other", "x"), ("cpu_nice", "20"), ("cpu_nice", "text"), ("default_format", "json")))
_BOUNDS = Literal("bounds", "name string, lo double, hi double", tuple((k, float(a), float(b)) for k, (a, b) in requests.SETTING_BOUNDS.items()))
_CHOICES = Literal("choices", "name string, choice string", tuple((k, c) for k, v in requests.SETTING_CHOICES.items() for c in v))


@query(
    "settings_checked",
    f"""WITH {_SETTINGS.sql.replace("settings AS", "few AS")}, settings AS (SELECT * FROM few UNION ALL SELECT ['listen_port', 'cpu_nice', 'log_level', 'other'][event_id % 4 + 1], CASE event_id % 4 WHEN 2 THEN event_type ELSE (event_id % 70000)::VARCHAR END FROM events), {_BOUNDS.sql}, {_CHOICES.sql} SELECT s.name, value AS given, CASE WHEN b.name IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST(value AS DOUBLE) BETWEEN lo AND hi THEN value ELSE greatest(lo, least(hi, TRY_CAST(value AS DOUBLE)))::VARCHAR END
 WHEN s.name IN (SELECT name FROM choices) AND NOT EXISTS (SELECT 1 FROM choices c WHERE c.name = s.name AND choice = lower(value)) THEN NULL ELSE value END AS value FROM settings s LEFT JOIN bounds b USING (name)""",
)
def settings_checked(spark, sf_dir):
    """Settings held to their bounds and choices: some of every kind, and one an event."""
    name = F.get(F.array(*map(F.lit, ["listen_port", "cpu_nice", "log_level", "other"])), (F.col("event_id") % 4).cast("int"))
    value = F.when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise((F.col("event_id") % 70000).cast("string"))
    given = _SETTINGS.frame(spark).unionByName(table(spark, sf_dir, "events").select(name.alias("name"), value.alias("value")))
    return given.select("name", F.col("value").alias("given"), requests.setting_value(F.col("name"), F.col("value")).alias("value"))


@query("takedown_filter", f"WITH {DOCUMENTS_SQL}, gone AS (SELECT DISTINCT url FROM docs JOIN labels USING (doc_id) WHERE toxic = 1) SELECT doc_id, url FROM docs WHERE url NOT IN (SELECT url FROM gone)")
def takedown_filter(spark, sf_dir):
    """Documents whose exact URL no takedown names; toxic ones stand for those taken down."""
    docs = documents(spark, sf_dir).select("doc_id", "url")
    gone = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("url").distinct()
    return docs.join(gone, "url", "left_anti").select("doc_id", "url")
