"""What callers ask for: search filters, clean queries, access rules, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the ranking profiles, texts of paywalls, roles of tools, bounds and choices of settings.
PROFILES = {
    "default": {"bm25": 0.40, "freshness": 0.15, "trust": 0.10, "authority": 0.15, "title": 0.15, "url": 0.05},
    "tech-docs": {"bm25": 0.50, "freshness": 0.05, "trust": 0.10, "authority": 0.15, "title": 0.20, "url": 0.10},
    "news": {"bm25": 0.25, "freshness": 0.45, "trust": 0.15, "authority": 0.10, "title": 0.05, "url": 0.05},
    "academic": {"bm25": 0.35, "freshness": 0.05, "trust": 0.20, "authority": 0.25, "title": 0.10, "url": 0.05},
}
PAYWALL = ["subscribe to continue", "sign in to read", "create a free account", "this content is for subscribers"]
ROLES = ["admin", "reader", "crawler"]
TOOL_ROLES = {
    "search": ["admin", "reader", "crawler"],
    "search_local": ["admin", "reader", "crawler"],
    "fetch_page": ["admin", "reader"],
    "crawl_url": ["admin", "crawler"],
    "network_stats": ["admin", "reader"],
    "batch_search": ["admin", "reader"],
    "suggest": ["admin", "reader", "crawler"],
    "register_webhook": ["admin"],
    "analytics": ["admin"],
}
SETTING_BOUNDS = {
    "listen_port": (1, 65535), "max_concurrent": (1, 100), "politeness_delay": (0.1, 60.0), "urls_per_hour": (1, 10000), "pending_per_domain": (1, 1000),
    "upload_limit_mbps": (0.1, 1000.0), "download_limit_mbps": (0.1, 1000.0), "replication_factor": (1, 10), "max_doc_size_kb": (1, 10240), "compression_level": (1, 22),
    "max_cache_size_mb": (10, 100000), "max_index_size_gb": (1, 10000), "cache_ttl_days": (1, 365), "cpu_cores_limit": (1, 256), "cpu_nice": (0, 19),
    "memory_limit_mb": (64, 1048576), "bgm_volume": (0, 100), "refresh_interval": (0.2, 5.0), "max_response_chars": (0, 10000000),
}
SETTING_CHOICES = {"log_level": ["debug", "info", "warning", "error", "critical"], "disk_io_priority": ["low", "normal", "high"], "fts_tokenizer": ["unicode61", "ascii", "porter", "trigram"], "default_format": ["text", "json"]}


def filters(args: Column, now: float) -> Column:
    """The filters in a call's JSON arguments; recency_days wins over date_from, allow and block lists over include and exclude."""
    get = lambda k: F.get_json_object(args, f"$.{k}")
    names = lambda k: F.from_json(get(k), "array<string>")
    given = lambda k: F.when(F.size(names(k)) > 0, names(k))
    recent = get("recency_days").try_cast("int")
    date_from = F.when(get("recency_days").isNotNull(), F.when(recent > 0, F.lit(now) - recent * 86400.0)).otherwise(get("date_from").cast("double"))
    return F.struct(
        F.nullif(get("language"), F.lit("")).alias("language"),
        date_from.alias("date_from"),
        get("date_to").cast("double").alias("date_to"),
        F.array_join(F.coalesce(given("domain_allowlist"), given("include_domains")), ",").alias("include"),
        F.array_join(F.coalesce(given("domain_blocklist"), given("exclude_domains")), ",").alias("exclude"),
    )


def sanitized(query: Column, empty: str = "") -> Column:
    """A query without the index's own syntax; only letters and digits where nothing else is left, or the word for none."""
    q = F.substring(query, 1, 1000)
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r'["()*{}^:]', " "), r"(?i)\b(AND|OR|NOT|NEAR)\b", " "), r"\s+", " "))
    plain = F.substring(F.trim(F.regexp_replace(F.regexp_replace(q, r"[^a-zA-Z0-9\s]", " "), r"\s+", " ")), 1, 100)
    return F.when(clean != "", clean).when(plain != "", plain).otherwise(F.lit(empty))


def paywalled(text: Column) -> Column:
    found = F.lit(False)
    for sign in PAYWALL:
        found = found | F.contains(F.lower(text), F.lit(sign))
    return found


def may_use(tool: Column, role: Column) -> Column:
    """Whether a role may use a tool: without a role or for an unlisted tool, all may; an unknown role may nothing else."""
    allowed = F.create_map(*[x for t, roles in TOOL_ROLES.items() for x in (F.lit(t), F.array(*map(F.lit, roles)))])[tool]
    return role.isNull() | allowed.isNull() | F.array_contains(allowed, role)


def setting_bounds() -> Column:
    """Bounds by name of a setting."""
    return F.create_map(*[x for k, (lo, hi) in SETTING_BOUNDS.items() for x in (F.lit(k), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])


def setting_value(name: Column, value: Column) -> Column:
    """A number within its setting's bounds, a choice that its setting knows, or null for one that it does not; other settings as they are."""
    number, bounds = value.try_cast("double"), setting_bounds()[name]
    choices = F.create_map(*[x for k, v in SETTING_CHOICES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[name]
    inside = F.greatest(bounds["lo"], F.least(bounds["hi"], number)).cast("string")
    return F.when(bounds.isNotNull() & number.isNotNull(), F.when(number == inside.cast("double"), value).otherwise(inside)).when(choices.isNotNull() & ~F.array_contains(choices, F.lower(value)), None).otherwise(value)
