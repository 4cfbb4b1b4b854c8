"""What markup and lists of the web hold: feeds, outlines, crawl rules, site maps, images, code, tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alternative texts that say nothing, and the entities that are read, in order.
PLACEHOLDERS = "image photo picture img icon logo banner thumbnail avatar".split()
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def plain(text: Column) -> Column:
    """Text without tags, entities read in a fixed order."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def feed_links(html: Column) -> Column:
    """Addresses, as written, of the feeds that a page links to, in order, once each."""
    tags = _all(html, r"""(?i)(<link\b[^>]*type=["']application/(?:rss|atom)\+xml["'][^>]*>)""")
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href=["']([^"']+)["']""", 1)), lambda h: h != ""))


def outlines(opml: Column) -> Column:
    """(url, label) of the feeds in an outline: the text, else the title; the first of each address."""
    attributes = _all(opml, r"(?is)<outline\b([^>]*?)/?>")
    attribute = lambda a, n: F.trim(F.regexp_extract(a, rf"""(?i)\b{n}=["']([^"']*)["']""", 1))
    has = lambda a, n: F.rlike(a, F.lit(rf"""(?i)\b{n}=["']"""))
    rows = F.transform(attributes, lambda a: F.struct(attribute(a, "xmlUrl").alias("url"), F.when(has(a, "text"), attribute(a, "text")).otherwise(attribute(a, "title")).alias("label")))
    rows = F.filter(rows, lambda x: x["url"] != "")
    return F.filter(rows, lambda x, i: F.array_position(F.transform(rows, lambda y: y["url"]), x["url"]) == i + 1)


def site_maps(robots: Column) -> Column:
    return F.transform(_all(robots, r"(?im)^\s*Sitemap:\s*(\S+)"), lambda x: x)


def crawl_delay(robots: Column) -> Column:
    """Seconds of the first Crawl-delay, null without one."""
    return F.nullif(F.regexp_extract(robots, r"(?im)^\s*Crawl-delay:\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def locations(site_map: Column) -> Column:
    return _all(site_map, r"(?i)<loc>\s*(https?://[^<]+?)\s*</loc>")


def forbidden(robots: Column, path: Column) -> Column:
    """Whether the rules for all agents forbid a path: the first rule whose path it starts with decides, none allows."""
    group = F.concat(F.lit("\n"), F.regexp_extract(F.concat(F.regexp_replace(robots, r"\r", ""), F.lit("\n")), r"(?is)(?:^|\n)\s*user-agent:\s*\*[^\n]*\n(.*?)(?=\n\s*user-agent:|$)", 1))
    rules = F.transform(_all(group, r"(?i)\n\s*((?:dis)?allow:[^\n#]*)"), lambda r: F.struct(F.lower(r).startswith("dis").alias("no"), F.trim(F.regexp_replace(r, r"^[^:]*:", "")).alias("start")))
    rules = F.filter(rules, lambda r: r["start"] != "")
    hits = F.filter(rules, lambda r: path.startswith(r["start"]))
    return F.coalesce(F.get(hits, 0)["no"], F.lit(False))


def image_texts(html: Column) -> Column:
    """Alternative texts of images that say something, at most 50."""
    alts = F.transform(_all(html, r"""(?i)<img\b[^>]*\balt=["']([^"']{3,200})["']"""), lambda x: F.trim(x))
    return F.slice(F.filter(alts, lambda a: ~F.lower(a).isin(PLACEHOLDERS) & (F.length(a) > 3)), 1, 50)


def code_blocks(html: Column) -> Column:
    """(language, code, lines) of code blocks of at least two lines, at most 50."""
    found = _all(html, r"""(?is)(<pre[^>]*>\s*<code[^>]*>.*?</code>\s*</pre>)""")
    rows = F.transform(found, lambda b: F.struct(F.lower(F.regexp_extract(b, r"""(?i)<code[^>]*class=["'](?:language-|lang-|highlight-)?([\w+#.-]+)""", 1)).alias("language"), plain(F.regexp_extract(b, r"(?is)<code[^>]*>(.*?)</code>", 1)).alias("code")))
    rows = F.transform(rows, lambda r: F.struct(r["language"].alias("language"), r["code"].alias("code"), (F.length(r["code"]) - F.length(F.replace(r["code"], F.lit("\n"), F.lit(""))) + 1).alias("lines")))
    return F.slice(F.filter(rows, lambda r: r["lines"] >= 2), 1, 50)


def table_cells(html: Column) -> Column:
    """Rows of cells of every table, at most 20 tables."""
    tables = F.slice(_all(html, r"(?is)<table[^>]*>(.*?)</table>"), 1, 20)
    rows = lambda t: F.transform(_all(t, r"(?is)<tr[^>]*>(.*?)</tr>"), lambda r: F.transform(_all(r, r"(?is)<(?:th|td)[^>]*>(.*?)</(?:th|td)>"), lambda c: F.trim(plain(c))))
    return F.transform(tables, lambda t: F.filter(rows(t), lambda r: F.size(r) > 0))


def csv(cells: Column) -> Column:
    """A table as lines of quoted cells, nothing escaped."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ",")), "\n")


def records(cells: Column) -> Column:
    """A table as maps from the header row's cells; missing cells are empty."""
    head = F.get(cells, 0)
    return F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.array_distinct(head), F.transform(F.array_distinct(head), lambda h: F.coalesce(F.get(r, F.array_position(head, h).cast("int") - 1), F.lit("")))))


def json_ld(html: Column) -> Column:
    """Contents of the JSON-LD scripts of a page that parse."""
    return F.filter(F.transform(_all(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), lambda x: F.trim(x)), lambda j: F.get_json_object(j, "$").isNotNull())
