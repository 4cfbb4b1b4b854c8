"""Query understanding over all conversation turns and a few literal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions import understanding as u
from ..registry import query
from ..sources.literal import Literal
from ..sources.tables import NOW, table

ASKED = [
    "how to install docker", "what is rust", "python vs java which or", "official login page", "download free trial", "docs.python.org", "recent news from bbc.com in english",
    "last 14 days error in korean", "yesterday api method with parameter", "best guide of this year 2023", "today last week bug failed exception", "site:example.org config server performance", "async cache auth test", "tonight or which one", "latest docs last month", "kurulum hata ve sunucu", "",
]
ASKED_SQL = "asked AS (SELECT conv_id * 1000 + turn AS id, text AS q FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}::BIGINT, '{q}')" for i, q in enumerate(ASKED)) + ") v(id, q))"


def asked(spark, sf_dir):
    """id, q: every conversation turn as a query, and literal queries under negative ids."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("q"))
    return turns.unionByName(spark.createDataFrame([(-i - 1, q) for i, q in enumerate(ASKED)], "id long, q string"))


def _like(pattern: str) -> str:
    return "regexp_matches(q, '" + pattern.replace("'", "''") + "')"


@query("intent3", f"WITH {ASKED_SQL} SELECT id, CASE WHEN {' OR '.join(map(_like, u.INTENT3['navigational']))} THEN 'navigational' WHEN {' OR '.join(map(_like, u.INTENT3['transactional']))} THEN 'transactional' ELSE 'informational' END AS intent FROM asked")
def intent3(spark, sf_dir):
    return asked(spark, sf_dir).select("id", u.intent3(F.col("q")).alias("intent"))


_COUNTS = ", ".join("(" + " + ".join(_like("(?i)" + p) + "::INT" for p in ps) + f") AS {n}" for n, ps in u.INTENT6.items())
_TOP = f"greatest({', '.join(u.INTENT6)})"


@query(
    "intent6",
    f"""WITH {ASKED_SQL}, c AS (SELECT id, {_COUNTS} FROM asked) SELECT id, CASE {' '.join(f"WHEN {n} > 0 THEN '{n}'" for n in u.INTENT6)} ELSE 'informational' END AS intent,
 CASE WHEN {_TOP} = 0 THEN 'informational' {' '.join(f"WHEN {n} = {_TOP} THEN '{n}'" for n in u.INTENT6)} END AS best, CASE WHEN {_TOP} = 0 THEN 0.3::DOUBLE ELSE round(least(1.0::DOUBLE, {_TOP} / 3.0::DOUBLE), 2) END AS confidence FROM c""",
)
def intent6(spark, sf_dir):
    first, best, sure = u.intent6(F.col("q"))
    return asked(spark, sf_dir).select("id", first.alias("intent"), best.alias("best"), sure.alias("confidence"))


@query(
    "temporal_hint",
    f"WITH {ASKED_SQL} SELECT id, CASE "
    + " ".join(f"WHEN {_like('(?i)' + p)} THEN {d}" for p, d in u.TEMPORAL)
    + r""" WHEN regexp_matches(q, '(?i)\blast\s+(\d+)\s+days?\b') THEN regexp_extract(q, '(?i)\blast\s+(\d+)\s+days?\b', 1)::INT WHEN regexp_matches(q, '(?i)\b(?:latest|newest|recent)\b') THEN 7
 WHEN regexp_matches(q, '\b20[2-3]\d\b') THEN greatest(1, (2024 - regexp_extract(q, '\b(20[2-3]\d)\b', 1)::INT + 1) * 365) END AS days FROM asked""",
)
def temporal_hint(spark, sf_dir):
    return asked(spark, sf_dir).select("id", u.temporal_days(F.col("q"), 2024).alias("days"))


def _parse_sql() -> str:
    out, last = ["p0 AS (SELECT id, q AS t, NULL::DOUBLE AS date_from FROM asked)"], "p0"
    for i, (p, d) in enumerate(u.DATES):
        pat = "(?i)" + p
        n = f"regexp_extract(t, '{pat}', 1)::INT" if d is None else str(d)
        out.append(f"p{i + 1} AS (SELECT id, regexp_replace(t, '{pat}', '') AS t, CASE WHEN regexp_matches(t, '{pat}') THEN {NOW}::DOUBLE - {n} * 86400.0::DOUBLE ELSE date_from END AS date_from FROM {last})")
        last = f"p{i + 1}"
    spoken = r"(?i)\bin\s+(" + "|".join(u.LANGUAGES) + r")\b"
    names = " ".join(f"WHEN '{w}' THEN '{c}'" for w, c in u.LANGUAGES.items())
    domain = u.DOMAIN.replace("'", "''")
    out.append(f"dom AS (SELECT id, date_from, list_transform(regexp_extract_all(t, '(?i){domain}', 0), lambda m: regexp_replace(m, '(?i)^(site:|from\\s+)', '')) AS include_domains, regexp_replace(t, '(?i){domain}', '', 'g') AS t FROM {last})")
    return ", ".join(out) + f" SELECT id, trim(regexp_replace(regexp_replace(t, '{spoken}', ''), '\\s+', ' ', 'g')) AS cleaned_query, date_from, array_to_string(include_domains, ',') AS include_domains, CASE lower(regexp_extract(t, '{spoken}', 1)) {names} END AS language FROM dom"


@query("nl_query_parse", f"WITH {ASKED_SQL}, {_parse_sql()}")
def nl_query_parse(spark, sf_dir):
    parsed = u.parse(F.col("q"), NOW)
    parsed["include_domains"] = F.array_join(parsed["include_domains"], ",")
    return asked(spark, sf_dir).select("id", *[c.alias(n) for n, c in parsed.items()])


_SYN = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v[:3])}]" for k, v in u.SYNONYMS.items()) + "}"


@query(
    "expand_query",
    f"""WITH {ASKED_SQL}, t AS (SELECT id, {text.chunks_of_space_sql('lower(q)')} AS w FROM asked), f AS (SELECT id, w, flatten(list_transform(w, lambda x: coalesce({_SYN}[x], []))) AS e FROM t),
 g AS (SELECT id, list_filter(e, lambda x, i: NOT list_contains(w, x) AND list_position(e, x) = i) AS e FROM f) SELECT id, array_to_string(list_slice(e, 1, 6), ',') AS expansions FROM g""",
)
def expand_query(spark, sf_dir):
    return asked(spark, sf_dir).select("id", F.array_join(u.expansions(F.col("q")), ",").alias("expansions"))


_STOP = ", ".join(f"'{w}'" for w in u.STOP_WORDS_EN)


@query("remove_stop_words", f"WITH {ASKED_SQL} SELECT id, array_to_string(list_filter({text.chunks_of_space_sql('q')}, lambda w: NOT list_contains([{_STOP}], lower(w))), ' ') AS kept FROM asked")
def remove_stop_words(spark, sf_dir):
    stop = F.array(*[F.lit(w) for w in u.STOP_WORDS_EN])
    return asked(spark, sf_dir).select("id", F.array_join(F.filter(text.chunks_of_space(F.col("q")), lambda w: ~F.array_contains(stop, F.lower(w))), " ").alias("kept"))


@query("stop_words_by_language", f"WITH t AS (SELECT doc_id, lang, unnest(list_distinct({text.words_sql('text')})) AS word FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, word, round(count(*) / any_value(n)::DOUBLE, 6) AS share FROM t JOIN n USING (lang) GROUP BY lang, word HAVING count(*) / any_value(n)::DOUBLE >= 0.5")
def stop_words_by_language(spark, sf_dir):
    """Stop words of every language of the corpus, by rule."""
    return u.frequent_words(table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 6))


_TERMS = [(lang, i, term, english) for lang, terms in u.TRANSLATIONS.items() for i, (term, english) in enumerate(terms.items())]


_FOREIGN = Literal("foreign_asked", "id long, q string", ((-201, "서버 설치 오류"), (-202, "服务器安装错误"), (-203, "cài đặt máy chủ"), (-204, "データベースの設定エラー"), (-205, "خطأ خادم"), (-206, "keamanan basis data"), (-207, "การตั้งค่า ไฟล์")))


@query("translate_terms", f"WITH {ASKED_SQL}, {_FOREIGN.sql}, every AS (SELECT * FROM asked UNION ALL SELECT * FROM foreign_asked), terms AS (SELECT * FROM (VALUES {', '.join(map(str, _TERMS))}) v(lang, pos, term, english)) SELECT id, lang, string_agg(english, ',' ORDER BY pos) AS english FROM every JOIN terms ON contains(q, term) GROUP BY id, lang")
def translate_terms(spark, sf_dir):
    """English terms of the keywords of a language that a query contains, in the table's order."""
    terms = {lang: [(t, e) for k, _, t, e in _TERMS if k == lang] for lang in u.TRANSLATIONS}
    rows = asked(spark, sf_dir).unionByName(_FOREIGN.frame(spark))
    found = F.array(*[F.struct(F.lit(k).alias("lang"), F.array_join(F.array_compact(F.array(*[F.when(F.contains(F.col("q"), F.lit(t)), e) for t, e in v])), ",").alias("english")) for k, v in terms.items()])
    return rows.select("id", F.inline(found)).filter("english <> ''")


@query(
    "did_you_mean",
    rf"""WITH {ASKED_SQL}, vocab AS (SELECT term AS word FROM (SELECT unnest({text.index_tokens_sql("text")}) AS term FROM benchmark) GROUP BY term HAVING count(*) >= 3),
 t AS (SELECT DISTINCT unnest({text.chunks_of_space_sql("lower(q)")}) AS token FROM asked WHERE id < 0), c AS (SELECT token, word, levenshtein(token, word) AS d FROM t, vocab WHERE token NOT IN (SELECT word FROM vocab) AND abs(length(token) - length(word)) <= 2)
 SELECT token, word, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, word) AS r FROM c WHERE d BETWEEN 1 AND 2) WHERE r = 1""",
)
def did_you_mean(spark, sf_dir):
    """The nearest vocabulary word within two edits of each unknown token of the literal queries.

    Words within two edits differ in length by at most two, and so meet by length: no cross join.
    """
    tokens = F.explode(text.index_tokens(F.col("text"))).alias("word")
    vocab = table(spark, sf_dir, "benchmark").select(tokens).groupBy("word").count().filter("count >= 3").select("word")
    asked_ = spark.createDataFrame([(q,) for q in ASKED], "q string").select(F.explode(text.chunks_of_space(F.lower("q"))).alias("token")).distinct()
    unknown = asked_.join(vocab, F.col("token") == F.col("word"), "left_anti").select("token", F.explode(F.sequence(F.length("token") - 2, F.length("token") + 2)).alias("size"))
    near = unknown.join(vocab.withColumn("size", F.length("word")), "size").withColumn("distance", F.levenshtein("token", "word")).filter("distance between 1 and 2")
    return near.groupBy("token").agg(F.min(F.struct("distance", "word")).alias("m")).select("token", "m.word", "m.distance")


_CATEGORY = " ".join(f"WHEN {' OR '.join(f'contains(lower(url), {p!r})' for p in ps)} THEN '{n}'" for n, ps in u.DOMAIN_CATEGORIES.items())


@query("domain_category", f"SELECT page_id, CASE {_CATEGORY} ELSE 'default' END AS category FROM pages")
def domain_category(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.domain_category(F.col("url")).alias("category"))
