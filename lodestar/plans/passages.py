"""Passages, answers, fact checks and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import passages as ps
from ..functions import quality, scores, text
from ..operators import segmentation
from ..registry import ORACLES, query
from ..sources.literal import Literal
from ..sources.tables import DOCUMENTS_SQL, documents, table
from .search import RANKED_SQL, ranked_search


@query("split_passages")
def split_passages(spark, sf_dir):
    """doc_id, pos, passage of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ps.passages(F.col("text"))).alias("pos", "passage"))


@query("best_passage")
def best_passage(spark, sf_dir):
    """The passage of each document that fits a fixed query best, the first at a tie; without any, the start of the text."""
    want = text.ascii_tokens(F.lit("the of tion"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode_outer(ps.passages(F.col("text"), 300)).alias("pos", "passage"))
    score = F.coalesce(scores.passage_score(text.ascii_tokens(F.col("passage")), want), F.lit(0.0))
    best = rows.withColumn("score", score).groupBy("doc_id").agg(F.max_by(F.struct("passage", "score", "text"), F.struct("score", -F.coalesce("pos", F.lit(0)))).alias("b"))
    return best.select("doc_id", F.when(F.col("b.score") > 0, F.substring("b.passage", 1, 300)).otherwise(F.substring("b.text", 1, 200)).alias("passage"), F.round("b.score", 6).alias("score"))


_WIDE = Literal("wide", "doc_id long, text string", ((-1, "日本語のテキスト abc x1 한"), (-2, "한국어 문장 and words"), (-3, "字"), (-4, ""), (-5, "ไทย ภาษา")))
_RUNS = "regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}\\x{f900}-\\x{faff}\\x{20000}-\\x{2a6df}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}\\x{3130}-\\x{318f}\\x{3040}-\\x{309f}\\x{30a0}-\\x{30ff}\\x{0e00}-\\x{0e7f}]+|[A-Za-z0-9]+')"


@query(
    "cjk_ngrams",
    f"WITH {_WIDE.sql}, t AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM wide), g AS (SELECT doc_id, flatten(list_transform({_RUNS}, lambda r: CASE WHEN ord(r) < 3584 OR length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) AS g FROM t) SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS pos FROM g",
)
def cjk_ngrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(_WIDE.frame(spark))
    return rows.select("doc_id", F.posexplode(ps.wide_bigrams(F.col("text"))).alias("pos", "gram"))


_WIDE_SHARE = f"len(regexp_extract_all(text, '{quality.CJK}')) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0)::DOUBLE"


@query(
    "query_tokens",
    f"WITH {_WIDE.sql}, t AS (SELECT doc_id, text FROM (SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT * FROM wide)), g AS (SELECT doc_id, CASE WHEN coalesce({_WIDE_SHARE}, 0) >= 0.2 THEN flatten(list_transform({_RUNS}, lambda r: CASE WHEN ord(r) < 3584 OR length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)) ELSE {text.chunks_of_space_sql('text')} END AS g FROM t) SELECT doc_id, array_to_string(g, ' ') AS tokens FROM g",
)
def query_tokens(spark, sf_dir):
    """Tokens of queries: bigrams where enough characters are wide ones, else pieces between blanks. The same stands in for the segmentation of Korean and Chinese."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").unionByName(_WIDE.frame(spark))
    share = F.regexp_count("text", F.lit(quality.CJK)) / F.nullif(F.length(F.regexp_replace("text", r"\s", "")), F.lit(0))
    return rows.select("doc_id", F.array_join(F.when(F.coalesce(share, F.lit(0.0)) >= 0.2, ps.wide_bigrams(F.col("text"))).otherwise(text.chunks_of_space(F.col("text"))), " ").alias("tokens"))


@query("rag_chunks", "SELECT doc_id, (i // 500)::INT AS chunk, substr(text, (i + 1)::BIGINT, 500) AS body FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 500)) AS i FROM documents)")
def rag_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ps.chunks(F.col("text"), 500)).alias("chunk", "body"))


_TERMS = text.chunks_of_space_sql("lower({})")
ANSWER_SQL = f"""{RANKED_SQL}, se AS (SELECT query_id, doc_id, combined, pos, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS answer FROM (SELECT r.query_id, r.doc_id, r.combined, unnest(regexp_split_to_array(d.text, '[.!?]+')) AS s, generate_subscripts(regexp_split_to_array(d.text, '[.!?]+'), 1) - 1 AS pos FROM ranked r JOIN docs d USING (doc_id))),
an AS (SELECT se.*, list_distinct({_TERMS.format('q.query')}) AS q, list_distinct({_TERMS.format('answer')}) AS w FROM se JOIN queries q USING (query_id) WHERE length(answer) >= 10),
ac AS (SELECT query_id, doc_id, pos, answer, round(least(1.0::DOUBLE, len(list_intersect(q, w)) / greatest(1, len(q))::DOUBLE * 0.8::DOUBLE + combined * 0.2::DOUBLE), 6) AS confidence FROM an WHERE len(list_intersect(q, w)) >= 1)"""


@query("extract_answers", f"WITH {ANSWER_SQL} SELECT query_id, rank, doc_id, answer, confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, doc_id, pos) AS rank FROM ac WHERE confidence > 0.2) WHERE rank <= 3")
def extract_answers(spark, sf_dir):
    """The three best sentences of each query's results by shared words and the result's score."""
    from ..sources.tables import queries

    hits = ranked_search(spark, sf_dir).select("query_id", "doc_id", "combined")
    said = ps.sentences(hits.select("doc_id").distinct().join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id"))
    terms = lambda c: F.array_distinct(text.chunks_of_space(F.lower(c)))
    rows = hits.join(said, "doc_id").join(queries(spark, sf_dir), "query_id")
    q = terms(F.col("query"))
    shared = F.size(F.array_intersect(q, terms(F.col("sentence"))))
    sure = F.round(F.least(F.lit(1.0), shared / F.greatest(F.lit(1), F.size(q)) * 0.8 + F.col("combined") * 0.2), 6)
    rows = rows.withColumns({"shared": shared, "confidence": sure}).filter("shared >= 1 and confidence > 0.2")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "doc_id", "pos"))).filter("rank <= 3")
    return best.select("query_id", "rank", "doc_id", F.col("sentence").alias("answer"), "confidence")


@query(
    "fact_check",
    f"""WITH {RANKED_SQL}, o AS (SELECT r.query_id, len(list_intersect(list_distinct({_TERMS.format('q.query')}), list_distinct({_TERMS.format('d.text')}))) / len(list_distinct({_TERMS.format('q.query')}))::DOUBLE AS share FROM ranked r JOIN queries q USING (query_id) JOIN docs d USING (doc_id)),
 c AS (SELECT query_id, count(*) AS total, count(*) FILTER (share >= 0.3) AS supporting FROM o GROUP BY query_id)
 SELECT query_id, supporting, total - supporting AS contradicting, CASE WHEN supporting >= total * 0.5 THEN 'supported' WHEN supporting = 0 THEN 'unverified' ELSE 'disputed' END AS verdict, round(CASE WHEN supporting = 0 THEN 0.1::DOUBLE ELSE supporting / total::DOUBLE END, 3) AS confidence FROM c""",
)
def fact_check(spark, sf_dir):
    """Each query as a claim against its own results."""
    from ..sources.tables import queries

    terms = lambda c: F.array_distinct(text.chunks_of_space(F.lower(c)))
    rows = ranked_search(spark, sf_dir).select("query_id", "doc_id").join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id").join(queries(spark, sf_dir), "query_id")
    q = terms(F.col("query"))
    c = rows.withColumn("share", F.size(F.array_intersect(q, terms(F.col("text")))) / F.size(q)).groupBy("query_id").agg(F.count("*").alias("total"), F.count_if(F.col("share") >= 0.3).alias("supporting"))
    s, t = F.col("supporting"), F.col("total")
    verdict = F.when(s >= t * 0.5, "supported").when(s == 0, "unverified").otherwise("disputed")
    return c.select("query_id", "supporting", (t - s).alias("contradicting"), verdict.alias("verdict"), F.round(F.when(s == 0, 0.1).otherwise(s / t), 3).alias("confidence"))


#: The summary of a document is every other line of it here; its facts are its lines of more than ten characters.
FACTS_SQL = f"""li AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
sc AS (SELECT doc_id, pos, s, text, CASE WHEN regexp_matches(s, '(^|[^\\p{{L}}\\p{{N}}_])\\d+') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(s, '\\d+%') THEN 0.5::DOUBLE ELSE 0 END + least(1.0::DOUBLE, len(list_filter(regexp_extract_all(regexp_replace(s, '^[A-Z][a-z]+', 'x'), '[\\p{{L}}\\p{{N}}_]+', 0), lambda w: regexp_matches(w, '^[A-Z][a-z]+'))) * 0.3::DOUBLE)
 + CASE WHEN len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) BETWEEN 8 AND 30 THEN 0.5::DOUBLE ELSE 0 END AS score FROM li WHERE length(trim(s)) > 10),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, pos) AS rank FROM sc) WHERE rank <= 20 AND score > 0),
fc AS (SELECT doc_id, rank, s AS fact, len(list_intersect(list_distinct({text.words_sql('s')}), {text.words_sql('array_to_string(list_filter(string_split(text, chr(10)), lambda _, i: i % 2 = 1), chr(10))')})) / nullif(len(list_distinct({text.words_sql('s')})), 0)::DOUBLE AS share FROM fa)"""


def summary():
    """Every other line of a text, which stands for its summary."""
    return F.array_join(F.filter(F.split("text", "\n"), lambda _, i: i % 2 == 0), "\n")


def facts(spark, sf_dir):
    """doc_id, rank, fact, share: up to 20 factual lines and how much of their words the summary holds.

    Lines are ranked alone; a document's text meets its best lines once.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "fact")).filter(F.length(F.trim("fact")) > 10)
    ranked = lines.withColumn("score", F.round(quality.fact_score(F.col("fact")), 6)).filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos"))).filter("rank <= 20")
    best = ranked.groupBy("doc_id").agg(F.collect_list(F.struct("rank", "fact")).alias("best"))  # 20 lines at most
    rows = docs.select("doc_id", text.words(summary()).alias("said")).join(best, "doc_id").select("doc_id", "said", F.inline("best")).withColumn("w", F.array_distinct(text.words(F.col("fact"))))
    return rows.select("doc_id", "rank", "fact", (F.size(F.array_intersect("w", "said")) / F.nullif(F.size("w"), F.lit(0))).alias("share"))


@query("key_fact_coverage", f"WITH {FACTS_SQL} SELECT doc_id, count(*) AS facts, count(*) FILTER (share >= 0.4) AS found FROM fc GROUP BY doc_id")
def key_fact_coverage(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("facts"), F.count_if(F.col("share") >= 0.4).alias("found"))


_NUM = "list_distinct(regexp_extract_all({}, '(\\b\\d+(?:\\.\\d+)?\\b)', 1))"


@query(
    "summary_verify",
    f"""WITH {FACTS_SQL}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (share >= 0.4) AS found FROM fc GROUP BY doc_id), d AS (SELECT doc_id, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE found / n::DOUBLE END, 4) AS coverage,
 len(list_filter({_NUM.format("text")}, lambda x: NOT list_contains({_NUM.format("array_to_string(list_filter(string_split(text, chr(10)), lambda _, i: i % 2 = 1), chr(10))")}, x))) > 2 AS contradiction FROM documents LEFT JOIN c USING (doc_id)), p AS (SELECT *, (n < 3 OR coverage >= 0.3) AND NOT contradiction AS passed FROM d)
 SELECT doc_id, coverage, contradiction, CASE WHEN passed THEN 'self_verified' ELSE 'unverified' END AS level, round(CASE WHEN passed THEN 0.5::DOUBLE + 0.2::DOUBLE * coverage ELSE 0 END, 4) AS quality FROM p""",
)
def summary_verify(spark, sf_dir):
    """Verification of each text as a summary would be checked: coverage of key facts, and no more than two numbers that the summary lacks."""
    c = key_fact_coverage(spark, sf_dir)
    n = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(\b\d+(?:\.\d+)?\b)"), 1))
    novel = F.size(F.array_except(n(F.col("text")), n(summary()))) > 2
    rows = table(spark, sf_dir, "documents").select("doc_id", novel.alias("contradiction")).join(c, "doc_id", "left").na.fill(0, ["facts", "found"])
    rows = rows.withColumn("coverage", F.round(F.when(F.col("facts") == 0, 0.0).otherwise(F.col("found") / F.col("facts")), 4))
    passed = ((F.col("facts") < 3) | (F.col("coverage") >= 0.3)) & ~F.col("contradiction")
    return rows.select("doc_id", "coverage", "contradiction", F.when(passed, "self_verified").otherwise("unverified").alias("level"), F.round(F.when(passed, 0.5 + 0.2 * F.col("coverage")).otherwise(0.0), 4).alias("quality"))


_PEERS = {"even": "i % 2 = 0", "first": "i <= 3"}
_LINES = "array_to_string(list_filter(string_split(text, chr(10)), lambda _, i: {}), chr(10))"
_SIMILAR = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE END"


@query(
    "summary_cross_check",
    f"""WITH s AS (SELECT doc_id, {', '.join(f"list_distinct({text.words_sql(_LINES.format(c))}) AS {n}" for n, c in {"own": "i % 2 = 1", **_PEERS}.items())} FROM documents), x AS (SELECT doc_id, ({' + '.join(_SIMILAR.format('own', n) for n in _PEERS)}) / 2 AS avg FROM s),
 v AS (SELECT * FROM ({ORACLES["summary_verify"]}))
 SELECT doc_id, round(avg, 4) AS similarity, CASE WHEN avg >= 0.3 AND level = 'self_verified' THEN 'cross_validated' ELSE level END AS level, round(least(1, quality + CASE WHEN avg >= 0.3 THEN 0.3::DOUBLE * avg ELSE 0 END), 3) AS quality FROM x JOIN v USING (doc_id)""",
)
def summary_cross_check(spark, sf_dir):
    """Summaries against those of two peers, which have the other lines and the first three: agreement lifts the level and the quality."""
    lines = F.split("text", "\n")
    picked = lambda keep: F.array_distinct(text.words(F.array_join(F.filter(lines, keep), "\n")))
    rows = table(spark, sf_dir, "documents").select("doc_id", picked(lambda _, i: i % 2 == 0).alias("own"), F.array(picked(lambda _, i: i % 2 == 1), picked(lambda _, i: i < 3)).alias("peers"))
    checked = ps.cross_checked(F.col("own"), F.col("peers"))
    both = rows.select("doc_id", checked.alias("similarity")).join(summary_verify(spark, sf_dir).select("doc_id", "level", "quality"), "doc_id")
    agrees = F.col("similarity") >= ps.LEAST_AGREEMENT
    level = F.when(agrees & (F.col("level") == "self_verified"), "cross_validated").otherwise(F.col("level"))
    return both.select("doc_id", F.round("similarity", 4).alias("similarity"), level.alias("level"), F.round(F.least(F.lit(1.0), F.col("quality") + F.when(agrees, 0.3 * F.col("similarity")).otherwise(0.0)), 3).alias("quality"))


_SPACED, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国个到说们为子和你地出"


@query("segmented_words")
def segmented_words(spark, sf_dir):
    """Words of all documents written with a sign for each letter and without spaces, by a lexicon learned from them, and how many of the true words were found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("spaced"))
    signs = docs.select("doc_id", "spaced", F.translate(F.regexp_replace("spaced", " ", ""), _SPACED, _SIGNS).alias("text"))
    tokens = segmentation.segmented(signs, segmentation.lexicon(signs)).select(F.col("doc_id").alias("d"), "tokens")
    true = F.array_distinct(F.regexp_extract_all(F.translate("spaced", _SPACED, _SIGNS), F.lit(f"([{_SIGNS}]+)"), 1))
    both = signs.join(tokens, F.col("doc_id") == F.col("d"))
    return both.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"), F.size(F.array_intersect(F.array_distinct("tokens"), true)).alias("n_true"))
