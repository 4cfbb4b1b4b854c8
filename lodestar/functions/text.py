"""Tokenizers. The index, the passages and plain word sets each have their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Characters of a passage token: ASCII letters and digits, Hangul, CJK ideographs and kana.
PASSAGE_TOKEN = r"[a-z0-9ㄱ-ㆎ가-힣一-鿿]+"


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased, accent-folded text."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def index_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '([\\p{{L}}\\p{{N}}]+)', 1)"


def words(text: Column) -> Column:
    r"""Unicode \w+ runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]+)', 1)"


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("(" + PASSAGE_TOKEN + ")"), 1)


def ascii_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '([a-z0-9\\x{{3131}}-\\x{{318E}}\\x{{AC00}}-\\x{{D7A3}}\\x{{4E00}}-\\x{{9FFF}}]+)', 1)"


def chunks_of_space(text: Column) -> Column:
    """split() of the text at white space, without empty pieces."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunks_of_space_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
