"""Passages, chunks and n-grams of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import jaccard

_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Zㄱ-ㆎ一-鿿])")
_WIDE = re.compile("[一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df　-〿가-힯ᄀ-ᇿ㄰-㆏぀-ヿ฀-๿]+|[A-Za-z0-9]+")
FIRST_WIDE = "฀"


def pack(pieces: list[str], most: int) -> list[list[str]]:
    """Greedy groups of pieces whose lengths, each with a blank, stay within most."""
    groups: list[list[str]] = []
    used = 0
    for p in pieces:
        if not groups or used + len(p) > most:
            groups.append([])
            used = 0
        groups[-1].append(p)
        used += len(p) + 1
    return groups


def split(text: str | None, most: int = 500, least: int = 40) -> list[str]:
    """Paragraphs; short ones join the passage before them (or are lost at the start), long ones break at sentences, else at words."""
    out: list[str] = []
    for part in re.split(r"\n\s*\n", text or ""):
        part = part.strip()
        if len(part) < least:
            if out:
                out[-1] = f"{out[-1]} {part}"
        elif len(part) <= most:
            out.append(part)
        else:
            sentences = [s.strip() for s in _SENTENCE.split(part)]
            alone = len(sentences) <= 1
            groups = [" ".join(g) for g in pack(part.split() if alone else [s for s in sentences if s], most)]
            if not alone and len(groups[-1]) < least and len(out) + len(groups) > 1:
                short = groups.pop()
                (groups if groups else out)[-1] += f" {short}"
            out += groups
    return out


def passages(text: Column, most: int = 500) -> Column:
    """split() of every text; sentences depend on what stands before them, so this is Python, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda t: split(t, most))

    return of(text)


def wide_grams(text: str | None, n: int) -> list[str]:
    """n-grams of runs of CJK, Hangul, kana and Thai; runs shorter than n and ASCII words stay whole."""
    out: list[str] = []
    for run in _WIDE.findall(text or ""):
        if run[0] < FIRST_WIDE or len(run) < n:
            out.append(run)
        else:
            out += [run[i : i + n] for i in range(len(run) - n + 1)]
    return out


def wide_bigrams(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda t: wide_grams(t, 2))

    return of(text)


def chunks(text: Column, size: int) -> Column:
    """Fixed-size slices; an empty text is one empty slice."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(size))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def sentences(docs: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """doc_id, pos, sentence: pieces between full stops, question and exclamation marks of at least `least` characters."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, r"[.!?]+")).alias("pos", "s"))
    return rows.select("doc_id", "pos", F.regexp_replace("s", r"^\s+|\s+$", "").alias("sentence")).filter(F.length("sentence") >= least)


#: Mean similarity from which the summaries of peers agree with one.
LEAST_AGREEMENT = 0.3


def cross_checked(own: Column, peers: Column) -> Column:
    """Mean word similarity of a summary (distinct words) to those of peers; 0 without peers."""
    each = F.transform(peers, lambda p: jaccard(own, p))
    return F.when(F.size(peers) == 0, 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(peers))
