"""The threshold algorithm against all scores: ties, odd rows, blocks of items, depths."""

import math
import random
import re
from collections import Counter

import pytest

from lodestar.llm import lexical

from .helpers import documents, frame, vocabulary

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, term string, uid string"


def _split(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _brute(docs, items, k=10):
    counts = [(d, Counter(_split(t))) for d, t in docs]
    df = Counter(x for _, c in counts for x in c)
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    out = []
    for i, text in items:
        scored = []
        for d, c in counts:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * c[x] // (1000 * c[x] + 8 * (10 + 90 * n * n_docs // total))) for x in set(_split(text)) if x in c)
            if score > 0:
                scored.append((-score, float("-inf") if d is None else d, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def _items(docs, seed=0, n=25):
    r = random.Random(seed)
    v = vocabulary(seed)
    items = [(i, " ".join(r.choice(v) for _ in range(r.randint(1, 12))).title()) for i in range(n)]
    items += [(50 + i, (docs[i][1] or "")[:200]) for i in range(5)]
    return items + [(60, ""), (61, None), (62, "nowhere-to-be-found"), (63, "ab-AB; ab"), (None, items[0][1]), (3, items[4][1]), (0, items[0][1])]


def _got(spark, docs, items, **more):
    q = spark.createDataFrame([(*x, "a", "b", "c") for x in items], ITEMS).repartition(3)
    return sorted(map(tuple, lexical.search(frame(spark, docs), q, **more).collect()), key=repr)


def test_results_match_brute_force(spark):
    docs = documents()
    items = _items(docs)
    assert _got(spark, docs, items) == _brute([x[:2] for x in docs], items)


def test_shallow_rounds_and_blocks_of_items(spark, monkeypatch):
    docs = documents(1)
    items = _items(docs, 1, 8)
    for name, value in {"DEPTH": 2, "GROWTH": 1, "BLOCK": 2, "CELLS": 64, "TERMS": 40, "TEXT": 500}.items():
        monkeypatch.setattr(lexical, name, value)
    assert _got(spark, docs, items, k=3) == _brute([x[:2] for x in docs], items, 3)


def test_reading_stops_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(lexical, "DEPTH", 8)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    plain = (None,) * 10
    docs = [(i, "rare word " * 3 if i < 12 else "word " + f"other{i} " * (i % 50 + 5), *plain) for i in range(600)]
    trace = []
    got = _got(spark, docs, [(1, "rare word")], k=5, trace=trace)
    assert got == _brute([x[:2] for x in docs], [(1, "rare word")], 5)
    assert sum(n for *_, n in trace) < 100


def test_equal_scores_come_by_id(spark):
    docs = [(i, "same text here", *(None,) * 10) for i in range(40, 0, -1)] + [(None, "same text here", *(None,) * 10)] + [(99, f"filler{i}", *(None,) * 10) for i in range(90)]
    got = sorted(_got(spark, docs, [(1, "Text")]), key=lambda r: r[1])
    assert [r[2] for r in got] == [None, *range(1, 10)]


@pytest.mark.parametrize("docs", [[], [(1, None, *(None,) * 10), (2, "", *(None,) * 10)]])
def test_no_documents_or_items(spark, docs):
    assert _got(spark, docs, [(1, "word")]) == [] and _got(spark, documents(), []) == []


def test_words_of_an_equal_hash_are_told_apart():
    import numpy as np
    import pyarrow as pa

    from lodestar.llm._text import utf8, words

    known = lexical.Vocabulary([b"alpha", b"gamma"])
    data, offsets = utf8(pa.array(["Alpha omega GAMMA alphas"]))
    hashes, start, end, _ = words(data, offsets, lower=True, loose=True)
    hashes = hashes.copy()
    hashes[1] = known.hashes[0]  # as if it collided
    found = known.find(data, hashes, start, end)
    assert (found >= 0).tolist() == [True, False, True, False] and len(np.unique(found)) == 3
