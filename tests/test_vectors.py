"""Exact vector search by pivots against all scores."""

import numpy as np
import pytest

from lodestar.operators import search, vectors


def _rows(seed, n=600, dim=6, spread=0.05):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, dim))
    rows = [(i, (centers[i % 12] + r.normal(size=dim) * spread).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(25)]  # ties
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.1]), (2002, [-1.0, -2.0])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * dim), (3003, [float("nan")] + [1.0] * (dim - 1)), (3004, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim)]
    return rows, odd


def _brute(rows, probes, k, least):
    out = []
    for q, p in probes:
        scored = []
        for i, v in rows:
            if i != q and len(v) == len(p):
                a, b = np.array(p), np.array(v)
                s = round(float((a / np.sqrt(a @ a)) @ (b / np.sqrt(b @ b))), 4)
                if s >= least:
                    scored.append((-s, i))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _got(spark, rows, probes, k, least=0.0, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dim string").repartition(5)
    asked = spark.createDataFrame([(q, p, "x") for q, p in probes], "query_id long, probe array<double>, kth string")
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 4), r["rank"]) for r in vectors.nearest(df, asked, k, least, **more).collect())


@pytest.mark.parametrize("k, least", [(1, 0.0), (10, -1.0), (40, 0.9)])
def test_nearest_are_those_of_all_scores(spark, monkeypatch, k, least):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows, odd = _rows(k)
    probes = rows[::50] + [rows[7], (2000, [1.0, 2.0]), (-1, [5.0, 0.1]), (-2, [1.0]), *odd[:5]]
    assert _got(spark, rows + odd, probes, k, least) == _brute(rows, [p for p in probes if p[0] < 3000], k, least)


def test_clusters_spare_most_comparisons(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "HELD", 5)
    rows, _ = _rows(9, n=2000)
    read = []
    probes = rows[::100]
    assert _got(spark, rows, probes, 5, read=read) == _brute(rows, probes, 5, 0.0)
    assert read[0] < 0.3 * read[1]


def test_no_vectors_or_probes(spark):
    rows, _ = _rows(1, n=20)
    assert _got(spark, [], rows[:2], 3) == [] and _got(spark, rows, [], 3) == []


def test_pairs_of_a_long_turn(spark):
    rows = spark.createDataFrame([([f"t{i:04}" for i in range(1500)],), (["t0001", "t0002", "only"],), (["t0002", "t0001"],), ([],), (None,)], "w array<string>")
    assert sorted(map(tuple, search.shared_pairs(rows, "w").collect())) == [("t0001", "t0002", 3)]
