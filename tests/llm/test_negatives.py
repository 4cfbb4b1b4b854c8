"""Hard negatives against all scores: windows, ties, odd rows, small slices and groups."""

import math

import numpy as np
import pytest

from lodestar.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, score string, v string"


def _rows(seed=0, n=700, dim=9):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, dim))
    rows = []
    for i in range(n):
        x = (centers[i % 5] + r.normal(size=dim) * 0.7) * r.choice([0.2, 1.0, 1.0, 3.0])
        rows.append((i, x.tolist(), int(r.integers(0, 4))))
    rows += [(n + 100 + i, rows[100][1], i % 3) for i in range(30)]  # ties at an anchor
    rows += [(1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1002, [1.0, 2.4], 2), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    rows += [(1200, [0.0] * dim, 1), (1300, [-x for x in rows[0][1]], 2)]
    odd = [(1400, None, 1), (1500, [1.0] * dim, None), (1600, [math.nan] + [9.0] * (dim - 1), 1), (1700, [math.inf] + [9.0] * (dim - 1), 1), (1800, [None] + [9.0] * (dim - 1), 1), (None, [9.0] * dim, 1)]
    return rows, odd


def _brute(rows, share=80):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows]
    out = []
    for a, (i, v, lab) in enumerate(good):
        if i % 100:
            continue
        scored = [(-max(negatives.LOW, min(negatives.HIGH, sum(x * y for x, y in zip(v, w, strict=True)))), j, other) for b, (j, w, other) in enumerate(good) if b != a and len(w) == len(v)]
        positives = sorted((s, j) for s, j, other in scored if other == lab)[:5]
        for s, j in positives:
            fit = sorted((t, k) for t, k, other in scored if other != lab and share * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)


def _got(df):
    return sorted(map(tuple, df.collect()))


def test_all_windows_match_brute_force(spark):
    rows, odd = _rows()
    want = _brute(rows)
    assert len(want) > 50 and _got(negatives.hard_negatives(_frame(spark, rows + odd))) == want


def test_small_buckets_slices_and_groups(spark, monkeypatch):
    rows, odd = _rows(1, 400)
    for name, value in {"BUCKET": 16, "SLICE": 40, "GROUP": 2, "STEP": 3}.items():
        monkeypatch.setattr(negatives, name, value)
    assert _got(negatives.hard_negatives(_frame(spark, rows + odd))) == _brute(rows)


def test_repeated_rows_are_rows_of_their_own(spark):
    rows, _ = _rows(2, 200)
    rows = rows + rows[:5] + rows[100:101] * 2
    assert _got(negatives.hard_negatives(_frame(spark, rows))) == _brute(rows)


def test_large_components_and_no_rows(spark):
    rows = [(0, [1e17, 1.0], 1), (1, [1e16, 3.0], 1), (2, [9.5e15, 0.0], 2), (100, [3e6, 2e6], 1), (101, [3e6, 2e6], 1), (102, [2.9e6, 2e6], 3), (200, [1e300, 0.0], 2)]
    got = _got(negatives.hard_negatives(_frame(spark, rows)))
    clipped = [(i, [max(-(2.0**54), min(2.0**54, x)) for x in v], lab) for i, v, lab in rows]
    assert got == _brute(clipped)
    assert negatives.hard_negatives(_frame(spark, [])).count() == 0


def test_buckets_that_cannot_matter_are_not_scored(monkeypatch):
    read = []
    monkeypatch.setattr(negatives, "_scores", lambda a, b, f=negatives._scores: read.append(len(b)) or f(a, b))
    held = negatives._Held([(1, 0, 0, np.full(2, 10, np.int16).tobytes(), 14.2, 80, 100, negatives.LOW)], 2, False, 2)
    bucket = lambda *v: (np.arange(len(v)) + 10, np.arange(len(v)), np.ones(len(v), np.int64), np.array(v, np.int16).tobytes())
    held.read(7.1, *bucket([5, 5], [5, 4], [4, 5]))
    assert held.score[0].tolist() == [100, 90] and held.found[0].tolist() == [0, 1]
    held.read(6.0, *bucket([4, 4]))  # below the kth score of 90, though within the window
    held.read(5.0, *bucket([3, 4]))  # below the window
    assert read == [3]


@pytest.mark.parametrize("share", [0, 33, 100])
def test_other_shares(spark, share):
    rows, _ = _rows(3, 150)
    assert _got(negatives.hard_negatives(_frame(spark, rows), share=share)) == _brute(rows, share)
