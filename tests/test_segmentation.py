"""Words of texts without spaces: costs against plain counts, best paths against every path."""

import itertools
import math
import random
from collections import Counter

from lodestar.operators import segmentation as sg

SIGNS = "天地人水火山石田土木金"


def _paths(run, longest):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        out, start = [], 0
        for i, c in enumerate([*cuts, 1]):
            if c:
                out.append(run[start : i + 1])
                start = i + 1
        if all(len(w) <= longest for w in out):
            yield out


def test_best_path_is_the_best_of_all():
    r = random.Random(1)
    for _ in range(60):
        costs = {"".join(r.choice(SIGNS[:5]) for _ in range(r.randint(1, 4))): float(r.randint(1, 6)) for _ in range(25)}
        run = "".join(r.choice(SIGNS[:6]) for _ in range(r.randint(1, 9)))
        unknown = max(costs.values()) + 1
        price = lambda p, c=costs, u=unknown: sum(c.get(w, u if len(w) == 1 else math.inf) for w in p)
        best = min(_paths(run, 4), key=lambda p: (price(p), len(p), [-len(w) for w in p]))
        assert sg.best_path(run, costs) == best, (run, costs)
    assert sg.best_path("", {}) == [] and sg.best_path("天地", {}) == ["天", "地"]


def _corpus(r):
    words = ["天地", "山水", "木石人", "火", "田土", "김치", "한국어"]
    return [(i, "".join(r.choice(words) for _ in range(r.randint(1, 30))) + r.choice(["。", " abc DEF1 ", "!"]) + r.choice(words)) for i in range(200)], words


def test_lexicon_equals_plain_counts_and_finds_the_words(spark):
    rows, words = _corpus(random.Random(2))
    df = spark.createDataFrame([(*x, "c") for x in rows] + [(900, None, "c"), (901, "", "c")], "doc_id long, text string, tokens string").repartition(4)
    counts = Counter()
    for _, t in rows:
        for run in __import__("re").findall(f"[{sg.HAN}]+|[{sg.HANGUL}]+", t):
            counts.update(run[i : i + k] for i in range(len(run)) for k in range(1, 5) if i + k <= len(run))
    assert {x["gram"]: x["n"] for x in sg.counted(df).collect()} == counts
    total = sum(n for g, n in counts.items() if len(g) == 1)
    kept = {g for g, n in counts.items() if len(g) == 1 or n >= 3 and min(n * total / (counts[g[:k]] * counts[g[k:]]) for k in range(1, len(g))) >= 2.0}
    costs = sg.lexicon(df, cohesion=2.0)
    weight = sum(counts[g] for g in kept)
    assert set(costs) == kept and all(math.isclose(c, -math.log(counts[g] / weight)) for g, c in costs.items()) and set(words) <= kept
    got = {x["doc_id"]: x["tokens"] for x in sg.segmented(df, costs).collect()}
    assert got[900] == got[901] == [] and all("".join(got[i]) == "".join(c for c in t.lower() if c.isalnum()) for i, t in rows)
    assert any("abc" in v and "def1" in v for v in got.values())
    assert sg.lexicon(df.limit(0)) == {} and len(sg.lexicon(df, cohesion=2.0, size=5)) == 5


def test_a_long_run_takes_time_in_proportion():
    run = "天地人水火山石田土木金" * 20000
    assert len(sg.best_path(run, {"天地": 1.0, "人": 1.0})) > 100000


def test_paths_side_by_side_are_those_of_each_run():
    r = random.Random(8)
    for n in (0, 4, 25):
        costs = {"".join(r.choice(SIGNS[:5]) for _ in range(r.randint(1, 4))): float(r.randint(1, 3)) for _ in range(n)}
        prices, unknown = sg._prices(costs)
        runs = ["".join(r.choice(SIGNS[:6]) for _ in range(r.randint(1, 30))) for _ in range(200)]
        assert sg._paths(runs, sg._tree(prices, 4), unknown, 4) == [sg.best_path(x, costs) for x in runs]


def test_strings_of_a_chunk_are_not_counted_one_by_one(monkeypatch):
    text = "\0".join("".join(random.Random(i).choice(SIGNS + "김치a") for _ in range(40)) for i in range(60))
    runs = __import__("re").findall(f"[{sg.HAN}]+|[{sg.HANGUL}]+", text)
    want = Counter(x[i : i + k] for x in runs for k in range(1, 5) for i in range(len(x) - k + 1))
    for dense in (sg.DENSE, 0):
        monkeypatch.setattr(sg, "DENSE", dense)
        assert {g: n for grams, ns in sg._grams(text, 4) for g, n in zip(grams, ns, strict=True)} == want


def test_words_of_a_batch_are_never_all_held(spark, monkeypatch):
    rows, _ = _corpus(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    costs = sg.lexicon(df, cohesion=2.0)

    class Spy:  # the function that segmented() gives to Spark, fed with one batch
        def __init__(self, frame):
            self.frame = frame

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            table = df.select("doc_id", "text").toArrow().combine_chunks().to_batches()
            return list(run(iter(table)))

    out = sg.segmented(Spy(df), costs)
    assert len(out) > 1 and max(b.num_rows for b in out) <= sg.SLICE and sum(b.num_rows for b in out) == len(rows)
    monkeypatch.setattr(sg, "HELD", 10)
    assert sg.lexicon(df, cohesion=2.0) == costs
