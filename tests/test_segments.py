"""The index in segments against one built anew: updates, deletions, merges, versions, writers at once."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, segments

WORDS = [f"w{i}" for i in range(40)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows], "doc_id long, title string, text string, len string").repartition(3)


def _text(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))


def _hits(df):
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "w1"), (2, "w2 w3"), (3, "nothing"), (4, "w5 w5 w6"), (5, "")], "query_id long, query string")


def _same(index, spark, living, asked):
    fresh = search.bm25(_docs(spark, [(i, *d) for i, d in sorted(living.items())]), asked)
    assert _hits(index.bm25(asked)) == _hits(fresh)
    assert sorted(r["doc_id"] for r in index.ids().collect()) == sorted(living)


def test_any_history_equals_a_fresh_build(spark, asked, tmp_path):
    r, living = random.Random(4), {}
    index = segments.Index(spark, str(tmp_path / "i"), buckets=4, slices=2, fan=2)
    for step in range(5):
        rows = [(i, _text(r)[:10], _text(r)) for i in r.sample(range(60), r.choice([1, 5, 20]))]
        index.add(_docs(spark, rows))
        living |= {i: (t, x) for i, t, x in rows}
        gone = r.sample(range(80), 6)
        index.delete(spark.createDataFrame([(g,) for g in [*gone, gone[0], None]], "doc_id long"))
        for g in gone:
            living.pop(g, None)
        if step == 2:
            assert index.merge() > 0
    _same(index, spark, living, asked)
    index.merge()
    _same(index, spark, living, asked)
    sizes = [s["docs"] - s["dead"] for s in index.state()["segments"].values()]
    assert sum(sizes) == len(living) and len({s.bit_length() for s in sizes}) == len(sizes)
    index.optimize()
    _same(index, spark, living, asked)
    state = index.state()
    assert len(state["segments"]) == 1 and state["marks"] == []


def test_old_versions_stay_until_vacuum(spark, asked, tmp_path):
    index = segments.Index(spark, str(tmp_path / "i"), buckets=2)
    index.add(_docs(spark, [(1, "w1", ""), (2, "", "w2 w3 w2")]))
    before, first = index.versions()[-1], _hits(index.bm25(asked))
    index.add(_docs(spark, [(2, "", "w9"), (3, "w1", None), (3, "w1", None)]))
    assert _hits(index.bm25(asked, before)) == first and _hits(index.bm25(asked)) != first
    index.optimize()
    assert index.vacuum() > 0 and len(index.versions()) == 1
    assert {d for _, d, _ in _hits(index.bm25(asked))} == {1, 3}
    index.delete(spark.createDataFrame([(i,) for i in range(9)], "doc_id long"))
    index.merge()
    assert _hits(index.bm25(asked)) == [] and index.state()["segments"] == {}


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    one = segments.Index(spark, str(tmp_path / "i"))
    state = one.state()
    one.add(_docs(spark, [(1, "w1", "")]))
    with pytest.raises(segments.Conflict):
        one._commit(state | {"version": state["version"] + 1})
    assert one.ids().count() == 1


def test_odd_rows_and_ranked_search(spark, asked, tmp_path):
    index = segments.Index(spark, str(tmp_path / "i"), buckets=2)
    assert _hits(index.bm25(asked)) == []
    index.add(_docs(spark, []))
    with pytest.raises(ValueError):
        index.add(_docs(spark, [(None, "a", "b")]))
    rows = [(1, "w1", "w2 w3"), (2, None, None), (3, "", ""), (4, "w1 " * 5000, "w2")]
    index.add(_docs(spark, rows))
    full = _docs(spark, rows).withColumns({"url": F.lit("https://a/w1"), "crawled_at": F.lit(0.0), "source": F.lit("s")})
    plain, found = (search.ranked(full, asked, 5, 0.0, index=i).collect() for i in (None, index))
    assert sorted(plain) == sorted(found) and found


@pytest.mark.parametrize("left", ["", '{"version": 2, "segm'])
def test_what_a_dead_writer_leaves_is_passed_over(spark, asked, tmp_path, left):
    index = segments.Index(spark, str(tmp_path / "i"), buckets=2)
    index.add(_docs(spark, [(1, "w1", "w2 w3")]))
    (tmp_path / "i" / "manifest" / "000000002.json").write_text(left)
    assert {d for _, d, _ in _hits(index.bm25(asked))} == {1}
    index.add(_docs(spark, [(2, "w1", "")]))
    assert index.versions()[-1] == 3 and sorted(r["doc_id"] for r in index.ids().collect()) == [1, 2]
    index.vacuum()
    assert sorted(r["doc_id"] for r in index.ids().collect()) == [1, 2]
