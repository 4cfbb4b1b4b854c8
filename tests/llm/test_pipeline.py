"""Each stage against a plain version of it, on its own input."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from lodestar.llm import decontamination, language_id, mixing

from . import helpers as h

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def test_stages(spark, tmp_path):
    rows = [(*r[:4], len(r[1] or "")) for r in h.documents(3, near=25)]
    item = " ".join(max((r[1] or "" for r in rows), key=len).split()[100:140])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "sharding":
            assert out.columns == COLUMNS
        before, after = _rows(docs), _rows(out)
        if name == "language_id":
            want = {(r["doc_id"], r["text"]) for r in language_id.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_SCORE and r["familiar"]}
            assert after == Counter({r: n for r, n in before.items() if (r[0], r[1]) in want})
        elif name == "near_duplicates":
            classes = {d: c for d, _, c in h.near_classes([(r[0], r[1]) for r in before])}
            keep = Counter({r: 1 if r[0] is not None and h.shingles(r[1]) else n for r, n in before.items() if r[0] is None or not h.shingles(r[1]) or classes[r[0]] == r[0]})
            assert after == keep
        elif name == "decontamination":
            gone = {r["text"] for r in decontamination.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
            assert gone and after == Counter({r: n for r, n in before.items() if r[1] not in gone})
        elif name == "mixing":
            want = Counter()
            for r in mixing.mix(docs).collect():
                want[tuple(r[c] for c in COLUMNS)] += r["copies"]
            assert after == +want
        else:
            assert after == before and out.filter("law <> 'key' or shard not between 0 and 39").count() == 0
        docs = out
    assert pipeline.ORACLE_SQL is None


def test_near_duplicates_keeps_different_texts_of_one_id(spark):
    v = h.vocabulary(8)
    a, b, c, d = (" ".join(v[i : i + 50]) for i in (0, 60, 120, 180))
    rows = [(7, a), (7, b), (7, b), (3, c), (9, c), (9, d), (5, b + " end"), (1, a), (1, a), (None, a), (7, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, a), (5, b + " end"), (3, c), (9, d), (None, a), (7, None)])


OTHERS = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "xq zzkw pfft qqq jjjx wvwv zxcv bnmq wrtp lkjh gfds qwrt mnbv xcvz kkkk jjjj",
]


def test_text_of_no_learned_language_goes(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    other = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(OTHERS)], known.schema)
    kept = {r["doc_id"] for r in pipeline.identify_language(spark, known.unionByName(other), "").collect()}
    assert kept == {r["doc_id"] for r in known.filter("text rlike '[a-zA-Z]'").collect()}


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, coverage string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    long = "the house of the king is on the hill and the people are in it " * 20000
    rows = [(i, f"the house number {i} of the king is on the hill and the people of the town are in it", "en", f"s{i % 3}", 1, "x", "y", "z") for i in range(40)]
    rows += [(100, long, "en", "s0", 1, "x", "y", "z"), (101, None, "en", None, 1, None, None, None), (None, rows[0][1], "en", None, 1, "p", "q", "r")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path / "empty"))
        assert out.columns == docs.columns, name
        kept = {tuple(r) for r in out.collect()}
        assert kept <= set(rows) and all(r[1] is not None for r in kept) and any(r[1] == long for r in kept), name
        docs = spark.createDataFrame(sorted(kept, key=str), schema)


def test_decontamination_and_mixing_by_plain_versions(spark, tmp_path):
    from .test_others import _tiled

    v = h.vocabulary(11, 80)
    r = random.Random(4)
    items = [" ".join(r.choice(v) for _ in range(20)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = [r.choice(v) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            item = r.choice(items).split()
            cut = r.randint(0, 20)
            words += item[cut:] + item[: r.randint(0, cut)]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 1))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = _rows(pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)))
    want = Counter(x for x in rows if all(_tiled(x[1].split(), i.split()) < decontamination.COVERED for i in items))
    assert kept == want and 0 < len(want) < len(rows)
    mixed = _rows(pipeline.mix_sources(spark, docs, str(tmp_path)))
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += len(x[1].split())
    taken, longest = Counter(), {s: max(len(x[1].split()) for x in rows if x[3] == s) for s in sizes}
    for x, n in mixed.items():
        assert x in rows and n <= 3
        taken[x[3]] += n * len(x[1].split())
    # Weights 1, 2, 3, 1 share all words, no source's share being over three times its own here.
    share = {s: sum(sizes.values()) * w / 7 for s, w in zip(sorted(sizes), (1, 2, 3, 1), strict=True)}
    assert all(share[s] <= 3 * sizes[s] and abs(taken[s] - share[s]) <= longest[s] / 2 + 1 for s in sizes)
