import numpy as np

from lodestar.llm import embeddings, graph


def _brute(rows, cosine=0.9):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links = {k: [] for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            (x, y) = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y >= cosine * np.sqrt((x @ x) * (y @ y)):
                links[a].append(b)
                links[b].append(a)
    component = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        component[k] = min(good[n][0] for n in seen)
    out = sorted((good[k][0], len(links[k]), component[k], component[k] == good[k][0]) for k in links)
    return out


def _rows():
    r = np.random.default_rng(5)
    rows, centers = [], r.normal(size=(6, 16))
    for i in range(400):
        rows.append((i, (centers[i % 6] + r.normal(size=16) * (0.2 if i % 3 else 0.9)).tolist()))
    rows += [(400 + i, rows[3][1]) for i in range(5)] + [(500, [1.0, 2.0, 3.0]), (501, [1.0, 2.0, 3.1]), (502, [2.0])]
    odd = [(600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] + [1.0] * 15), (604, [None] + [1.0] * 15), (605, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    return rows, odd


def test_links_and_components_match_brute_force(spark):
    rows, odd = _rows()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], "vec_id long, embedding array<float>, n_links string, w string")
    got = {r["vec_id"]: tuple(r) for r in embeddings.near_vectors(df).collect()}
    assert sorted(v for k, v in got.items() if k is not None and k < 600) == _brute(rows)
    for i, _ in odd:
        assert got[i] == (i, 0, i, True)


def test_hot_cells_are_dealt(spark, monkeypatch):
    rows, _ = _rows()
    monkeypatch.setattr(embeddings, "HOME", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect())) == _brute(rows)


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_double_precision_and_repeated_rows(spark):
    rows = [(1, [1e300, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1e-300]), (4, [0.0, 5.0]), (4, [0.0, 5.0]), (6, [1.0, 1.0])]
    got = sorted(map(tuple, embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (6, 0, 6, True)]


def test_small_steps(spark, monkeypatch):
    rows, _ = _rows()
    monkeypatch.setattr(embeddings, "HOME", 64)
    monkeypatch.setattr(embeddings, "STEP", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect())) == _brute(rows)


def test_a_flat_axis_and_an_outlier(spark, monkeypatch):
    r = np.random.default_rng(11)
    flat = [(i, [*r.normal(size=2).tolist(), 0.0, 0.0]) for i in range(60)]
    rows = flat + [(100, [0.0, 0.0, 1.0, 0.0]), (101, [0.0, 0.0, 0.9, 1.0]), (102, [0.0, 0.0, 0.91, 1.0])]
    monkeypatch.setattr(embeddings, "SAMPLE", 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect())) == _brute(rows)
    grid = embeddings.Grid(np.array([v for _, v in flat]), 0.9)
    assert all(np.isfinite(grid.cells(grid.turn(np.array([[0.0, 0.0, 1.0, 0.0]])), k)).all() for k in range(len(grid.blocks)))


def test_components_settle_each_table_once(spark, monkeypatch):
    settled = []
    monkeypatch.setattr(graph, "settle", lambda df, f=graph.settle: settled.append(df.columns) or f(df))
    star = spark.createDataFrame([(1, 2), (3, 1), (1, 1), (9, 8)], "a long, b long")
    assert sorted(map(tuple, graph.components(star).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert settled == [["a", "b"], ["id", "to"], ["a", "b"]]
    settled.clear()
    path = spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "a long, b long")
    assert sorted(map(tuple, graph.components(path).collect())) == [(i, 1) for i in range(1, 8)]
    assert settled[:3] == [["a", "b"], ["id", "to"], ["a", "b"]]
    assert settled[3:] == [["id", "to"], ["id", "component"], ["a", "b"]] * (len(settled) // 3 - 1)
