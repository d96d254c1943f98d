"""The neighbour search in bounded memory, against all pairs."""

import numpy as np
from linkfold.operators import knn


def test_cosines_held_at_once_are_bounded(monkeypatch):
    """However many queries and rows there are, no more than CELLS cosines are held, and the best are those of all pairs."""
    monkeypatch.setattr(knn, "CELLS", 500)
    seen = []
    original = np.round
    monkeypatch.setattr(knn.np, "round", lambda x, *a, **k: (seen.append(x.size), original(x, *a, **k))[1])
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (90, 3)).astype(float)  # many equal cosines, and rows of zeros
    best = knn.Best(np.arange(60), vectors[:60], 4, True)
    order = rng.permutation(90)
    for a in range(0, 90, 7):
        own = order[a : a + 7]
        best.add(own, vectors[own])
    assert max(seen) <= 500
    lengths = np.linalg.norm(vectors, axis=1)
    every = original((vectors[:60] @ vectors.T) / np.maximum(lengths[:60, None] * lengths, 1e-12), 6)
    want = [(q, k, every[q, k]) for q in range(60) for k in sorted((k for k in range(90) if k != q), key=lambda k: (-every[q, k], k))[:4]]
    assert sorted(map(tuple, best.found(-2).itertuples(index=False))) == sorted(want)


def test_best_of_several_batches(spark):
    """One task with several batches of rows keeps the nearest ``n`` of all; fewer, where fewer are as near as asked."""
    rows = [(k, [1.0, k / 50]) for k in range(60)] + [(60, None), (61, [1.0]), (62, [0.0, float("nan")]), (63, [float("inf"), 1.0])]
    table = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = [tuple(r) for r in knn.knn(table.filter("id in (0, 30)"), table, 3, exclude_self=True).collect()]
        near = knn.knn(table.filter("id = 0"), table, 3, exclude_self=True, least=0.9999).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((q, i) for q, i, _, _ in got) == [(0, 1), (0, 2), (0, 3), (30, 29), (30, 31), (30, 32)]
    assert [r["id"] for r in near] == [k for k in (1, 2, 3) if 1 / (1 + (k / 50) ** 2) ** 0.5 >= 0.99995]
