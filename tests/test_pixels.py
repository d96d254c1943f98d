"""Colours of pixels against plain readings of the same rules."""

import colorsys

import numpy as np
from pyspark.sql import functions as F

from linkfold.functions.pixels import hsv, lab
from linkfold.functions.similarity import bhattacharyya
from linkfold.operators import decide, pixels

IMAGES = "id int, pixels array<int>"


def plain_lab(r, g, b):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    x, y, z = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) @ lin / [0.950456, 1, 1.088754]
    f = lambda t: np.cbrt(t) if t > 0.008856 else 7.787 * t + 16 / 116
    return (116 * np.cbrt(y) - 16 if y > 0.008856 else 903.3 * y) * 2.55, 500 * (f(x) - f(y)) + 128, 200 * (f(y) - f(z)) + 128


def test_colours_of_pixels(spark):
    rng = np.random.default_rng(3)
    colours = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (7, 7, 7), (255, 0, 1), (1, 0, 255), *rng.integers(0, 256, (500, 3)).tolist()]
    df = spark.createDataFrame([(r * 65536 + g * 256 + b, r, g, b) for r, g, b in colours], "pixel int, r int, g int, b int")
    p = F.col("pixel")
    rows = df.select("r", "g", "b", *[c.alias(f"hsv{k}") for k, c in enumerate(hsv(p))], *[c.alias(f"lab{k}") for k, c in enumerate(lab(p))]).collect()
    for r in rows:
        h, s, v = colorsys.rgb_to_hsv(r["r"] / 255, r["g"] / 255, r["b"] / 255)
        assert min(abs(r["hsv0"] - h * 180), 180 - abs(r["hsv0"] - h * 180)) <= 0.7 and 0 <= r["hsv0"] < 180.5
        assert abs(r["hsv1"] - 255 * s) <= 0.51 and r["hsv2"] == max(r["r"], r["g"], r["b"])
        assert all(abs(r[f"lab{k}"] - w) <= 0.51 for k, w in enumerate(plain_lab(r["r"], r["g"], r["b"])))


def test_histograms_feed_distances(spark):
    red, blue = 200 << 16, 200
    images = spark.createDataFrame([(1, [red] * 30 + [blue] * 40), (2, [blue] * 8), (1, [None]), (3, []), (None, [red]), (4, None), (2, [blue])], IMAGES).withColumn("n", F.lit(1))
    got = {r["id"]: np.array(r["hist"]) for r in pixels.hsv_histograms(images).collect()}
    assert set(got) == {1, 2} and all(len(h) == 960 and abs((h**2).sum() - 1) < 1e-6 for h in got.values())
    assert sorted(got[1][got[1] > 0].tolist()) == [np.float32(0.6), np.float32(0.8)] and got[2].max() == 1
    hists = pixels.hsv_histograms(images)
    rows, missing = decide.with_distances(spark.createDataFrame([(9, 1), (9, 2)], "query_id int, id int"), hists.filter("id = 2").select(F.lit(9).alias("query_id"), "hist"), hists.filter("id = 1"), hists, bhattacharyya)
    found = {r["id"]: r["distance"] for r in rows.collect()}
    assert found[2] < 1e-6 < 0.1 < found[1] < 1 and [r["id"] for r in missing.collect()] == [2]


def test_kmeans_is_that_of_repeated_points():
    """Weights are repetitions, order is irrelevant, and no other assignment of the points is tighter by one move."""
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5):
        points = rng.integers(0, 12, (40, 3)).astype(float)
        weights = rng.integers(1, 5, 40).astype(float)
        centres, sizes = pixels.kmeans(points, weights, k, least_move=0)
        assert sizes.sum() == weights.sum() and len(centres) == k
        shuffled = rng.permutation(40)
        again = pixels.kmeans(points[shuffled], weights[shuffled], k, least_move=0)
        assert np.allclose(centres, again[0]) and np.allclose(sizes, again[1])
        spread = np.repeat(points, weights.astype(int), axis=0)
        one = pixels.lloyd(spread, np.ones(len(spread)), centres, 5, 0)
        assert np.allclose(one[0], centres)  # repeated points stay where the weighted ones are
    assert pixels.kmeans(np.ones((1, 3)), np.array([9.0]), 3)[1].sum() == 9


def test_dominant_colours(spark):
    rng = np.random.default_rng(5)
    near = lambda r, g, b, n: [int((r + x) << 16 | (g + y) << 8 | (b + z)) for x, y, z in rng.integers(-3, 4, (n, 3))]
    wine, gold, grey = near(120, 20, 40, 300), near(200, 160, 40, 90), near(130, 130, 130, 900)
    black = [0] * 10
    images = [(1, wine + grey), (1, gold), (2, grey + gold[:49]), (3, wine[:2]), (4, []), (5, None), (6, black), (None, wine), (7, gold * 500)]
    table = spark.createDataFrame(images, IMAGES).withColumn("n", F.lit(1))
    got = {r["id"]: r for r in pixels.dominant_colours(table).collect()}
    assert set(got) == {1, 2, 3, 6, 7}
    as_lab = lambda ps: np.array([np.round(plain_lab(p >> 16, p >> 8 & 255, p & 255)) for p in ps])
    of = lambda i: np.array([got[i][c] for c in ("l8", "a8", "b8")])
    assert np.abs(of(1) - as_lab(wine).mean(axis=0)).max() < 3 and got[1]["pixels"] == 390  # grey isn't coloured; reds may split between clusters
    assert np.abs(of(2) - as_lab(grey).mean(axis=0)).max() < 3 and got[2]["pixels"] == 949  # too few coloured ones, so all count
    assert np.allclose(of(3), as_lab(wine[:2]).mean(axis=0)) and got[3]["share"] == 1
    assert np.allclose(of(6), [0, 128, 128]) and got[7]["pixels"] == 45_000
    assert sorted(map(tuple, pixels.dominant_colours(table.repartition(5)).collect())) == sorted(map(tuple, got.values()))
    assert pixels.dominant_colours(table.limit(0)).count() == 0
