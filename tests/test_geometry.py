"""Keypoint pairs and tilts against planted transforms and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.operators import keypoints, tilt


def _image(rng, n, shape=32):
    return rng.uniform(0, 600, (n, 2)), rng.normal(size=(n, shape)).astype(np.float32)


def _rows(name, points, descriptors):
    return [(name, float(x), float(y), [float(v) for v in d]) for (x, y), d in zip(points, descriptors)]


def test_ratio_test_is_that_of_all_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(60, 8)), rng.normal(size=(80, 8))
    b[:20] = a[10:30] + rng.normal(size=(20, 8)) * 0.05
    b[70] = b[3]  # of two equal ones neither is nearer
    want = []
    for i, d in enumerate(a):
        far = [math.dist(d, e) for e in b]
        order = sorted(range(len(b)), key=lambda j: (far[j], j))
        if far[order[0]] < 0.75 * far[order[1]]:
            want.append((i, order[0]))
    assert list(zip(*map(list, keypoints.ratio_matches(a, b)))) == want and len(want) > 15


def test_planted_transforms_are_found(spark):
    rng = np.random.default_rng(7)
    points, descriptors = _image(rng, 200)
    h = np.array([[0.9, -0.3, 40], [0.25, 1.0, -10], [0.0003, -0.0002, 1]])
    moved = np.c_[points, np.ones(200)] @ h.T
    moved = moved[:, :2] / moved[:, 2:] + rng.normal(size=(200, 2)) * 0.5
    moved[120:] = rng.uniform(0, 600, (80, 2))  # right descriptors at wrong places
    other = _image(rng, 150)
    refs = _rows("same", moved, descriptors + rng.normal(size=descriptors.shape).astype(np.float32) * 0.02) + _rows("other", *other) + _rows("few", points[:3], descriptors[:3]) + [("few", None, 1.0, [0.0] * 32), (None, 1.0, 1.0, [0.0] * 32)]
    refs += _rows("short", points[:9], descriptors[:9, :5])
    schema = "image string, x double, y double, descriptor array<float>"
    pairs = spark.createDataFrame([("q", n) for n in ("same", "other", "few", "none", "short", "same")], "query_id string, id string").repartition(3)
    found = keypoints.verified_pairs(pairs, spark.createDataFrame(_rows("q", points, descriptors), schema), spark.createDataFrame(refs, schema))
    rows = [r.asDict() for r in found.collect()]
    assert len(rows) == 6
    got = {r["id"]: r for r in rows}
    clean = np.hypot(*(moved - np.array([(p[:2] / p[2]) for p in np.c_[points, np.ones(200)] @ h.T])).T) <= 5
    same = got["same"]
    assert same["matches"] == 200 and abs(same["inliers"] - clean.sum()) <= 4 and same["inliers"] >= 118
    assert same["score"] == pytest.approx(min(1, same["inliers"] / 80 * 0.7 + same["inliers"] / 200 * 0.3), abs=1e-4) and same["error"] is None
    assert got["other"]["inliers"] <= 8 and got["few"]["error"] == got["none"]["error"] == got["short"]["error"] == "too_few_keypoints" and got["few"]["score"] == 0
    assert keypoints.verified_pairs(pairs.limit(0), spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_maps_and_inliers_are_those_of_single_samples():
    rng = np.random.default_rng(9)
    a, b = rng.uniform(0, 100, (30, 4, 2)), rng.uniform(0, 100, (30, 4, 2))
    a[0, 2] = (a[0, 0] + a[0, 1]) / 2  # three points on a line
    maps = keypoints.homographies(a, b)
    assert not maps[0].any()
    points, partners = rng.uniform(0, 100, (50, 2)), rng.uniform(0, 100, (50, 2))
    held = keypoints.inliers_of(maps, points, partners, 20)
    for k in range(1, 30):
        for (x, y), (u, v) in zip(a[k], b[k]):
            p = maps[k] @ [x, y, 1]
            assert np.allclose(p[:2] / p[2], [u, v], atol=1e-5)
        plain = [math.dist((q := maps[k] @ [x, y, 1])[:2] / q[2], w) <= 20 for (x, y), w in zip(points, partners)]
        assert plain == held[k].tolist()
    assert not held[0].any() and keypoints.ransac(points[:3], partners[:3]).sum() == 0
    line = np.c_[np.arange(20.0), np.arange(20.0)]
    assert keypoints.ransac(line, line).sum() == 0  # no four of its points give a map


def _edges(angle, length=180, sides=(0, 150), noise=0, seed=0):
    t, rng = math.radians(angle), np.random.default_rng(seed)
    points = {(round(300 + s * math.cos(t) - k * math.sin(t)), round(80 + s * math.sin(t) + k * math.cos(t))) for s in sides for k in range(length)}
    return points | {tuple(map(int, p)) for p in rng.integers(0, 400, (noise, 2))}


def test_tilts_of_planted_edges(spark):
    angles = [-37, -22.3, -9, -3.7, 0, 0.4, 5, 8.2, 14.6, 29.9, 38]
    rows = [(k, x, y) for k, a in enumerate(angles) for x, y in _edges(a, noise=150, seed=k)]
    rows += rows[:500] + [(100, 1, 1), (101, None, 3), (None, 2, 2)]
    rows += [(102, x, x // 4 + (x * 7) % 3) for x in range(0, 400, 4)]  # no line near the vertical: the main axis
    points = spark.createDataFrame(rows, "image int, x int, y int").withColumns({"k": F.lit(1), "votes": F.lit(2)}).repartition(5)
    got = {r["image"]: r for r in tilt.axis_tilts(points, ["image"]).collect()}
    assert set(got) == {*range(len(angles)), 100, 102}
    assert all(abs(got[k]["tilt"] - a) <= 0.5 and got[k]["method"] == "hough" for k, a in enumerate(angles))
    assert got[100]["method"] == "none" and got[100]["tilt"] is None
    assert got[102]["method"] == "axis" and abs(abs(got[102]["tilt"]) - 76) < 2
    turned = {r["image"]: r for r in tilt.upright(points, ["image"]).collect()}
    for k, a in enumerate(angles):
        assert turned[k]["reason"] == ("rotated" if abs(got[k]["tilt"]) >= 8 else "below_threshold")
        assert turned[k]["rotate"] == (pytest.approx(a, abs=0.5) if abs(got[k]["tilt"]) >= 8 else 0) and (turned[k]["rest"] or 0) <= 1
    assert turned[100]["reason"] == "no_axis" and tilt.upright(points.limit(0), ["image"]).count() == 0


def test_rotation_holds_the_whole_image(spark):
    for degrees in (0, 20, -35, 90, 180):
        m = spark.range(1).select(tilt.rotation(F.lit(200), F.lit(100), F.lit(float(degrees))).alias("m")).first()["m"]
        corners = [(m["a"] * x + m["b"] * y + m["c"], m["d"] * x + m["e"] * y + m["f"]) for x in (0, 200) for y in (0, 100)]
        assert all(-1 <= x <= m["width"] + 1 and -1 <= y <= m["height"] + 1 for x, y in corners)
        assert max(x for x, _ in corners) - min(x for x, _ in corners) == pytest.approx(m["width"], abs=1)
