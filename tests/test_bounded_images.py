"""Images of many points: what a task holds doesn't grow with the pairs of points, and votes are counted beside their points."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from linkfold.operators import keypoints, tilt


def test_ratio_matches_hold_some_distances_at_a_time():
    rng = np.random.default_rng(5)
    reference = rng.normal(size=(4_000, 8))
    query = reference[::-1] + rng.normal(size=(4_000, 8)) * 1e-3
    tracemalloc.start()
    i, j = keypoints.ratio_matches(query, reference)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64_000_000  # all distances at once are twice that
    assert len(i) > 3_500 and (j == 3_999 - i).mean() > 0.99 and (np.diff(i) > 0).all()


def test_a_map_of_many_matches_is_fitted_in_little_memory():
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 800, (3_000, 2))
    b = np.where(np.arange(3_000)[:, None] % 3 > 0, a * 0.9 + 5, rng.uniform(0, 800, (3_000, 2)))
    tracemalloc.start()
    held = keypoints.ransac(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64_000_000 and held[np.arange(3_000) % 3 > 0].all() and held.sum() < 2_100
    assert np.allclose(keypoints.inliers_of(keypoints.refitted(a[:4], a[:4] * 2)[None], a[:9], a[:9] * 2, 1e-3), True)


def test_tilt_sends_no_points_to_the_driver(spark):
    along = F.explode(F.sequence(F.lit(0), F.lit(99)))
    edge = spark.range(3).select("id", F.explode(F.array(F.lit(0), F.lit(60))).alias("side")).select("*", along.alias("k"))
    angle = F.radians(F.col("id") * 12)
    points = edge.select("id", F.round(200 + F.col("side") * F.cos(angle) - F.col("k") * F.sin(angle)).alias("x"), F.round(100 + F.col("side") * F.sin(angle) + F.col("k") * F.cos(angle)).alias("y"))
    found = tilt.upright(points, ["id"])
    got = {r["id"]: r for r in found.collect()}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [abs(abs(got[k]["tilt"]) - 12 * k) < 2 for k in range(3)] == [True] * 3 and [got[k]["reason"] for k in range(3)] == ["below_threshold", "rotated", "rotated"]
