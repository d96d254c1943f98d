"""Geometric check of pairs of images from their keypoints: nearest descriptors with the ratio test, then a homography by RANSAC.

Keypoints come as rows with descriptors, as a detector leaves them, some thousands for an image at most.  They are packed by
image once, pairs fetch both images by equal joins, and each pair is judged by matrix products of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.functions.scores import inlier_score

#: A match counts if the nearest descriptor is nearer than this share of the distance to the second.
RATIO = 0.75
#: Fewer matches than this aren't tried; a match is an inlier within so many pixels; so many samples of four matches are tried.
LEAST_MATCHES, LEAST_KEYPOINTS, REACH, SAMPLES = 8, 4, 5.0, 1_000
#: Distances, and places of matches under sampled maps, that a task holds at once (8 MB of doubles), however many keypoints two images have.
CELLS = 1_000_000


def packed_keypoints(keypoints: DataFrame) -> DataFrame:
    """(image, xs, ys, descriptors) of keypoints (image, x, y, descriptor array<float>): one row an image, in the order of their places.

    Keypoints with a null anywhere are left out.
    """
    point = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("descriptor").cast("array<float>").alias("d"))
    usable = keypoints.filter("image is not null and x is not null and y is not null and descriptor is not null").filter(F.forall("descriptor", lambda v: v.isNotNull()))
    points = usable.groupBy("image").agg(F.sort_array(F.collect_list(point)).alias("p"))
    field = lambda name: F.transform("p", lambda p: p[name])
    return points.select("image", field("x").alias("xs"), field("y").alias("ys"), F.flatten(field("d")).alias("descriptors"))


def ratio_matches(query: np.ndarray, reference: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """Places of the query's descriptors that pass the ratio test, and of their nearest reference descriptors (the first of equal ones)."""
    found, places, squares, step = [], [], (reference**2).sum(axis=1), max(1, CELLS // max(1, len(reference)))
    for at in range(0, len(query), step):
        part = query[at : at + step]
        far = np.maximum((part**2).sum(axis=1)[:, None] + squares - 2 * part @ reference.T, 0)
        rows, nearest = np.arange(len(part)), far.argmin(axis=1)
        first = np.linalg.norm(part - reference[nearest], axis=1)  # without the cancellation of the product
        far[rows, nearest] = np.inf
        second = np.linalg.norm(part - reference[far.argmin(axis=1)], axis=1)
        kept = first < ratio * second
        found.append(at + rows[kept])
        places.append(nearest[kept])
    return np.concatenate(found), np.concatenate(places)


def homographies(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plane maps that take four points of ``a`` to those of ``b``, for many samples (n, 4, 2) at once; degenerate ones are all zero."""
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    zero, one = np.zeros_like(x), np.ones_like(x)
    upper = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], axis=-1)
    lower = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], axis=-1)
    system, right = np.concatenate([upper, lower], axis=1), np.concatenate([u, v], axis=1)
    area = lambda p, i, j, k: np.abs((p[:, j, 0] - p[:, i, 0]) * (p[:, k, 1] - p[:, i, 1]) - (p[:, k, 0] - p[:, i, 0]) * (p[:, j, 1] - p[:, i, 1]))
    sound = np.all([area(p, *t) > 1e-6 for p in (a, b) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))], axis=0)
    out = np.zeros((len(a), 9))
    if sound.any():
        system[~sound] = np.eye(8)
        flat = np.abs(np.linalg.det(system)) < 1e-300
        system[flat], sound = np.eye(8), sound & ~flat
        out[:, :8], out[:, 8] = np.linalg.solve(system, right[..., None])[..., 0], 1
        out[~sound] = 0
    return out.reshape(-1, 3, 3)


def inliers_of(maps: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Whether each map takes each point of ``a`` to within ``reach`` of its partner: (maps, points)."""
    to = np.concatenate([a, np.ones((len(a), 1))], axis=1) @ maps.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        off = to[..., :2] / to[..., 2:] - b
        return np.nan_to_num((off**2).sum(axis=-1), nan=np.inf) <= reach * reach


def refitted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plane map with the least algebraic error over all points, both sides shifted and scaled first."""

    def norm(p: np.ndarray) -> np.ndarray:
        centre = p.mean(axis=0)
        scale = np.sqrt(2) / max(np.linalg.norm(p - centre, axis=1).mean(), 1e-12)
        return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])

    s, t = norm(a), norm(b)
    (x, y), (u, v) = (a * s[0, 0] + s[:2, 2]).T, (b * t[0, 0] + t[:2, 2]).T
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    # of four points the map is what the eight rows leave; of more, a square of all rows isn't needed for it
    return np.linalg.inv(t) @ np.linalg.svd(rows, full_matrices=len(rows) < 9)[2][-1].reshape(3, 3) @ s


def ransac(a: np.ndarray, b: np.ndarray, reach: float = REACH, samples: int = SAMPLES, seed: int = 0) -> np.ndarray:
    """Which matches the best plane map found explains; the same matches give the same answer.

    The first of the samples with most inliers counts; it is fitted again to its inliers while that wins more.
    """
    n = len(a)
    if n < 4:
        return np.zeros(n, dtype=bool)
    rng, best = np.random.default_rng([seed, n]), np.zeros(n, dtype=bool)
    picks, step = np.stack([rng.permutation(n)[:4] for _ in range(samples)]), max(1, min(100, CELLS // n))
    for at in range(0, samples, step):
        part = picks[at : at + step]
        held = inliers_of(homographies(a[part], b[part]), a, b, reach)
        top = int(held.sum(axis=1).argmax())
        if held[top].sum() > best.sum():
            best = held[top]
    while best.sum() >= 4:
        more = inliers_of(refitted(a[best], b[best])[None], a, b, reach)[0]
        if more.sum() <= best.sum():
            break
        best = more
    return best


def verified_pairs(pairs: DataFrame, queries: DataFrame, references: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of pairs (query_id, id) with keypoints_query, keypoints_ref, matches, inliers, inlier_ratio, score and error.

    queries and references: keypoints (image, x, y, descriptor).  Pairs of which either image has fewer than four keypoints, or of
    descriptors of unequal length, have the error ``too_few_keypoints`` and zeros; repeated pairs are judged alike.
    """
    named = lambda df, key, name: packed_keypoints(df).select(F.col("image").alias(key), F.struct("xs", "ys", "descriptors").alias(name))
    rows = pairs.select("query_id", "id").join(named(queries, "query_id", "q"), "query_id", "left").join(named(references, "id", "r"), "id", "left")

    def judge(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for qs, rs in batches:
            out = []
            for k in range(len(qs)):
                sides = [(np.stack([s["xs"][k], s["ys"][k]], axis=1), np.asarray(s["descriptors"][k], dtype=float)) if s["xs"][k] is not None else (np.zeros((0, 2)), np.zeros(0)) for s in (qs, rs)]
                (a, da), (b, db) = sides
                matches = inliers = 0
                fit = min(len(a), len(b)) >= LEAST_KEYPOINTS and len(da) % len(a) == 0 == len(db) % len(b) and len(da) // len(a) == len(db) // len(b)
                if fit:
                    i, j = ratio_matches(da.reshape(len(a), -1), db.reshape(len(b), -1))
                    matches = len(i)
                    inliers = int(ransac(a[i], b[j], seed=seed).sum()) if matches >= LEAST_MATCHES else 0
                out.append((len(a), len(b), matches, inliers, fit))
            yield pd.DataFrame(out, columns=["keypoints_query", "keypoints_ref", "matches", "inliers", "fit"])

    judge.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.DataFrame]], "return": Iterator[pd.DataFrame]}
    schema = "keypoints_query int, keypoints_ref int, matches int, inliers int, fit boolean"
    judged = rows.select("query_id", "id", F.pandas_udf(judge, schema)("q", "r").alias("g")).select("query_id", "id", "g.*")
    ratio = F.round(F.when(F.col("matches") > 0, F.col("inliers") / F.col("matches")).otherwise(0.0), 4)
    return judged.withColumns({"inlier_ratio": ratio, "score": F.when(F.col("fit"), F.round(inlier_score(F.col("matches"), F.col("inliers")), 4)).otherwise(0.0), "error": F.when(~F.col("fit"), "too_few_keypoints")}).drop("fit")
