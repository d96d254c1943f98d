"""Colours of images whose pixels are array columns: histograms of hue and saturation, and dominant colours by k-means.

Pixels are counted by image and colour before anything else, so an image's size and repeated rows of it (tiles) don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.functions.pixels import hsv, lab

HUES, SATURATIONS = 30, 32
#: Pixels with less saturation, too dark or too bright say nothing of a label's colour.
LEAST_SATURATION, LEAST_VALUE, MOST_VALUE = 40, 30, 250
#: With fewer coloured pixels all of an image's count.
LEAST_COLOURED = 50


def counted_colours(images: DataFrame) -> DataFrame:
    """(id, pixel, n) of images (id, pixels array<int>); null pixels don't count, and rows with a null id are left out."""
    each = images.filter("id is not null").select("id", F.explode("pixels").alias("pixel")).filter("pixel is not null")
    return each.groupBy("id", "pixel").agg(F.count(F.lit(1)).alias("n"))


def hsv_histograms(images: DataFrame) -> DataFrame:
    """(id, hist array<double>): counts of HUES x SATURATIONS bins, by hue, scaled to a length of 1, as 32-bit floats hold them.

    images: id, pixels; an image may come in several rows.  Images without pixels have no row.
    """
    hue, saturation, _ = hsv(F.col("pixel"))
    place = F.floor(hue * HUES / 180).cast("int") * SATURATIONS + F.floor(saturation * SATURATIONS / 256).cast("int")
    bins = counted_colours(images).groupBy("id", place.alias("bin")).agg(F.sum("n").alias("n"))
    whole = bins.groupBy("id").agg(F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("length"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    value = lambda k: F.coalesce((F.try_element_at("bins", k) / F.col("length")).cast("float"), F.lit(0.0)).cast("double")
    return whole.select("id", F.transform(F.sequence(F.lit(0), F.lit(HUES * SATURATIONS - 1)), value).alias("hist"))


def lloyd(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int, least_move: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, each point's centre and the weighted sum of squared distances, from given centres on.

    A point between two centres goes to the first; a centre without points moves to the point that is farthest from its own.
    """
    for turn in range(rounds + 1):
        far = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        owner = far.argmin(axis=1)
        if turn == rounds:
            break
        totals = np.bincount(owner, weights, len(centres))
        moved = np.stack([np.bincount(owner, weights * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1) / np.maximum(totals, 1e-300)[:, None]
        lone = far[np.arange(len(points)), owner]
        for k in np.flatnonzero(totals == 0):
            at = int(lone.argmax())
            moved[k], lone[at] = points[at], -1
        step = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max()
        centres = moved
        if step <= least_move:
            rounds = turn + 1
    return centres, owner, float((weights * far[np.arange(len(points)), owner]).sum())


def kmeans(points: np.ndarray, weights: np.ndarray, k: int, starts: int = 5, rounds: int = 40, least_move: float = 0.5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights of k clusters of weighted points: the tightest of several starts, each by k-means++ with its own fixed seed.

    Points are put in order first, so the same points in any order give the same clusters.
    """
    order = np.lexsort(points.T[::-1])
    points, weights = points[order].astype(float), weights[order].astype(float)
    best = None
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        chosen = [int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), side="right"))]
        near = ((points - points[chosen[0]]) ** 2).sum(axis=1)
        for _ in range(k - 1):
            mass = np.cumsum(weights * near)
            chosen.append(min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), len(points) - 1))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        found = lloyd(points, weights, points[chosen], rounds, least_move)
        if best is None or found[2] < best[2]:
            best = found
    return best[0], np.bincount(best[1], weights, k)


def dominant_colours(images: DataFrame, clusters: int = 3, seed: int = 0) -> DataFrame:
    """(id, l8, a8, b8, share, pixels): the centre of the largest of an image's clusters of colours, in Lab as bytes, and its share of the pixels.

    images: id, pixels; an image may come in several rows.  Only coloured pixels count, or all if these are fewer than
    LEAST_COLOURED; of fewer than three pixels the mean is taken, and there is at most one cluster for 20 pixels.  Of equally
    large clusters the first counts.  Images without pixels have no row.  A task holds the distinct Lab colours of one image
    at a time, of which there are at most some millions, whatever the image's size.
    """
    _, saturation, value = hsv(F.col("pixel"))
    coloured = (saturation >= LEAST_SATURATION) & (value >= LEAST_VALUE) & (value <= MOST_VALUE)
    light, a, b = lab(F.col("pixel"))
    counts = counted_colours(images).groupBy("id", light.alias("l8"), a.alias("a8"), b.alias("b8"), coloured.alias("coloured")).agg(F.sum("n").alias("n"))
    kind = images.schema["id"].dataType.simpleString()

    def largest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows[rows["coloured"]]
        kept = rows if kept["n"].sum() < LEAST_COLOURED else kept
        kept = kept.groupby(["l8", "a8", "b8"], as_index=False)["n"].sum()
        points, weights, n = kept[["l8", "a8", "b8"]].to_numpy(float), kept["n"].to_numpy(float), int(kept["n"].sum())
        if n < 3:
            centre, share = np.average(points, axis=0, weights=weights), 1.0
        else:
            centres, sizes = kmeans(points, weights, min(clusters, max(1, n // 20)), seed=seed)
            centre, share = centres[sizes.argmax()], sizes.max() / n
        return pd.DataFrame([(key[0], *centre, share, n)], columns=["id", "l8", "a8", "b8", "share", "pixels"])

    return counts.groupBy("id").applyInPandas(largest, f"id {kind}, l8 double, a8 double, b8 double, share double, pixels long")
