"""Tilt of an image's main axis by Hough voting over its edge points, and the rotation that sets it upright.

Every edge point votes for the lines through it, one for each angle near the vertical; votes are counted by image, angle and
distance from the origin.  Points are dealt out by image and packed, as an image's edge is some pixels of it, and votes,
of which there are a hundred times more, are counted beside them angle by angle; only points and lines are rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.operators.spread import dealt
from linkfold.operators.tables import written

#: Degrees from the vertical that are looked at, in steps of so many.
MOST_TILT, STEP = 40.0, 0.5
#: Votes that make a line; with no line, points that the axis of their spread is taken from at least.
LEAST_VOTES, LEAST_POINTS = 30, 80
#: Places that votes are counted in at a time.
CELLS = 1_000_000
#: Tilts below this aren't corrected.
LEAST_TILT = 8.0
#: Parts of the tilt that are tried, the first that leaves at most so many degrees is taken.
PARTS, SMALL_REST = (1.0, 0.8, 0.65, 0.5), 3.0


def voted_lines(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of LEAST_VOTES points or more: their angles, votes, and the mean x of their points."""
    angles = [k * STEP - MOST_TILT for k in range(int(2 * MOST_TILT / STEP) + 1)]
    turns = np.array([(a, math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles])
    most, found = 16 * len(xs) + 4_096, []
    step = max(1, CELLS // most)
    for at in range(0, len(turns), step):
        angle, cos, sin = turns[at : at + step].T
        distance = np.floor(xs * cos[:, None] + ys * sin[:, None])
        low = distance.min(axis=1, keepdims=True)
        width = (distance.max(axis=1, keepdims=True) - low).max() + 1
        if width <= most:
            width, places = int(width), (distance - low).astype(np.int64)
        else:  # places far apart would make a long table of few points
            width, places = len(xs), np.stack([np.unique(d, return_inverse=True)[1] for d in distance])
        places = (places + width * np.arange(len(angle))[:, None]).ravel()
        votes = np.bincount(places)
        lines = np.flatnonzero(votes >= LEAST_VOTES)
        found.append((angle[lines // width], votes[lines], np.bincount(places, np.tile(xs, len(angle)))[lines] / votes[lines]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def axis_tilts(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tilt, method, lines, points) of edge points (keys, x, y), distinct pixels; y grows downwards, tilt is in degrees from the vertical.

    A line weighs by the square of its votes beyond LEAST_VOTES, more at the sides of the image's points and less in the middle, where
    print is; the tilt is the mean over the angles within two steps of the one with most weight, the smaller of equal ones
    (method hough).  Without a line it is that of the main axis of LEAST_POINTS points or more (method axis), else null (method none).
    Points with a null key or place don't count.
    """
    usable = dealt(points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), *keys).distinct()
    spans = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.min("x").alias("left"), F.greatest(F.max("x") - F.min("x"), F.lit(1.0)).alias("width"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
    )
    packed = usable.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    packed = packed.select(*keys, F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [voted_lines(np.asarray(xs), np.asarray(ys)) for xs, ys in zip(batch["xs"], batch["ys"], strict=True)]
            if rows:
                angle, votes, x = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield batch[keys].iloc[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])].assign(angle=angle, votes=votes, x=x)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema)
    lines = packed.mapInPandas(vote, f"{kinds}, angle double, votes long, x double")
    place = (F.col("x") - F.col("left")) / F.col("width")
    side = F.when((place <= 0.22) | (place >= 0.78), 2.2).when(place.between(0.35, 0.65), 0.55).otherwise(1.0)
    weighed = lines.hint("merge").join(spans.select(*keys, "left", "width"), keys).withColumn("weight", side * F.pow(F.col("votes") - LEAST_VOTES + 1, F.lit(2)))
    weights = weighed.groupBy(*keys, "angle").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("lines"))
    angle = F.struct("angle", "weight", "lines")  # at most as many an image as angles
    found = weights.groupBy(*keys).agg(F.max_by("angle", F.struct("weight", -F.col("angle"))).alias("peak"), F.sum("lines").alias("lines"), F.array_sort(F.collect_list(angle)).alias("a"))
    near = F.filter("a", lambda a: F.abs(a["angle"] - F.col("peak")) <= 2 * STEP)
    total = lambda of: F.aggregate("a", F.lit(0.0), lambda t, a: t + of(a))
    found = found.withColumn("a", near).select(*keys, "lines", (total(lambda a: a["weight"] * a["angle"]) / total(lambda a: a["weight"])).alias("hough"))
    axis = F.pmod(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2), F.lit(180.0)) - 90
    spread = F.when(F.col("points") >= LEAST_POINTS, F.when(axis <= -90, axis + 180).otherwise(axis))
    out = spans.hint("merge").join(found, keys, "left")
    method = F.when(F.col("hough").isNotNull(), "hough").when(spread.isNotNull(), "axis").otherwise("none")
    return out.select(*keys, F.coalesce("hough", spread).alias("tilt"), method.alias("method"), F.coalesce("lines", F.lit(0)).alias("lines"), "points")


def upright(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tilt, method, rotate, part, rest, reason): by how many degrees, counter-clockwise, each image is turned.

    Tilts of LEAST_TILT or more are corrected: all or parts of the tilt are tried on the points, and the first that leaves no more than
    SMALL_REST degrees, else the one that leaves least, is taken.  reason: rotated, below_threshold or no_axis.
    """
    found = written(axis_tilts(points, keys), "tilts")
    steep = found.filter(F.abs("tilt") >= LEAST_TILT).select(*keys, "tilt", F.explode(F.lit(list(PARTS))).alias("part"))
    turn = F.radians(F.col("tilt") * F.col("part"))
    # exploded points look small to the planner, which would gather them in the driver to send them to all tasks
    turned = points.select(*keys, "x", "y").hint("merge").join(steep, keys).select(*keys, "part", F.round(F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)).alias("x"), F.round(F.col("y") * F.cos(turn) - F.col("x") * F.sin(turn)).alias("y"))
    rests = axis_tilts(turned, [*keys, "part"]).select(*keys, "part", F.abs("tilt").alias("rest"))
    first = F.struct(F.when(F.col("rest") <= SMALL_REST, 0.0).otherwise(F.coalesce("rest", F.lit(999.0))), -F.col("part"))
    chosen = rests.groupBy(*keys).agg(F.min_by(F.struct("part", "rest"), first).alias("chosen"))
    reason = F.when(F.col("tilt").isNull(), "no_axis").when(F.abs("tilt") < LEAST_TILT, "below_threshold").otherwise("rotated")
    part = F.col("chosen.part")
    return found.hint("merge").join(chosen, keys, "left").select(*keys, "tilt", "method", F.coalesce(F.col("tilt") * part, F.lit(0.0)).alias("rotate"), part.alias("part"), F.col("chosen.rest").alias("rest"), reason.alias("reason"))


def rotation(width: Column, height: Column, degrees: Column) -> Column:
    """A struct (a, b, c, d, e, f, width, height): x' = a x + b y + c, y' = d x + e y + f turn an image about its centre onto a canvas that holds all of it."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    wide = F.floor(height * F.abs(sin) + width * F.abs(cos))
    high = F.floor(height * F.abs(cos) + width * F.abs(sin))
    shift_x, shift_y = wide / 2 - cos * width / 2 - sin * height / 2, high / 2 + sin * width / 2 - cos * height / 2
    return F.struct(cos.alias("a"), sin.alias("b"), shift_x.alias("c"), (-sin).alias("d"), cos.alias("e"), shift_y.alias("f"), wide.alias("width"), high.alias("height"))
