"""Rectangles (x1, y1, x2, y2) as structs, and the rules that pick and merge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return F.greatest(box["x2"] - box["x1"], F.lit(0.0)) * F.greatest(box["y2"] - box["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def share_inside(inner: Column, outer: Column, size: Column | None = None) -> Column:
    """The share of ``inner``, whose area is ``size`` if given, that lies in ``outer``; 0 for an empty box."""
    size = area(inner) if size is None else size
    return F.when(size > 0, intersection(inner, outer) / size).otherwise(0.0)


def from_unit_scale(box: Column, width: Column, height: Column) -> Column:
    """A box on a scale of 0 to 1000 (y1, x1, y2, x2) in pixels, clamped; null if that leaves nothing."""
    at = lambda k, size: F.least(F.greatest(box[k] / 1000.0 * size, F.lit(0.0)), size)
    out = F.struct(at(1, width).alias("x1"), at(0, height).alias("y1"), at(3, width).alias("x2"), at(2, height).alias("y2"))
    return F.when(area(out) > 0, out)


def tilt(degrees: Column) -> Column:
    """An angle from the horizontal as a tilt from the upright, from -90 to 90."""
    return F.pmod(degrees, F.lit(180.0)) - 90


def center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def is_inside(inner: Column, outer: Column, slack: float = 0.0) -> Column:
    """Whether a box lies in another, up to some pixels."""
    return (inner["x1"] >= outer["x1"] - slack) & (inner["y1"] >= outer["y1"] - slack) & (inner["x2"] <= outer["x2"] + slack) & (inner["y2"] <= outer["y2"] + slack)


def are_close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether all four edges of two boxes are within a tolerance of each other."""
    return F.greatest(*[F.abs(a[k] - b[k]) for k in ("x1", "y1", "x2", "y2")]) <= tolerance


def transformed(box: Column, matrix: Column) -> Column:
    """The upright box around a box whose corners an affine matrix (two rows of three numbers) has moved."""
    at = lambda row, x, y: matrix[row][0] * x + matrix[row][1] * y + matrix[row][2]
    corners = [(box[x], box[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    xs, ys = [at(0, x, y) for x, y in corners], [at(1, x, y) for x, y in corners]
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))


def overlap_join(inner: DataFrame, outer: DataFrame, image: str, least: float) -> DataFrame:
    """Pairs of boxes (columns ``box`` and an id, ``inner_id`` or ``outer_id``) of one image where enough of the inner lies in the outer."""
    pairs = inner.withColumnRenamed("box", "inner_box").join(outer.withColumnRenamed("box", "outer_box"), image)
    share = share_inside(F.col("inner_box"), F.col("outer_box"))
    return pairs.withColumn("share", share).filter(F.col("share") >= least)


def merge_labels(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of one bottle as one: from the topmost's upper edge to the lowest's lower edge, as wide as all, the best confidence."""
    box = F.col("box")
    return assigned.groupBy(*keys).agg(
        F.struct(F.min(box["x1"]).alias("x1"), F.min(box["y1"]).alias("y1"), F.max(box["x2"]).alias("x2"), F.max(box["y2"]).alias("y2")).alias("box"),
        F.max("conf").alias("conf"),
        F.count(F.lit(1)).alias("n"),
    )


def primary_box(boxes: DataFrame, image: str) -> DataFrame:
    """The largest box of each image, the surer of equals, then that with the smallest id."""
    order = Window.partitionBy(image).orderBy(area(F.col("box")).desc(), F.col("conf").desc_nulls_last(), "id")
    return boxes.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def drop_weak(boxes: DataFrame, image: str, least: float) -> DataFrame:
    """Boxes above a confidence, where an image has any and more than one box; all others stay."""
    per = Window.partitionBy(image)
    sure = F.max(F.col("conf")).over(per) > least
    return boxes.withColumn("_drop", (F.count(F.lit(1)).over(per) > 1) & sure & (F.col("conf") <= least)).filter("not _drop").drop("_drop")


# When a label is an orphan, when it belongs to a bottle, and which of several is taken.
ORPHAN_OUTSIDE, ORPHAN_CONF, ORPHAN_PEER = 0.5, 0.5, 0.5
BELONGS, MERGE_FROM = 0.85, 2
SIMILAR_AREAS, HALF_SIZE, CONF_GAP, WEAK_CONF, WEAK_GAP, WEAK_AREA = 0.12, 0.5, 0.9, 0.55, 0.15, 0.25
NECK, IN_BOTTLE, TOP_TRIM, TOP_TRIM_MOST = 0.20, 0.90, 0.18, 0.35
SILHOUETTE_HEIGHT, SILHOUETTE_CONF, LABELLED_CONF, LABELLED_GAP = 0.85, 0.55, 0.55, 0.20


def best_share(labels: DataFrame, bottles: DataFrame, image: str) -> DataFrame:
    """``labels`` (image, id, box, conf) with best, the largest share of each that lies in a bottle (image, bottle_id, bottle_box) of its image; 0 without one."""
    pairs = labels.join(bottles.select(image, "bottle_box"), image, "left")
    share = F.coalesce(share_inside(F.col("box"), F.col("bottle_box")), F.lit(0.0))
    return pairs.groupBy(*labels.columns).agg(F.max(share).alias("best"))


def drop_orphans(labels: DataFrame, bottles: DataFrame, image: str, outside: float = ORPHAN_OUTSIDE, most_conf: float = ORPHAN_CONF, peer: float = ORPHAN_PEER) -> DataFrame:
    """``labels`` without those of low confidence that lie mostly outside all bottles, where another label of the image lies in one."""
    shares = best_share(labels, bottles, image)
    others = F.sum((F.col("best") >= peer).cast("int")).over(Window.partitionBy(image)) - (F.col("best") >= peer).cast("int")
    bottled = shares.join(bottles.select(image).distinct().withColumn("_has", F.lit(True)), image, "left").withColumn("_others", others)
    orphan = F.coalesce(F.col("_has"), F.lit(False)) & (F.col("best") <= outside) & (F.coalesce("conf", F.lit(0.0)) <= most_conf) & (F.col("_others") > 0)
    return bottled.filter(~orphan).select(*labels.columns)


def assigned_to_bottles(labels: DataFrame, bottles: DataFrame, image: str, least: float = BELONGS) -> DataFrame:
    """``labels`` (image, id, box, conf) with bottle_id: the first bottle of the image, by its id, that holds enough of each label; null for none."""
    pairs = labels.join(bottles.select(image, "bottle_id", "bottle_box"), image, "left")
    held = F.when(share_inside(F.col("box"), F.col("bottle_box")) >= least, F.col("bottle_id"))
    return pairs.groupBy(*labels.columns).agg(F.min(held).alias("bottle_id"))


def merged_by_bottle(labels: DataFrame, bottles: DataFrame, image: str) -> DataFrame:
    """(image, box, conf, n): the labels of one bottle as one box where it has two or more, all others as they are."""
    rows = assigned_to_bottles(labels, bottles, image)
    several = F.count(F.lit(1)).over(Window.partitionBy(image, "bottle_id")) >= MERGE_FROM
    own = F.when(F.col("bottle_id").isNotNull() & several, F.struct(F.lit(0).alias("alone"), F.col("bottle_id").alias("key"))).otherwise(F.struct(F.lit(1).alias("alone"), F.col("id").alias("key")))
    return merge_labels(rows.withColumn("_own", own), [image, "_own"]).drop("_own")


def primary_label(labels: DataFrame, image: str) -> DataFrame:
    """(image, id, box, conf, reason): the label of each image that is cropped.

    The largest, but the middle one of three alike in size; the next by size if it is much surer and over half as large; or if the largest is weak, surer and over a
    quarter as large.  Equal sizes go by id.
    """
    size = F.struct((-area(F.col("box"))).alias("a"), "id", "box", "conf")
    top = labels.groupBy(image).agg(F.array_sort(F.collect_list(size)).alias("by"))
    first, second, third = (F.get("by", F.lit(k)) for k in range(3))
    a0, a1, a2 = (-x["a"] for x in (first, second, third))
    c0, c1 = (F.coalesce(x["conf"], F.lit(0.0)) for x in (first, second))
    n = F.size("by")
    middle = (n == 3) & (a2 > 0) & ((a0 - a2) / a0 <= SIMILAR_AREAS)
    half = (n >= 2) & (a0 > 0) & (a1 <= HALF_SIZE * a0)
    surer = (n >= 2) & (c1 - c0 >= CONF_GAP)
    weak = (n >= 2) & (c0 < WEAK_CONF) & (c1 - c0 >= WEAK_GAP) & (a0 > 0) & (a1 > WEAK_AREA * a0)
    pick = lambda x, why: F.struct(x["id"].alias("id"), x["box"].alias("box"), x["conf"].alias("conf"), F.lit(why).alias("reason"))
    chosen = F.when(middle, pick(second, "middle_of_three_similar")).when(half, pick(first, "largest_vs_half_size")).when(surer, pick(second, "next_by_size_higher_conf"))
    chosen = chosen.when(weak, pick(second, "next_by_size_weak_largest")).otherwise(pick(first, "largest"))
    return top.select(image, chosen.alias("c")).select(image, "c.*")


def on_body(label: Column, conf: Column, bottle: Column) -> Column:
    """Whether a label is one of a bottle's body: nine tenths of it in the bottle, its middle below the neck, and no weak box of almost the bottle's height."""
    height = F.nullif(bottle["y2"] - bottle["y1"], F.lit(0.0))
    middle = (center(label)["y"] - bottle["y1"]) / height
    silhouette = (F.coalesce(conf, F.lit(0.0)) < SILHOUETTE_CONF) & ((label["y2"] - label["y1"]) / height >= SILHOUETTE_HEIGHT)
    return (share_inside(label, bottle) >= IN_BOTTLE) & ~F.coalesce(silhouette, F.lit(False)) & (F.coalesce(middle, F.lit(1.0)) >= NECK)


def primary_bottle(bottles: DataFrame, labels: DataFrame, image: str) -> DataFrame:
    """(image, bottle_id, bottle_box): the largest bottle of each image, or the one with the surest label on its body, if that is sure and much surer than the largest's own.

    bottles: image, bottle_id, bottle_box, bottle_conf; labels: image, box, conf.  Equal bottles go by confidence, then id.
    """
    pairs = bottles.join(labels.select(image, "box", "conf"), image, "left")
    best = F.max(F.when(on_body(F.col("box"), F.col("conf"), F.col("bottle_box")), F.coalesce("conf", F.lit(0.0))))
    rated = pairs.groupBy(image, "bottle_id", "bottle_box", "bottle_conf").agg(F.coalesce(best, F.lit(-1.0)).alias("label_conf"))
    rated = rated.withColumn("size", area(F.col("bottle_box")))
    row = F.struct("bottle_id", "bottle_box", "label_conf")
    by_size = F.min_by(row, F.struct((-F.col("size")).alias("s"), (-F.coalesce("bottle_conf", F.lit(0.0))).alias("c"), "bottle_id"))
    by_label = F.min_by(row, F.struct((-F.col("label_conf")).alias("l"), (-F.col("size")).alias("s"), "bottle_id"))
    found = rated.groupBy(image).agg(by_size.alias("large"), by_label.alias("labelled"))
    sure = (F.col("labelled.label_conf") >= LABELLED_CONF) & (F.col("labelled.label_conf") - F.greatest(F.col("large.label_conf"), F.lit(0.0)) >= LABELLED_GAP)
    chosen = F.when(sure, F.col("labelled")).otherwise(F.col("large"))
    return found.select(image, chosen["bottle_id"].alias("bottle_id"), chosen["bottle_box"].alias("bottle_box"))


def crop_boxes(labels: DataFrame, bottles: DataFrame, image: str, least_conf: float = 0.6) -> DataFrame:
    """(image, box, reason): what of each image with bottles is cropped: the primary label on the body of its primary bottle, else that bottle's body.

    bottles: image, bottle_id, bottle_box, bottle_conf; where an image has several, weak ones don't count unless all are.  A bottle's body begins below the labels on
    its neck and those that stick out of all bottles, within bounds.
    """
    strong = drop_weak(bottles.withColumnRenamed("bottle_conf", "conf"), image, least_conf).withColumnRenamed("conf", "bottle_conf")
    chosen = primary_bottle(strong, labels, image).select(image, F.col("bottle_box").alias("bottle"))
    pairs = best_share(labels, strong, image).join(chosen, image)
    body = pairs.filter(on_body(F.col("box"), F.col("conf"), F.col("bottle")))
    picked = primary_label(body.select(*labels.columns), image).select(image, F.col("box").alias("picked"), F.col("reason").alias("why"))
    own = share_inside(F.col("box"), F.col("bottle")) >= IN_BOTTLE
    left_out = (F.col("best") < IN_BOTTLE) | (own & ~on_body(F.col("box"), F.col("conf"), F.col("bottle")))
    crosses = (F.col("box")["y2"] > F.col("bottle")["y1"]) & (F.col("box")["y1"] < F.col("bottle")["y2"])
    high = center(F.col("box"))["y"] <= F.col("bottle")["y1"] + NECK * (F.col("bottle")["y2"] - F.col("bottle")["y1"])
    neck = pairs.filter(left_out & crosses & high).groupBy(image).agg(F.max(F.col("box")["y2"]).alias("neck"))
    rows = chosen.join(picked, image, "left").join(neck, image, "left")
    height = F.col("bottle")["y2"] - F.col("bottle")["y1"]
    top = F.col("bottle")["y1"] + TOP_TRIM * height
    begin = F.least(F.greatest(top, F.coalesce("neck", top)), F.col("bottle")["y1"] + TOP_TRIM_MOST * height)
    rest = F.struct(F.col("bottle")["x1"].alias("x1"), F.when(begin >= F.col("bottle")["y2"] - 2, top).otherwise(begin).alias("y1"), F.col("bottle")["x2"].alias("x2"), F.col("bottle")["y2"].alias("y2"))
    box = F.when(F.col("picked").isNotNull(), F.col("picked")).otherwise(rest)
    return rows.select(image, box.alias("box"), F.coalesce(F.concat("why", F.lit("_on_primary_bottle")), F.lit("bottle_body_fallback")).alias("reason"))


def cut_rects(crop: DataFrame, foreign: DataFrame, image: str) -> DataFrame:
    """(image, rects): the parts of each crop (image, box) that labels of other bottles (image, box) cover, in the crop's own coordinates, from top to bottom."""
    pairs = crop.select(image, F.col("box").alias("crop")).join(foreign.select(image, "box"), image)
    part = F.struct(*[(f(F.col("box")[k], F.col("crop")[k]) - F.col("crop")[o]).alias(k) for f, k, o in ((F.greatest, "y1", "y1"), (F.greatest, "x1", "x1"), (F.least, "y2", "y1"), (F.least, "x2", "x1"))])
    return pairs.filter(intersection(F.col("crop"), F.col("box")) > 0).groupBy(image).agg(F.array_sort(F.collect_list(part)).alias("rects"))


# What a label of another bottle may cover of a crop to be cut out of it, and how large the cut must be.
SAME_LABEL, INSIDE_SLACK, OWNS = 3.0, 1.0, 0.5
MOST_COVERED, WITHIN, MOST_CUT, LEAST_CUT_AREA, LEAST_CUT_SIDE = 0.20, 0.98, 0.35, 400.0, 4.0


def label_area(labels: DataFrame) -> Column:
    """The area of each label: its column ``area`` if there is one, else that of its box."""
    return F.col("area") if "area" in labels.columns else area(F.col("box"))


def owning_bottle(labels: DataFrame, bottles: DataFrame, image: str, key: list[str]) -> DataFrame:
    """(image, key, owner, owner_share): the bottle that holds most of each label (image, key, box, area if measured), the first by its id of equals; null with less than half of the label."""
    pairs = labels.select(image, *key, "box", label_area(labels).alias("size")).join(bottles.select(image, "bottle_id", "bottle_box"), image)
    shares = pairs.withColumn("share", share_inside(F.col("box"), F.col("bottle_box"), F.col("size"))).filter(F.col("share") >= OWNS)
    best = F.max_by(F.struct("bottle_id", "share"), F.struct("share", (-F.col("bottle_id")).alias("b"))).alias("best")
    return shares.groupBy(image, *key).agg(best).select(image, *key, F.col("best.bottle_id").alias("owner"), F.col("best.share").alias("owner_share"))


def foreign_cuts(crops: DataFrame, labels: DataFrame, bottles: DataFrame, image: str, primary: DataFrame | None = None) -> DataFrame:
    """(image, id, cut, owner, owner_share, covered, inside): what labels of other bottles cover of each image's crop, and is cut out of it, in the image's coordinates.

    crops: image, box, one an image; labels: image, id, box, conf; both with area if it was measured before the boxes were scaled, since a share at a gate's bound depends on it; bottles: image, bottle_id, bottle_box, bottle_conf; primary: image, bottle_id, by default ``primary_bottle``.
    The crop's own bottle is the one that holds half of it or more, else the primary one; without either nothing is cut.  A label is cut if another bottle holds half of it
    or more and most of it, it isn't the crop itself (up to SAME_LABEL pixels), it doesn't lie inside the crop, by its box or by WITHIN of its area, it covers at most MOST_COVERED
    of the crop, and what it covers is no sliver.  Empty boxes cut nothing and aren't cut.
    """
    first = (primary if primary is not None else primary_bottle(bottles, labels, image)).select(image, F.col("bottle_id").alias("first"))
    own = owning_bottle(crops, bottles, image, []).select(image, F.col("owner").alias("held_by"))
    held = crops.select(image, F.col("box").alias("crop"), label_area(crops).alias("crop_size")).join(own, image, "left").join(first, image, "left").withColumn("own", F.coalesce("held_by", "first")).filter("own is not null")
    owned = owning_bottle(labels, bottles, image, ["id"])
    rows = labels.select(image, "id", "box", label_area(labels).alias("size")).join(owned, [image, "id"]).join(held, image)
    box, crop = F.col("box"), F.col("crop")
    cut = F.struct(*[f(box[k], crop[k]).alias(k) for f, k in ((F.greatest, "x1"), (F.greatest, "y1"), (F.least, "x2"), (F.least, "y2"))])
    same = F.lit(True)
    for k in ("x1", "y1", "x2", "y2"):
        same = same & (F.abs(box[k] - crop[k]) <= SAME_LABEL)
    rows = rows.withColumns({"cut": cut, "_area": intersection(box, crop), "covered": safe_share(intersection(box, crop), F.col("crop_size")), "inside": safe_share(intersection(box, crop), F.col("size"))})
    wide, high = F.col("cut")["x2"] - F.col("cut")["x1"], F.col("cut")["y2"] - F.col("cut")["y1"]
    gates = [
        F.col("owner") != F.col("own"), ~same, ~is_inside(box, crop, INSIDE_SLACK), F.col("inside") < WITHIN, F.col("covered") <= F.least(F.lit(MOST_COVERED), F.lit(MOST_CUT)),
        (F.col("_area") >= LEAST_CUT_AREA) & (wide >= LEAST_CUT_SIDE) & (high >= LEAST_CUT_SIDE),
    ]
    for gate in gates:
        rows = rows.filter(gate)
    return rows.select(image, "id", "cut", "owner", "owner_share", "covered", "inside")


def safe_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)
