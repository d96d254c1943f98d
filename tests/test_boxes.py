"""Cuts of foreign labels, gate by gate, and nearly equal tokens against all pairs."""

import random

import pytest

from linkfold.functions import boxes
from linkfold.functions.similarity import near_equal
from linkfold.operators import linking
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CROP = (100.0, 100.0, 300.0, 300.0)


@pytest.mark.parametrize(
    "label, cut",
    [
        ((280.0, 150.0, 420.0, 250.0), (280.0, 150.0, 300.0, 250.0)),  # the neighbour's label reaches into the crop
        ((310.0, 150.0, 420.0, 250.0), None),  # it doesn't
        ((150.0, 150.0, 200.0, 200.0), None),  # inside the crop
        ((102.0, 99.0, 301.0, 298.0), None),  # the crop itself
        ((240.0, 100.0, 420.0, 300.0), None),  # covers 30 %
        ((296.0, 100.0, 420.0, 190.0), None),  # under 400 pixels
        ((298.0, 100.0, 420.0, 300.0), None),  # a sliver of two columns
        ((285.0, 290.0, 420.0, 420.0), None),  # a corner of 150 pixels
        ((90.0, 280.0, 310.0, 300.5), None),  # nearly all of its area inside the crop
        ((60.0, 250.0, 180.0, 420.0), None),  # of no bottle by half
    ],
)
def test_gates_of_foreign_cuts(spark, label, cut):
    bottles = spark.createDataFrame([(1, 7, (80.0, 0.0, 305.0, 400.0), 0.9), (1, 8, (270.0, 0.0, 500.0, 400.0), 0.9), (2, 7, (0.0, 0.0, 9.0, 9.0), 0.9)], f"image int, bottle_id long, bottle_box {BOX}, bottle_conf double")
    labels = spark.createDataFrame([(1, 1, CROP, 0.9), (1, 2, label, 0.8), (3, 3, label, 0.8)], f"image int, id long, box {BOX}, conf double")
    crops = spark.createDataFrame([(1, CROP), (2, CROP), (3, CROP)], f"image int, box {BOX}")
    rows = boxes.foreign_cuts(crops, labels, bottles, "image").collect()
    assert [(r["image"], r["id"], tuple(r["cut"]), r["owner"]) for r in rows] == ([(1, 2, cut, 8)] if cut else [])
    if cut:
        assert rows[0]["covered"] == pytest.approx(20 * 100 / 200**2) and rows[0]["inside"] == pytest.approx(20 / 140)
    assert boxes.foreign_cuts(crops.limit(0), labels, bottles, "image").count() == 0 == boxes.foreign_cuts(crops, labels, bottles.limit(0), "image").count()


def test_primary_bottle_owns_a_crop_of_none(spark):
    bottles = spark.createDataFrame([(1, 7, (0.0, 0.0, 150.0, 500.0), 0.9), (1, 8, (290.0, 0.0, 400.0, 400.0), 0.9)], f"image int, bottle_id long, bottle_box {BOX}, bottle_conf double")
    labels = spark.createDataFrame([(1, 2, (280.0, 150.0, 420.0, 250.0), 0.8)], f"image int, id long, box {BOX}, conf double")
    crops = spark.createDataFrame([(1, CROP)], f"image int, box {BOX}")
    assert [r["owner"] for r in boxes.foreign_cuts(crops, labels, bottles, "image").collect()] == [8]  # bottle 7 is the larger one
    own = spark.createDataFrame([(1, 8)], "image int, bottle_id long")
    assert boxes.foreign_cuts(crops, labels, bottles, "image", own).count() == 0


def test_near_equal_tokens_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    words = set()
    for _ in range(60):
        w = [rng.choice("abcd") for _ in range(rng.choice([4, 5, 6, 9, 12, 30]))]
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(4)):
                p = rng.randrange(len(v))
                what = rng.randrange(3)
                v[p : p + (what != 1)] = [] if what == 0 else [rng.choice("abcde")]
            words.add("".join(v))
    table = spark.createDataFrame([(w,) for w in [*words, *words, None, "", "abc"]], "token string")
    a, b = table.select(F.col("token").alias("a")).distinct(), table.select(F.col("token").alias("b")).distinct()
    want = a.crossJoin(b).filter((F.col("a") < F.col("b")) & (F.length("a") >= 4) & (F.length("b") >= 4) & near_equal(F.col("a"), F.col("b")))
    got = sorted(map(tuple, linking.near_equal_tokens(table).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 60
