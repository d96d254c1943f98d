"""Boosted trees against a plain version on all rows, and against logistic regression on held-out pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.operators import boosting


def plain_first_cut(places, labels, ridge=1.0, least=1.0):
    """The first tree's first cut, by trying every feature and range."""
    p = labels.mean()
    g, h = p - labels, np.full(len(labels), p * (1 - p))
    best = None
    for f in range(places.shape[1]):
        for r in range(boosting.RANGES):
            left = places[:, f] <= r
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[~left].sum() ** 2 / (h[~left].sum() + ridge) - g.sum() ** 2 / (h.sum() + ridge)
            if best is None or gain > best[0] + 1e-6:
                best = gain, f, r
    return best[1:]


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(3)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    y = np.where(rng.random(n) < 0.03, 1 - y, y)
    rows = [(i, *[float(v) if rng.random() > 0.02 else None for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return rows, "id int, a double, b double, c double, d double, y int"


def test_trees(spark):
    rows, schema = _rows(1500, 1)
    df = spark.createDataFrame(rows, schema).repartition(4)
    model = boosting.fit_boosted(df, ["a", "b", "c", "d"], "y", trees=25, depth=3, shrink=0.3)
    again = boosting.fit_boosted(df.repartition(3, "c"), ["a", "b", "c", "d"], "y", trees=25, depth=3, shrink=0.3)
    assert again == model and len(model.trees) == 25  # the same rows, dealt otherwise, give the same trees
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows])
    places = np.stack([np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(model.ends[k], x[:, k])) for k in range(4)], axis=1).astype(np.uint8)
    assert model.trees[0].cuts[1] == plain_first_cut(places, np.array([r[5] for r in rows], dtype=float))
    scored = df.select("id", model.chance().alias("p")).toPandas().set_index("id")["p"].loc[range(1500)].to_numpy()
    assert np.allclose(scored, 1 / (1 + np.exp(-model.raw(places))))  # the expression says what the trees do
    fresh, _ = _rows(600, 2)
    test = spark.createDataFrame(fresh, schema).select("y", model.chance().alias("p")).toPandas()
    assert ((test["p"] > 0.5) == test["y"]).mean() > 0.9


def test_odd_tables(spark):
    rows, schema = _rows(60, 3)
    df = spark.createDataFrame(rows, schema)
    nothing = boosting.fit_boosted(df.limit(0), ["a"], "y")
    assert nothing.trees == [] and df.select(nothing.chance().alias("p")).first()["p"] < 1e-5
    ones = boosting.fit_boosted(df.withColumn("y", F.lit(1)), ["a", "b"], "y", trees=2)
    assert df.select(F.min(ones.chance())).first()[0] > 0.99
    holes = df.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(float("nan")), "c": F.lit(1.0), "places": F.lit("x")}).unionByName(df.withColumns({"y": F.lit(None).cast("int"), "places": F.lit("x")}))
    flat = boosting.fit_boosted(holes, ["a", "b", "c"], "y", trees=2)
    share = sum(r[5] for r in rows) / 60
    assert holes.select(F.max(flat.chance())).first()[0] == pytest.approx(share, abs=0.02)


def test_pairs_are_scored_better_than_by_a_line(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from linkfold.plans import scan_queries

    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = scan_queries._labelled_pairs(table).cache()
    got = scan_queries.boosted_pairs(table).filter("held_out").toPandas()
    loss = lambda y, p: -np.mean([math.log(max(q if t else 1 - q, 1e-6)) for t, q in zip(y, p)])
    features = [c for c in rows.columns if c not in ("id", "query", "reference", "y")]
    vectors = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    vectors = StandardScaler(inputCol="raw", outputCol="v").fit(vectors).transform(vectors)
    line = LogisticRegression(featuresCol="v", labelCol="y", maxIter=100, regParam=0.01).fit(vectors.filter("id % 5 > 0"))
    other = line.transform(vectors.filter("id % 5 = 0")).select("y", "probability").collect()
    ours, theirs = loss(got["y"], got["chance"]), loss([r["y"] for r in other], [r["probability"][1] for r in other])
    print(ours, theirs)
    assert len(got) == len(other) and ours < theirs
