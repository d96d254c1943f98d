"""Gradient-boosted trees for a label of 0 or 1, grown from histograms of gradients that Spark adds up.

Features are cut into ranges by their quantiles once.  Each level of a tree is one aggregation: every partition sums the gradients
of its rows by node, feature and range, as whole numbers, so their sum doesn't depend on its order and the same rows always give
the same trees; only these sums, whose number is bounded by nodes x features x ranges, reach the driver.  The fitted trees are one
expression over the feature columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a feature, beside one for missing values.
RANGES = 32
#: Gradients are added up in steps of this size.
UNIT = 2.0**-24


@dataclass
class Tree:
    """Nodes by number from 1, the children of k being 2k and 2k + 1: the feature and last range that go left, or the value of a leaf."""

    cuts: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, places: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        at, last = np.ones(len(places), dtype=np.int64), max([1, *self.cuts]).bit_length()
        for _ in range(last):
            for k in [k for k in self.cuts if (at == k).any()]:
                here = at == k
                feature, last_left = self.cuts[k]
                at[here] = 2 * k + (places[here, feature] > last_left)
        return at


@dataclass
class Boosted:
    """Trees over named features; ``ends`` are the upper ends of each feature's ranges."""

    features: list[str]
    ends: list[list[float]]
    base: float
    trees: list[Tree]

    def raw(self, places: np.ndarray) -> np.ndarray:
        out = np.full(len(places), self.base)
        for tree in self.trees:
            value = np.zeros(2 * max([1, *tree.cuts, *tree.values]) + 2)
            value[list(tree.values)] = list(tree.values.values())
            out += value[tree.nodes(places)]
        return out

    def chance(self) -> Column:
        """The chance of label 1 as an expression over the feature columns; missing values go left."""

        def of(tree: Tree, k: int) -> Column:
            if k not in tree.cuts:
                return F.lit(tree.values[k])
            feature, last = tree.cuts[k]
            x = F.col(self.features[feature]).cast("double")
            missing = x.isNull() | F.isnan(x)
            left = missing | (x <= self.ends[feature][last - 1]) if last else missing
            return F.when(left, of(tree, 2 * k)).otherwise(of(tree, 2 * k + 1))

        # a balanced sum, which keeps the expression shallow
        parts = [F.lit(self.base), *[of(t, 1) for t in self.trees]]
        while len(parts) > 1:
            parts = [sum(parts[i + 1 : i + 2], parts[i]) for i in range(0, len(parts), 2)]
        return 1 / (1 + F.exp(-parts[0]))


def _sums(binned: DataFrame, model: Boosted, tree: Tree, active: list[int], width: int) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Sums of gradient and curvature by active node, feature and range."""
    cells = (RANGES + 1) * width

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slopes = np.zeros((2, len(active) * cells), dtype=np.int64)
        number = np.full(2 * max(active) + 2, -1)
        number[active] = range(len(active))
        for batch in batches:
            places = np.frombuffer(b"".join(batch["places"]), dtype=np.uint8).reshape(-1, width)
            chance = 1 / (1 + np.exp(-model.raw(places)))
            node = number[tree.nodes(places)]
            inside = node >= 0
            flat = (node[inside, None] * width + np.arange(width)) * (RANGES + 1) + places[inside]
            for k, slope in enumerate((chance - batch["label"].to_numpy(), chance * (1 - chance))):
                whole = np.rint(slope[inside] / UNIT)
                slopes[k] += np.bincount(flat.ravel(), np.repeat(whole, width), len(active) * cells).astype(np.int64)
        some = np.flatnonzero(slopes.any(axis=0))
        yield pd.DataFrame({"cell": some, "g": slopes[0, some], "h": slopes[1, some]})

    rows = binned.mapInPandas(count, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    return {(active[r["cell"] // cells], r["cell"] % cells // (RANGES + 1), r["cell"] % (RANGES + 1)): (r["g"], r["h"]) for r in rows}


def _grow(sums: dict[tuple[int, int, int], tuple[int, int]], tree: Tree, active: list[int], width: int, shrink: float, ridge: float, least: float, deeper: bool) -> list[int]:
    """Split the active nodes, or make leaves of them; the new nodes.  Of equal gains the first feature and range win."""
    new = []
    for k in active:
        table = np.zeros((2, width, RANGES + 1), dtype=np.int64)
        for (node, feature, place), slopes in sums.items():
            if node == k:
                table[:, feature, place] = slopes
        g, h = table * UNIT
        total_g, total_h = g[0].sum() if width else 0.0, h[0].sum() if width else 0.0
        left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
        gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
        if deeper and gain.size and gain.max() > 1e-9:
            feature, place = np.unravel_index(int(gain.argmax()), gain.shape)
            tree.cuts[k] = int(feature), int(place)
            new += [2 * k, 2 * k + 1]
        for child, (cg, ch) in ((2 * k, (left_g, left_h)), (2 * k + 1, (right_g, right_h))) if k in tree.cuts else ((k, (None, None)),):
            at = tree.cuts.get(k)
            g0, h0 = (total_g, total_h) if at is None else (cg[at], ch[at])
            tree.values[child] = float(-shrink * g0 / (h0 + ridge))
    return new


def fit_boosted(rows: DataFrame, features: list[str], label: str, trees: int = 60, depth: int = 3, shrink: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit on rows with the columns ``features`` (numbers) and ``label`` (0 or 1); rows without a label don't count.

    Missing values and NaN are a range of their own, below all others.  Nodes are split while both sides hold a curvature of
    ``least``.  Without rows, or with one label only, the chance is near the labels' share for all.  Rows are read once for each level of each tree,
    in a packed form that is kept in memory or on disk, and is computed anew where an executor is lost.
    """
    rows = rows.filter(F.col(label).isNotNull())
    values = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features]
    marks = [k / RANGES for k in range(1, RANGES)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("ones"), *[F.percentile_approx(v, marks, 10_000).alias(f"f{k}") for k, v in enumerate(values)]).first()
    ends = [sorted(set(found[f"f{k}"] or [])) for k in range(len(features))]
    share = min(max((found["ones"] or 0) / max(found["n"], 1), 1e-6), 1 - 1e-6)
    model = Boosted(list(features), ends, float(np.log(share / (1 - share))), [])
    if not found["n"]:
        return model

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([np.array(v, dtype=float) for v in batch]).reshape(len(batch), len(ends))
            out = np.zeros(x.shape, dtype=np.uint8)
            for k, e in enumerate(ends):
                out[:, k] = np.where(np.isnan(x[:, k]), 0, 1 + np.searchsorted(np.array(e), x[:, k], side="left"))
            yield pd.Series([r.tobytes() for r in out], dtype=object)

    place.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    nan = F.lit(float("nan"))
    binned = rows.select(F.col(label).cast("double").alias("label"), F.pandas_udf(place, "binary")(F.array(*[F.coalesce(v, nan) for v in values])).alias("places"))
    binned = binned.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(trees):
            tree, active = Tree(values={1: 0.0}), [1]
            for level in range(depth):
                if active:
                    sums = _sums(binned, model, tree, active, len(features))
                    active = _grow(sums, tree, active, len(features), shrink, ridge, least, deeper=level < depth)
            model.trees.append(tree)
    finally:
        binned.unpersist()
    return model
