"""Exact cosine search of query vectors in a catalogue of vectors, and the joins built on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkfold.operators.tables import written

#: Query components that are broadcast at most (32 MB of doubles), and best rows that a task keeps at most; more queries are searched for in blocks.
BLOCK_COMPONENTS, BLOCK_BEST = 4_000_000, 1_000_000
#: Cosines that a task holds at once (8 MB of doubles), whatever the numbers of queries and rows.
CELLS = 1_000_000


class Best:
    """The ``n`` best of the rows seen so far for each of some queries (sorted ids, a row each of ``matrix``)."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, n: int, exclude_self: bool) -> None:
        self.ids, self.matrix, self.n, self.exclude_self = ids, matrix, n, exclude_self
        self.lengths = np.linalg.norm(matrix, axis=1)
        self.cosines, self.rows = np.full((len(ids), n), -np.inf), np.full((len(ids), n), np.iinfo(np.int64).max)

    def add(self, own: np.ndarray, vectors: np.ndarray) -> None:
        lengths = np.linalg.norm(vectors, axis=1)
        step = max(1, CELLS // max(1, len(own)))
        for a in range(0, len(self.ids), step):
            z = min(a + step, len(self.ids))
            cosine = self.matrix[a:z] @ vectors.T
            cosine /= np.maximum(self.lengths[a:z, None] * lengths, 1e-12)
            np.round(cosine, 6, out=cosine)
            np.nan_to_num(cosine, copy=False, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
            if self.exclude_self:
                cosine[self.ids[a:z, None] == own] = -np.inf
            least = self.cosines[a:z, -1].copy()
            if len(own) > self.n:  # of a query without n rows yet, only what this batch's own best can hold
                few = np.flatnonzero(least == -np.inf)
                if len(few):
                    least[few] = np.partition(cosine[few], len(own) - self.n, axis=1)[:, len(own) - self.n]
            q, k = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
            if len(q):
                self._merge(a, q, cosine[q, k], own[k])

    def _merge(self, a: int, q: np.ndarray, cosine: np.ndarray, rows: np.ndarray) -> None:
        some = np.unique(q)
        every = np.concatenate([np.repeat(some, self.n), q])
        cosines, ids = np.concatenate([self.cosines[a + some].ravel(), cosine]), np.concatenate([self.rows[a + some].ravel(), rows])
        order = np.lexsort((ids, -cosines, every))
        first = np.searchsorted(every[order], some)
        kept = order[first[:, None] + np.arange(self.n)]
        self.cosines[a + some], self.rows[a + some] = cosines[kept], ids[kept]

    def found(self, least: float) -> pd.DataFrame:
        q, k = np.nonzero((self.cosines > -np.inf) & (self.cosines >= least))
        return pd.DataFrame({"query_id": self.ids[q], "id": self.rows[q, k], "cosine": self.cosines[q, k]})


def knn(queries: DataFrame, catalog: DataFrame, n: int, exclude_self: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, id, cosine, pos): the ``n`` nearest of ``catalog`` (id, vector) to each of ``queries`` (id, vector).

    A stated set of queries is taken in blocks of bounded size against all rows of the catalogue.  A task multiplies its rows by some queries at a
    time and keeps the best ``n`` for each query, so what it holds is bounded and what is shuffled is ``n`` rows for each query and task.  Ties go to the smaller
    id.  Vectors that are null, hold nulls or differ in length from the query match nothing.
    """
    spark, totals = queries.sparkSession, queries.agg(F.sum(F.size("vector")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks, found = max(1, math.ceil((totals["n"] or 0) / BLOCK_COMPONENTS), math.ceil(totals["rows"] * n / BLOCK_BEST)), None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r["id"], r["vector"]) for r in block.select("id", "vector").collect() if r["vector"] and None not in r["vector"]]
        by_size: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: r[0]):
            by_size.setdefault(len(row[1]), []).append(row)
        held = spark.sparkContext.broadcast({k: (np.array([i for i, _ in v]), np.array([x for _, x in v], dtype=np.float64)) for k, v in by_size.items()})

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            best = {size: Best(ids, matrix, n, exclude_self) for size, (ids, matrix) in held.value.items()}
            for batch in batches:
                for size, kept in best.items():
                    part = batch[[v is not None and len(v) == size for v in batch["vector"]]]
                    step = max(1, CELLS // size)
                    for a in range(0, len(part), step):
                        own, vectors = part["id"].to_numpy()[a : a + step], np.stack(part["vector"].to_numpy()[a : a + step]).astype(np.float64)
                        whole = ~np.isnan(vectors).any(axis=1)
                        if whole.any():
                            kept.add(own[whole], vectors[whole])
            for kept in best.values():
                yield kept.found(-2 if least is None else least)

        near = catalog.select("id", "vector").mapInPandas(search, "query_id long, id long, cosine double")
        if blocks > 1:  # a block's few best rows are written, and its vectors released before the next block's are sent
            near = written(near, "near")
            held.unpersist()
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def with_reuse(hits: DataFrame, previous: DataFrame, cosine_of_winner: DataFrame, least: float = 0.5) -> DataFrame:
    """``hits`` (query_id, id, cosine) and, for each query, the winner of its nearest earlier query, as one more row with reused = true.

    previous: query_id, previous_id, winner_id, previous_cosine; cosine_of_winner: query_id, id, cosine.  The row's cosine is the winner's own, else that
    of the earlier query.  It is added, so an id may come twice, and never takes a hit's place.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("previous_cosine"), "previous_id")
    nearest = previous.filter(F.col("winner_id").isNotNull()).withColumn("r", F.row_number().over(order)).filter(f"r = 1 and previous_cosine >= {least}")
    own = cosine_of_winner.select("query_id", F.col("id").alias("winner_id"), F.col("cosine").alias("own"))
    extra = nearest.join(own, ["query_id", "winner_id"], "left")
    extra = extra.select("query_id", F.col("winner_id").alias("id"), F.coalesce("own", "previous_cosine").alias("cosine"), F.lit(True).alias("reused"))
    return hits.select("query_id", "id", "cosine", F.lit(False).alias("reused")).unionByName(extra)


def channel_max(hits: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The best score of each candidate over its channels, and in how many it occurs."""
    return hits.groupBy(*keys).agg(F.max(score).alias(score), F.count_distinct("channel").alias("channels"))


def first_seen_union(*lists: DataFrame, key: str = "id", query: str = "query_id") -> DataFrame:
    """Candidates of several ordered lists (with ``pos``), each once, in the order in which they are first seen."""
    both = None
    for k, part in enumerate(lists):
        part = part.select(query, key, F.struct(F.lit(k).alias("list"), "pos").alias("seen"))
        both = part if both is None else both.unionByName(part)
    once = both.groupBy(query, key).agg(F.min("seen").alias("seen"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy("seen", key))).drop("seen")


def argmax(rows: DataFrame, keys: list[str], score: Column, pos: str = "pos") -> DataFrame:
    """Of each group the row with the best score, the first in candidate order of equals; rows with a null score don't count."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(score, -F.col(pos)))
    return rows.filter(score.isNotNull()).groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
