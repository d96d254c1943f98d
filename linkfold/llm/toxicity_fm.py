"""Toxicity by a factorization machine over hashed terms.

A term is a word or one of its beginnings, hashed; terms that set toxic documents apart are selected by chi-square over counts.
Beside a weight, each term has a vector of factors, and the product of two terms' vectors weighs their common occurrence: an insult
together with a group's name, say, which a sum of weights misses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

HASH_BITS = 22
#: At most so many labelled rows, those with the smallest hashed doc_id, are fitted on.
MAX_TRAINING_ROWS = 20_000
SELECTED_TERMS = 4_096
FACTORS = 8
_LIMIT = 100_000
_STRIPPED = ".,;:!?\"'()[]{}<>*%$&#@-_/\\|`~«»¿¡…"


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself and its first four, five and six letters."""
    word = word.strip(_STRIPPED).lower()
    if not word:
        return ()
    parts = {"=" + word} | {word[:k] for k in (4, 5, 6) if len(word) >= k}
    return tuple(sorted({xxhash.xxh32_intdigest(p) >> (32 - HASH_BITS) for p in parts}))


class TermReader:
    """Terms of whole texts, with common words remembered; ``places`` keeps only some terms and gives their place."""

    def __init__(self, places: dict[int, int] | None = None):
        self.places = places
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = word_terms(word)
        if self.places is not None:
            found = tuple(self.places[t] for t in found if t in self.places)
        if len(self.known) < _LIMIT:
            self.known[word] = found
        return found

    def read(self, text: str | None) -> list[int]:
        words = set(text.split()) if text else ()
        out: set[int] = set()
        for word in words:
            found = self.known.get(word)
            if found is None:
                found = self.word(word)
            if found:
                out.update(found)
        return sorted(out)


@dataclass
class Model:
    places: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Chance of label 1 for rows of places."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], dtype=np.int64)
        raw = np.full(len(rows), self.bias)
        if len(flat):
            v = self.factors[flat]
            total = np.zeros((len(rows), self.factors.shape[1]))
            square = np.zeros(len(rows))
            np.add.at(total, owner, v)
            np.add.at(square, owner, (v * v).sum(axis=1))
            raw = raw + np.bincount(owner, self.weights[flat], len(rows)) + 0.5 * ((total * total).sum(axis=1) - square)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: Sequence[Sequence[int]], toxic: np.ndarray, places: dict[int, int], epochs: int = 20, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Fit a factorization machine by minibatches of Adam steps on the logistic loss; the same rows give the same model."""
    n, rng = len(places), np.random.default_rng(7)
    share = min(max(toxic.mean(), 1e-3), 1 - 1e-3) if len(toxic) else 1e-3
    params = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(n), "v": rng.normal(0, 0.02, (n, FACTORS))}
    first = {k: np.zeros_like(p) for k, p in params.items()}
    second = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    for _ in range(epochs if n and len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            owner = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            flat = np.concatenate([np.asarray(rows[i], dtype=np.int64) for i in part])
            b, w, v = params["b"], params["w"], params["v"]
            vs = v[flat]
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, owner, vs)
            raw = b[0] + np.bincount(owner, w[flat], len(part)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(owner, (vs**2).sum(axis=1), len(part)))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic[part]) / len(part)
            gw = np.bincount(flat, error[owner], n) + decay * w
            gv = decay * v
            np.add.at(gv, flat, error[owner, None] * (total[owner] - vs))
            step += 1
            for k, g in (("b", np.array([error.sum()])), ("w", gw), ("v", gv)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(places, float(params["b"][0]), params["w"], params["v"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is never fitted on: crc32 of its doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out: a bounded sample of them, but whole texts.

    docs: doc_id, text; labels: doc_id, toxic; rows with a null id or label are left out, and without any the score is the same for all.
    A document that some labels call toxic and others don't is toxic; texts that share a doc_id share its label.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = stored(docs.join(F.broadcast(sample), "doc_id"), "labelled").repartition(48, "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TermReader()
        for batch in batches:
            found: dict[int, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for t in reader.read(text):
                    found.setdefault(t, [0, 0])[int(toxic == 1)] += 1
            yield pd.DataFrame([(t, a, b) for t, (a, b) in found.items()], columns=["term", "clean", "toxic"])

    totals = {r["toxic"]: r["n"] for r in sample.groupBy(F.col("toxic") == 1).agg(F.count(F.lit(1)).alias("n")).toDF("toxic", "n").collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    counts = sample.mapInPandas(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    cross = b * (n0 - a) - a * (n1 - b)
    chi = F.try_divide((n0 + n1) * cross * cross, F.lit(float(n0) * n1) * (a + b) * (n0 + n1 - a - b))
    chosen = counts.withColumn("chi", chi).filter("chi > 6 and a + b >= 3").orderBy(F.desc("chi"), "term").limit(SELECTED_TERMS)
    places = {r["term"]: i for i, r in enumerate(chosen.select("term").collect())}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TermReader(places)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [np.array(reader.read(t), dtype=">u2").tobytes() for t in batch["text"]]})

    # two bytes a place, and at most SELECTED_TERMS of them a row, so the largest sample takes some 160 MB here
    rows = [(r["doc_id"], bytes(r["terms"]), r["toxic"]) for r in sample.mapInPandas(reduce, "doc_id long, toxic int, terms binary").toLocalIterator()]
    rows.sort()
    return train([np.frombuffer(terms, dtype=">u2") for _, terms, _ in rows], np.array([float(toxic == 1) for _, _, toxic in rows]), places)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows and columns of ``docs`` (text and any others) with a score from 0 to 1 in a new column; null and empty texts get the model's bias.

    A column of the score's name is refused.
    """
    if name in docs.columns:
        raise ValueError(f"docs have a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = held.value
        reader = TermReader(model.places)
        for texts in batches:
            yield pd.Series(model.scores([reader.read(t) for t in texts]), dtype="float64")

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(scores, "double")("text"))

