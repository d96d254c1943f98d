"""Quality of texts, learnt from trusted good texts and unlabelled ones (positive-unlabelled learning).

A text is measured by shares and counts (letters, capitals, marks, repeated words and lines, and so on), each cut into ranges by
its quantiles over all documents; the classifier adds up a weight for each measure's range.  It minimises the non-negative
unbiased risk

    prior * E_good[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_good[loss(-)])

so bad texts are never labelled: what the unlabelled texts hold beyond their share of good ones makes up the other class.
That share, the class prior, is estimated first: a classifier of good against unlabelled texts is fitted, and of all its
thresholds the one with the smallest bound on (share of all documents above it) / (share of good texts above it) gives the prior.
Bounds are by Hoeffding's inequality, and the good texts that are counted weren't fitted on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many good, and so many unlabelled texts, those with the smallest hashes, are fitted on.
MAX_TRAINING_ROWS = 20_000
#: Quantiles that cut a measure into ranges: closer at both ends, where unlike texts are.
QUANTILES = (0.002, 0.005, 0.01, 0.02, 0.04, *(k / 16 for k in range(1, 16)), 0.96, 0.98, 0.99, 0.995, 0.998)
RANGES = len(QUANTILES) + 1
BINS = 1_000

MEASURES = (
    "log_words", "word_length", "log_longest_word", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "wordless", "capital_words", "marked_ends", "short_words",
    "letters", "capitals", "digits", "stops", "marks", "top_mark", "blanks", "beyond_ascii", "log_lines", "line_length", "distinct_lines", "stopped_lines",
)

_KIND = np.zeros(256, dtype=np.int64)  # 0 control, 1 capital, 2 small letter, 3 digit, 4 stop, 5 other mark, 6 blank, 7 first byte beyond ASCII, 8 further byte
_KIND[np.arange(65, 91)] = 1
_KIND[np.arange(97, 123)] = 2
_KIND[np.arange(48, 58)] = 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
_KIND[np.frombuffer(b".,;:'\"?()-", dtype=np.uint8)] = 4
_KIND[np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)] = 6
_KIND[192:] = 7
_KIND[128:192] = 8
_ENDS = frozenset(".!?:;\"'…")


def measures(text: str | None) -> list[float]:
    """The numbers by which a text is judged, in the order of MEASURES; null is measured as an empty text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 9)
    chars = max(len(data) - kinds[8], 1)
    letters = kinds[1] + kinds[2] + kinds[7]
    words = text.split()
    n = len(words)
    m = max(n, 1)
    often = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    pairs = list(zip(words, words[1:]))  # noqa: B905
    return [
        np.log1p(n), sum(map(len, words)) / m, np.log1p(max(map(len, words), default=0)), len(often) / m, max(often.values(), default=0) / m, sum(a == b for a, b in pairs) / m, len(set(pairs)) / m,
        sum(c for w, c in often.items() if not any(map(str.isalpha, w))) / m, sum(c for w, c in often.items() if len(w) > 1 and w.isupper()) / m,
        sum(c for w, c in often.items() if not w[-1].isalnum() and w[-1] not in ".,;:?!\"')") / m, sum(c for w, c in often.items() if len(w) <= 3) / m,
        letters / chars, kinds[1] / max(letters, 1), kinds[3] / chars, kinds[4] / chars, kinds[5] / chars, (counts * (_KIND == 5)).max() / chars, kinds[6] / chars, kinds[7] / chars,
        np.log1p(len(lines)), np.log1p(len(text) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), sum(x[-1] in _ENDS for x in lines) / max(len(lines), 1),
    ]


def measured(docs: DataFrame, name: str = "measures") -> DataFrame:
    """The columns of ``docs`` but for ``text``, which becomes an array of its MEASURES in the column ``name``."""
    if name in docs.columns:
        raise ValueError(f"docs have a column {name} already")

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([measures(t) for t in texts], dtype=object)

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(*[c for c in docs.columns if c != "text"], F.pandas_udf(read, "array<float>")(F.col("text").cast("string")).alias(name))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is never learnt: crc32 of its doc_id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Weights of each measure's ranges, whose upper ends are ``cuts``; ``prior`` is the estimated share of good texts."""

    cuts: list[list[float]]
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        places = places_of(rows, self.cuts)
        return _chance(self.bias + self.weights[np.arange(places.shape[1]), places].sum(axis=1)) if len(rows) else np.zeros(0)


def _chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def places_of(rows: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """The range of each measure that a row falls in."""
    out = np.zeros((len(rows), len(cuts)), dtype=np.uint8)
    for j, ends in enumerate(cuts):
        out[:, j] = np.searchsorted(np.array(ends, dtype=np.float32), rows[:, j], side="left")
    return out


def minimise(good: np.ndarray, others: np.ndarray, ranges: int, prior: float | None, steps: int = 800, rate: float = 0.1, decay: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative unbiased risk, or without prior the logistic risk of good against others.

    Adam steps over all rows from zero, so the same rows give the same weights.  Where the bracket of the risk is below zero, the
    step climbs out of it instead of following the whole risk, which keeps a flexible classifier from overfitting there.
    """
    width = good.shape[1]
    start = np.arange(width) * ranges
    flats = [(rows.astype(np.int64) + start).ravel() for rows in (good, others)]
    sizes = [len(good), len(others)]
    params = np.zeros(width * ranges + 1)
    first, second = np.zeros_like(params), np.zeros_like(params)

    def slope(side: int, error: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(flats[side], np.repeat(error, width), width * ranges), error.sum()) / sizes[side]

    for step in range(1, steps + 1):
        raw = [params[flats[k]].reshape(-1, width).sum(axis=1) + params[-1] for k in (0, 1)]
        chance = [_chance(r) for r in raw]
        if prior is None:
            gradient = slope(0, chance[0] - 1) + slope(1, chance[1])
        else:
            rest = np.logaddexp(0, raw[1]).mean() - prior * np.logaddexp(0, raw[0]).mean()
            bracket = slope(1, chance[1]) - prior * slope(0, chance[0])
            gradient = prior * slope(0, chance[0] - 1) + bracket if rest >= 0 else -bracket
        gradient[:-1] += decay * params[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-1].reshape(width, ranges), float(params[-1])


def prior_of(good: np.ndarray, everything: np.ndarray, failure: float = 0.1) -> float:
    """Share of good texts in everything, from counts by score range, the highest last.

    Above any threshold there are at least prior * (share of good texts above it) of all; the threshold with the smallest upper
    bound on the ratio gives the estimate.
    """
    g, e = np.cumsum(good[::-1]), np.cumsum(everything[::-1])
    if not g[-1] or not e[-1]:
        return 0.5
    slack = np.sqrt(np.log(4 / failure) / 2) * (1 / np.sqrt(e[-1]) + 1 / np.sqrt(g[-1]))
    p, u = g / g[-1], e / e[-1]
    bound = np.where(p > slack, (u + slack) / np.maximum(p, 1e-12), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(u[best] / max(p[best], 1e-12), 0.01, 0.99))


def _some(rows: DataFrame, total: int, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``most`` rows, by hash; only about twice as many are sorted, however many there are."""
    spread = F.xxhash64("doc_id", "measures")
    if total > most:
        rows = rows.filter(F.pmod(spread, F.lit(1 << 40)) < int((1 << 40) * min(1.0, 2 * most / total)))
    return rows.orderBy(spread, "doc_id").limit(most)


def _packed(rows: DataFrame) -> np.ndarray:
    """The measures of a bounded number of rows."""
    found = rows.select("measures").toArrow().column(0).combine_chunks()
    return found.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES)) if len(found) else np.zeros((0, len(MEASURES)), dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on measured docs (doc_id, measures) and labels (doc_id, quality): good ones are those that all their labels call 1.

    Labels of held-out rows aren't read, and labels of 0 only keep a text from being trusted.  All documents, labelled or not, are
    the unlabelled ones; the fit uses at most MAX_TRAINING_ROWS of either, while the measures' quantiles and the class prior are
    taken over all documents.  Rows with a null doc_id or label are left out of the good ones; without any good or any document
    every text gets the same score of 1 / 2.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").filter(~held_out())
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * MAX_TRAINING_ROWS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "measures")
    found = docs.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("measures")[j], list(QUANTILES), 5_000).alias(f"m{j}") for j in range(len(MEASURES))]).first()
    if not found["n"]:
        return Model([[]] * len(MEASURES), np.zeros((len(MEASURES), 1)), 0.0, 0.5)
    cuts = [sorted(set(found[f"m{j}"])) for j in range(len(MEASURES))]
    ours = docs.join(F.broadcast(trusted), "doc_id", "left_semi")
    good = places_of(_packed(_some(ours, ours.count(), 2 * MAX_TRAINING_ROWS)), cuts)
    others = places_of(_packed(_some(docs, found["n"])), cuts)
    if not len(good):
        return Model(cuts, np.zeros((len(MEASURES), RANGES)), 0.0, 0.5)
    fitted, counted = (good[0::2], good[1::2]) if len(good) > 1 else (good, good)
    against = Model(cuts, *minimise(fitted, others, RANGES, None, steps=200), prior=0.5)
    range_of = (F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))).cast("int")
    total = np.zeros(BINS)
    for b, n in score(docs, against).groupBy(range_of.alias("b")).count().collect():
        total[b] = n
    raw = against.bias + against.weights[np.arange(len(cuts)), counted].sum(axis=1)
    prior = prior_of(np.bincount(np.minimum((_chance(raw) * BINS).astype(int), BINS - 1), minlength=BINS), total)
    return Model(cuts, *minimise(good[:MAX_TRAINING_ROWS], others, RANGES, prior), prior=prior)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Measured docs with the chance of being good, from 0 to 1, in a new column in place of the measures.

    Every row gets a score, those of null and empty texts too.  A column of the score's name is refused.
    """
    if name in docs.columns:
        raise ValueError(f"docs have a column {name} already")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(held.value.scores(np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, len(MEASURES)))), dtype="float64")

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(*[c for c in docs.columns if c != "measures"], F.pandas_udf(scores, "double")("measures").alias(name))
