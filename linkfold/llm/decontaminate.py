"""Benchmark passages in documents, up to a share of edited words.

Item-sized windows of words are embedded by CGK random walks, which map edit distance to Hamming distance: at each step the
window's current word is emitted, and whether the walk moves on to the next word depends on a random bit of that word.  Words
sampled at random steps are hashed; windows that agree with an item in one of several repetitions are verified by exact edit distance.
With ``indels`` passages may be shorter or longer than the item by all their edits, windows reach over the ends of a text, and an item is
aligned with any run of words around its window; without, only runs of as many words as the item has are compared.
Only windows are embedded that hold as many of the benchmark's word pairs as so few edits must leave, which loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored
from linkfold.llm.words import folded_hashes, mix

#: Repetitions, and words sampled in each, of items with fewer words than the number before them.  The more edits a walk has met, the rarer its
#: words agree, so longer items are sampled by fewer words and more often; by test, over 95 % of passages edited up to the limit are found at any length.
SAMPLING = ((60, 24, 3), (math.inf, 48, 2))
#: Words of items that a task holds at a time (some 100 MB with their tables); more items are searched for in blocks.
BLOCK_WORDS = 1_000_000
#: Texts whose hashes are broadcast at most (16 MB); beyond, documents are shuffled by them.
BROADCAST_TEXTS = 1_000_000
_PAIR, _STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
PAIRS_SCHEMA = "doc_id long, item_id long, start long, distance int"


def allowed(m: int, share: float) -> int:
    return int(m * share + 1e-9)


def sampling(m: int) -> tuple[int, int]:
    """Repetitions, and words sampled in each, for items of ``m`` words."""
    return next((repetitions, min(sampled, 2 * m)) for below, repetitions, sampled in SAMPLING if m < below)


def _runs(hashes: np.ndarray, m: int) -> np.ndarray:
    """A hash of each run of ``m`` words."""
    n = max(len(hashes) - m + 1, 0)
    out = hashes[:n]
    for j in range(1, m):
        out = mix(out * _PAIR + hashes[j : j + n])
    return out


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * _PAIR + hashes[1:])


def _bits(values: np.ndarray) -> np.ndarray:
    """A table of marks by the low bits of the values, at most one in 64 set."""
    out = np.zeros(2 ** max(12, math.ceil(math.log2(64 * len(values) + 1))), dtype=bool)
    out[(values & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def _starts(pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many marked pairs start before each place of a text."""
    count = np.zeros(len(pairs) + 1, dtype=np.int32)
    np.cumsum(seen[(pairs & np.uint64(len(seen) - 1)).astype(np.int64)], out=count[1:])
    return count


def cgk_keys(stream: np.ndarray, starts: np.ndarray, m: int, first: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
    """Keys (repetition, window) of the windows of ``m`` words at ``starts``: hashes of the sampled words of their embeddings.

    Words outside of a window's text, from ``first`` to ``end``, are blank.
    """
    end = len(stream) if end is None else end
    repetitions, sampled = sampling(m)
    rng = np.random.default_rng([m, repetitions, sampled])
    steps = 2 * m
    bits = rng.integers(0, 2**63, (steps, repetitions, 1), dtype=np.uint64)
    picked = np.zeros((steps, repetitions), dtype=bool)
    for r in range(repetitions):
        picked[rng.choice(steps, sampled, replace=False), r] = True
    last = int(np.flatnonzero(picked.any(axis=1)).max())
    # each window's words in a row of their own, with a blank behind them at which walks end
    spots = starts[:, None] + np.arange(m + 1)
    inside = (spots >= np.reshape(first, (-1, 1))) & (spots < np.reshape(end, (-1, 1)))
    inside[:, m] = False
    words = np.where(inside, stream[np.clip(spots, 0, len(stream) - 1)], np.uint64(0)).ravel()
    begin = np.arange(len(starts)) * (m + 1)
    at = np.broadcast_to(begin, (repetitions, len(starts))).copy()
    keys = np.broadcast_to(np.arange(1, repetitions + 1, dtype=np.uint64)[:, None], at.shape).copy()
    for j in range(last + 1):
        word = words[at]
        r = picked[j]
        if r.any():
            keys[r] = mix(keys[r] * _PAIR + word[r])
        at += (((word ^ bits[j]) * _STEP) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, begin + m, out=at)
    return keys


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact edit distances of the rows of two equally shaped arrays of word hashes."""
    n, m = a.shape
    steps = np.arange(m + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (n, m + 1)).copy()
    for i in range(m):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (a[:, i : i + 1] != b), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, m]


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance of each row of ``b`` to any run of words of the same row of ``a``, and where the first such run starts."""
    one = np.int64(2**32)  # an edit; the run's start is held below
    steps = np.arange(a.shape[1] + 1, dtype=np.int64)
    row = np.broadcast_to(steps, (len(a), len(steps))).copy()
    for i in range(b.shape[1]):
        new = row + one
        np.minimum(new[:, 1:], row[:, :-1] + (a != b[:, i : i + 1]) * one, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps * one, axis=1) + steps * one
    distance, start = np.divmod(row.min(axis=1), one)
    return distance, start


class Items:
    """A block of benchmark items, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], share: float, indels: bool = False):
        self.share, self.indels = share, indels
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            words = folded_hashes(text)
            if len(words):
                by_size.setdefault(len(words), []).append((item, words))
        # items too short for an edit are looked up by the hash of all their words
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in [m for m in by_size if allowed(m, share) == 0]:
            found = by_size.pop(m)
            keys = np.array([_runs(w, m)[0] for _, w in found], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.exact[m] = keys[order], np.array([i for i, _ in found], dtype=np.int64)[order]
        self.ids = {m: np.array([i for i, _ in v], dtype=np.int64) for m, v in by_size.items()}
        self.words = {m: np.stack([w for _, w in v]) for m, v in by_size.items()}
        own = {m: np.unique(np.concatenate([_pairs(x) for x in w])) for m, w in self.words.items()}
        self.seen = _bits(np.concatenate([np.zeros(0, dtype=np.uint64), *own.values()]))
        self.seen_by_size = {m: _bits(p) for m, p in own.items()}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, w in self.words.items():
            keys = cgk_keys(w.ravel(), np.arange(len(w)) * m, m).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys[m] = keys[order], order % len(w)
        # classes of sizes within an eighth of each other share a first look
        self.classes: list[list[int]] = []
        for m in sorted(by_size):
            if self.classes and m <= self.classes[-1][0] * 9 // 8:
                self.classes[-1].append(m)
            else:
                self.classes.append([m])

    def needed(self, m: int) -> int:
        """Word pairs that a window within the allowed edits of an item of ``m`` words must share with it: an edit breaks two at most."""
        return m - 1 - 2 * allowed(m, self.share)

    def reach(self, m: int) -> int:
        """Words that a passage may have more or less than its item."""
        return allowed(m, self.share) if self.indels else 0

    def windows(self, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Sizes and starts of the windows of a text that hold enough of the items' word pairs, counted over the longest passage."""
        n = len(hashes)
        pairs = _pairs(hashes) if n > 1 else hashes[:0]
        count = _starts(pairs, self.seen)
        # a window of m words holds m - 1 pairs
        for sizes in self.classes:
            if sizes[0] - self.reach(sizes[0]) > n:
                break
            wide = min(sizes[-1] + self.reach(sizes[-1]), n)
            if (count[wide - 1 :] - count[: n - wide + 1]).max() < min(map(self.needed, sizes)):
                continue
            for m in sizes:
                k = self.reach(m)
                if m - k <= n:
                    own = _starts(pairs, self.seen_by_size[m])
                    starts = np.arange(-k, n - m + k + 1)
                    held = own[np.minimum(starts + (m + k - 1), n - 1)] - own[np.maximum(starts, 0)]
                    starts = starts[held >= self.needed(m)]
                    if len(starts):
                        yield m, starts

    def equal(self, hashes: np.ndarray) -> dict[int, int]:
        """The first place of each item too short for an edit that a text holds."""
        first: dict[int, int] = {}
        for m, (keys, ids) in self.exact.items():
            runs = _runs(hashes, m)
            for at in np.flatnonzero(np.isin(runs, keys)).tolist():
                for item in ids[np.searchsorted(keys, runs[at], "left") : np.searchsorted(keys, runs[at], "right")].tolist():
                    first.setdefault(item, at)
        return first

    def find(self, docs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """(doc_id, item_id, start, distance) of the best window of each document and item within the allowed edits."""
        windows: dict[int, list[tuple[np.ndarray, int]]] = {}
        best: dict[tuple[int, int], tuple[int, int]] = {}
        base, streams = 0, []
        for k, (_, hashes) in enumerate(docs):
            best |= {(k, item): (0, at) for item, at in self.equal(hashes).items()}
            hit = False
            for m, starts in self.windows(hashes):
                windows.setdefault(m, []).append((starts + base, k))
                hit = True
            if hit:
                streams.append(hashes)
                windows.setdefault(-1, []).append((np.array([base]), k))
                base += len(hashes)
        stream = np.concatenate(streams) if streams else np.zeros(0, dtype=np.uint64)
        begin = np.zeros(len(docs), dtype=np.int64)
        for at, k in windows.pop(-1, []):
            begin[k] = at[0]
        finish = begin + [len(h) for _, h in docs]
        for m, found in windows.items():
            starts = np.concatenate([s for s, _ in found])
            owner = np.concatenate([np.full(len(s), k) for s, k in found])
            keys, place = self.keys[m]
            for at in range(0, len(starts), 4096):
                part, first, end = starts[at : at + 4096], begin[owner[at : at + 4096]], finish[owner[at : at + 4096]]
                asked = cgk_keys(stream, part, m, first, end)
                lo, hi = np.searchsorted(keys, asked.ravel(), "left"), np.searchsorted(keys, asked.ravel(), "right")
                some = np.flatnonzero(hi > lo)
                n = (hi - lo)[some]
                item = place[np.repeat(lo[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(some) else np.zeros(0, dtype=np.int64)
                window = np.repeat(some % len(part), n)
                pairs = np.unique(window * len(self.ids[m]) + item)
                for lot in range(0, len(pairs), 4096):
                    w, i = np.divmod(pairs[lot : lot + 4096], len(self.ids[m]))
                    if self.indels:
                        reach = self.reach(m)
                        spots = part[w][:, None] + np.arange(-reach, m + 2 * reach)
                        inside = (spots >= first[w][:, None]) & (spots < end[w][:, None])
                        distance, start = aligned(np.where(inside, stream[np.clip(spots, 0, len(stream) - 1)], np.uint64(0)), self.words[m][i])
                        start = np.maximum(part[w] - reach + start, first[w])
                    else:
                        distance, start = edit_distances(stream[part[w][:, None] + np.arange(m)], self.words[m][i]), part[w]
                    for j in np.flatnonzero(distance <= allowed(m, self.share)):
                        k = int(owner[at + w[j]])
                        got = int(distance[j]), int(start[j] - begin[k])
                        key = k, int(self.ids[m][i[j]])
                        best[key] = min(best.get(key, got), got)
        return [(docs[k][0], item, start, d) for (k, item), (d, start) in best.items()]


def _found(docs: DataFrame, items: DataFrame, share: float, indels: bool) -> DataFrame:
    """(doc_id, item_id, start, distance) for ``docs`` (doc_id: any number, text), with one block of items broadcast at a time."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    words = items.agg(F.sum(F.octet_length("text") / 2 + 1).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    if blocks > 1:
        hashed = F.pandas_udf(lambda texts: pd.Series([folded_hashes(t).tobytes() for t in texts], dtype="object"), "binary")
        docs = stored(docs.select("doc_id", hashed("text").alias("text")), "hashed")  # words are hashed once for all blocks
    out = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text")
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            block = Items(held.value, share, indels)
            hashes = folded_hashes if blocks == 1 else lambda x: np.frombuffer(x, dtype=np.uint64)
            for batch in batches:
                for at in range(0, len(batch), 2_000):
                    part = batch[at : at + 2_000]
                    rows = block.find([(d, hashes(t)) for d, t in zip(part["doc_id"], part["text"], strict=True)])
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "distance"])

        found = stored(docs.mapInPandas(search, PAIRS_SCHEMA), "contaminated")
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.2, indels: bool = False) -> DataFrame:
    """(doc_id, item_id, start, distance) for documents with a window of an item's size, or of any with ``indels``, within the allowed edits of it.

    docs: doc_id, text; items: item_id, text; other columns are ignored.  Words are compared without case and marks at their ends; an item of m
    words allows m * share edited words, rounded down, so that very short ones are matched exactly; start is the best window's first word.  Rows without words or id, on either side, match nothing;
    repeated rows give one row for each.  Items are searched for in blocks of bounded size, each against all documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return _found(docs, items, share, indels)


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.2, indels: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` (text and any others) without the documents that hold a benchmark item; see ``contaminated``.

    Rows are judged by their texts, so those without a doc_id, and repeated ones, go too; texts are held equal if their 64-bit hashes are.
    """
    held = _found(docs.filter("text is not null").select(F.xxhash64("text").alias("doc_id"), "text"), items, share, indels)
    held = stored(held.select(F.col("doc_id").alias("held")).distinct(), "held")
    few = held.count() <= BROADCAST_TEXTS
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("held"))  # a struct, so that no name can clash
    return rows.join(F.broadcast(held) if few else held, "held", "left_anti").select("row.*")
