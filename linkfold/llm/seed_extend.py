"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: of the ``seed``-word runs inside each window of ``window`` words, the one with the smallest hash.
Equal windows choose equal anchors, so documents that share a window meet when they are joined on anchors, and any text has about
one anchor in 18 words.  From an anchor the match is extended both ways to the whole stretch of words whose windows chose it.
Occurrences whose stretches are equal throughout form one class and need no further look; only where an anchor has several
classes are the windows of one occurrence of each class compared, which finds how far the classes' extensions agree.
The maximal repeats over the threshold are the unions of these windows.  No pairs of occurrences are formed, so a passage in a third
of all documents costs a row for each occurrence and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored
from linkfold.llm.words import RunHashes, split_words, word_hashes

SEED = 16


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def stretches(words: list[bytes], window: int, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Anchor, hash of the words, first window and number of windows of each stretch of windows with one anchor."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    runs = RunHashes(word_hashes(words))
    grams = runs.runs(np.arange(len(words) - seed + 1), seed)
    anchor = _sliding_min(grams, window - seed + 1)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(start, n))
    whole = runs.runs(start, count + window - 1)
    return anchor[start].view(np.int64), whole.view(np.int64), start, count


def _columns(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i, k in enumerate(names)})


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, copy, start, stop): word ranges of ``docs`` (doc_id, text) covered by windows that also start in a smaller doc_id.

    ``copy`` is the text's 64-bit hash, which tells rows apart that share a doc_id; of those, none is smaller than another.
    Ranges may overlap.  Rows with a null doc_id or fewer than ``window`` words have none; rows equal in both are one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").filter("doc_id is not null")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for doc, copy, text in zip(batch["doc_id"], batch["copy"], batch["text"], strict=True):
                found = stretches(split_words(text), window)
                if len(found[0]):
                    parts.append((*found, *(np.full(len(found[0]), x, dtype=np.int64) for x in (doc, copy))))
            yield _columns(parts, ["anchor", "whole", "start", "count", "doc_id", "copy"])

    places = stored(docs.mapInPandas(find, "anchor long, whole long, start long, count long, doc_id long, copy long"), "places")
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    # counts by anchor are written before they are joined, so that the joins are of plain tables, whose large keys Spark can split
    places = stored(places.join(stored(shared.select("anchor"), "shared"), "anchor", "left_semi"), "seeds")

    classes = places.groupBy("anchor", "whole").agg(F.min(F.struct("doc_id", "copy", "start", "count")).alias("head"))
    classes = stored(classes.select("anchor", "whole", "head.*"), "classes")
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    several = stored(several, "several")

    # windows of one occurrence of each class, where an anchor has several classes
    heads = classes.join(several, "anchor", "left_semi").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "whole", "start", "count")).alias("heads"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["anchor", "whole", "k", "content", "doc_id"]
        for batch in batches:
            parts, size = [], 0
            for doc, text, heads in zip(batch["doc_id"], batch["text"], batch["heads"], strict=True):
                runs = RunHashes(word_hashes(split_words(text)))
                for h in heads:
                    k = np.arange(h["count"])
                    parts.append((np.full(len(k), h["anchor"]), np.full(len(k), h["whole"]), k, runs.runs(k + h["start"], window).view(np.int64), np.full(len(k), doc, dtype=np.int64)))
                    size += len(k)
                if size > 200_000:
                    yield _columns(parts, names)
                    parts, size = [], 0
            yield _columns(parts, names)

    compared = stored(docs.join(heads.hint("shuffle_hash"), ["doc_id", "copy"]).mapInPandas(windows, "anchor long, whole long, k long, content long, doc_id long"), "windows")
    earliest = compared.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    extended = compared.join(stored(earliest, "earliest"), ["anchor", "content"]).filter("first < doc_id").select("anchor", "whole", "k").distinct()
    # neighbouring windows are one range
    apart = F.col("k") - F.row_number().over(Window.partitionBy("anchor", "whole").orderBy("k"))
    extended = extended.withColumn("apart", apart).groupBy("anchor", "whole", "apart").agg(F.min("k").alias("low"), F.max("k").alias("high"))

    # an occurrence behind its class's first document is covered throughout, the first document's where it is extended
    same = places.join(classes.select("anchor", "whole", F.col("doc_id").alias("first")), ["anchor", "whole"])
    behind = same.filter("doc_id > first").select("doc_id", "copy", "start", (F.col("start") + F.col("count") + window - 1).alias("stop"))
    ahead = same.filter("doc_id = first").join(extended, ["anchor", "whole"])
    ahead = ahead.select("doc_id", "copy", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + window).alias("stop"))
    return behind.unionByName(ahead)


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored): doc_id, n_words, n_removed, kept_text.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; kept words are
    joined by one blank.  Null and empty texts have no words and an empty kept_text.  A null doc_id keeps all its words.
    Rows may share a doc_id, with one text or several: each is judged by its own text, against documents with smaller ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    spans = repeated_spans(docs, window).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = split_words(text)
                kept, n = words, len(words)
                if spans is not None and len(spans):
                    edges = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edges, [min(s["start"], n) for s in spans], 1)
                    np.add.at(edges, [min(s["stop"], n) for s in spans], -1)
                    kept = list(compress(words, (np.cumsum(edges[:n]) == 0).tolist()))
                rows.append((doc, n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text"]).astype({"doc_id": "Int64"})

    return docs.join(spans.hint("shuffle_hash"), ["doc_id", "copy"], "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_text string")

