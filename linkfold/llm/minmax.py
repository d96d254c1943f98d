"""Near-duplicate documents by min-max hashing of their word shingles.

Under each permutation both the smallest and the largest hash of a document's shingles are kept, so half as many
permutations give as many signature values, with less variance than from minima alone.  Bands of the signature
give buckets; documents in a common bucket are candidates, and a link counts only if the full shingle sets confirm it.
Equal word sequences are one node from the start.  Within buckets, nodes are first checked against one representative each;
then all candidate pairs that are still in different components are checked, so no candidate between components is left out
and a group of thousands of copies never becomes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.llm.components import connected_components
from linkfold.llm.scratch import small_batches, stored
from linkfold.llm.words import lower_ascii, mix, word_hashes

BANDS, ROWS = 45, 7
#: Chance of missing a link at similarity 0.85: (1 - 0.85**7)**45, about 3e-8, and 3e-5 at 0.8; less above.  ``SIGMAS`` adds about 1e-5, by the
#: exact binomial over the signature.
PERMUTATIONS = (BANDS * ROWS + 1) // 2
#: Members of a bucket that are compared with each other in one go, and pairs of blocks that Python gets at a time (some 100 MB).
BLOCK, BLOCK_PAIRS = 256, 256
#: Candidates whose signatures agree in so many standard deviations less than the threshold aren't confirmed on full sets: with more of them, the
#: pairs of a large group that are nearly links, but aren't, become rows.
SIGMAS = 4.5
#: Ids that are broadcast at most (16 MB); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20_240_229)
_XOR = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; with fewer words, of the whole sequence; without any, none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = word_hashes(words)
    k = min(size, len(words))
    n = len(words) - k + 1
    run = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        run = run * _BASE + mix(hashes[j : j + n] + np.uint64(1))
    return np.unique(mix(run))


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a nonempty set under each permutation, in turn."""
    low = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(values), 1024):  # very long texts in blocks
        x = (values[at : at + 1024, None] ^ _XOR) * _ODD
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()[: BANDS * ROWS]


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        key = mix(key * _BASE + column)
    return key.view(np.int64)


def _described(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                words = lower_ascii(text)
                values = shingles(words, size)
                if len(values):
                    sig = signature(values)
                    rows.append((row, doc, _words_key(words), len(values), band_keys(sig), sig.astype(np.uint8).tobytes()))
                else:
                    rows.append((row, doc, None, 0, None, None))
            out = pd.DataFrame(rows, columns=["row", "doc_id", "words_key", "n_shingles", "bands", "short"])
            yield out.astype({"row": "Int64", "doc_id": "Int64"})

    return docs.mapInPandas(run, "row long, doc_id long, words_key binary, n_shingles long, bands array<long>, short binary")


def _words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [lower_ascii(t) for t in batch["text"]]
            yield pd.DataFrame({"words_key": [_words_key(w) for w in texts], "shingles": [shingles(w, size).view(np.int64) for w in texts]})

    return docs.mapInPandas(run, "words_key binary, shingles array<long>")


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal signature values, an unbiased estimate of the similarity."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _likely_across(members: DataFrame, nodes: DataFrame, percent: int, least: float) -> DataFrame:
    """Pairs (a, b) of ``members`` (bucket, node, n, part) that share a bucket, but not a part, and whose signatures agree enough.

    A bucket's members are dealt into blocks of about BLOCK, and the pairs of blocks are dealt out by themselves, so that no task holds a
    whole bucket, and only likely pairs become rows.  A pair is given once, for the first of the bands that it shares.
    """
    counts = stored(members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "counts")
    dealt = members.join(counts, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.join(nodes.select("node", "bands", "short"), "node")
    blocks = dealt.groupBy("bucket", "blocks", "block").agg(F.collect_list(F.struct("node", "n", "part", "bands", "short")).alias("members"))
    blocks = stored(blocks, "blocks")
    within = blocks.select("bucket", F.col("block").alias("i"), F.col("block").alias("j"), F.col("members").alias("x"), F.col("members").alias("y"))
    several = blocks.filter("blocks > 1")
    x = several.filter("block < blocks - 1").select("bucket", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("j"), F.col("members").alias("x"))
    y = several.filter("block > 0").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("members").alias("y"))

    def matrix(members: list, field: str, dtype: type) -> np.ndarray:
        return np.array([m[field] for m in members], dtype=dtype)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for bucket, i, j, xs, ys in zip(batch["bucket"], batch["i"], batch["j"], batch["x"], batch["y"], strict=True):
                part, n, node = ([matrix(m, f, np.int64) for m in (xs, ys)] for f in ("part", "n", "node"))
                wanted = part[0][:, None] != part[1]
                wanted &= 100 * np.minimum(n[0][:, None], n[1]) >= percent * np.maximum(n[0][:, None], n[1])
                if i == j:
                    wanted &= node[0][:, None] < node[1]
                a, b = np.nonzero(wanted)
                if not len(a):
                    continue
                short = [np.frombuffer(b"".join(m["short"] for m in members), dtype=np.uint8).reshape(len(members), -1) for members in (xs, ys)]
                bands = [np.stack([m["bands"] for m in members]) for members in (xs, ys)]
                for at in range(0, len(a), 8_192):
                    p, q = a[at : at + 8_192], b[at : at + 8_192]
                    near = (short[0][p] == short[1][q]).mean(axis=1) >= least
                    p, q = p[near], q[near]
                    shared = bands[0][p] == bands[1][q]
                    here = bands[0][p, shared.argmax(axis=1)] == bucket
                    found.append(np.stack([node[0][p[here]], node[1][q[here]]], axis=1))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            yield pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    pairs = within.unionByName(x.join(y, ["bucket", "i", "j"])).mapInPandas(compare, "a long, b long")
    with small_batches(members.sparkSession, BLOCK_PAIRS):
        return stored(pairs, "across").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable over links, or, for a row without one, null.  Null, empty and blank texts have no shingles and are linked with nothing.  Repeated
    rows, and rows that share a doc_id, are linked as their texts are.  kept: whether doc_id is component_id; a null doc_id is kept.  With
    ``row``, the name of a column of distinct numbers, that column is returned too, and first: whether the row is the one of its
    component that stays, the first of those with the smallest doc_id.  ``percent`` below about 70 needs more bands.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    docs = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = stored(_described(docs, size), "described")
    worded = described.filter("words_key is not null")
    # a text without any doc_id still links others; it stands behind all that have one
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")
    nodes = worded.groupBy("words_key").agg(F.min(order).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("short").alias("short"))
    nodes = stored(nodes.select("words_key", F.col("least.row").alias("node"), "least", "n", "bands", "short"), "nodes")

    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head != last")
    members = stored(placed.join(shared.select("bucket", "head"), "bucket"), "members")

    involved = stored(members.select("node").distinct(), "involved")
    few = involved.count() <= BROADCAST_IDS
    shorts = nodes.join(F.broadcast(involved) if few else involved, "node", "left_semi").select("node", "n", "short")
    # texts are found again by the doc_id of their node, and their sets by the words
    wanted = nodes.join(F.broadcast(involved) if few else involved, "node", "left_semi").select("words_key", "node", F.col("least.doc_id").alias("of"))
    ids = wanted.select("of").distinct()
    ids = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    sets = _sets(ids, size).groupBy("words_key").agg(F.first("shingles").alias("shingles"))
    sets = stored(wanted.select("words_key", "node").join(sets, "words_key").select("node", "shingles"), "sets")

    share = percent / 100
    least = share - SIGMAS * (share * (1 - share) / (BANDS * ROWS)) ** 0.5

    agreement = F.pandas_udf(_agreement, "double")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        left = shorts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("short").alias("sa"))
        right = shorts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("short").alias("sb"))
        sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        likely = stored(sized.filter(agreement("sa", "sb") >= least).select("a", "b", "na", "nb"), "likely")
        xs, ys = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xs")), sets.select(F.col("node").alias("a"), F.col("shingles").alias("ys"))
        common = F.size(F.array_intersect("xs", "ys")).cast("long")
        both = likely.join(xs, "b").join(ys, "a").select("a", "b", common.alias("common"), (F.col("na") + F.col("nb")).alias("total"))
        return stored(both.filter(f"100 * common >= {percent} * (total - common)").select("a", "b"), "links")

    # every node against one representative, the head of most of its buckets
    heads = members.filter("node != head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("n"))
    best = heads.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", (-F.col("head")).alias("less"))).alias("best"))
    edges = confirmed(best.select("a", (-F.col("best.less")).alias("b")))
    labels = connected_components(edges)

    # where that left a bucket with several components, every node against the heads of all its buckets
    def mixed_members() -> DataFrame:
        named = members.join(labels, "node", "left").select("bucket", "node", "n", "head", F.coalesce("component", "node").alias("part"))
        named = stored(named, "named")
        mixed = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p != q")
        return stored(named.join(stored(mixed.select("bucket"), "open"), "bucket", "left_semi"), "mixed")

    open_heads = mixed_members().filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"), "part").distinct()
    parts = labels.select(F.col("node").alias("b"), "component")
    open_heads = open_heads.join(parts, "b", "left").filter(F.col("part") != F.coalesce("component", "b")).select("a", "b")
    edges = edges.unionByName(confirmed(open_heads))
    labels = connected_components(edges)

    # whatever still shares a bucket across components
    across = _likely_across(mixed_members().select("bucket", "node", "n", "part"), nodes, percent, least)
    labels = connected_components(edges.unionByName(confirmed(across)))

    named = nodes.join(labels, "node", "left").select("words_key", "least", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("least").alias("top"))
    group = named.join(firsts, "component").select("words_key", "top")
    out = described.join(group, "words_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("top.doc_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    more = [] if row is None else [F.col("row").alias(row), F.coalesce(F.col("row") == F.col("top.row"), F.lit(True)).alias("first")]
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *more)
