"""Chroma fingerprints of recordings, and their alignment.

A recording's short-time spectra are folded onto the twelve pitch classes.  Filters that compare sums of rectangles of this image, each
four reads of its integral image, are quantised to two bits and packed into one integer for each frame.  Recordings whose integers share
two of their four bytes vote for the offset between them; at the offsets of these histograms the share of different bits decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

RATE, FRAME, HOP = 4_096, 1_024, 512
#: Fixed values: (kind, first pitch class, pitch classes, frames) of the sixteen filters, and the thresholds of all.
FILTERS = (
    (0, 0, 4, 15), (0, 4, 4, 12), (0, 8, 4, 9), (1, 0, 8, 14), (1, 4, 8, 10), (1, 0, 12, 6), (2, 0, 6, 16), (2, 6, 6, 12),
    (2, 3, 6, 8), (3, 0, 8, 14), (3, 4, 8, 10), (3, 2, 6, 6), (4, 0, 9, 12), (4, 3, 9, 8), (5, 0, 12, 15), (5, 0, 6, 9),
)
THRESHOLDS = (-0.18, 0.0, 0.18)
SPAN = 16
#: Recordings and samples that a task holds at a time (samples of some 100 MB with their spectra), and votes or places.
LOT_ROWS, LOT_SAMPLES, LOT_VOTES = 256, 1_000_000, 2_000_000
#: Prints of queries that are broadcast at most (some 60 MB with their index); more queries are searched for in blocks.
BLOCK_PRINTS = 500_000
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def chroma_frames(pcm: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the twelve pitch classes (recording, frame, class) of recordings of equal length, each frame of unit length."""
    n, samples = pcm.shape
    count = max(0, (samples - FRAME) // HOP + 1)
    if not count:
        return np.zeros((n, 0, 12))
    hertz = np.arange(FRAME // 2 + 1) * rate / FRAME
    heard = (hertz >= 55) & (hertz <= 1_760)
    pitch = np.round(12 * np.log2(np.where(heard, hertz, 440) / 440)).astype(int) % 12
    fold = np.zeros((len(hertz), 12), dtype=np.float32)
    fold[np.flatnonzero(heard), pitch[heard]] = 1
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP]
    lot, parts = max(1, LOT_SAMPLES // (FRAME * n)), []
    for at in range(0, count, lot):  # a long recording's spectra are never all in memory
        spectra = np.fft.rfft(frames[:, at : at + lot] * np.hanning(FRAME).astype(np.float32), axis=2)
        parts.append(np.sqrt((spectra.real**2 + spectra.imag**2) @ fold))
    chroma = np.concatenate(parts, axis=1)
    return chroma / np.maximum(np.linalg.norm(chroma, axis=2, keepdims=True), 1e-9)


def prints(chroma: np.ndarray) -> np.ndarray:
    """Packed integers (recording, place), one for each run of ``SPAN`` frames."""
    n, frames, _ = chroma.shape
    places = frames - SPAN + 1
    if places < 1:
        return np.zeros((n, 0), dtype=np.int64)
    image = np.zeros((n, frames + 1, 13))
    image[:, 1:, 1:] = chroma.cumsum(axis=1).cumsum(axis=2)
    at = np.arange(places)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[:, at + t1, c1] - image[:, at + t0, c1] - image[:, at + t1, c0] + image[:, at + t0, c0]

    out = np.zeros((n, places), dtype=np.uint32)
    for kind, c, high, wide in FILTERS:
        half_t, half_c, third_t, third_c = wide // 2, high // 2, wide // 3, high // 3
        whole = area(0, wide, c, c + high)
        if kind == 0:  # level against the other classes
            part = area(0, wide, 0, 12) - whole
            a, b = whole * (12 - high), part * high
        elif kind == 1:  # lower classes against higher
            a, b = area(0, wide, c, c + half_c), area(0, wide, c + half_c, c + 2 * half_c)
        elif kind == 2:  # before against after
            a, b = area(0, half_t, c, c + high), area(half_t, 2 * half_t, c, c + high)
        elif kind == 3:  # opposite corners
            a = area(0, half_t, c, c + half_c) + area(half_t, 2 * half_t, c + half_c, c + 2 * half_c)
            b = area(half_t, 2 * half_t, c, c + half_c) + area(0, half_t, c + half_c, c + 2 * half_c)
        elif kind == 4:  # middle classes against those around
            a = 2 * area(0, wide, c + third_c, c + 2 * third_c)
            b = area(0, wide, c, c + 3 * third_c) - a / 2
        else:  # middle frames against those around
            a = 2 * area(third_t, 2 * third_t, c, c + high)
            b = area(0, 3 * third_t, c, c + high) - a / 2
        level = np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(THRESHOLDS, level)]
    return out.astype(np.int64)


def prints_of(pcms: list[np.ndarray]) -> list[np.ndarray]:
    """The packed integers of recordings of any lengths, a bounded number of samples at a time."""
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(pcms)
    by_size: dict[int, list[int]] = {}
    for i, pcm in enumerate(pcms):
        by_size.setdefault(len(pcm), []).append(i)
    for size, rows in by_size.items():
        lot = max(1, LOT_SAMPLES // max(size, 1))
        for at in range(0, len(rows) if size >= FRAME else 0, lot):
            part = rows[at : at + lot]
            for i, p in zip(part, prints(chroma_frames(np.stack([pcms[i] for i in part]))), strict=True):
                found[i] = p
    return found


def _fingerprinted(table: DataFrame, column: str, samples: Callable[[object], np.ndarray]) -> DataFrame:
    """(id, prints) of a table (id, column), with ``samples`` to make a recording of a value; few recordings are in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LOT_ROWS):
                part = batch[at : at + LOT_ROWS]
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "prints": prints_of([samples(v) for v in part[column]])})

    return table.select("id", column).mapInPandas(run, "id long, prints array<long>")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(id, prints: array<long>) of ``recordings`` (id, pcm: binary of signed 16-bit samples, mono, at RATE).  Null or short recordings have none.

    Long recordings reach Python in batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows; lower it, or set ``maxBytesPerBatch``, for minutes of sound a row.
    """
    return _fingerprinted(recordings, "pcm", lambda pcm: np.frombuffer(pcm if pcm is not None else b"", dtype="<i2", count=len(pcm or b"") // 2))


def melody_fingerprints(vectors: DataFrame, note: int = HOP) -> DataFrame:
    """(id, prints) of unit ``vectors`` (id, vector) played as melodies, a note for each component, its pitch by the component's place in the normal
    distribution that random directions have.  A null or empty vector is silent, a null component a rest.  The sound is made and read in one
    function, so no table of samples is ever passed on."""
    from statistics import NormalDist

    edges = np.array([NormalDist().inv_cdf(k / 24) for k in range(1, 24)])
    time = np.arange(note) / RATE
    tones = np.stack([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) for k in range(24)] + [np.zeros(note)])
    tones = np.round(12_000 * tones).astype("<i2")

    def samples(vector: object) -> np.ndarray:
        v = np.array(vector if vector is not None else [], dtype=np.float64)
        return tones[np.where(np.isfinite(v), np.searchsorted(edges, v * np.sqrt(len(v))), 24)].ravel()

    return _fingerprinted(vectors, "vector", samples)


class QueryIndex:
    """A block of queries' prints, filed under each pair of their four bytes: a print with errors in two bytes only is still found."""

    def __init__(self, queries: list[np.ndarray]):
        self.prints = np.concatenate([*queries, np.zeros(0, dtype=np.int64)]).astype(np.uint32)
        self.size = np.array([len(q) for q in queries], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(queries)), self.size)
        votes = np.flatnonzero(turns(self.prints, self.first))
        keys = _byte_pairs(self.prints[votes])
        order = np.argsort(keys, axis=1, kind="stable")
        self.start = np.stack([np.searchsorted(k[o], np.arange(2**16 + 1)) for k, o in zip(keys, order, strict=True)])
        self.filed = order
        self.asking = (self.owner[votes] << 21) + 2**20 - (votes - self.first[self.owner[votes]])
        self.voters = np.bincount(self.owner[votes], minlength=len(queries))

    def aligned(self, recordings: list[np.ndarray], max_errors: float, least_common: int) -> pd.DataFrame:
        """(recording, query, shift, common, bit_errors): the best offset of each query within the allowed errors of each recording."""
        own = np.concatenate([*recordings, np.zeros(0, dtype=np.int64)]).astype(np.uint32)
        size = np.array([len(r) for r in recordings], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        owner = np.repeat(np.arange(len(recordings)), size)
        at = np.flatnonzero(turns(own, first))
        voters = np.bincount(owner[at], minlength=len(recordings))
        keys = _byte_pairs(own[at])
        low = np.take_along_axis(self.start, keys, axis=1)
        count = np.take_along_axis(self.start, keys + 1, axis=1) - low
        found = []
        # a recording's votes are counted together; recordings are taken while their votes are few enough
        per = np.bincount(owner[at], count.sum(axis=0), len(recordings)).astype(np.int64)
        lots = np.cumsum(per) // LOT_VOTES
        for lot in np.unique(lots):
            mine = np.flatnonzero(lots[owner[at]] == lot)
            votes = []
            for k in range(len(keys)):
                n = count[k, mine]
                some = np.flatnonzero(n)
                n = n[some]
                ends = np.cumsum(n)
                place = self.filed[k][np.repeat(low[k, mine[some]] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
                # recording, query and offset in one number; its parts add up without carrying over
                votes.append(np.repeat((owner[at[mine[some]]] << 42) + (at[mine[some]] - first[owner[at[mine[some]]]]), n) + self.asking[place])
            packed, votes = np.unique(np.concatenate(votes), return_counts=True)
            who, q, shift = packed >> 42, (packed >> 21) & (2**21 - 1), (packed & (2**21 - 1)) - 2**20
            a, b = np.maximum(shift, 0), np.maximum(-shift, 0)
            common = np.minimum(size[who] - a, self.size[q] - b)
            wanted = (common >= least_common) & (votes >= np.minimum(np.minimum(voters[who], self.voters[q]), common) // 100)
            who, q, shift, common, a, b = (x[wanted] for x in (who, q, shift, common, a, b))
            a, b = a + first[who], b + self.first[q]
            for part in range(0, len(a), LOT_VOTES // 16):
                i = slice(part, part + LOT_VOTES // 16)
                errors = bit_errors(own, self.prints, a[i], b[i], common[i], max_errors)
                near = np.flatnonzero(errors <= max_errors) + part
                found.append(pd.DataFrame({"recording": who[near], "query": q[near], "shift": shift[near], "common": common[near], "bit_errors": errors[near - part]}))
        if not found:
            return pd.DataFrame({c: [] for c in ("recording", "query", "shift", "common", "bit_errors")})
        out = pd.concat(found)
        out = out.assign(less=-out["common"], far=out["shift"].abs()).sort_values(["recording", "query", "bit_errors", "less", "far", "shift"])
        return out.drop_duplicates(["recording", "query"])[["recording", "query", "shift", "common", "bit_errors"]]


def bit_errors(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, max_errors: float) -> np.ndarray:
    """The share of different bits of each run of ``common`` prints from ``a`` in x and from ``b`` in y, read to the end only while it may still be in the limit; else 1."""
    wrong, most = np.zeros(len(a), dtype=np.int64), max_errors * 32 * common
    still, step = np.arange(len(a)), 16
    x, y = (np.lib.stride_tricks.sliding_window_view(np.concatenate([z, np.zeros(step, dtype=z.dtype)]), step) for z in (x, y))
    done = 0
    while len(still):
        unlike = x[a[still] + done]
        unlike ^= y[b[still] + done]
        last = common[still] - done
        if last.min() < step:
            short = np.flatnonzero(last < step)
            unlike[short] *= np.arange(step) < last[short, None]
        wrong[still] += np.bitwise_count(unlike.view(np.uint64)).sum(axis=1, dtype=np.uint16)
        over = wrong[still] > most[still]
        wrong[still[over]] = 32 * common[still[over]]
        done += step
        still = still[~over & (last > step)]
    return wrong / (32 * common)


def turns(packed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places that vote: the first and last of each run of equal prints, which is every place but those inside a held tone or silence."""
    edge = np.zeros(len(packed) + 1, dtype=bool)
    edge[first[first <= len(packed)]] = True
    edge[-1] = True
    edge[1:-1] |= packed[1:] != packed[:-1]
    return edge[:-1] | edge[1:]


def _byte_pairs(packed: np.ndarray) -> np.ndarray:
    """(pair, place): the six pairs of a print's bytes as 16-bit keys."""
    byte = [((packed >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64) for k in range(4)]
    return np.stack([byte[j] << 8 | byte[k] for j in range(4) for k in range(j)])


def align(recorded: DataFrame, is_query: Column, max_errors: float = 0.25, least_common: int = 16) -> DataFrame:
    """One row for each row of ``recorded`` (id, prints; others are ignored) with the query recordings that it aligns with.

    Recordings with equal prints are one class, searched for once: class_id is its smallest id.  Returns id, class_id, n_prints, n_queries (to how many
    query recordings it aligns, itself not counted) and, null where there is none, the best of them: query_id, shift (places the query starts
    after the recording), common (places that overlap) and bit_errors (their share).  Ties go to the more common places, then the smallest
    query.  Recordings without prints and rows without id match nothing; repeated rows are copies.  Queries are searched for in blocks of bounded size, each
    against all recordings: every print votes for offsets by any two equal bytes, and offsets with a vote in a hundred places are verified.
    """
    known = (F.size("prints") > 0) & F.col("id").isNotNull()
    rows = recorded.select("id", "prints", F.sha2(F.to_json("prints"), 256).alias("key"), F.coalesce(is_query & known, F.lit(False)).alias("asks"))
    rows = stored(rows, "prints")
    asked = F.min(F.when(F.col("asks"), F.col("id")))
    classes = rows.filter(known).groupBy("key").agg(F.min("id").alias("class_id"), asked.alias("asked"), F.sum(F.col("asks").cast("long")).alias("n_asked"), F.first("prints").alias("prints"))
    classes = stored(classes, "classes")
    queries = classes.filter("asked is not null").select("class_id", "asked", "n_asked", "prints")
    blocks = max(1, math.ceil((queries.agg(F.sum(F.size("prints")).alias("n")).first()["n"] or 0) / BLOCK_PRINTS))
    found = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == b).orderBy("asked").collect()
        held = recorded.sparkSession.sparkContext.broadcast([(r["class_id"], r["asked"], r["n_asked"], np.array(r["prints"], dtype=np.int64)) for r in block])

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = QueryIndex([x[3] for x in held.value])
            own, ids, copies = (np.array([x[k] for x in held.value], dtype=np.int64) for k in range(3))
            for batch in batches:
                for at in range(0, len(batch), LOT_ROWS):
                    part = batch[at : at + LOT_ROWS]
                    near = index.aligned([np.asarray(p) for p in part["prints"]], max_errors, least_common)
                    near = near.assign(class_id=part["class_id"].to_numpy()[near["recording"].astype(int)], query=near["query"].astype(int))
                    near = near[near["class_id"] != own[near["query"]]]
                    near = near.assign(query_id=ids[near["query"]], n=copies[near["query"]], less=-near["common"])
                    near = near.assign(n=near.groupby("class_id")["n"].transform("sum")).sort_values(["class_id", "bit_errors", "less", "query_id"]).drop_duplicates("class_id")
                    yield near[["class_id", "query_id", "shift", "common", "bit_errors", "n"]].astype({"shift": "int32", "common": "int32", "n": "int64", "query_id": "int64"})

        near = stored(classes.select("class_id", "prints").mapInPandas(search, "class_id long, query_id long, shift int, common int, bit_errors double, n long"), "aligned")
        held.unpersist()
        found = near if found is None else found.unionByName(near)
    best = F.min(F.struct("bit_errors", (-F.col("common")).alias("less"), "query_id", "shift", "common")).alias("best")
    found = found.groupBy("class_id").agg(best, F.sum("n").alias("n"))
    out = rows.join(classes.select("key", "class_id", "asked", "n_asked").join(found, "class_id", "left"), "key", "left")
    own = F.col("asked").isNotNull() & (F.col("asked") != F.col("id"))
    pick = lambda name, value: F.when(own, value).otherwise(F.col(f"best.{name}")).alias(name)
    others = F.coalesce("n_asked", F.lit(0)) - F.col("asks").cast("long") + F.coalesce("n", F.lit(0))
    return out.select(
        "id", "class_id", F.size("prints").cast("long").alias("n_prints"), F.when(F.col("id").isNotNull(), others).otherwise(0).alias("n_queries"), pick("query_id", F.col("asked")),
        pick("shift", F.lit(0)), pick("common", F.size("prints")), pick("bit_errors", F.lit(0.0)),
    )
