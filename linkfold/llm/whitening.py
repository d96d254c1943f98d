"""Whitening of embeddings from an exact covariance, by products of digit slices.

Entries become integers, which are centred by an integer near the mean and split into balanced digits of 16 bits.  Products of
matrices of such digits stay below 2**53 in a batch, so float64 BLAS gives them exactly; per place value they are added up by
Spark, put together as big integers, and corrected for the rest of the mean.  The covariance is therefore exact, whatever the
data's offset and order, and its eigenvectors are found by Jacobi's rotations in extended precision, which keep small ones, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkfold.llm.scratch import stored

DIGIT = 16
#: Rows whose digit products are exact in one float64 product: 2**(53 - 2 * (DIGIT + 1)).
BLOCK = 2**19
#: Components with less of the variance than this are lost to the rounding of doubles, and count as having none.
NEGLIGIBLE = 1e-18
_SAFE = 2**62


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) for each entry as a double; null where the vector is null or has null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(F.coalesce(c, F.lit(0))) & (F.abs(F.coalesce(c, F.lit(0))) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def digits(x: np.ndarray) -> list[np.ndarray]:
    """Balanced digits of 64-bit integers, the lowest first: x = sum of digit[k] * 2**(DIGIT * k), with -2**15 <= digit < 2**15."""
    out = []
    while x.any() or not out:
        carry = (x >> (DIGIT - 1)) & 1
        out.append((x & (2**DIGIT - 1)) - (carry << DIGIT))
        x = (x >> DIGIT) + carry
    return out


def centred_digits(x: np.ndarray, centre: list[np.ndarray]) -> list[np.ndarray]:
    """Digits of x - centre, each below 2**16 in size: the difference itself may not fit in 64 bits, those of the digits do."""
    mine, none = digits(x), np.zeros(x.shape[1], dtype=np.int64)
    n = max(len(mine), len(centre))
    mine += [np.zeros_like(x)] * (n - len(mine))
    return [(d - c).astype(np.float64) for d, c in zip(mine, [*centre, *[none] * (n - len(centre))], strict=True)]


def _added(parts: DataFrame) -> dict[int, list[int]]:
    """Sums of rows (place, values array<long>) by place value and position, exact; at most as many rows as sizes of the result."""
    flat = parts.select("place", F.posexplode("values").alias("at", "value"))
    out: dict[int, list[int]] = {}
    for place, at, value in flat.groupBy("place", "at").agg(F.sum(F.col("value").cast("decimal(38,0)"))).orderBy("place", "at").collect():
        out.setdefault(place, []).append(int(value))
    return out


def _joined(parts: dict[int, list[int]], size: int) -> list[int]:
    """Big integers from the sums of their place values."""
    return [sum(values[i] << (DIGIT * place) for place, values in parts.items()) for i in range(size)]


def _per_partition(fit: DataFrame, width: int, of_block) -> dict[int, list[int]]:
    """Sum what ``of_block`` gives for blocks of rows: arrays by place value, each added up in 64 bits within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for low in range(0, len(x), BLOCK):
                for place, values in of_block(x[low : low + BLOCK]).items():
                    total[place] = total[place] + values if place in total else values
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["place", "values"])

    return _added(fit.select("x").mapInArrow(run, "place int, values array<long>"))


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    """Sums of the entries of x by dimension."""
    return _joined(_per_partition(fit, width, lambda x: {k: d.sum(axis=0) for k, d in enumerate(digits(x))}), width)


def exact_products(fit: DataFrame, width: int, centre: list[int]) -> list[list[int]]:
    """Sum over the rows of (x - centre)(x - centre)', by slices of digits."""
    rows, columns = np.triu_indices(width)
    shifts = digits(np.array(centre, dtype=np.int64))

    def products(x: np.ndarray) -> dict[int, np.ndarray]:
        slices, out = centred_digits(x, shifts), {}
        for a, left in enumerate(slices):
            for b, right in enumerate(slices):
                out[a + b] = out.get(a + b, 0) + (left.T @ right)[rows, columns].astype(np.int64)
        return out

    upper = _joined(_per_partition(fit, width, products), len(rows))
    full = [[0] * width for _ in range(width)]
    for i, j, value in zip(rows.tolist(), columns.tolist(), upper, strict=True):
        full[i][j] = full[j][i] = value
    return full


def rank(square: list[list[int]]) -> int:
    """Rank of a matrix of integers, by elimination modulo a prime of 61 bits (too small with a chance of about 2**-55)."""
    prime = 2**61 - 1
    left, found = np.array([[v % prime for v in row] for row in square], dtype=object), 0
    for j in range(left.shape[1] if len(left) else 0):
        at = next((i for i in range(found, len(left)) if left[i, j]), None)
        if at is None:
            continue
        left[[found, at]] = left[[at, found]]
        left[found] = left[found] * pow(int(left[found, j]), -1, prime) % prime
        below = left[found + 1 :]
        below[:] = (below - np.outer(below[:, j], left[found])) % prime
        found += 1
    return found


def eigen(square: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance, by rounds of disjoint Jacobi rotations.

    Rotations go on while an entry isn't negligible beside its own two diagonal entries, which keeps the precision of small
    eigenvalues beside large ones.
    """
    n = len(square)
    a, q, tiny = square.astype(np.longdouble), np.eye(n, dtype=np.longdouble), np.finfo(np.longdouble).eps
    ring = list(range(n)) + [-1] * (n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if i >= 0 and j >= 0]
            ring.insert(1, ring.pop())
            i, j = np.array(pairs, dtype=int).reshape(-1, 2).T
            act = np.abs(a[i, j]) > tiny * np.sqrt(np.abs(a[i, i] * a[j, j]))
            i, j = i[act], j[act]
            if not len(i):
                continue
            turned = True
            ratio = (a[j, j] - a[i, i]) / (2 * a[i, j])
            t = np.where(ratio < 0, -1, 1) / (np.abs(ratio) + np.sqrt(ratio * ratio + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            for m in (a, a.T, q):  # columns, rows, and the columns of the product of all rotations
                left, right = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * left - s * right, s * left + c * right
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


@dataclass
class Whitener:
    """What rows need: n, the sums S = n * centre + rest, and the first components as columns, over the root of their eigenvalue."""

    n: int
    centre: list[int]
    rest: list[int]
    project: np.ndarray
    explained: list[float | None]
    flat: list[bool]

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows, and their exact deviations: the sums of (n * x - S)**2."""
        centre, width = np.array(self.centre, dtype=np.int64), x.shape[1]
        far = max(int(x.max(initial=0)), -int(x.min(initial=0)), *map(abs, self.centre), 0)
        if far < _SAFE:
            z = x - centre
            near = z.astype(np.float64)
        else:
            z = x.astype(object) - centre.astype(object)
            near = (x.astype(np.longdouble) - centre.astype(np.longdouble)).astype(np.float64)
        if 4 * width * far * max(far, self.n) >= _SAFE:
            z = z.astype(object)
        rest = np.array(self.rest, dtype=object)
        square, cross = (z * z).sum(axis=1), (z * (rest if z.dtype == object else rest.astype(np.int64))).sum(axis=1)
        constant = sum(r * r for r in self.rest)
        deviations = [self.n * (self.n * int(a) - 2 * int(b)) + constant for a, b in zip(square, cross, strict=True)]
        return (near - np.array([r / self.n for r in self.rest])) @ self.project, deviations


def fit_whitener(fit: DataFrame, width: int, components: int = 4) -> Whitener | None:
    """Components of distinct integer vectors (x), largest eigenvalue first; None without rows."""
    n = fit.count()
    if not n or not width:
        return None
    sums = exact_sums(fit, width)
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    products = exact_products(fit, width, centre)
    scaled = [[n * v - rest[i] * rest[j] for j, v in enumerate(row)] for i, row in enumerate(products)]  # n**2 times the covariance
    trace = sum(scaled[i][i] for i in range(width))

    def extended(value: int) -> np.longdouble:
        high = value / n**2
        return np.longdouble(high) + np.longdouble(float(Fraction(value, n**2) - Fraction(high)))

    values, vectors = eigen(np.array([[extended(v) for v in row] for row in scaled], dtype=np.longdouble))
    full, kept = rank(scaled), min(components, width)
    flat = [k >= full or bool(values[k] <= NEGLIGIBLE * extended(trace)) for k in range(kept)]
    project = np.zeros((width, kept))
    for k in range(kept):
        unit = vectors[:, k] * (1 if vectors[np.argmax(np.abs(vectors[:, k])), k] > 0 else -1)
        project[:, k] = 0 if flat[k] else (unit / np.sqrt(values[k])).astype(np.float64)
    explained = [None if not trace else 0.0 if flat[k] else float(values[k] / extended(trace)) for k in range(kept)]
    return Whitener(n, centre, rest, project, explained, flat)


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Per usable row and component: key, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    vectors: key, vector array<float or double>; other columns are left out.  Rows with a null vector, or with null or non-finite
    entries, are dropped, and so are those whose length isn't the most frequent one among distinct vectors (of equally frequent
    ones, the greatest); entries beyond 64 bits after scaling count as the greatest or smallest long.  Repeated rows and keys, and
    null keys, give rows of their own, but a vector enters the fit once.  Where the covariance's rank is below a component's
    number, or its variance negligible beside the whole, ``whitened`` is null and ``explained`` 0, or null without any variance; ``identity_error`` covers the other
    components (null without any).  No usable rows give no rows.  ``deviation`` beyond 38 digits is null.

    The driver holds matrices of width x width entries; rows stay in tasks.
    """
    rows = vectors.select(F.col(key).alias("key"), integers(F.col(vector), scale).alias("x")).filter("x is not null")
    fit = stored(rows.select("x").distinct(), "fit")
    found = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = found["width"] if found else 0
    fit = fit.filter(F.size("x") == width)
    model = fit_whitener(fit, width, components)
    schema = "deviation string, whitened array<double>"
    if model is None:
        empty = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.filter("false").select(F.col("key").alias(key)).join(vectors.sparkSession.createDataFrame([], empty))
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whitened, deviations = held.value.rows(matrix(batch.column("x"), width))
            columns = [batch.column(0), pa.array(map(str, deviations), pa.string()), pa.array(list(whitened), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "deviation", "whitened"])

    def projected(x: DataFrame) -> DataFrame:
        kind = x.schema["key"].dataType.simpleString()
        return x.mapInArrow(project, f"key {kind}, {schema}")

    live = [k for k, flat in enumerate(model.flat) if not flat]
    error = None
    if live:
        w = projected(fit.select(F.lit(0).alias("key"), "x")).select([F.col("whitened")[k].alias(f"w{k}") for k in live])
        covariances = w.agg(*[F.abs(F.covar_pop(f"w{i}", f"w{j}") - float(i == j)).alias(f"{i}_{j}") for i in live for j in live if i <= j])
        error = max(covariances.first())
    parts = F.arrays_zip(
        F.lit(list(range(1, len(model.flat) + 1))).alias("component"), F.col("whitened"), F.array([F.lit(e).cast("double") for e in model.explained]).alias("explained"), F.lit(model.flat).alias("flat")
    )
    out = projected(rows.filter(F.size("x") == width)).select("key", "deviation", F.explode(parts).alias("part"))
    return out.select(
        F.col("key").alias(key), F.col("part.component").cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"),
        F.when(~F.col("part.flat"), F.col("part.whitened")).alias("whitened"), F.col("part.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
