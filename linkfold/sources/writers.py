"""Sinks: whole-table loads, upserts, and files of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str) -> None:
    """Load a table anew into one folder; while it is written there is none.  ``versions.replace`` keeps the old rows readable until then."""
    df.write.mode("overwrite").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the last change of each key, by ``order``: changed keys replaced, new ones added.  Both have the same columns."""
    rest = [c for c in current.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")
    kept = current.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last)


def write_predictions(df: DataFrame, path: str) -> None:
    """One JSON object for each query, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_split(df: DataFrame, key: str, seed: int = 42, validation: float = 0.1) -> DataFrame:
    """Rows with ``split``: train or validation by a hash of the key, the same in every run."""
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(10_000))
    return df.withColumn("split", F.when(share < round(10_000 * validation), "validation").otherwise("train"))


def export_rows(df: DataFrame, key: str, path: str, limit: int | None = None, seed: int = 42, validation: float = 0.1) -> DataFrame:
    """Write the rows that have a key, with their split, in the key's order, and return one row of metadata: rows, those of each split, seed and share.

    ``limit`` asks for the first rows by key, for a trial export.
    """
    rows = export_split(df.filter(F.col(key).isNotNull()), key, seed, validation)
    rows = rows.orderBy(key).limit(limit) if limit is not None else rows
    rows.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation")]]
    return written.agg(*counts).withColumns({"seed": F.lit(seed), "share": F.lit(validation)})
