"""Parallelism of small inputs, and columns that are worked out once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, if it comes in fewer partitions than there are cores; larger inputs stay as they are.

    A table in one small file is one task, whatever is done to its rows; dealing it out first costs no more than its few bytes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out over some tasks a core, by ``keys`` if there are any, for work on its rows that is far dearer than their bytes.

    Adaptive execution joins the parts of a shuffle by their bytes, so texts of a megabyte would be compared in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def once(df: DataFrame) -> DataFrame:
    """``df`` with each column worked out once a row, however many later ones read it.

    A plan puts a column's expression in the place of each use that it can see, those of functions in Python among them; it doesn't see through batches that pass by Python as they are.
    """

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches

    return df.mapInArrow(same, df.schema)
