"""Results of an external model, kept by the content that they are of, so that no content goes to the model twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkfold.sources import versions


def with_model(rows: DataFrame, content: str, model: Callable[[pd.Series], pd.Series], result: str, path: str, name: str, version: str = "1", batch: tuple[str, int] | None = None, at_once: int = 64) -> DataFrame:
    """``rows`` with the model's result for the column ``content`` in a new column ``name``, of the SQL type ``result``.

    ``model`` gets a series of distinct contents, at most ``at_once`` of them, and gives one of results.  Contents are known by
    their SHA-256 and the model's ``version``; only those that the store under ``path`` hasn't got reach the model, and their
    results are appended in one commit before rows are filled from the store.  A null result isn't kept, so that content is tried
    again next time.  Null contents have a null result.  Works on the batches of a stream: pass ``batch`` (the stream's name and
    the batch's number), and a batch that comes again adds nothing.  A task that is run again asks the model again, but only
    the results of one run are kept.
    """
    if name in rows.columns:
        raise ValueError(f"rows have a column {name} already")
    spark = rows.sparkSession
    key = F.concat_ws(":", F.lit(version), F.sha2(F.col(content).cast("binary"), 256))
    kind = rows.schema[content].dataType.simpleString()
    asked = rows.filter(F.col(content).isNotNull()).select(key.alias("key"), F.col(content).alias("content")).groupBy("key").agg(F.first("content").alias("content"))
    known = versions.read(spark, path) if versions.last_commit(spark, path).schema else None
    unseen = asked.join(known.select("key"), "key", "left_anti") if known is not None else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for low in range(0, len(part), at_once):
                some = part[low : low + at_once]
                yield pd.DataFrame({"key": some["key"].to_numpy(), "result": pd.Series(list(model(some["content"].reset_index(drop=True))), dtype=object)})

    if kind not in ("string", "binary"):
        raise ValueError(f"contents are strings or binary values, not {kind}")
    if not unseen.isEmpty():
        versions.append(unseen.mapInPandas(run, f"key string, result {result}").filter("result is not null"), path, batch)
        known = versions.read(spark, path)
    if known is None:
        return rows.withColumn(name, F.lit(None).cast(result))
    # writers at the same time may both have asked for a content; either result will do, but always the same one
    kept = known.groupBy("key").agg(F.first("result").alias("result")).select(F.col("key").alias("_key"), F.col("result").alias(name))
    held = rows.withColumn("_key", F.when(F.col(content).isNotNull(), key))
    return held.join(kept, "_key", "left").drop("_key")
