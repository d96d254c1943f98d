"""The log of queries as a stream: counts of outcomes by event time, with late rows up to a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parquet files of a folder as they come in."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_report(log: DataFrame, ts: str, outcome: str, seconds: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, outcome, n, mean_seconds) for each window of event time; a window is final once the watermark has passed it.

    The state is one row for each open window and outcome, whatever the number of rows.  Rows with a null time belong to no window; missing,
    negative and NaN seconds don't count in the mean.
    """
    took = F.when(~F.isnan(seconds) & (F.col(seconds) >= 0), F.col(seconds))
    rows = log.select(F.col(ts).cast("timestamp").alias("ts"), F.col(outcome).alias("outcome"), took.alias("took")).filter("ts is not null")
    counted = rows.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("took"), 6).alias("mean_seconds"))
    return counted.select(F.col("w.start").alias("start"), "outcome", "n", "mean_seconds")


def write_report(report: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append final windows to a Parquet folder; with ``once`` the query ends when all files that are there have been read."""
    writer = report.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
