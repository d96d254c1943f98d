"""Records as JSON that any reader takes, and times of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DateType, DecimalType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType


def _safe(value: Column, kind: DataType) -> Column | None:
    """A value as JSON can hold it; None where it can't."""
    if isinstance(kind, BinaryType):
        return None
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return value.cast("string")
    if isinstance(kind, DecimalType):
        return value.cast("double")
    if isinstance(kind, StructType):
        parts = [(f.name, _safe(value[f.name], f.dataType)) for f in kind.fields if not f.name.startswith("_")]
        kept = [(c if c is not None else F.lit(None).cast("string")).alias(n) for n, c in parts]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, ArrayType):
        inner = lambda x: _safe(x, kind.elementType)
        return None if isinstance(kind.elementType, BinaryType) else F.transform(value, inner)
    if isinstance(kind, MapType):
        return None if isinstance(kind.valueType, BinaryType) else F.transform_values(F.map_filter(value, lambda k, v: ~k.cast("string").startswith("_")), lambda k, v: _safe(v, kind.valueType))
    return value


def json_records(rows: DataFrame) -> DataFrame:
    """(json): each row as an object of all its columns, nulls included.

    Names that begin with an underscore are private and left out, at any depth; binary values, NaN and infinities are null, times and dates
    are texts.
    """
    parts = [(f.name, _safe(F.col(f"`{f.name}`"), f.dataType)) for f in rows.schema.fields if not f.name.startswith("_")]
    kept = [(c if c is not None else F.lit(None).cast("string")).alias(n) for n, c in parts]
    return rows.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("json"))


def timing_records(steps: DataFrame) -> DataFrame:
    """(run, step, start_ms, ms) of steps (run, step, started: timestamp, ms, skipped): when each began after its run's first, and how long it took, to a tenth.

    Skipped steps and those that took no time have no record, and of a step that was taken twice the last counts; ``total`` is
    from the run's first begin to its last end.  Rows without run, step or begin don't count.
    """
    usable = steps.filter("run is not null and step is not null and started is not null").withColumn("at", F.unix_micros(F.col("started").cast("timestamp")) / 1000)
    first = usable.groupBy("run").agg(F.min("at").alias("begin"), F.max(F.col("at") + F.coalesce("ms", F.lit(0.0))).alias("end"))
    took = usable.filter(~F.coalesce("skipped", F.lit(False)) & (F.col("ms") > 0)).groupBy("run", "step").agg(F.max(F.struct("at", "ms")).alias("last"))
    each = took.join(first, "run").select("run", "step", F.round(F.col("last.at") - F.col("begin"), 1).alias("start_ms"), F.round("last.ms", 1).alias("ms"))
    return each.unionByName(first.select("run", F.lit("total").alias("step"), F.lit(0.0).alias("start_ms"), F.round(F.col("end") - F.col("begin"), 1).alias("ms")))
