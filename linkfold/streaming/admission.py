"""Admission of calls as a stream: the state of a key is the times of its last admitted calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, id long, at long, admitted long"


class Admission(StatefulProcessor):
    """Calls (key, id, at: microseconds) of one key go ahead when fewer than ``limit`` have in the last ``window`` microseconds.

    Calls of a batch go by time, then id, behind those of earlier batches.  The state is at most ``limit`` numbers a key.
    """

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.times.get() if self.times.exists() else None
        last = [int(t) for t in held[0]] if held else []
        out = []
        for at in calls["at"].tolist():
            go = max(at, last[-1] if last else at, last[-self.limit] + self.window if len(last) >= self.limit else at)
            last = [*last, go][-self.limit :]
            out.append(go)
        self.times.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(out), "id": calls["id"].to_numpy(), "at": calls["at"].to_numpy(), "admitted": out})

    def close(self) -> None:
        pass


def admitted_stream(calls: DataFrame, key: str, id_column: str, ts: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """(key, id, ts, admitted, waited) for a stream of calls, whose batches come in time order; see ``operators.admission`` for tables.

    The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).  Calls without a time are left out; calls
    without a key are calls of the empty key.
    """
    window = round(seconds * 1_000_000)
    rows = calls.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(id_column).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).filter("at is not null")
    found = rows.groupBy("key").transformWithStateInPandas(Admission(limit, window), OUTPUT, "append", "none")
    return found.select("key", "id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("admitted").alias("admitted"), ((F.col("admitted") - F.col("at")) / 1_000_000).alias("waited"))
