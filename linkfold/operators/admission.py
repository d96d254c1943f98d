"""Admission of calls to services that take so many in a sliding window: when each call may go ahead.

A call waits for the calls of its key before it, and until fewer than ``limit`` of them were admitted in the last ``window``.  With
calls numbered from 0 in their order, call i is admitted at the latest of ts[j] + window * floor((i - j) / limit) over all j <= i.
With q = i // limit and r = i % limit that is window * q plus the greatest of a[j] = ts[j] - window * q[j] over earlier calls with a
remainder up to r, and of a[j] - window over the others; so all that a stretch of calls must know of what came before it is the
greatest a of each remainder, and these merge by maximum.  A key's calls are therefore cut into parts that are judged at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkfold.operators.tables import written

#: Calls in one part, whichever keys they are of.
PART_ROWS = 200_000
_NONE = -(2**62)


def admitted_at(times: np.ndarray, limit: int, window: int, first: int = 0, before: np.ndarray | None = None) -> np.ndarray:
    """Admission times of calls in order, the first of which has the number ``first``; ``before``: greatest a of each remainder of earlier calls."""
    best = np.full(limit, _NONE, dtype=np.int64) if before is None else before.copy()
    out = np.empty(len(times), dtype=np.int64)
    for k, t in enumerate(times.tolist()):
        q, r = divmod(first + k, limit)
        best[r] = max(best[r], t - window * q)
        late = best[: r + 1].max()
        if r + 1 < limit:
            late = max(late, best[r + 1 :].max() - window)
        out[k] = late + window * q
    return out


def admissions(calls: DataFrame, key: str, ts: str, order: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """``calls`` with ``admitted`` (timestamp) and ``waited`` (seconds): ``limit`` calls of a key go ahead in any ``seconds``, the others wait.

    Calls of a key go in the order of their time, then of the column ``order``, which should tell equal times apart.  A call
    without a time is never admitted and keeps nobody waiting; calls without a key are calls of one key.  A call may come exactly
    ``seconds`` after the one that makes room.

    Parts of the calls are dealt out by ranges of key and time, so a key with a third of all calls is in many tasks; of each
    part and each key that reaches over a part's end, ``limit`` numbers are exchanged.
    """
    if limit < 1:
        raise ValueError("at least one call must be admitted")
    window = round(seconds * 1_000_000)
    row = F.struct(*calls.columns).alias("row")
    timed = calls.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("order"), row)
    usable = timed.filter("at is not null")
    parts = max(1, math.ceil(usable.count() / PART_ROWS))
    dealt = written(usable.repartitionByRange(parts, "key", "at", "order").withColumn("part", F.spark_partition_id()), "calls")

    counts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    # keys that reach over a part's end: at most two for each part
    several = counts.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("parts > 1") if parts > 1 else counts.limit(0)
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = several.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    firsts = written(firsts, "firsts")
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["part"] == b["part"])
    joined = dealt.join(F.broadcast(firsts), same(dealt, firsts)).select(dealt["key"], dealt["part"], "at", "order", "first")
    number = F.col("first") + F.row_number().over(Window.partitionBy("key", "part").orderBy("at", "order")) - 1
    numbered = joined.withColumn("i", number).select("key", "part", (F.col("i") % limit).alias("r"), (F.col("at") - window * F.floor(F.col("i") / limit)).alias("a"))
    best = numbered.groupBy("key", "part", "r").agg(F.max("a").alias("a")).groupBy("key", "part").agg(F.map_from_entries(F.collect_list(F.struct("r", "a"))).alias("best"))
    values = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda r: F.try_element_at("best", r.cast("long")))
    slots = firsts.join(best, firsts["key"].eqNullSafe(best["key"]) & (firsts["part"] == best["part"]), "left").select(firsts["key"], firsts["part"], "first", values.alias("slots"))
    slots = slots.select("key", "part", "first", F.posexplode_outer("slots").alias("r", "a"))
    before = F.max("a").over(Window.partitionBy("key", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = slots.withColumn("before", F.coalesce(before, F.lit(_NONE))).groupBy("key", "part", "first").agg(F.array_sort(F.collect_list(F.struct("r", "before"))).alias("before"))
    carried = written(carried.select("key", "part", "first", F.transform("before", lambda b: b["before"]).alias("before")), "carried")

    rows = dealt.join(F.broadcast(carried), same(dealt, carried), "left").select(dealt["key"], dealt["part"], "at", "order", "row", "first", "before")
    schema = dealt.schema["row"].dataType.simpleString()

    def admit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "at", "order"], kind="stable", na_position="first").reset_index(drop=True)
        out = np.empty(len(rows), dtype=np.int64)
        for _, group in rows.groupby(rows["key"].fillna("") + rows["key"].isna().map({True: "\0", False: ""}), sort=False):
            first, before = group["first"].iloc[0], group["before"].iloc[0]
            out[group.index] = admitted_at(group["at"].to_numpy(), limit, window, 0 if pd.isna(first) else int(first), None if before is None else np.asarray(before, dtype=np.int64))
        return pd.DataFrame({"row": rows["row"], "at": rows["at"], "admitted": out})

    judged = rows.groupBy("part").applyInPandas(admit, f"row {schema}, at long, admitted long")
    never = timed.filter("at is null").select("row", "at", F.lit(None).cast("long").alias("admitted"))
    return judged.unionByName(never).select("row.*", F.timestamp_micros("admitted").alias("admitted"), ((F.col("admitted") - F.col("at")) / 1_000_000).alias("waited"))
