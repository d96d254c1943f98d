"""Admission of calls against a queue of times, as a table and as a stream."""

import datetime as dt
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkfold.operators import admission
from linkfold.streaming.admission import admitted_stream

START = 1_700_000_000_000_000


def plain(calls, limit, window):
    """calls: (key, at, id) in any order; a queue of the last admitted times of each key."""
    queues, out = {}, {}
    for key, at, i in sorted(calls, key=lambda c: (str(c[0]), c[1], c[2])):
        q, now = queues.setdefault(key, deque()), at
        now = max(now, q[-1] if q else now)
        while True:
            while q and now - q[0] >= window:
                q.popleft()
            if len(q) < limit:
                break
            now = q[0] + window
        q.append(now)
        out[i] = now
    return out


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_parts_agree_with_the_queue(limit):
    rng = random.Random(limit)
    for _ in range(60):
        times = sorted(rng.randrange(300) for _ in range(rng.randrange(1, 60)))
        want = plain([("k", t, i) for i, t in enumerate(times)], limit, 40)
        got = admission.admitted_at(np.array(times), limit, 40)
        assert got.tolist() == [want[i] for i in range(len(times))]
        cut = rng.randrange(len(times))
        before = np.full(limit, -(2**62))
        for i in range(cut):
            before[i % limit] = max(before[i % limit], times[i] - 40 * (i // limit))
        assert admission.admitted_at(np.array(times[cut:]), limit, 40, cut, before).tolist() == got.tolist()[cut:]


@pytest.mark.parametrize("part_rows", [10**6, 60])
def test_admissions(spark, monkeypatch, part_rows):
    """Busy keys over many parts, equal times, and rows without key or time."""
    monkeypatch.setattr(admission, "PART_ROWS", part_rows)
    rng = random.Random(9)
    calls = [("busy", START + rng.randrange(300) * 1_000_000, i) for i in range(500)]
    calls += [(rng.choice(["a", "b", "c", None]), START + rng.randrange(50) * 1_000_000, i) for i in range(500, 700)]
    calls += [(f"k{i}", START, i) for i in range(700, 730)]
    at = lambda m: dt.datetime.fromtimestamp(m / 1e6, dt.UTC).replace(tzinfo=None) if m is not None else None
    rows = [(k, at(t), i, "p", "q") for k, t, i in calls] + [("a", None, 900, "p", "q")]
    df = spark.createDataFrame(rows, "user string, ts timestamp, id long, part string, row string").repartition(7)
    found = admission.admissions(df, "user", "ts", "id", 3, 20.0)
    assert found.columns == [*df.columns, "admitted", "waited"]
    got = {r["id"]: r for r in found.select("id", F.unix_micros("admitted").alias("m"), "waited", "part").collect()}
    want = plain(calls, 3, 20_000_000)
    assert len(got) == len(rows) and got[900]["m"] is None and all(got[i]["m"] == m for i, m in want.items())
    assert all(r["waited"] >= 0 for i, r in got.items() if i != 900) and max(r["waited"] or 0 for r in got.values()) > 100
    assert admission.admissions(df.limit(0), "user", "ts", "id", 3).count() == 0
    with pytest.raises(ValueError):
        admission.admissions(df, "user", "ts", "id", 0)


def test_stream(spark, tmp_path):
    """Batches one after the other, as a queue would take them; the state outlives a batch."""
    rng = random.Random(4)
    calls = sorted((START + rng.randrange(400) * 1_000_000, rng.choice(["x", "x", "y"]), i) for i in range(120))
    for k in range(3):
        part = [(i, key, dt.datetime.fromtimestamp(t / 1e6, dt.UTC).replace(tzinfo=None)) for t, key, i in calls[40 * k : 40 * k + 40]]
        spark.createDataFrame(part, "id long, user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = admitted_stream(source, "user", "id", "ts", 2, 15.0)
        out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r["id"]: r["m"] for r in spark.read.parquet(str(tmp_path / "out")).select("id", F.unix_micros("admitted").alias("m")).collect()}
    assert got == plain([(key, t, i) for t, key, i in calls], 2, 15_000_000)
