"""Versioned tables under failing and competing writers, and results of a model kept by content."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkfold.sources import model_cache, versions

SCHEMA = "k long, v string, n int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_is_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    first = [(1, "a", 1), (2, None, 2), (None, "c", 3)]
    assert versions.replace(spark.createDataFrame(first, SCHEMA), path)
    reader = versions.read(spark, path)
    dying = spark.range(200, numPartitions=8).select("id", F.when(F.col("id") == 199, F.raise_error(F.lit("dies midway")).cast("string")).otherwise("x").alias("v"), F.lit(1).alias("n"))
    with pytest.raises(Exception, match="dies midway"):
        versions.replace(dying, path)
    assert rows_of(versions.read(spark, path)) == sorted(first, key=str)
    assert versions.replace(spark.createDataFrame([(9, "z", 9)], SCHEMA), path)
    assert rows_of(reader) == sorted(first, key=str) and rows_of(versions.read(spark, path)) == [(9, "z", 9)]  # who reads the old rows goes on
    assert versions.replace(spark.createDataFrame([], SCHEMA), path) and versions.read(spark, path).count() == 0
    assert versions.forget(spark, path, keep=1) == 2 and versions.read(spark, path).columns == ["k", "v", "n"]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(spark.createDataFrame([(i, "old", 0) for i in range(300)], SCHEMA), path, keys=["k"], buckets=16)
    before = versions.last_commit(spark, path)
    changes = spark.createDataFrame([(5, "x", 1), (5, "y", 2), (900, "new", 1), (5, "w", 0)], SCHEMA)
    assert versions.upsert(changes, path, "n", batch=("s", 0))
    after = versions.last_commit(spark, path)
    assert 1 <= sum(after.folders[b] != before.folders.get(b) for b in after.folders) <= 2
    want = rows_of(versions.read(spark, path))
    assert len(want) == 301 and (5, "y", 2) in want and (900, "new", 1) in want
    assert not versions.upsert(changes, path, "n", batch=("s", 0))  # the batch comes again
    assert versions.upsert(changes, path, "n") and rows_of(versions.read(spark, path)) == want  # so do its rows
    assert not versions.upsert(changes.limit(0), path, "n")
    with pytest.raises(ValueError):
        versions.append(changes, path)
    loose = str(tmp_path / "loose")
    versions.append(changes, loose)
    with pytest.raises(ValueError):
        versions.upsert(changes, loose, "n")


def test_competing_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken starts again from the other's rows."""
    path = str(tmp_path / "t")
    versions.replace(spark.createDataFrame([(1, "a", 1)], SCHEMA), path, keys=["k"], buckets=2)
    real, turns = versions._commit, []

    def late(spark_, path_, new):
        if not turns:
            turns.append(1)
            versions.upsert(spark.createDataFrame([(2, "other", 1)], SCHEMA), path_, "n")
        real(spark_, path_, new)

    monkeypatch.setattr(versions, "_commit", late)
    versions.upsert(spark.createDataFrame([(3, "mine", 1)], SCHEMA), path, "n")
    assert rows_of(versions.read(spark, path)) == [(1, "a", 1), (2, "other", 1), (3, "mine", 1)]
    assert versions.last_commit(spark, path).number == 3
    monkeypatch.setattr(versions, "_commit", real)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, versions.Commit(3, "{}"))


def _model(calls):
    def model(contents: pd.Series) -> pd.Series:
        with open(calls, "a") as f:
            f.writelines(f"{c}\n" for c in contents)
        return contents.map(lambda c: None if c == "fails" else [float(len(c)), 1.0])

    return model


def test_model_is_asked_once(spark, tmp_path):
    path, calls = str(tmp_path / "store"), str(tmp_path / "calls")
    asked = lambda: open(calls).read().split("\n")[:-1]
    rows = spark.createDataFrame([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None), (5, "fails")], "id int, text string").withColumns({"key": F.lit("k"), "result": F.lit("r")}).repartition(3)
    got = {r["id"]: r["e"] for r in model_cache.with_model(rows, "text", _model(calls), "array<double>", path, "e").collect()}
    assert got == {1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0], 4: None, 5: None} and sorted(asked()) == ["aa", "bbb", "fails"]
    again = model_cache.with_model(rows.filter("text is null or text != 'fails'"), "text", _model(calls), "array<double>", path, "e")
    assert again.count() == 4 and again.columns == [*rows.columns, "e"] and len(asked()) == 3
    more = model_cache.with_model(spark.createDataFrame([(7, "aa"), (8, "c"), (9, "fails")], "id int, text string"), "text", _model(calls), "array<double>", path, "e")
    assert {r["id"]: r["e"] for r in more.collect()} == {7: [2.0, 1.0], 8: [1.0, 1.0], 9: None} and sorted(asked()[3:]) == ["c", "fails"]
    model_cache.with_model(rows.filter("id = 1"), "text", _model(calls), "array<double>", path, "e", version="2").count()
    assert asked()[5:] == ["aa"]
    nothing = model_cache.with_model(rows.limit(0), "text", _model(calls), "array<double>", str(tmp_path / "other"), "e")
    assert nothing.count() == 0 and nothing.columns == [*rows.columns, "e"]
    with pytest.raises(ValueError):
        model_cache.with_model(rows, "text", _model(calls), "array<double>", path, "id")


def test_model_in_a_stream(spark, tmp_path):
    path, calls = str(tmp_path / "store"), str(tmp_path / "calls")
    for k in range(3):
        spark.createDataFrame([(k, "same"), (10 + k, f"own {k}")], "id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def each(batch, number):
        filled = model_cache.with_model(batch, "text", _model(calls), "array<double>", path, "e", batch=("s", number))
        versions.append(filled, str(tmp_path / "out"), batch=("s", number))

    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = {r["id"]: r["e"][0] for r in versions.read(spark, str(tmp_path / "out")).collect()}
    assert out == {0: 4.0, 1: 4.0, 2: 4.0, 10: 5.0, 11: 5.0, 12: 5.0}
    assert sorted(open(calls).read().split("\n")[:-1]) == ["own 0", "own 1", "own 2", "same"]
