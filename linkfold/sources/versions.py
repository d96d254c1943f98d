"""Tables whose loads, appends and upserts take effect at once or not at all.

A table is a folder of data folders and of numbered commits.  A commit is a small file that names the data folders which make
up the table; it appears by one rename that fails if its number is taken, so readers see the table of the last commit, and of
two writers that started from the same one, one has to start again.  What a failed write leaves behind is in no commit.

Keyed tables are kept in buckets by a hash of the key, so an upsert writes anew only the buckets that it touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkfold.sources.writers import upserted

BUCKETS = 64
#: Times that a writer starts again because another one came first.
ATTEMPTS = 20
_COMMITS = "_commits"


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass
class Commit:
    """The table after commit ``number``: data folders by label (a bucket, or a load of its own), and the last batch of each stream."""

    number: int = 0
    schema: str | None = None
    folders: dict[str, str] = field(default_factory=dict)
    keys: list[str] | None = None
    batches: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def last_commit(spark: SparkSession, path: str) -> Commit:
    """The table's last commit; one without a number if there is none."""
    files, make = _files(spark, path)
    folder = make(f"{path}/{_COMMITS}")
    if not files.exists(folder):
        return Commit()
    numbers = [int(s.getPath().getName()) for s in files.listStatus(folder) if s.getPath().getName().isdigit()]
    if not numbers:
        return Commit()
    text = spark.read.text(f"{path}/{_COMMITS}/{max(numbers):010d}", wholetext=True).first()[0]
    return Commit(max(numbers), **json.loads(text))


def _commit(spark: SparkSession, path: str, new: Commit) -> None:
    files, make = _files(spark, path)
    files.mkdirs(make(f"{path}/{_COMMITS}"))
    draft, final = make(f"{path}/{_COMMITS}/.draft-{uuid.uuid4().hex}"), make(f"{path}/{_COMMITS}/{new.number:010d}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({"schema": new.schema, "folders": new.folders, "keys": new.keys, "batches": new.batches}).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), options)  # fails where the number is taken
    except Exception as e:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(f"commit {new.number} of {path} is taken") from e
        raise


def read(spark: SparkSession, path: str, commit: Commit | None = None, labels: list[str] | None = None) -> DataFrame:
    """The table of the last commit, or of a given one; with ``labels`` only these of its folders.  A table without commits is refused."""
    commit = commit or last_commit(spark, path)
    if commit.schema is None:
        raise FileNotFoundError(f"{path} has no commit")
    schema = StructType.fromJson(json.loads(commit.schema))
    chosen = [f"{path}/{folder}" for label, folder in sorted(commit.folders.items()) if labels is None or label in labels]
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, keys: list[str] | None, buckets: int) -> dict[str, str]:
    """Write rows into a new data folder; its parts by label."""
    name = f"data-{uuid.uuid4().hex}"
    if keys is None:
        df.write.parquet(f"{path}/{name}")
        return {name: name}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    df.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    files, make = _files(df.sparkSession, path)
    found = [s.getPath().getName() for s in files.listStatus(make(f"{path}/{name}"))]
    return {f.removeprefix("_bucket="): f"{name}/{f}" for f in found if f.startswith("_bucket=")}


def _attempt(spark: SparkSession, path: str, batch: tuple[str, int] | None, change: Callable[[Commit], Commit | None]) -> bool:
    """Commit what ``change`` makes of the last commit, again from the start while others come first; whether anything was committed."""
    for _ in range(ATTEMPTS):
        base = last_commit(spark, path)
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return False
        new = change(base)
        if new is None:
            return False
        new.number = base.number + 1
        new.batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        try:
            _commit(spark, path, new)
            return True
        except Conflict:
            continue
    raise Conflict(f"{path}: other writers came first {ATTEMPTS} times")


def replace(df: DataFrame, path: str, keys: list[str] | None = None, buckets: int = BUCKETS, batch: tuple[str, int] | None = None) -> bool:
    """Load a table anew; readers see the old rows until all new ones are there.  With ``keys`` it can be upserted into later.

    ``batch``: the name of a stream and the number of its batch; a batch that was committed before changes nothing.
    """
    key_list = [str(buckets), *keys] if keys else None
    written: dict[str, str] = {}

    def change(_: Commit) -> Commit:
        if not written:
            written.update(_write(df, path, keys, buckets))
        return Commit(schema=df.schema.json(), folders=dict(written), keys=key_list)

    return _attempt(df.sparkSession, path, batch, change)


def append(df: DataFrame, path: str, batch: tuple[str, int] | None = None) -> bool:
    """Add rows to a table without keys, or make it.  Columns are those of the table, by name."""
    written: dict[str, str] = {}

    def change(base: Commit) -> Commit:
        if base.keys:
            raise ValueError(f"{path} has keys; use upsert")
        if not written:
            rows = df.select(*StructType.fromJson(json.loads(base.schema)).names) if base.schema else df
            written.update(_write(rows, path, None, 0))
        return Commit(schema=base.schema or df.schema.json(), folders=base.folders | written)

    return _attempt(df.sparkSession, path, batch, change)


def upsert(changes: DataFrame, path: str, order: str, batch: tuple[str, int] | None = None) -> bool:
    """Put the last change of each key, by ``order``, in place of the table's row, or add it; only the buckets of these keys are written.

    Rows of the table are replaced whatever their own ``order``, so the same changes in the same turn change nothing more.  Columns
    are those of the table.  Null keys are keys like others.  No changes make no commit.
    """
    spark = changes.sparkSession

    def change(base: Commit) -> Commit | None:
        if not base.keys:
            raise ValueError(f"{path} has no keys")
        buckets, keys = int(base.keys[0]), base.keys[1:]
        marked = changes.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("b")).distinct()
        touched = sorted(str(r["b"]) for r in marked.collect())  # at most as many as buckets
        if not touched:
            return None
        current = read(spark, path, base, touched)
        merged = upserted(current, changes.select(*current.columns), keys, order)
        return Commit(schema=base.schema, keys=base.keys, folders=base.folders | _write(merged, path, keys, buckets))

    return _attempt(spark, path, batch, change)


def forget(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` commits, and data that only these named; how many data folders went.  Readers of older commits fail."""
    files, make = _files(spark, path)
    last = last_commit(spark, path).number
    commits = {n: Commit(n, **json.loads(spark.read.text(f"{path}/{_COMMITS}/{n:010d}", wholetext=True).first()[0])) for n in range(1, last + 1) if files.exists(make(f"{path}/{_COMMITS}/{n:010d}"))}
    kept = {f for n, c in commits.items() if n > last - keep for f in c.folders.values()}
    gone = {f for n, c in commits.items() if n <= last - keep for f in c.folders.values()} - kept
    for n in commits:
        if n <= last - keep:
            files.delete(make(f"{path}/{_COMMITS}/{n:010d}"), False)
    for folder in gone:
        files.delete(make(f"{path}/{folder}"), True)
    return len(gone)
