"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests on one
machine) is a folder of this process used.  A written table cuts the lineage, survives the loss of an executor, and is read
again column by column with its true size, which a cached DataFrame would not be.  Tables stay while the process runs,
as results may still read them, and are deleted at its end or by ``release``.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets ``spark.checkpoint.dir`` for this session where it is unset and the master is local, else refuses."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; it is unset, and the master is {master}")
    own = tempfile.mkdtemp(prefix="linkfold-")
    _own.append(own)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkfold-{name}-{uuid.uuid4().hex[:12]}"
    _stored.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, what is stored passes at most ``rows`` rows to Python at a time, for rows that hold large arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Delete all tables stored so far; results that read them can't be computed any more."""
    jvm = SparkContext._jvm
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for own in _own:
        shutil.rmtree(own, ignore_errors=True)
    with contextlib.suppress(Exception):  # the JVM may be gone, or the store out of reach, as the process ends
        release()
