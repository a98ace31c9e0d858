"""Tables that are ingested once in a session and then read by every query, until they expire or their source changes.

The cache is bounded: at most ``MOST`` tables are known, the one asked for longest ago
goes first. What goes, is replaced or forgotten is deleted ``GRACE`` seconds later, since a
plan that was made before may still read it.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where a table is, what its source looked like, and when it was written.
_INGESTED: dict[tuple[str, str, str], tuple[str, str, float]] = {}
#: Folders that no query is given any more, since when; and what was kept in each open scratch.
_RETIRED: list[tuple[str, float]] = []
_SCRATCHES: list[list[str]] = []
#: Seconds after which a table is made again, and after which a retired one is deleted; tables that are known at most.
EXPIRY, GRACE, MOST = 600, 3600, 4096


def folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def state(spark: SparkSession, source: str) -> str:
    """What tells that a folder's files have changed: newest time, size and number of its files, by the file system that Spark uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return "none"
    newest = max((s.getModificationTime() for s in files.listStatus(path)), default=0)
    return f"{newest} {files.getContentSummary(path).getLength()} {files.getContentSummary(path).getFileCount()}"


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _swept(spark: SparkSession, most: int, grace: float) -> None:
    """Retires what is beyond the bound, and deletes what was retired long enough ago."""
    now = time.time()
    while len(_INGESTED) > most:
        _RETIRED.append((_INGESTED.pop(next(iter(_INGESTED)))[0], now))
    for path, since in [r for r in _RETIRED if now - r[1] >= grace]:
        _deleted(spark, path)
        _RETIRED.remove((path, since))


def ingested(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], expiry: float = EXPIRY, most: int = MOST, grace: float = GRACE) -> DataFrame:
    """The table ``name`` of ``source``, written as Parquet when a session first asks, and again after ``expiry`` seconds or once the source's files have changed."""
    key = (spark.sparkContext.applicationId, source, name)
    now = state(spark, source)
    known = _INGESTED.pop(key, None)  # what is asked for goes to the end of the line
    if known is None or known[1] != now or time.time() - known[2] > expiry:
        if known is not None:
            _RETIRED.append((known[0], time.time()))
        path = f"{folder(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
        made = make()
        made.write.parquet(path)
        known = (path, now, time.time())
    _INGESTED[key] = known
    _swept(spark, most, grace)
    return spark.read.parquet(known[0])


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so what several branches read is made once. It stays until the ``scratch`` around it ends, or the job's owner clears the folder."""
    path = f"{folder(df.sparkSession)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    if _SCRATCHES:
        _SCRATCHES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was ``kept`` inside; so what comes of it has to be written or collected inside too."""
    _SCRATCHES.append([])
    try:
        yield
    finally:
        for path in _SCRATCHES.pop():
            _deleted(spark, path)


def forget(source: str | None = None) -> None:
    """What was ingested of ``source`` (or of all) is made again when it is next asked for."""
    for key in [k for k in _INGESTED if source in (None, k[1])]:
        _RETIRED.append((_INGESTED.pop(key)[0], time.time()))


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, such as a payload as it was received, by the file system that Spark uses."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
