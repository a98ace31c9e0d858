"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only if that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    A lost executor costs a re-read, never a recomputation of what stands
    before. The folder holds a table until the job's owner clears it, as Spark's
    own checkpoints do.
    """
    path = f"{shared_folder(df.sparkSession)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: all that follows from them is staged itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a sieve at most, each of 64 bits: its broadcast stays below 4 MB at any size of the data.
SIEVE = 17


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """These names, with as many underscores in front as it takes to be none of ``columns``, as Spark compares names."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sieve(rows: DataFrame, on: list[str], wanted: DataFrame, out: bool = False) -> DataFrame:
    """``rows`` whose columns ``on`` may be among the rows of ``wanted`` (as many columns); with ``out`` the others, never among them.

    A bitmap of fixed size, broadcast, so rows that cannot match are left out of the
    shuffle that the join proper needs. With many wanted rows it lets more through,
    which changes no result.
    """
    h, w, m = unused(rows.columns, "_h", "_word", "_mask")
    word, bit = F.expr(f"shiftrightunsigned({h}, {64 - SIEVE})"), f"shiftleft(1L, cast(shiftrightunsigned({h}, {58 - SIEVE}) & 63 as int))"
    marks = wanted.select(F.xxhash64(*wanted.columns).alias(h)).groupBy(word.alias(w)).agg(F.bit_or(F.expr(bit)).alias(m))
    both = rows.withColumn(h, F.xxhash64(*on)).withColumn(w, word).join(F.broadcast(marks), w, "left")
    held = F.coalesce(F.expr(f"{m} & {bit}"), F.lit(0)) != 0
    return both.where(~held if out else held).drop(h, w, m)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The one column of 64-bit hashes as bits, a word of 64 for each value of the first ``SIEVE`` bits: 1 MB on the driver at any size."""
    h = hashes.select(F.col(hashes.columns[0]).alias("_h"))
    bit = f"shiftleft(1L, cast(shiftrightunsigned(_h, {58 - SIEVE}) & 63 as int))"
    got = h.groupBy(F.expr(f"shiftrightunsigned(_h, {64 - SIEVE})").alias("word")).agg(F.bit_or(F.expr(bit)).alias("mask")).toPandas()
    out = np.zeros(1 << SIEVE, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these unsigned hashes may be in a ``bitmap``."""
    word, bit = hashes >> np.uint64(64 - SIEVE), (hashes >> np.uint64(58 - SIEVE)) & np.uint64(63)
    return (bits[word.astype(np.int64)] >> bit) & np.uint64(1) != 0


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches of Python workers, since rows hold whole texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
