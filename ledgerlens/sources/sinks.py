"""Sinks over Parquet and JSON folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Rows of the keys in ``df`` replace those stored; other keys stay. Stored by key, so only those folders are written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upserted(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last write wins."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.select(*stored.columns).withColumn("_seq", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("r")).select(*keys, "r.*").select(*stored.columns)


def absent(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key is not stored, one for each key."""
    return fresh.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def append_events(df: DataFrame, path: str) -> None:
    """JSON lines with a UTC time ``ts`` in front."""
    ts = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    (df if "ts" in df.columns else df.select(ts.alias("ts"), "*")).write.mode("append").json(path)


def reports_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
