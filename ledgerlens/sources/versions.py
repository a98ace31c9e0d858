"""Tables of Parquet files with committed versions.

A version is a manifest: which folders hold which buckets of keys. A write makes new
folders first and then, in one rename, the manifest of the next version; readers are
pinned to the manifest they opened. A write that fails before that leaves folders
that no version names, and the last version as it was. Two writers of one version:
the second finds its manifest's name taken, and is refused.

Only buckets that a write touches are read and written again; all others are carried
over by name, so a small upsert costs what it touches, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.staging import put


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class Table:
    """A table at ``path`` whose rows are told apart by ``keys``, in ``buckets`` by a hash of them."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    buckets: int = 16
    _bucket: str = field(default="_bucket", init=False)

    # --- versions

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The last committed version; 0: none yet."""
        files, path = self._files()
        if not files.exists(path(self.path)):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path(self.path))]
        return max((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``schema`` and ``folders`` by bucket of a version, the last one by default."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "folders": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest-{version:09}").first()[0]
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> int:
        files, path = self._files()
        staged = f"{self.path}/.manifest-{uuid.uuid4().hex}"
        put(self.spark, staged, json.dumps(manifest))
        to = path(f"{self.path}/manifest-{version:09}")
        if files.exists(to) or not files.rename(path(staged), to):
            files.delete(path(staged), False)
            raise Conflict(f"version {version} is there already")
        return version

    # --- reading

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a version, the last by default, whatever is written later; None without any."""
        found = self.manifest(version)
        if found["schema"] is None:
            return None
        schema = self.spark.createDataFrame([], found["schema"]).schema
        folders = [f for b, fs in found["folders"].items() for f in fs if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    # --- writing

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self._bucket, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """``rows`` whose keys are none of ``others``'; null keys are equal to each other."""
        named = others.select(*[F.col(k).alias(f"_other_{k}") for k in self.keys])
        return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in self.keys], "left_anti")

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders of ``rows`` (with their bucket), by bucket."""
        name = f"data-{uuid.uuid4().hex}"
        rows.repartition(self._bucket, F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(4))).write.partitionBy(self._bucket).parquet(f"{self.path}/{name}")
        files, path = self._files()
        made = [s.getPath().getName() for s in files.listStatus(path(f"{self.path}/{name}")) if s.isDirectory()]
        return {m.split("=")[1]: [f"{name}/{m}"] for m in sorted(made)}

    def _touched(self, dealt: DataFrame) -> list[int]:
        return [r[0] for r in dealt.select(self._bucket).distinct().collect()]  # at most one row for each bucket

    def upsert(self, fresh: DataFrame, seq: str) -> int:
        """Rows of ``fresh`` replace those of equal keys; of several in it the one of largest ``seq`` stands (then of largest values). Gives the new version."""
        now = self.version()
        found, rest = self.manifest(now), [c for c in fresh.columns if c not in (*self.keys, seq)]
        last = fresh.groupBy(*self.keys).agg(F.max(F.struct(seq, *rest)).alias("_r")).select(*self.keys, f"_r.{seq}", *[f"_r.{c}" for c in rest])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.schema.fields)
        dealt = self._dealt(last)
        touched = self._touched(dealt)
        old = self.read(now, touched)
        whole = dealt if old is None else self._dealt(self._without(old, last)).unionByName(dealt)
        made = self._write(whole)
        folders = {b: f for b, f in found["folders"].items() if int(b) not in touched} | made
        return self._commit(now + 1, {"schema": found["schema"] or schema, "folders": folders})

    def insert_absent(self, fresh: DataFrame, seq: str) -> int:
        """Rows of ``fresh`` whose keys are not there, of several the one of smallest ``seq`` (then of smallest values); what is there stays where it is. Gives the new version, or the last if nothing is new."""
        now = self.version()
        found, rest = self.manifest(now), [c for c in fresh.columns if c not in (*self.keys, seq)]
        first = fresh.groupBy(*self.keys).agg(F.min(F.struct(seq, *rest)).alias("_r")).select(*self.keys, f"_r.{seq}", *[f"_r.{c}" for c in rest])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first.schema.fields)
        old = self.read(now)
        new = self._dealt(first if old is None else self._without(first, old))
        made = self._write(new)
        if now and not made:
            return now
        folders = {b: [*found["folders"].get(b, []), *made.get(b, [])] for b in {*found["folders"], *made}}
        return self._commit(now + 1, {"schema": found["schema"] or schema, "folders": folders})

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests before the last ``keep`` and all folders that none of those names; readers of older versions lose theirs. Gives the number deleted."""
        files, path = self._files()
        last = self.version()
        kept = {f.split("/")[0] for v in range(max(1, last - keep + 1), last + 1) for fs in self.manifest(v)["folders"].values() for f in fs}
        gone = 0
        for s in files.listStatus(path(self.path)):
            name = s.getPath().getName()
            old = name.startswith("manifest-") and int(name.removeprefix("manifest-")) <= last - keep
            if old or (name.startswith("data-") and name not in kept):
                files.delete(s.getPath(), True)
                gone += 1
        return gone
