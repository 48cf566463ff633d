"""A keyed table kept as snapshots: upserts and deletes rewrite the buckets they touch, readers see one version.

Rows lie in buckets of their key's hash. A change reads the touched buckets only, writes their new
content into a folder of its own, and then puts a manifest beside the former ones: one small file that
names the folder of each bucket. A manifest appears whole and under a number of its own or not at all, so a
reader never sees half a change, earlier versions stay readable, and of two writers that start from one
version the later fails and can try again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class ConcurrentChange(RuntimeError):
    """Another writer made the next version first."""


class Snapshots:
    """Versions of a table in ``folder``; ``key`` says which rows are of one bucket, ``merge(old, new)`` how an upsert ends.

    ``buckets`` holds for a folder from its first version on.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.merge = spark, folder.rstrip("/"), schema, key, merge
        self.buckets = buckets
        if self.versions():
            self.buckets = self._manifest(self.versions()[-1])["buckets"]

    # -- manifests
    def _files(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        files, path = self._files("manifests")
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))

    def _manifest(self, version: int) -> dict:
        files, path = self._files("manifests", f"{version:09}.json")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, parts: dict[int, str]) -> int:
        """A hidden file, filled and then renamed; a name that is there is never written over."""
        text = json.dumps({"buckets": self.buckets, "parts": {str(b): name for b, name in sorted(parts.items())}})
        files, hidden = self._files("manifests", f".{uuid.uuid4().hex}")
        _, path = self._files("manifests", f"{version:09}.json")
        stream = files.create(hidden)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(hidden, path, none)
        except Exception as error:
            files.delete(hidden, False)
            if files.exists(path):
                raise ConcurrentChange(f"version {version} of {self.folder} is there already") from error
            raise
        return version

    # -- reading
    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A version, the newest if not told; no rows where there is none."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no version {version} in {self.folder}")
        parts = self._manifest(known[-1] if version is None else version)["parts"] if known else {}
        names = [f"{self.folder}/data/{name}" for b, name in parts.items() if name and (only is None or int(b) in only)]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    # -- changes
    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _change(self, touching: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        known = self.versions()
        base = known[-1] if known else 0
        parts = {int(b): name for b, name in self._manifest(base)["parts"].items()} if known else {}
        touched = sorted(r[BUCKET] for r in self._bucketed(touching).select(BUCKET).distinct().collect())  # at most one row per bucket
        changed = change(self.read(base, touched) if known else self.read())
        name = f"{base + 1:09}-{uuid.uuid4().hex}"
        out = self._bucketed(changed.select(self.schema.names)).repartition(max(len(touched), 1), BUCKET)
        out.sortWithinPartitions(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{name}")
        files, path = self._files("data", name)
        there = {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path) if s.getPath().getName().startswith(f"{BUCKET}=")}
        parts |= {b: f"{name}/{BUCKET}={b}" if b in there else "" for b in touched}
        return self._publish(base + 1, parts)

    def upsert(self, rows: DataFrame) -> int:
        """The new version's number."""
        return self._change(rows, lambda old: self.merge(old, rows))

    def delete(self, keys: DataFrame, remove: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Without the rows that ``remove(old, keys)`` takes away; ``key`` must be computable from ``keys``."""
        return self._change(keys, lambda old: remove(old, keys))

    def forget(self, keep: int = 1) -> list[str]:
        """Remove all versions but the newest ``keep``, and the folders that only they name."""
        known = self.versions()
        kept = known[-keep:] if keep else []
        named = {name.split("/")[0] for v in kept for name in self._manifest(v)["parts"].values() if name}
        gone = {name.split("/")[0] for v in known if v not in kept for name in self._manifest(v)["parts"].values() if name} - named
        for version in set(known) - set(kept):
            files, path = self._files("manifests", f"{version:09}.json")
            files.delete(path, False)
        for name in gone:
            files, path = self._files("data", name)
            files.delete(path, True)
        return sorted(gone)
