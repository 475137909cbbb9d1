"""Tables that are changed by whole versions: upserts and deletes rewrite the buckets they touch, and nothing else.

A store is a folder with data files and manifests. A manifest names, for each table and bucket (a hash of task_id), the
files that hold it; the newest one is the store. A commit reads the buckets that new rows or deleted tasks fall in, writes
these anew beside the old files, and publishes a manifest that names the new files and all untouched old ones. Publishing
is one rename that fails where the version exists already: readers see all tables of a commit or none, a commit
that fails or loses a race leaves the version before it, and a retried task only leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidscreen.sources.sinks import upsert, without_tasks


class Store:
    """Tables under one folder; each has task_id, is keyed by `keys[name]`, and keeps the row of the greatest `version`."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, tuple[str, ...]], buckets: int = 64, version: str = "version"):
        self.spark, self.path, self.keys, self.buckets, self.version = spark, path.rstrip("/"), keys, buckets, version
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        """Numbers of the published versions, oldest first."""
        folder = self._at("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{table: {"schema": ..., "files": {bucket: [file, ...]}}} of a version, by default the newest."""
        known = self.versions()
        if not known:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{known[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, by default the newest."""
        held = self.manifest(version)[table]
        return self._files(held, [f for files in held["files"].values() for f in files])

    def _files(self, held: dict, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("task_id"), F.lit(self.buckets)).cast("int")

    def _touched(self, *frames: DataFrame | None) -> list[int]:
        found: set[int] = set()
        for df in frames:
            if df is not None:
                found |= {r[0] for r in df.select(self._bucket()).distinct().collect()}  # at most `buckets` numbers
        return sorted(found)

    def commit(self, changes: dict[str, DataFrame] | None = None, deleted: DataFrame | None = None) -> int:
        """Upsert the rows of each table in changes and drop the tasks in deleted (task_id) from all tables, at once.
        A task that is deleted and brings new rows keeps the new rows alone. The new version's number is returned."""
        changes = changes or {}
        base = (self.versions() or [0])[-1]
        held = self.manifest(base) if base else {}
        for name, df in changes.items():
            held.setdefault(name, {"schema": df.schema.jsonValue(), "files": {}})
        for name, entry in held.items():
            new = changes.get(name)
            touched = self._touched(new, deleted)
            old = self._files(entry, [f for b in touched for f in entry["files"].get(str(b), [])])
            left = without_tasks(old, deleted) if deleted is not None else old
            rows = upsert(left, new.select(*old.columns), self.keys[name], self.version) if new is not None else left
            folder = f"data/{base + 1:012d}-{uuid.uuid4().hex}/{name}"
            rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            for b in touched:
                place = self._at(folder, f"_bucket={b}")
                names = [f.getPath().getName() for f in self._fs.listStatus(place)] if self._fs.exists(place) else []
                entry["files"][str(b)] = [f"{folder}/_bucket={b}/{n}" for n in names if n.endswith(".parquet")]
        self._publish(base + 1, held)
        return base + 1

    def _publish(self, version: int, held: dict) -> None:
        unready, ready = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{version:012d}.json")
        out = self._fs.create(unready)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if self._fs.exists(ready) or not self._fs.rename(unready, ready):
            self._fs.delete(unready, False)
            raise RuntimeError(f"version {version} has been committed by another writer")

    def drop_unnamed(self, keep: int = 2) -> int:
        """Delete the manifests before the newest `keep`, and data files that none of the others names; how many files."""
        known = self.versions()
        named = {f for v in known[-keep:] for entry in self.manifest(v).values() for files in entry["files"].values() for f in files}
        for v in known[:-keep]:
            self._fs.delete(self._at("manifests", f"{v:012d}.json"), False)
        gone, found = 0, self._fs.listFiles(self._at("data"), True) if self._fs.exists(self._at("data")) else None
        doomed = []
        while found is not None and found.hasNext():
            place = found.next().getPath()
            if place.getName().endswith(".parquet") and place.toString().split("/data/")[-1] not in {f.removeprefix("data/") for f in named}:
                doomed.append(place)
        for place in doomed:
            gone += bool(self._fs.delete(place, False))
        return gone
