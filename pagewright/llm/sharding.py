"""Sharded storage with size-tiered compaction and a versioned manifest; DataFrame functions only.

A store is a folder in shared storage. ``append`` writes arrivals as runs of small immutable Parquet shards. ``compact`` puts
runs into tiers by the logarithm of their bytes; where ``FANOUT`` runs of similar size stand in a tier, they are merged into
one run of files of about ``target`` bytes, without a shuffle: partitions of the input are coalesced, and each task streams its
rows. Merging goes on until no tier is full, so that a row is rewritten a logarithmic number of times.

A manifest names the runs of one version. It is written under a name of its own and then given its version's name in one step that
fails if the name is taken (a rename without overwriting; on a local disk a hard link), in which case the change is worked out again on
the other writer's version. Readers see whole versions only. ``vacuum`` removes replaced runs, and what a crash leaves behind: runs that
no manifest names, once nothing has been written to them for ``orphan_seconds``, so that a run which another writer has not committed yet stays.

Defined cases: null values, empty and very long texts, repeated rows and columns of any name are stored as they are; an append
of no rows adds an empty run of zero bytes; an empty store has no rows and version 0; columns must be the same in all appends.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 4
TARGET_BYTES = 128 << 20
SMALLEST_TIER = 64 << 10
#: A run that no manifest names is taken for the rest of a crash after this time without a change.
ORPHAN_SECONDS = 7 * 86400.0


class Conflict(Exception):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The runs of a version (the last one by default)."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.path}/_manifest/v{version or known[-1]:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> dict:
        draft, final = self._path(f"{self.path}/_manifest/draft-{uuid.uuid4().hex}"), self._path(f"{self.path}/_manifest/v{manifest['version']:010d}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            self._publish(draft, final)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {manifest['version']}") from None
        finally:
            self._fs.delete(draft, False)
        return manifest

    def _publish(self, draft, final) -> None:
        """Give the draft its final name, or fail with some AlreadyExists exception; never replace a file."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        if self._fs.getUri().getScheme() == "file":
            nio = [jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{p.toUri().getRawPath()}")) for p in (final, draft)]
            jvm.java.nio.file.Files.createLink(*nio)
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, final, gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))

    def _run(self, path: str) -> dict:
        files = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]
        return {"path": path, "files": len(files), "bytes": sum(s.getLen() for s in files)}

    def _change(self, change) -> dict:
        """Commit what ``change`` makes of the last version; again if another writer was first."""
        while True:
            last = self.manifest()
            new = change(last)
            if new is None:
                return last
            try:
                return self._commit(new | {"version": last["version"] + 1})
            except Conflict:
                continue

    def _write(self, df: DataFrame, arrival: Column | None) -> list[dict]:
        """The rows as runs that no manifest names yet."""
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        if arrival is None:
            df.write.parquet(folder)
            return [self._run(folder)]
        name = "_arrival"
        while name in df.columns:
            name += "_"
        df.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
        return [self._run(p) for p in sorted(str(s.getPath()) for s in self._fs.listStatus(self._path(folder)) if s.isDirectory() and not s.getPath().getName().startswith("_temporary"))]

    def _add(self, runs: list[dict], schema: str) -> dict:
        def change(last: dict) -> dict:
            if last["schema"] not in (None, schema):
                raise ValueError("columns differ from those of the store")
            return {"schema": schema, "runs": last["runs"] + runs}

        return self._change(change)

    def append(self, df: DataFrame, arrival: Column | None = None) -> dict:
        """Add the rows as one run, or as one run for each value of ``arrival`` (in one pass over the rows)."""
        return self._add(self._write(df, arrival), df.schema.json())

    def tier(self, run: dict) -> int:
        return max(0, math.ceil(math.log(max(1, run["bytes"]) / SMALLEST_TIER, self.fanout)))

    def _full_tier(self, runs: list[dict]) -> list[dict]:
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(self.tier(run), []).append(run)
        return next((sorted(t, key=lambda r: (r["bytes"], r["path"]))[: self.fanout] for _, t in sorted(tiers.items()) if len(t) >= self.fanout), [])

    def compact(self) -> dict:
        """Merge runs until no tier is full."""
        while True:
            last = self.manifest()
            group = self._full_tier(last["runs"])
            if not group:
                return last
            paths = {r["path"] for r in group}
            # every tier that this merge would fill is taken along, so that rows are not rewritten twice in a row
            while len(more := self._full_tier([r for r in last["runs"] if r["path"] not in paths] + [{"path": "", "bytes": sum(r["bytes"] for r in group)}])) and any(r["path"] == "" for r in more):
                group += [r for r in more if r["path"]]
                paths = {r["path"] for r in group}
            size = sum(r["bytes"] for r in group)
            merged = f"{self.path}/runs/{uuid.uuid4().hex}"
            rows = self.spark.read.schema(StructType.fromJson(json.loads(last["schema"]))).parquet(*sorted(paths))
            rows.coalesce(max(1, math.ceil(size / self.target))).write.parquet(merged)
            new = self._run(merged)

            def change(now: dict, paths=paths, new=new) -> dict | None:
                if not paths <= {r["path"] for r in now["runs"]}:
                    return None  # another writer has merged some of them: theirs stays
                return now | {"runs": [r for r in now["runs"] if r["path"] not in paths] + [new]}

            self._change(change)

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("the store is empty")
        schema = StructType.fromJson(json.loads(found["schema"]))
        paths = [r["path"] for r in found["runs"] if r["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def shards(self) -> DataFrame:
        """The last manifest as a table: ``version``, ``path``, ``tier``, ``files``, ``bytes``."""
        found = self.manifest()
        rows = [(found["version"], r["path"], self.tier(r), r["files"], r["bytes"]) for r in found["runs"]]
        return self.spark.createDataFrame(rows, "version long, path string, tier int, files int, bytes long")

    def _last_written(self, folder) -> float:
        """Seconds since the epoch of the last change in a folder."""
        last, files = self._fs.getFileStatus(folder).getModificationTime(), self._fs.listFiles(folder, True)
        while files.hasNext():
            last = max(last, files.next().getModificationTime())
        return last / 1000

    def vacuum(self, orphan_seconds: float = ORPHAN_SECONDS) -> None:
        """Remove runs that older versions name and the last one does not, and runs of no version that are older than ``orphan_seconds``.

        Older versions are given up: whoever still reads one fails.
        """
        versions = self.versions()
        place = lambda p: self._path(p).toUri().getPath()
        once = {place(r["path"]) for v in versions for r in self.manifest(v)["runs"]}
        # read last: what was committed meanwhile is in use
        used = {place(r["path"]) for r in self.manifest()["runs"]}
        top = self._path(f"{self.path}/runs")
        for folder in [s.getPath() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []:
            # a run is a folder, or one of the arrivals' folders in it
            parts = [folder, *(s.getPath() for s in self._fs.listStatus(folder) if s.isDirectory())]
            named = {p.toUri().getPath() for p in parts}
            if named & used:
                gone = [p for p in parts[1:] if p.toUri().getPath() in once - used]
            elif named & once or time.time() - self._last_written(folder) > orphan_seconds:
                gone = [folder]
            else:
                gone = []
            for path in gone:
                self._fs.delete(path, True)
        for version in versions[:-1]:
            self._fs.delete(self._path(f"{self.path}/_manifest/v{version:010d}"), False)
