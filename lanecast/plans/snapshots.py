"""Published tables as whole sets: readers see the old set or the new one, never a mix.

Tables of a run are written to a folder of their own.  Only when all are there, one small
manifest naming them is put into ``versions`` under the next number, by a rename that
fails if the number is taken.  The highest number is what readers resolve; a run that
ends early leaves files that no manifest names, and nothing else.

    folder/data/<run>/<table>/...      Parquet
    folder/versions/0000000012.json    {"version", "run", "tables": {name: schema}}
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DIGITS = 10


class Snapshots:
    """The versions of one folder, in whatever store Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.folder).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/versions/{version:0{_DIGITS}d}.json"

    def _list(self, name: str) -> list:
        target = self._path(f"{self.folder}/{name}")
        return list(self._files.listStatus(target)) if self._files.exists(target) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._list("versions")]
        return sorted(int(n[:_DIGITS]) for n in names if n.endswith(".json") and n[:_DIGITS].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds; without a number the newest one."""
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"nothing is published in {self.folder}")
            version = found[-1]
        stream = self._files.open(self._path(self._manifest_path(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def begin(self) -> str:
        """A new run's id; its tables are written below ``place(run)``."""
        return f"{int(time.time()):d}-{uuid.uuid4().hex}"

    def place(self, run: str, table: str) -> str:
        return f"{self.folder}/data/{run}/{table}"

    def commit(self, run: str, tables: dict[str, StructType], extra: dict | None = None) -> int:
        """Make a run's tables the newest version; its number.

        Publishers that commit at once get different numbers.  ``extra`` is kept in the manifest.
        """
        draft = self._path(f"{self.folder}/versions/.{run}")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        no_overwrite = self.spark.sparkContext._gateway.new_array(options, 0)
        version = (self.versions() or [0])[-1]
        while True:
            version += 1
            schemas = {n: s.json() for n, s in tables.items()}
            body = {"version": version, "run": run, "tables": schemas, "extra": extra or {}}
            stream = self._files.create(draft, True)
            try:
                stream.write(json.dumps(body).encode())
            finally:
                stream.close()
            target = self._path(self._manifest_path(version))
            if self._files.exists(target):
                continue
            try:
                context.rename(draft, target, no_overwrite)
                return version
            except Exception as error:
                if "FileAlreadyExists" not in str(error):
                    raise

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of one version, by default of the newest."""
        found = self.manifest(version)
        return self.spark.read.schema(self.schema(table, found)).parquet(self.place(found["run"], table))

    @staticmethod
    def schema(table: str, manifest: dict) -> StructType:
        if table not in manifest["tables"]:
            raise KeyError(f"version {manifest['version']} has no table {table}")
        return StructType.fromJson(json.loads(manifest["tables"][table]))

    def expire(
        self,
        keep: int = 2,
        unfinished_hours: float = 24.0,
        needed: Callable[[dict], set[str]] = lambda manifest: set(),
    ) -> list[str]:
        """Forget all but the newest ``keep`` versions; the runs whose files were deleted.

        Manifests go first, so no reader resolves a set that is being deleted.  Runs that no
        manifest names are deleted once they are older than ``unfinished_hours``, as a younger
        one may still be written.  ``needed`` names further runs that a manifest builds on.
        """
        if keep < 1:
            raise ValueError("the newest version must be kept")
        manifests = {v: self.manifest(v) for v in self.versions()}
        runs = {v: {m["run"], *needed(m)} for v, m in manifests.items()}
        old = sorted(manifests)[:-keep]
        for version in old:
            self._files.delete(self._path(self._manifest_path(version)), False)
        kept = set().union(*[r for v, r in runs.items() if v not in old])
        released = set().union(*[runs[v] for v in old]) - kept
        gone = []
        for status in self._list("data"):
            run = status.getPath().getName()
            started = run.partition("-")[0]
            age = time.time() - int(started) if started.isdigit() else float("inf")
            if run not in kept and (run in released or age >= 3600 * unfinished_hours):
                self._files.delete(status.getPath(), True)
                gone.append(run)
        return sorted(gone)
