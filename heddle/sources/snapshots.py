"""Versioned tables: writers add snapshots that readers see whole, and of two writers one loses."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has added a version since the one that this write was made from."""


class Snapshots:
    """A table as a folder of snapshots: ``data/<id>`` holds the rows of one write, ``versions/<n>.json`` says
    which of them is version n.

    A version is added by renaming a finished manifest to its number, which fails if there is one: so
    a reader sees the version before or the one after, never half of it, and of two writers that
    started from one version the second gets ``Conflict`` and leaves nothing behind.  (Renaming without
    overwriting is atomic on HDFS and its like; on a store without it, two writers need a lock.)
    A version's files are never changed; ``vacuum`` deletes those of old versions.

    Manifests carry for each stream the last batch applied, so that a batch that comes again after a
    failure is known (``applied``).  Manifests are small and few between vacuums; only they are read on the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where = self._path(f"{self.path}/versions")
        if not self._fs.exists(where):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(where))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def current(self) -> int:
        """The newest version's number; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if version == 0:
            return {"version": 0, "data": None, "schema": None, "streams": {}}
        source = self._fs.open(self._path(f"{self.path}/versions/{version:010}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is given; None before the first."""
        said = self.manifest(version)
        if said["data"] is None:
            return None
        return self.spark.read.schema(T.StructType.fromJson(said["schema"])).parquet(f"{self.path}/data/{said['data']}")

    def applied(self, stream: str, batch: int) -> bool:
        return self.manifest()["streams"].get(stream, -1) >= batch

    def write(self, df: DataFrame, base: int | None = None, stream: str | None = None, batch: int | None = None, by: list[str] | None = None) -> int:
        """Add these rows as the version after ``base`` (the newest now, if none is given) and return its number.

        ``df`` may read this table: what it reads is not touched.  ``stream`` and ``batch`` are noted in
        the same step as the rows, so either both count or neither.
        """
        base = self.current() if base is None else base
        streams = dict(self.manifest(base)["streams"])
        if stream is not None:
            streams[stream] = batch
        name = uuid.uuid4().hex
        out = df.write
        (out.partitionBy(*by) if by else out).parquet(f"{self.path}/data/{name}")
        said = {"version": base + 1, "data": name, "schema": json.loads(df.schema.json()), "streams": streams}
        if not self._added(base + 1, said):
            self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
            raise Conflict(f"version {base + 1} is another writer's")
        return base + 1

    def _added(self, version: int, said: dict) -> bool:
        from py4j.protocol import Py4JJavaError

        fs = self.spark._jvm.org.apache.hadoop.fs
        draft, final = (self._path(f"{self.path}/versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:010}.json"))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions (one at least); returns those that went.  Readers of these fail from
        now on, so keep as many as the longest reader needs."""
        numbers = self.versions()
        stay = numbers[-max(1, keep) :]
        data = {self.manifest(v)["data"] for v in stay}
        gone = numbers[: -max(1, keep)]
        for v in gone:
            if (name := self.manifest(v)["data"]) not in data:
                self._fs.delete(self._path(f"{self.path}/data/{name}"), True)
            self._fs.delete(self._path(f"{self.path}/versions/{v:010}.json"), False)
        return gone
