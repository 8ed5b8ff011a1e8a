"""A source tree as a table: folders are its partitions, and what is left out is never listed."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from heddle.functions.predicates import IGNORED_NAMES

FILES = "path string, size long, mtime_ns long"
#: Folders that the driver lists at most before the rest is left to tasks, and groups that these are dealt into.
FAN_OUT = 64
#: Bytes of contents that a task gives at once.
BATCH_BYTES = 8 << 20

#: Gives the names of a folder's folders, and (name, size, mtime_ns) of its files.
Lister = Callable[[str], tuple[list[str], list[tuple[str, int, int]]]]


@dataclass(frozen=True)
class Rules:
    """Which folders are entered: as ``predicates.prune_folder``, for one path at a time, and, with
    ``under``, only those that lead to one of these paths or lie below."""

    exclude: tuple[str, ...] = ()
    unignore: tuple[str, ...] = ()
    under: tuple[str, ...] | None = None
    ignored: tuple[str, ...] = IGNORED_NAMES

    def pruned(self, folder: str) -> bool:
        parts = folder.split("/")
        below = lambda p: folder == p or folder.startswith(p + "/")
        if any(x in self.exclude for x in parts) or any(below(p) for p in self.exclude):
            return True
        if self.under is not None and not any(p.startswith(folder + "/") or folder.startswith(p) for p in self.under):
            return True
        if any(p.startswith(folder + "/") or below(p) for p in self.unignore):
            return False
        return any(x in self.ignored for x in parts)


def _inner(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def walked(listed: Lister, start: str, rules: Rules, deep: bool = True) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the files below a folder, or of its own; folders left out aren't listed."""
    ahead = [start]
    while ahead:
        folder = ahead.pop()
        folders, files = listed(folder)
        for name, size, mtime in files:
            yield _inner(folder, name), size, mtime
        if deep:
            ahead += [f for f in (_inner(folder, n) for n in folders) if not rules.pruned(f)]


def planned(listed: Lister, rules: Rules, fan_out: int) -> list[tuple[str, bool]]:
    """Folders to read, and whether with all below: the top ones, listed level by level until there are
    ``fan_out`` to share out."""
    done: list[tuple[str, bool]] = []
    level = [""]
    while level and len(done) + len(level) < fan_out:
        done += [(f, False) for f in level]
        level = [f for above in level for f in (_inner(above, n) for n in listed(above)[0]) if not rules.pruned(f)]
    return done + [(f, True) for f in level]


class Folders(InputPartition):
    def __init__(self, value: list[tuple[str, bool]]):
        self.value = value


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.fan_out = int(options.get("fan_out", FAN_OUT))
        self.rules = Rules(tuple(json.loads(options.get("exclude", "[]"))), tuple(json.loads(options.get("unignore", "[]"))), None, IGNORED_NAMES if options.get("ignore", "true") == "true" else ())

    def lister(self) -> Lister:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, base = FileSystem.from_uri(self.root)

        def listed(folder: str):
            infos = fs.get_file_info(FileSelector(_inner(base.rstrip("/"), folder) if folder else base))
            own = [i for i in infos if i.base_name != "_SUCCESS" and not (i.base_name.startswith(".") and i.base_name.endswith(".crc"))]  # what Spark's writers leave beside their files
            return sorted(i.base_name for i in own if i.type == FileType.Directory), sorted((i.base_name, i.size, i.mtime_ns or 0) for i in own if i.type == FileType.File)

        return listed

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Paths, or beginnings of them, that a filter asks for bound the folders entered; Spark filters the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                asked = tuple(f.value) if isinstance(f, In) else (f.value,)
                if all(isinstance(x, str) for x in asked):
                    old = self.rules.under
                    narrower = asked if old is None else tuple(x for x in asked if any(x.startswith(o) or o.startswith(x) for o in old))
                    self.rules = replace(self.rules, under=narrower)
            yield f

    def partitions(self) -> list[Folders]:
        folders = planned(self.lister(), self.rules, self.fan_out)
        n = min(len(folders), 4 * self.fan_out)
        return [Folders(folders[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple[str, int, int]]:
        listed = self.lister()
        for folder, deep in partition.value:
            yield from walked(listed, folder, self.rules, deep)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: path below the root, size and mtime_ns of every file.

    Options ``exclude`` and ``unignore`` are JSON lists, as for ``predicates.skip_path``; ``ignore`` set to false
    enters the folders with built-in names too.  The driver lists
    the top folders only, each task what lies below its own; folders that are left out, or that no
    path asked for by a filter lies in, are not listed.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), unignore: tuple[str, ...] = (), fan_out: int = FAN_OUT, ignore: bool = True) -> DataFrame:
    """path, size and mtime_ns of every file below a folder, less folders left out.  Any place that Arrow's
    file systems reach; an empty folder gives no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("exclude", json.dumps(exclude)).option("unignore", json.dumps(unignore)).option("fan_out", fan_out).option("ignore", ignore).load(root)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Files with their content and its SHA-256, each read by one task; the paths are dealt out anew, as
    one folder may have very many files."""

    def read(batches) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(root)
        kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("content", pa.binary()), ("sha", pa.string())])
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base.rstrip('/')}/{row['path']}") as f:
                    content = f.read()
                out.append(row | {"content": content, "sha": hashlib.sha256(content).hexdigest()})
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return files.select("path", "size", "mtime_ns").repartition("path").mapInArrow(read, f"{FILES}, content binary, sha string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
