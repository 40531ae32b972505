"""Listing and reading file trees by tasks, not by the driver.

``folders`` is a Spark data source: the driver opens folders only until there is one for each task, and each task
lists its own folder and all below it, row by row, without contents. Local trees (plain paths and ``file://``) are
read by the operating system's calls, others by Arrow's file systems (hdfs, s3, gs, abfs); what Arrow can't open is
left to Spark's own reader, which lists through Hadoop's file systems and passes over files without bytes and those
whose name or folder begins with a dot or an underscore.

Defined cases: links to folders aren't followed; what vanishes while a tree is listed or read has no row; a root
that isn't there raises FileNotFoundError; a file without bytes has a row.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTED = "filepath string, mtime double, size long"
READ = "filepath string, mtime double, content binary"
SKIPPED = (".git", "__pycache__", "node_modules")
ROWS, BYTES = 10_000, 8 << 20  # of a batch, about


def local_path(root: str) -> str | None:
    """The path of a root in the local file system, or None if it is in another."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return None if "://" in root else os.path.realpath(root)


def _millis(ns: int | None) -> float:
    """Times in whole milliseconds, as Spark's readers have them."""
    return (ns or 0) // 1_000_000 / 1000


class Tree:
    """A root in a file system that tasks open by themselves."""

    def __init__(self, root: str):
        self.local = local_path(root)
        if self.local is None:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(root)

    def entries(self, folder: str) -> Iterator[tuple[str, bool, float, int]]:
        """(path below the root, whether it is a folder, time, size) of what stands in a folder."""
        at = f"{folder}/" if folder else ""
        if self.local is not None:
            with os.scandir(os.path.join(self.local, folder)) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield at + e.name, True, 0.0, 0
                        elif e.is_file():
                            s = e.stat()
                            yield at + e.name, False, _millis(s.st_mtime_ns), s.st_size
                    except FileNotFoundError:
                        continue
            return
        from pyarrow import fs

        for x in self.fs.get_file_info(fs.FileSelector(f"{self.base.rstrip('/')}/{folder}".rstrip("/"))):
            if x.type != fs.FileType.NotFound:
                yield at + x.base_name, x.type == fs.FileType.Directory, _millis(x.mtime_ns), x.size or 0

    def read(self, path: str) -> tuple[float, bytes] | None:
        """A file's time and bytes, or None if there is none."""
        try:
            if self.local is not None:
                with open(os.path.join(self.local, path), "rb") as f:
                    return _millis(os.fstat(f.fileno()).st_mtime_ns), f.read()
            at = f"{self.base.rstrip('/')}/{path}"
            time = _millis(self.fs.get_file_info(at).mtime_ns)
            with self.fs.open_input_file(at) as f:
                return time, f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool  # with all that is below it


class FoldersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.skipped, self.tasks = options["root"], {*json.loads(options["skipped"])}, int(options["tasks"])

    def partitions(self) -> list[Folder]:
        tree, level, opened = Tree(self.root), [""], []
        while level and len(level) < self.tasks:
            below = []
            for folder in level:
                below += [p for p, is_folder, *_ in self._entries(tree, folder) if is_folder]
            opened, level = opened + level, below
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in level]

    def _entries(self, tree: Tree, folder: str) -> Iterator[tuple[str, bool, float, int]]:
        try:
            for e in tree.entries(folder):
                if not (e[1] and e[0].rsplit("/", 1)[-1] in self.skipped):
                    yield e
        except (FileNotFoundError, NotADirectoryError):
            if not folder:
                raise

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        tree, todo, rows = Tree(self.root), [partition.path], []
        while todo:
            for path, is_folder, time, size in self._entries(tree, todo.pop()):
                if is_folder:
                    if partition.deep:
                        todo.append(path)
                    continue
                rows.append((path, time, size))
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, times, sizes = zip(*rows, strict=True)
    paths = [p.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for p in paths]
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.float64()), pa.array(sizes, pa.int64())], names=["filepath", "mtime", "size"])


class Folders(DataSource):
    """``spark.read.format("folders").option("root", ...)``: the files of a tree."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: object) -> DataSourceReader:
        return FoldersReader(self.options)


def _by_spark(root: str) -> bool:
    """Whether only Spark's readers can open a root."""
    try:
        Tree(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return True
    return False


def _relative(root: str) -> F.Column:
    """Paths below a root, of Spark's ``path``; cut by length, as a root may hold any characters."""
    base = root.rstrip("/")
    return F.col("path").substr(F.lit(len(base) + 2), F.length("path"))


def _spark_reader(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, mtime, size) of all files of a tree, contents unread."""
    if _by_spark(root):
        raw = _spark_reader(spark).load(root).select(_relative(root).alias("filepath"), (F.unix_millis("modificationTime") / 1000).alias("mtime"), F.col("length").alias("size"))
        return raw.where(~F.arrays_overlap(F.split("filepath", "/"), F.array(*map(F.lit, SKIPPED))))
    if local_path(root) is not None and not os.path.isdir(local_path(root)):
        raise FileNotFoundError(f"no folder {root}")
    spark.dataSource.register(Folders)
    return spark.read.format("folders").option("root", root).option("skipped", json.dumps(SKIPPED)).option("tasks", str(2 * spark.sparkContext.defaultParallelism)).load()


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(filepath, mtime, content) of the files that ``paths`` (filepath) names and that are there; each task reads its own."""
    spark = paths.sparkSession
    if _by_spark(root):
        names = [r.filepath for r in paths.select("filepath").distinct().collect()]  # Spark's reader wants them from the driver
        raw = _spark_reader(spark).option("ignoreMissingFiles", "true").load([f"{root.rstrip('/')}/{n}" for n in names]) if names else None
        return spark.createDataFrame([], READ) if raw is None else raw.select(_relative(root).alias("filepath"), (F.unix_millis("modificationTime") / 1000).alias("mtime"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, rows, n = Tree(root), [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = tree.read(path)
                if found is None:
                    continue
                rows.append((path, *found))
                n += len(found[1])
                if n >= BYTES:
                    yield as_batch(rows)
                    rows, n = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.binary())], names=["filepath", "mtime", "content"])

    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # dealt anew, as one folder may have most
    return paths.select("filepath").repartition(n).mapInArrow(read, READ)
