"""Files as tables: which ones count, what git tells of them, and their texts."""

from __future__ import annotations

import subprocess
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import EXTENSIONS
from siftline.functions.text import decoded, matches_extension

from .listing import contents, listing, local_path

FILES = "filepath string, mtime double, file_hash string, text string"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_scratch: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables between steps, in the one that ``spark.checkpoint.dir`` names; removed when the driver ends.

    A local one serves only where that is unset and Spark runs in one process."""
    global _scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _scratch = _scratch or f"file://{tempfile.mkdtemp(prefix='siftline-')}"
        base = _scratch
    path = f"{base.rstrip('/')}/siftline/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a table between steps or of an index, in few bytes; what was shuffled for it goes from the disks at once, not when the driver's garbage happens to be collected."""
    spark, before = df.sparkSession, df.sparkSession.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def _git(root: str, *args: str) -> bytes | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def is_git_repo(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or b"").strip() == b"true"


def head_commit(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.decode().strip() if out else None


def git_files(root: str) -> list[str]:
    out = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z") or b""
    names = dict.fromkeys(x.decode(errors="replace") for x in out.split(b"\0") if x)
    return [n for n in names if (Path(root) / n).is_file()]


def matches(path: str, extensions: tuple[str, ...] | None = None) -> bool:
    name = path.rsplit("/", 1)[-1].lower()
    endings = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in (EXTENSIONS if extensions is None else extensions)]
    return any(name.endswith(e) and len(name) > len(e) for e in endings)


def tree_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(filepath, mtime, size) of the files that count: all of a tree, or those that git knows where it is one of git's."""
    found = listing(spark, root).where(matches_extension(F.col("filepath"), extensions))
    at = local_path(root)
    if at is None or not is_git_repo(at):
        return found
    known = [(p,) for p in git_files(at) if matches(p, extensions)]  # git's own list, of a clone that the driver has
    return found.join(spark.createDataFrame(known, "filepath string"), "filepath", "left_semi")


def collect_files(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None) -> list[str]:
    return sorted(r.filepath for r in tree_files(spark, root, extensions).select("filepath").collect())


def read_files(spark: SparkSession, root: str, paths: list[str] | DataFrame | None = None) -> DataFrame:
    """(filepath, mtime, file_hash, text) of files under ``root``: all indexable ones, or those in ``paths`` that are there."""
    if isinstance(paths, list):
        paths = spark.createDataFrame([(p,) for p in paths], "filepath string")
    raw = contents(tree_files(spark, root) if paths is None else paths, root)
    return raw.select("filepath", "mtime", F.sha2("content", 256).alias("file_hash"), decoded(F.col("content")).alias("text"))


def name_status(lines: DataFrame) -> DataFrame:
    """``git diff --name-status`` lines as (filepath, action): deleted or changed."""
    part = F.split("line", r"\t")
    part = F.when(F.size(part) > 1, part).otherwise(F.split(F.trim("line"), r"\s+"))
    kind, first, last = F.substring(F.get(part, 0), 1, 1), F.get(part, 1), F.element_at(part, -1)
    row = lambda path, action: F.struct(path.alias("filepath"), F.lit(action).alias("action"))
    both = F.array(row(first, "deleted"), row(last, "changed"))
    some = F.when(kind == "D", F.array(row(first, "deleted"))).when(kind == "R", both).otherwise(F.array(row(last, "changed")))
    return lines.where(F.size(part) > 1).select(F.explode(some).alias("x")).select("x.filepath", "x.action")


def git_changes(spark: SparkSession, root: str, old: str, new: str = "HEAD") -> DataFrame:
    out = _git(root, "-c", "core.quotePath=false", "diff", "--name-status", old, new) or b""
    return name_status(spark.createDataFrame([(x,) for x in out.decode(errors="replace").splitlines()], "line string"))
