"""Keeping an index in step with its files: snapshots are compared in one outer join, changed files redone.

A sync lists the tree by tasks, compares modification times first, and reads only files that are new, touched or
named by git; names and contents stay with the executors. What has changed becomes a new segment, chunks that are
gone become bits of their ranges' masks and are taken from the dictionary, and the manifest that says so is published
last. Segments of like size are merged ``FAN_IN`` at a time, so that a chunk is written anew once for each time its
segment grows by that factor; a segment of which half is gone is written anew, one of which all is gone is dropped.
"""

from __future__ import annotations

import dataclasses
import math
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import DEFAULT, Settings
from siftline.operators import index as ix
from siftline.operators import rank
from siftline.operators.chunk import chunks
from siftline.sources import files as src
from siftline.sources.listing import local_path

FAN_IN = 4
REPORTED = 1000  # paths that a report names; its counts are of all
HEAD = "last_commit_hash"


def changes(known: DataFrame, current: DataFrame) -> DataFrame:
    """(filepath, action) between two snapshots (filepath, mtime, file_hash): added, changed, deleted, touched, unchanged."""
    a, b = known.alias("a"), current.alias("b")
    action = (
        F.when(F.col("a.filepath").isNull(), "added").when(F.col("b.filepath").isNull(), "deleted").when(F.col("a.file_hash") != F.col("b.file_hash"), "changed")
        .when(F.abs(F.col("a.mtime") - F.col("b.mtime")) > 1e-6, "touched").otherwise("unchanged")
    )
    return a.join(b, F.col("a.filepath") == F.col("b.filepath"), "full_outer").select(F.coalesce("a.filepath", "b.filepath").alias("filepath"), action.alias("action"))


def suspects(known: DataFrame, listed: DataFrame, named: DataFrame) -> DataFrame:
    """(filepath, action) by names and times alone: added, deleted, or to be read (``look``) as its time has moved or git names it."""
    a, b, c = known.alias("a"), listed.alias("b"), named.select("filepath").distinct().withColumn("named", F.lit(True)).alias("c")
    both = a.join(b, F.col("a.filepath") == F.col("b.filepath"), "full_outer").join(c, F.col("b.filepath") == F.col("c.filepath"), "left")
    moved = (F.abs(F.col("a.mtime") - F.col("b.mtime")) > 1e-6) | F.col("named").isNotNull()
    action = F.when(F.col("a.filepath").isNull(), "added").when(F.col("b.filepath").isNull(), "deleted").when(moved, "look")
    return both.select(F.coalesce("a.filepath", "b.filepath").alias("filepath"), action.alias("action")).where("action is not null")


def purged(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("filepath"), "filepath", "left_anti")


def resynced(old: DataFrame, diff: DataFrame, current: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The chunks after a sync: those of unchanged files, and new ones of added and changed files."""
    redo = diff.where("action in ('added', 'changed')")
    stale = diff.where("action in ('deleted', 'changed')")
    return purged(old, stale).unionByName(chunks(current.join(redo, "filepath", "left_semi"), settings).select(*old.columns))


def _named(files: DataFrame) -> list[str]:
    """The first ``REPORTED`` paths, for a report."""
    return [r.filepath for r in files.select("filepath").orderBy("filepath").limit(REPORTED).collect()]


def due(segments: dict[str, dict]) -> set[str]:
    """The segments to be written as one: ``FAN_IN`` of like size, or those of which half is gone."""
    tiers: dict[int, list[str]] = {}
    for s, x in segments.items():
        tiers.setdefault(int(math.log(max(x["n"] - x["gone"], 1), FAN_IN)), []).append(s)
    return {s for group in tiers.values() if len(group) >= FAN_IN for s in group} | {s for s, x in segments.items() if x["gone"] * 2 > x["n"]}


class EmptyTree(RuntimeError):
    """A tree that was indexed lists no files."""


class Store:
    """An index folder of a file tree.

    Reads and writes single chunks, files, their metadata and state as well; each change is a generation."""

    def __init__(self, spark: SparkSession, root: str, folder: str, settings: Settings = DEFAULT, extensions: tuple[str, ...] | None = None):
        self.spark, self.root, self.folder, self.settings, self.extensions = spark, root, folder, settings, extensions
        self._staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # where tables between steps stand

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing stays open between calls."""

    # what is stored

    def exists(self) -> bool:
        return ix.has_index(self.spark, self.folder)

    def manifest(self) -> ix.Manifest:
        return ix.Manifest.latest(self.spark, self.folder) if self.exists() else ix.Manifest()

    def index(self) -> ix.Index:
        return ix.Index.open(self.spark, self.folder)

    def search(self, query: str, top_k: int = 5, mode: str = "OR", diversify: bool = True) -> DataFrame:
        return rank.search(self.index(), {0: query}, top_k, mode, diversify, self.settings)

    def chunks(self) -> DataFrame:
        return ix.live_chunks(self.spark, self.folder, self.manifest())

    def metadata(self) -> DataFrame:
        """(filepath, mtime, file_hash) of the files that are indexed, those without chunks too."""
        at = self.manifest()
        return self.spark.read.schema(ix.FILES).parquet(at.place(self.folder, at.files)) if at.files else self.spark.createDataFrame([], ix.FILES)

    def files(self) -> DataFrame:
        return self.chunks().select("filepath").distinct()

    def count_chunks(self, filepath: str | None = None) -> int:
        return self.manifest().n_chunks if filepath is None else self.chunks().where(F.col("filepath") == filepath).count()

    def get_metadata(self, filepath: str) -> tuple[float, str] | None:
        row = self.metadata().where(F.col("filepath") == filepath).first()
        return (row.mtime, row.file_hash) if row else None

    def get_state(self, key: str) -> str | None:
        return self.manifest().state.get(key)

    def head(self) -> str | None:
        at = local_path(self.root)
        return src.head_commit(at) if at else None

    def tables(self) -> list[str]:
        """The tables of the latest generation."""
        at = self.manifest()
        return sorted([f"{s}/{kind}" for s in at.segments for kind in ("chunks", "blocks", "terms")] + [t for t in (at.dead, at.gone, at.files) if t])

    # changes

    def set_state(self, key: str, value: str) -> None:
        at = self.manifest()
        at.state[key] = value
        at.publish(self.spark, self.folder)

    def upsert_metadata(self, filepath: str, mtime: float, file_hash: str) -> None:
        one = self.spark.createDataFrame([(filepath, float(mtime), file_hash)], ix.FILES)
        self._change(self.manifest(), None, None, metadata=one)

    def insert_chunk(self, filepath: str, start_line: int, end_line: int, raw_snippet: str) -> str:
        """One chunk more; its id. A chunk of the same file and first line is another row with the same id."""
        one = self.spark.createDataFrame([(filepath, start_line, end_line, raw_snippet)], "filepath string, start_line int, end_line int, raw_snippet string")
        self._change(self.manifest(), one, None)
        return f"{filepath}#{start_line:09d}"

    def delete_chunks(self, filepath: str) -> int:
        """Removes a file's chunks but not its metadata; how many there were."""
        n = self.count_chunks(filepath)
        if n:
            self._change(self.manifest(), None, self.spark.createDataFrame([(filepath,)], "filepath string"))
        return n

    def delete_file(self, filepath: str) -> int:
        """Removes a file's chunks and metadata; how many chunks there were."""
        n, one = self.count_chunks(filepath), self.spark.createDataFrame([(filepath,)], "filepath string")
        self._change(self.manifest(), None, one if n else None, forget=one)
        return n

    def index_file(self, filepath: str) -> int:
        """Indexes one file anew; how many chunks it has. A file that is missing is removed."""
        now = self.staged(src.read_files(self.spark, self.root, [filepath]), "sync-file")
        if now.isEmpty():
            self.delete_file(filepath)
            return 0
        self._change(self.manifest(), chunks(now, self.settings), now.select("filepath"), metadata=now.drop("text"))
        return self.count_chunks(filepath)

    def update(self, files: DataFrame, deleted: DataFrame | None = None, state: dict | None = None) -> None:
        """Takes over new texts of files (filepath, mtime, file_hash, text) and drops those in ``deleted`` (filepath); both are read several times, so give tables of what takes long to work out."""
        stale = files.select("filepath") if deleted is None else files.select("filepath").union(deleted.select("filepath"))
        self._change(self.manifest(), chunks(files, self.settings), stale, files.select("filepath", "mtime", "file_hash"), deleted, state)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table in the shared folder, which goes with the driver."""
        path = src.scratch(self.spark, name)
        src.write(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._staged[out] = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Removes a table that ``staged`` gave, before the driver's end would."""
        ix.remove(self.spark, self._staged.pop(table))

    def _forget(self, at: ix.Manifest, after: ix.Manifest, stale: DataFrame) -> None:
        """Take the chunks of ``stale`` files out of ``after``: their bits, their terms and the totals."""
        spark, folder = self.spark, self.folder
        live = ix.live_chunks(spark, folder, at)
        keys = self.staged(live.select("filepath", "segment", "no", "dl").join(stale.select("filepath").distinct(), "filepath", "left_semi").drop("filepath"), "sync-gone")
        counts = keys.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()
        if not counts:
            return
        masks = keys.groupBy("segment", ix.range_of(F.col("no")).alias("range")).agg(F.bit_or(ix.bit(ix.place_of(F.col("no")))).alias("mask"))
        # terms of few chunks are fetched by number, so that the others' aren't read
        if sum(r.n for r in counts) <= rank.MANY:
            numbers: dict[str, list[int]] = {}
            for r in keys.collect():
                numbers.setdefault(r.segment, []).append(r.no)
            rows = ix.Index(spark, at.n_chunks, 0.0, folder=folder, at=at).fetch(numbers)
        else:
            held = live.withColumn("range", ix.range_of(F.col("no"))).join(ix.told(self.staged(masks, "sync-masks"), at), ["segment", "range"])
            rows = held.where(F.col("mask").bitwiseAND(ix.bit(ix.place_of(F.col("no")))) != 0)
        terms = ix.term_counts(rows)
        if at.dead:
            masks = masks.union(spark.read.schema(ix.DEAD).parquet(at.place(folder, at.dead))).groupBy("segment", "range").agg(F.bit_or("mask").alias("mask"))
        if at.gone:
            terms = terms.union(spark.read.schema(ix.GONE).parquet(at.place(folder, at.gone))).groupBy("segment", "term").agg(F.sum("df").alias("df"), F.sum("times").alias("times"))
        after.dead, after.gone = ix.write_table(masks, folder, "dead"), ix.write_table(terms.sort("term"), folder, "gone")
        for r in counts:
            after.segments[r.segment] = after.segments[r.segment] | {"gone": after.segments[r.segment]["gone"] + r.n}
            after.n_chunks, after.total_length = after.n_chunks - r.n, after.total_length - r.total

    def _merge(self, after: ix.Manifest) -> None:
        """Bring the segments of ``after`` to few of each size."""
        spark, folder = self.spark, self.folder
        once = due(after.segments)
        if not once:
            return
        if some := [s for s in after.segments if s in once and after.segments[s]["n"] > after.segments[s]["gone"]]:
            name, about, *_ = ix.write_segment(ix.live_chunks(spark, folder, after, some).drop("segment", "no"), folder, self.settings)
            after.segments[name] = about
        after.segments = {s: x for s, x in after.segments.items() if s not in once}
        left = [s for s, x in after.segments.items() if x["gone"]]
        for kind, schema in (("dead", ix.DEAD), ("gone", ix.GONE)):
            if table := getattr(after, kind):
                rows = spark.read.schema(schema).parquet(after.place(folder, table)).where(F.col("segment").isin(left)) if left else None
                setattr(after, kind, None if rows is None else ix.write_table(rows, folder, kind))

    def _change(self, at: ix.Manifest, new: DataFrame | None, stale: DataFrame | None, metadata: DataFrame | None = None, forget: DataFrame | None = None, state: dict | None = None) -> None:
        """Publish a generation: ``stale`` files' chunks gone, ``new`` ones there; metadata rows replaced or forgotten."""
        after = dataclasses.replace(at, segments=dict(at.segments), state=dict(at.state) | (state or {}))
        if stale is not None and at.segments:
            self._forget(at, after, stale)
        if new is not None:
            name, about, n, total = ix.write_segment(new, self.folder, self.settings)
            if n:
                after.segments[name] = about
                after.n_chunks, after.total_length = after.n_chunks + n, after.total_length + total
        if metadata is not None or forget is not None:
            known = self.spark.read.schema(ix.FILES).parquet(at.place(self.folder, at.files)) if at.files else self.spark.createDataFrame([], ix.FILES)
            for rows in (metadata, forget):
                known = purged(known, rows) if rows is not None else known
            after.files = ix.write_table(known.unionByName(metadata.select(*known.columns)) if metadata is not None else known, self.folder, "files")
        self._merge(after)
        after.publish(self.spark, self.folder)

    def listing(self) -> DataFrame:
        """(filepath, mtime, size) of the tree's files that count; the index's own folder is none of them."""
        found = src.tree_files(self.spark, self.root, self.extensions)
        place = lambda path: local_path(path) or path.rstrip("/")
        own = place(self.folder).removeprefix(f"{place(self.root).rstrip('/')}/")
        return found if own == place(self.folder) else found.where(~F.col("filepath").startswith(f"{own}/"))

    def collect_files(self) -> list[str]:
        return sorted(r.filepath for r in self.listing().select("filepath").collect())

    def chunk_file(self, filepath: str) -> DataFrame:
        return chunks(src.read_files(self.spark, self.root, [filepath]), self.settings)

    def build(self) -> dict:
        """A generation with all files of the tree and no others."""
        head, before = self.head(), self.manifest()
        now = self.staged(src.read_files(self.spark, self.root, self.listing()), "sync-files")
        self._change(ix.Manifest(before.generation, state=before.state), chunks(now, self.settings), None, now.drop("text"), state={HEAD: head})
        n, some = now.count(), _named(now)
        return {"full_build": True, "files": n, "indexed": n, "chunks": self.manifest().n_chunks, "head": head, "deleted": 0, "updated": n, "deleted_files": [], "updated_files": some, "previous_head": before.state.get(HEAD), "branch_switched": False}

    def sync(self, allow_empty: bool = False) -> dict:
        """Brings the index up to date and tells what it did; without an index it is built.

        A tree without files whose index has some raises EmptyTree, unless that is allowed: more often it isn't there than empty."""
        at = self.manifest()
        if not at.segments and not at.files:
            return self.build()
        spark, head, last = self.spark, self.head(), at.state.get(HEAD)
        known, listed = self.metadata(), self.staged(self.listing(), "sync-listing")
        n = listed.count()
        if not n and not allow_empty and not known.isEmpty():
            raise EmptyTree(f"{self.root} has no files, but its index has")
        switched = bool(head and last and head != last)
        named = src.git_changes(spark, local_path(self.root), last, head).where("action = 'changed'") if switched else spark.createDataFrame([], "filepath string, action string")
        moved = self.staged(suspects(known, listed, named), "sync-moved")
        report = {"full_build": False, "files": n, "head": head, "previous_head": last, "branch_switched": switched, "deleted": 0, "updated": 0, "deleted_files": [], "updated_files": [], "indexed": 0, "chunks": at.n_chunks}
        if moved.isEmpty():
            if head != last:
                self.set_state(HEAD, head)
            return report
        look = moved.where("action != 'deleted'")
        read = self.staged(src.read_files(spark, self.root, look), "sync-read")
        differs = changes(known.join(read.select("filepath"), "filepath", "left_semi"), read.drop("text")).where("action in ('added', 'changed')")
        updated = self.staged(differs.select("filepath"), "sync-updated")
        vanished = purged(look, read).join(known, "filepath", "left_semi")
        deleted = self.staged(moved.where("action = 'deleted'").select("filepath").union(vanished.select("filepath")), "sync-deleted")
        n_updated, n_deleted = updated.count(), deleted.count()
        now = read.join(updated, "filepath", "left_semi")
        self._change(at, chunks(now, self.settings) if n_updated else None, updated.union(deleted) if n_updated or n_deleted else None, read.drop("text"), deleted if n_deleted else None, {HEAD: head})
        return report | {"deleted": n_deleted, "updated": n_updated, "deleted_files": _named(deleted), "updated_files": _named(updated), "indexed": n_updated, "chunks": self.manifest().n_chunks}

    # warm start

    def copy_to(self, folder: str, overwrite: bool = False) -> bool:
        """Another folder gets this index, by reference; not if there is none, it is the same folder, or has an index that isn't to be overwritten.

        Both change apart from then on, and what the other one refers to stays here."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (self.folder, folder))
        if not self.exists() or a.equals(b) or (b.getFileSystem(conf).exists(b) and not overwrite):
            return False
        ix.lend(self.spark, self.folder, folder)
        return True

    def warm_start_from(self, folder: str, overwrite: bool = True, sync: bool = True) -> dict:
        """Takes over the index of another tree's folder, then syncs it with this tree."""
        copied = Store(self.spark, self.root, folder).copy_to(self.folder, overwrite)
        return {"copied": copied} | (self.sync() if sync else {})
