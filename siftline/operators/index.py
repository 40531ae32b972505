"""The inverted index: numbered chunks, blocks of postings, and a term dictionary, in segments of a folder.

Text is cut into terms once, when a chunk is written. A segment numbers its chunks (the writing task in the high
bits, then shorter chunks first) and has

- ``chunks``, a folder a task, rows in the order of numbers: a few of them are read without touching the rest,
- ``blocks``, in buckets of terms: a term's postings in one range of ``RANGE`` numbers, with the peaks of frequency
  and length that bound the score of any chunk in it,
- ``terms``, sorted: what a search needs to know of a term before it reads a block.

Manifests are small JSON files of which the latest one counts: it names the segments, the tables of what is gone
from them (a mask of bits for each range, and what that takes from the dictionary), and the totals of scores.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siftline.config import DEFAULT, Settings
from siftline.functions import tokenize as tk
from siftline.sources.files import scratch, write

RANGE = 32  # chunks of a range, and bits of its mask
TASK_BITS = 33  # numbers that one writing task may give
BUCKET_ROWS = 1 << 20  # terms of chunks that a bucket has
TASK_ROWS = 4 * BUCKET_ROWS  # and those that one task writes
TASK_BYTES = 8 << 20  # of packed postings, over which a task's are dealt to several
TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SLICE_ROWS = 1 << 19  # and those that are put in order at once
MAX_BUCKETS = 4096
COUNTED = 1000  # chunks whose terms are counted at once
HELD = 1 << 18  # ranges whose masks go to all tasks; beyond, chunks and masks are dealt out by range
EXACT = 1000  # numbers that a scan is told one by one
CHUNKS = "no long, chunk_id string, filepath string, start_line int, end_line int, raw_snippet string, dl int, path_terms array<string>, body_terms array<string>"
BLOCKS = "term string, range long, n int, times long, peaks array<struct<tf:double,dl:int>>, docs array<struct<at:int,dl:int,p:int,b:int>>, places array<struct<p:array<int>,b:array<int>>>"
TERMS = "term string, df long, times long, blocks long"
FILES = "filepath string, mtime double, file_hash string"
DEAD = "segment string, range long, mask long"
GONE = "segment string, term string, df long, times long"
SHOWN = ["chunk_id", "filepath", "start_line", "end_line", "raw_snippet"]


def local(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows that the driver has, as a relation of the plan itself: no job makes them."""
    types = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types), StructType.fromDDL(schema))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a single small file is else cut up by one of them."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def with_terms(chunks: DataFrame) -> DataFrame:
    """Chunks with the terms of either column; a path's tokens stand in the body as well."""
    body = F.concat(tk.text_terms(F.col("filepath")), tk.text_terms(F.col("raw_snippet")))
    return spread(chunks).withColumns({"path_terms": tk.path_terms(F.col("filepath")), "body_terms": body})


def with_ids(chunks: DataFrame) -> DataFrame:
    """A chunk's id names its file and first line, so that it needs no numbering over all files."""
    return chunks.withColumn("chunk_id", F.concat_ws("#", "filepath", F.lpad(F.col("start_line").cast("string"), 9, "0")))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("dl", F.size("path_terms") + F.size("body_terms"))


def range_of(no: Column) -> Column:
    return F.shiftright(no, RANGE.bit_length() - 1)


def place_of(no: Column) -> Column:
    """A number's place in its range."""
    return no.bitwiseAND(RANGE - 1).cast("int")


def among(column: str, wanted: list[int]) -> Column:
    """Whether it is one of some numbers, by lists so short that a scan compares its pages with each, instead of with their least and largest."""
    some = [F.col(column).isin(wanted[i : i + 10]) for i in range(0, len(wanted), 10)] or [F.lit(False)]
    while len(some) > 1:  # in pairs, so that the condition stays flat
        some = [a | b for a, b in zip(some[::2], some[1::2], strict=False)] + some[len(some) & ~1 :]
    return some[0]


def bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def write_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """Number chunks, which get terms if they have none, and write them; the table. A task's shorter chunks come first, so that ranges hold chunks of like length."""
    cut = chunks if "body_terms" in chunks.columns else lengths(with_terms(with_ids(chunks)))
    dealt = cut.withColumn("task", F.spark_partition_id()).sortWithinPartitions("task", "dl", "chunk_id").withColumn("no", F.monotonically_increasing_id())
    write(dealt.select("task", *(f.split(" ")[0] for f in CHUNKS.split(", "))), path, "task")
    return chunks.sparkSession.read.schema(f"{CHUNKS}, task int").parquet(path)


def occurrences(chunks: DataFrame) -> DataFrame:
    """(term, no, dl, place, in_path): every term of every chunk."""
    at_body = F.size("path_terms")
    each = chunks.select("no", "dl", at_body.alias("first"), F.posexplode(F.concat("path_terms", "body_terms")).alias("pos", "term"))
    in_path = F.col("pos") < F.col("first")
    return each.select("term", "no", "dl", F.when(in_path, F.col("pos")).otherwise(F.col("pos") - F.col("first")).alias("place"), in_path.alias("in_path"))


def _peaks(docs: Column, settings: Settings) -> Column:
    """The (tf, dl) of which one isn't below another in frequency and above it in length: the score's bound for any constants, as chunks are in the order of their length."""
    empty = F.array().cast("array<struct<tf:double,dl:int>>")
    weighed = F.transform(docs, lambda d: F.struct((settings.path_weight * d.p + settings.body_weight * d.b).cast("double").alias("tf"), d.dl.alias("dl")))
    return F.aggregate(weighed, empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).tf >= x.tf), acc).otherwise(F.concat(acc, F.array(x))))


def blocks(found: DataFrame, keys: tuple[str, ...] = (), settings: Settings = DEFAULT) -> DataFrame:
    """The blocks of occurrences: terms' postings by range; ``keys`` are further columns that stay, on which rows are dealt."""
    places = lambda where: F.sort_array(F.collect_list(F.when(where, F.col("place"))))
    by_chunk = found.groupBy(*keys, "term", "no", "dl").agg(places(F.col("in_path")).alias("p"), places(~F.col("in_path")).alias("b"))
    one = F.struct(place_of(F.col("no")).alias("at"), "dl", "p", "b")
    by_range = by_chunk.groupBy(*keys, "term", range_of(F.col("no")).alias("range")).agg(F.sort_array(F.collect_list(one)).alias("x"))
    docs = F.transform("x", lambda d: F.struct(d.at.alias("at"), d.dl.alias("dl"), F.size(d.p).alias("p"), F.size(d.b).alias("b")))
    out = by_range.select(*keys, "term", "range", docs.alias("docs"), F.transform("x", lambda d: F.struct(d.p.alias("p"), d.b.alias("b"))).alias("places"))
    times = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d.p + d.b)
    return out.select(*keys, "term", "range", F.size("docs").alias("n"), times.alias("times"), _peaks(F.col("docs"), settings).alias("peaks"), "docs", "places")


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays in few bytes: first, second and further bytes of a column's numbers stand together, as most of the higher ones are alike."""
    planes = b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in map(np.ascontiguousarray, columns))
    return np.array([len(c) for c in columns], np.int32).tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes, types: tuple[type, ...]) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int32, len(types))
    ends = np.cumsum([n * np.dtype(t).itemsize for n, t in zip(sizes, types, strict=True)])
    planes = np.frombuffer(pa.decompress(data[sizes.nbytes :], int(ends[-1]), "zstd"), np.uint8) if ends[-1] else np.empty(0, np.uint8)
    return [np.ascontiguousarray(x.reshape(np.dtype(t).itemsize, -1).T).view(t).ravel() if len(x) else np.empty(0, t) for x, t in zip(np.split(planes, ends[:-1]), types, strict=True)]


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of words in bytes, and all of their bytes."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    at, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :] if len(words) else [0], words.buffers()[2]
    return sizes, np.frombuffer(data, np.uint8)[at[0] : at[0] + sizes.sum()] if data is not None else np.empty(0, np.uint8)


def _words(sizes: np.ndarray, letters: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


_CHUNK_TYPES = (np.int64, np.int32, np.int32, np.int32, np.uint8)  # numbers, sizes of the two columns, and the terms of the one, then of the other


def _packed_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' numbers and terms, a row for each range of a batch."""
    for rows in batches:
        no = rows["no"].to_numpy()
        begins = np.flatnonzero(np.diff(no // RANGE, prepend=-1))
        parts = []
        for i, j in zip(begins, np.append(begins[1:], len(no)), strict=True):
            columns = [rows[c].slice(i, j - i) for c in ("path_terms", "body_terms")]
            sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in columns]
            parts.append(_pack(no[i:j], *sizes, *_letters(pa.concat_arrays([c.flatten() for c in columns]))))
        yield pa.RecordBatch.from_pydict({"range": pa.array(no[begins] // RANGE, pa.int64()), "first": pa.array(no[begins], pa.int64()), "part": pa.array(parts, pa.binary())})


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks (no, dl, path_terms, body_terms) of packed ranges, about ``SLICE_ROWS`` terms at once."""
    held, n = [], 0
    for batch in batches:
        for part in batch.column("part"):
            no, n_path, n_body, *words = _unpacked(part.as_py(), _CHUNK_TYPES)
            terms, in_path = _words(*words), int(n_path.sum())
            lists = [_lists(np.cumsum(k) - k, k.sum(), x) for k, x in ((n_path, terms.slice(0, in_path)), (n_body, terms.slice(in_path)))]
            held.append(pa.RecordBatch.from_pydict({"no": pa.array(no), "dl": pa.array(n_path + n_body), "path_terms": lists[0], "body_terms": lists[1]}))
            n += len(terms)
            if n >= SLICE_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole ranges of rows that come in the order of numbers, of about ``SLICE_ROWS`` terms."""
    held = None
    for rows in batches:
        held = pa.Table.from_batches([rows]) if held is None else pa.concat_tables([held, pa.Table.from_batches([rows])])
        upto = np.cumsum(held["dl"].to_numpy())
        ends = np.flatnonzero(np.diff(held["no"].to_numpy() // RANGE)) + 1  # the last range may go on in the next batch
        done = 0
        while len(later := ends[ends > done]):
            fit = later[upto[later - 1] <= (upto[done - 1] if done else 0) + SLICE_ROWS]
            end = int(fit[-1] if len(fit) else later[0])
            yield held.slice(done, end - done)
            done = end
        held = held.slice(done)
    if held is not None and len(held):
        yield held


def _ordered(rows: pa.Table, group: Callable[[str], int] | None = None) -> tuple[np.ndarray, ...]:
    """The occurrences of some chunks by term, chunk, column and place: places, whether in the path, and where a chunk's begin; the terms, and the chunks' (term, chunk). With a ``group``, terms of one stand together."""
    columns = [rows[c].combine_chunks() for c in ("path_terms", "body_terms")]
    sizes = [pc.list_value_length(c).to_numpy() for c in columns]
    chunk = np.concatenate([np.repeat(np.arange(len(rows)), n) for n in sizes])
    place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes]).astype(np.int32)
    words = pa.chunked_array([c.flatten() for c in columns]).combine_chunks().dictionary_encode()
    terms, term = words.dictionary, words.indices.to_numpy().astype(np.int64)
    if group:
        by = np.argsort([group(t) for t in terms.to_pylist()], kind="stable")
        terms, term = terms.take(pa.array(by)), np.argsort(by)[term]
    key = term * len(rows) + chunk
    order = np.argsort(key, kind="stable")  # so paths stay before bodies, and places in order
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return place[order], order < sizes[0].sum(), first, terms, key[first] // len(rows), key[first] % len(rows)


def _lists(begins: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, total).astype(np.int32)), values)


def _struct(**columns: np.ndarray | pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _blocks_of(terms: pa.Array, term: np.ndarray, no: np.ndarray, dl: np.ndarray, p: np.ndarray, b: np.ndarray, places: tuple[np.ndarray, np.ndarray], settings: Settings) -> dict[str, pa.Array]:
    """The blocks of terms' chunks, which come by term and number: their lengths, how often the term is in either column, and where."""
    new = np.append(True, (np.diff(term) != 0) | (np.diff(no // RANGE) != 0))
    begin = np.flatnonzero(new)
    tf = settings.path_weight * p + settings.body_weight * b.astype(np.float64)
    values, level = np.unique(tf, return_inverse=True)
    level = level + (np.cumsum(new) - 1) * len(values)  # so that a block's are above those of the blocks before it
    peak = new | (level > np.append(-1, np.maximum.accumulate(level)[:-1]))
    upto = np.cumsum(peak)
    place_of_column = [_lists(np.cumsum(x) - x, x.sum(), pa.array(place)) for x, place in zip((p, b), places, strict=True)]
    return {
        "term": terms.take(pa.array(term[begin])), "range": pa.array(no[begin] // RANGE), "n": pa.array(np.diff(np.append(begin, len(no))).astype(np.int32)),
        "times": pa.array(np.add.reduceat((p + b).astype(np.int64), begin)),
        "peaks": _lists((upto - peak)[begin], upto[-1], _struct(tf=tf[peak], dl=dl[peak])),
        "docs": _lists(begin, len(no), _struct(at=(no % RANGE).astype(np.int32), dl=dl, p=p, b=b)),
        "places": _lists(begin, len(no), _struct(p=place_of_column[0], b=place_of_column[1])),
    }


def _counted(place: np.ndarray, in_path: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a chunk has its term in either column."""
    p = np.add.reduceat(in_path.astype(np.int32), first, dtype=np.int32)
    return p, (np.diff(np.append(first, len(place))) - p).astype(np.int32)


def _dealt(chunks: DataFrame, n_terms: int | None = None) -> DataFrame:
    """Chunks' terms by whole ranges, packed, as what moves stays on the disks until all of it has: a row a range, never an occurrence."""
    n_tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), ((chunks.agg(F.sum("dl")).first()[0] or 0) if n_terms is None else n_terms) // TASK_ROWS)
    packed = chunks.select("no", "path_terms", "body_terms").mapInArrow(_packed_ranges, "range long, first long, part binary")
    return packed.repartition(n_tasks, "range").sortWithinPartitions("range", "first")


def range_blocks(chunks: DataFrame, settings: Settings = DEFAULT, postings: bool = True, n_terms: int | None = None) -> DataFrame:
    """The blocks of all terms, as ``blocks`` makes them of occurrences; without ``postings`` (term, n, times) alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(_chunks_of(batches)):
            place, in_path, first, terms, term, chunk = _ordered(rows)
            if not len(first):
                continue
            no, dl = rows["no"].to_numpy()[chunk], rows["dl"].to_numpy()[chunk].astype(np.int32)
            p, b = _counted(place, in_path, first)
            if postings:
                yield pa.RecordBatch.from_pydict(_blocks_of(terms, term, no, dl, p, b, (place[in_path], place[~in_path]), settings))
            else:
                begin = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(no // RANGE) != 0)))
                n, times = np.diff(np.append(begin, len(no))).astype(np.int32), np.add.reduceat((p + b).astype(np.int64), begin)
                yield pa.RecordBatch.from_pydict({"term": terms.take(pa.array(term[begin])), "n": pa.array(n), "times": pa.array(times)})

    return _dealt(chunks, n_terms).mapInArrow(cut, BLOCKS if postings else "term string, n int, times long")


_POSTING_TYPES = (np.int32, np.uint8, np.int32, np.int64, np.int32, np.int32, np.int32, np.int32, np.int32)  # the terms and how many chunks each has; these, and the places


def bucketed_blocks(chunks: DataFrame, buckets: int, settings: Settings = DEFAULT, n_terms: int | None = None) -> DataFrame:
    """``range_blocks`` with the ``bucket`` of each, a bucket's in few tasks. Postings move packed, buckets of one task together; blocks are made of them where they arrive.

    What turns out too much for a task as it arrives is dealt to several, if ``TASK_SIZE`` is ``TASK_BYTES`` when it runs."""
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_terms or 0) // TASK_ROWS)
    groups = min(tasks, buckets)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(_chunks_of(batches)):
            place, in_path, first, terms, term, chunk = _ordered(rows, lambda t: bucket_of(t, buckets) % groups)
            if not len(first):
                continue
            no, dl = rows["no"].to_numpy()[chunk], rows["dl"].to_numpy()[chunk].astype(np.int32)
            p, b = _counted(place, in_path, first)
            group = np.array([bucket_of(t, buckets) % groups for t in terms.to_pylist()])
            sizes, letters = _letters(terms)
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            upto, of, at = np.append(0, np.cumsum(sizes)), np.append(np.searchsorted(term, np.arange(len(terms))), len(term)), np.append(first, len(place))
            parts = []
            for i, j in zip(begins, np.append(begins[1:], len(group)), strict=True):
                x, y = of[i], of[j]
                spot, own = place[at[x] : at[y]], in_path[at[x] : at[y]]
                parts.append(_pack(sizes[i:j], letters[upto[i] : upto[j]], np.diff(of[i : j + 1]).astype(np.int32), np.diff(no[x:y], prepend=0), np.diff(dl[x:y], prepend=np.int32(0)), p[x:y], b[x:y], spot[own], spot[~own]))
            yield pa.RecordBatch.from_pydict({"group": pa.array(group[begins], pa.int32()), "part": pa.array(parts, pa.binary())})

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        sizes, letters, of, no, dl, p, b, *places = (np.concatenate(x) for x in zip(*held, strict=True))
        terms, term = _words(sizes, letters), np.repeat(np.arange(len(of)), of)
        out = _blocks_of(terms, term, no, dl, p, b, tuple(places), settings)
        bucket = np.array([bucket_of(t, buckets) for t in terms.to_pylist()], np.int32)
        return pa.RecordBatch.from_pydict(out | {"bucket": pa.array(bucket[term[np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(no // RANGE) != 0)))]])})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in batch.column("part"):
                one = _unpacked(part.as_py(), _POSTING_TYPES)
                one[3], one[4] = np.cumsum(one[3]), np.cumsum(one[4], dtype=np.int32)
                held.append(one)
                n += len(one[7]) + len(one[8])
                if n >= SLICE_ROWS // 4:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return _dealt(chunks, n_terms).mapInArrow(pack, "group int, part binary").hint("rebalance", tasks, F.col("group")).mapInArrow(unpack, f"{BLOCKS}, bucket int")


def term_counts(chunks: DataFrame) -> DataFrame:
    """(segment, term, df, times) of some chunks; what moves is a row for each term of ``COUNTED`` chunks, never an occurrence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column("segment").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("segment"), segment))
                for i in range(0, len(own), COUNTED):
                    place, _, first, terms, term, _ = _ordered(pa.Table.from_batches([own.slice(i, COUNTED)]))
                    df, times = np.bincount(term, minlength=len(terms)), np.bincount(term, np.diff(np.append(first, len(place))), len(terms))
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([segment] * len(terms), pa.string()), "term": terms, "df": pa.array(df.astype(np.int64)), "times": pa.array(times.astype(np.int64))})

    found = chunks.select("segment", "path_terms", "body_terms").mapInArrow(cut, GONE)
    return found.groupBy("segment", "term").agg(F.sum("df").alias("df"), F.sum("times").alias("times"))


def dictionary(of: DataFrame) -> DataFrame:
    """(term, df, times, blocks) of blocks."""
    return of.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("times").alias("times"), F.count("*").alias("blocks"))


def bucket_of(term: str, n: int) -> int:
    return zlib.crc32(term.encode()) % n


@dataclass
class Index:
    """What a search reads. A stored one has a folder and a manifest; one that isn't has a ``table`` of chunks with terms, whose blocks are made for the terms that are asked."""

    spark: SparkSession
    n_chunks: int
    avg_length: float
    table: DataFrame | None = None
    folder: str = ""
    at: Manifest | None = None

    @classmethod
    def of(cls, chunks: DataFrame) -> Index:
        """An index that isn't stored: chunks are cut into terms once, into a table that goes with the driver."""
        table = write_chunks(chunks, scratch(chunks.sparkSession, "index-chunks"))
        stats = table.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
        return cls(chunks.sparkSession, stats.n, stats.avg or 0.0, table)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, at: Manifest | None = None) -> Index:
        at = at or Manifest.latest(spark, folder)
        return cls(spark, at.n_chunks, at.total_length / at.n_chunks if at.n_chunks else 0.0, None, folder, at)

    def chunks(self) -> DataFrame:
        """All live chunks (segment, no, ...)."""
        return self.table.withColumn("segment", F.lit("")).drop("task") if self.at is None else live_chunks(self.spark, self.folder, self.at)

    def terms(self) -> DataFrame:
        """(segment, term, df, times, blocks): the dictionary, without what is gone."""
        if self.at is None:
            return dictionary(range_blocks(self.table, postings=False)).withColumn("segment", F.lit(""))
        out = _union(self.spark, self.folder, self.at, "terms", f"{TERMS}, segment string")
        if not self.at.gone:
            return out
        less = self.spark.read.schema(GONE).parquet(self.at.place(self.folder, self.at.gone)).select("term", (-F.col("df")).alias("df"), (-F.col("times")).alias("times"), F.lit(0).cast("long").alias("blocks"), "segment")
        sums = out.select("term", "df", "times", "blocks", "segment").union(less).groupBy("segment", "term").agg(*(F.sum(c).alias(c) for c in ("df", "times", "blocks")))
        return sums.where("df > 0")

    def look_up(self, wanted: list[str], settings: Settings = DEFAULT) -> tuple[list, DataFrame]:
        """The dictionary's rows of some terms, and their blocks with the ``segment`` they are of; other buckets aren't read."""
        schema = f"{BLOCKS}, segment string"
        if self.at is None:
            path = scratch(self.spark, "index-blocks")
            own = self.table.where(F.arrays_overlap(F.concat("path_terms", "body_terms"), F.array(*map(F.lit, wanted)))) if wanted else self.table.limit(0)
            blocks(occurrences(own).where(F.col("term").isin(wanted)), settings=settings).withColumn("segment", F.lit("")).write.parquet(path)
            made = self.spark.read.schema(schema).parquet(path)
            return dictionary(made).withColumn("segment", F.lit("")).collect(), made
        rows = self.terms().where(F.col("term").isin(wanted)).collect() if wanted and self.at.segments else []
        out = None
        for name, about in self.at.segments.items():
            own = sorted(r.term for r in rows if r.segment == name)
            if own:
                paths = [f"{self.at.place(self.folder, name)}/blocks/bucket={b}" for b in sorted({bucket_of(t, about["buckets"]) for t in own})]
                one = self.spark.read.schema(BLOCKS).parquet(*paths).where(F.col("term").isin(own)).withColumn("segment", F.lit(name))
                out = one if out is None else out.unionByName(one)
        return rows, out if out is not None else local(self.spark, [], schema)

    def masks(self) -> DataFrame | None:
        """(segment, range, mask): the chunks that are gone; None if there are none."""
        return self.spark.read.schema(DEAD).parquet(self.at.place(self.folder, self.at.dead)) if self.at and self.at.dead else None

    def fetch(self, numbers: dict[str, list[int]]) -> DataFrame:
        """Some chunks, by segment and number; only the folders of the tasks that wrote them are read, and of these the pages that have the numbers."""
        out = None
        for name, wanted in numbers.items():
            if self.at is None:
                one = self.table.where(F.col("task").isin(sorted({n >> TASK_BITS for n in wanted}))).drop("task")
            else:
                one = self.spark.read.schema(CHUNKS).parquet(*(f"{self.at.place(self.folder, name)}/chunks/task={t}" for t in sorted({n >> TASK_BITS for n in wanted})))
            if len(wanted) <= EXACT:
                one = one.where(among("no", wanted))
            else:  # a relation, as a condition of so many numbers takes the driver longer than the tasks
                one = one.where(F.col("no").between(min(wanted), max(wanted))).join(F.broadcast(local(self.spark, [(n,) for n in wanted], "no long")), "no", "left_semi")
            one = one.withColumn("segment", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else local(self.spark, [], f"{CHUNKS}, segment string")

    def write(self, folder: str, state: dict | None = None) -> str:
        """A folder's first or next generation, with these chunks and no others."""
        return replace(self.chunks().drop("segment", "no"), folder, state)


# Files of a folder, in any file system that Spark writes to --------------------------------------------------


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """A path in the one form that its file system gives it."""
    fs, p = _path(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


@dataclass
class Manifest:
    generation: int = 0
    segments: dict[str, dict] = field(default_factory=dict)  # name: {"buckets", "n": chunks written, "gone": those no longer there, "from": the folder, if another's}
    dead: str | None = None  # the table of masks of chunks that are gone
    gone: str | None = None  # what these take from the dictionary
    files: str | None = None  # the table of file metadata
    n_chunks: int = 0
    total_length: int = 0
    state: dict = field(default_factory=dict)

    def place(self, folder: str, name: str) -> str:
        """Where a segment or table stands: in ``folder``, or in another one that lends it."""
        if "/" in name:
            return name
        return f"{self.segments[name].get('from', folder) if name in self.segments else folder}/{name}"

    def lent(self, folder: str, lender: str) -> set[str]:
        """What this manifest of ``folder`` uses of another folder."""
        every = [self.place(folder, t) for t in [*self.segments, self.dead, self.gone, self.files] if t]
        return {t.removeprefix(f"{lender}/") for t in every if t.startswith(f"{lender}/")}

    @classmethod
    def latest(cls, spark: SparkSession, folder: str) -> Manifest:
        found = [x for x in names(spark, folder) if x.startswith("manifest-")]
        if not found:
            raise FileNotFoundError(f"no index in {folder}")
        return cls.read(spark, f"{folder}/{found[-1]}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest:
        return cls(**json.loads(read_text(spark, path)))

    def publish(self, spark: SparkSession, folder: str) -> None:
        """Written whole under another name, then renamed; a writer that comes second fails. Older tables than the last generation's go."""
        self.generation += 1
        fs, draft = _path(spark, f"{folder}/draft-{time.time_ns()}")
        write_text(spark, draft.toString(), json.dumps(self.__dict__))
        if not fs.rename(draft, _path(spark, f"{folder}/manifest-{self.generation:012d}.json")[1]):
            fs.delete(draft, True)
            raise RuntimeError(f"another writer has published generation {self.generation} of {folder}")
        every = names(spark, folder)
        kept = [x for x in every if x.startswith("manifest-")][-2:]
        own = qualified(spark, folder)
        used = {t for x in kept for t in Manifest.read(spark, f"{folder}/{x}").lent(own, own)}
        for x in every:
            if x.startswith("lent-"):  # to an index that has begun as this one
                used |= _still_lent(spark, own, f"{folder}/{x}")
        for name in every:
            if name not in kept and name not in used and name.split("-")[0] in ("manifest", "segment", "dead", "gone", "files"):
                remove(spark, f"{folder}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def lend(spark: SparkSession, folder: str, to: str) -> None:
    """Publish in ``to`` a generation that has what ``folder`` has, without copying it; ``folder`` keeps it while that is used."""
    folder, to = qualified(spark, folder), qualified(spark, to)
    slip = json.dumps({"to": to, "since": time.time()})
    write_text(spark, f"{folder}/lent-{zlib.crc32(to.encode()):08x}.json", slip)  # first, so that nothing goes meanwhile
    at = Manifest.latest(spark, folder)
    for lender in {at.place(folder, t).rpartition("/")[0] for t in [*at.segments, at.dead, at.gone, at.files] if t} - {folder}:  # what this one has from others
        write_text(spark, f"{lender}/lent-{zlib.crc32(to.encode()):08x}.json", slip)
    generation = Manifest.latest(spark, to).generation if has_index(spark, to) else 0
    table = lambda t: t and at.place(folder, t)
    segments = {s: x | {"from": x.get("from", folder)} for s, x in at.segments.items()}
    Manifest(generation, segments, table(at.dead), table(at.gone), table(at.files), at.n_chunks, at.total_length, dict(at.state)).publish(spark, to)


def _still_lent(spark: SparkSession, folder: str, slip: str) -> set[str]:
    """What the borrower of a slip still uses; the slip goes where that is nothing."""
    told = json.loads(read_text(spark, slip))
    kept = [x for x in names(spark, told["to"]) if x.startswith("manifest-")]
    used = {t for x in kept for t in Manifest.read(spark, f"{told['to']}/{x}").lent(told["to"], folder)}
    if not used and (kept or time.time() - told["since"] > 3600):  # a borrower that is just beginning has no manifest yet
        remove(spark, slip)
    return used if kept else {t for t in names(spark, folder) if not t.startswith(("manifest-", "lent-"))}


def has_index(spark: SparkSession, folder: str) -> bool:
    return any(x.startswith("manifest-") for x in names(spark, folder))


def _union(spark: SparkSession, folder: str, at: Manifest, kind: str, schema: str, only: list[str] | None = None) -> DataFrame:
    """One table of several segments, with the ``segment`` of each row."""
    out = None
    for s in at.segments if only is None else only:
        one = spark.read.schema(schema.replace(", segment string", "")).parquet(f"{at.place(folder, s)}/{kind}").withColumn("segment", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else local(spark, [], schema)


def told(masks: DataFrame, at: Manifest) -> DataFrame:
    """Masks as a join takes them: all tasks get them while they are few, so that no chunk moves for them."""
    return F.broadcast(masks) if sum(x["n"] for x in at.segments.values()) // RANGE <= HELD else masks


def live_chunks(spark: SparkSession, folder: str, at: Manifest, only: list[str] | None = None) -> DataFrame:
    """The chunks of all segments, or of some, that aren't gone."""
    out = _union(spark, folder, at, "chunks", f"{CHUNKS}, segment string", only)
    if not at.dead:
        return out
    masks = spark.read.schema(DEAD).parquet(at.place(folder, at.dead))
    held = out.withColumn("range", range_of(F.col("no"))).join(told(masks, at), ["segment", "range"], "left")
    gone = F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(bit(place_of(F.col("no")))) != 0
    return held.where(~gone).drop("range", "mask")


def write_segment(chunks: DataFrame, folder: str, settings: Settings = DEFAULT) -> tuple[str, dict, int, int]:
    """A new segment of chunks, which get terms if they have none: its name, what the manifest says of it, chunks and total length."""
    spark, name = chunks.sparkSession, f"segment-{time.time_ns()}"
    stored = write_chunks(chunks, f"{folder}/{name}/chunks")
    n, total = stored.agg(F.count("*"), F.sum("dl")).first()
    total = total or 0
    buckets = min(MAX_BUCKETS, max(8, total // BUCKET_ROWS))
    made = bucketed_blocks(stored, buckets, settings, total).sortWithinPartitions("bucket", "term", "range")
    before = spark.conf.get(TASK_SIZE)
    spark.conf.set(TASK_SIZE, f"{TASK_BYTES}b")
    try:
        write(made, f"{folder}/{name}/blocks", "bucket")
    finally:
        spark.conf.set(TASK_SIZE, before)
    write(dictionary(spark.read.schema(BLOCKS).parquet(f"{folder}/{name}/blocks").select("term", "n", "times")).sort("term"), f"{folder}/{name}/terms")
    return name, {"buckets": buckets, "n": n, "gone": 0, "weights": [settings.path_weight, settings.body_weight]}, n, total


def replace(chunks: DataFrame, folder: str, state: dict | None = None, files: DataFrame | None = None) -> str:
    """Publish a generation that has these chunks only."""
    spark = chunks.sparkSession
    at = Manifest.latest(spark, folder) if has_index(spark, folder) else Manifest()
    name, about, n, total = write_segment(chunks, folder)
    Manifest(at.generation, {name: about}, files=write_table(files, folder, "files") if files is not None else None, n_chunks=n, total_length=total, state=state or {}).publish(spark, folder)
    return name


def write_table(df: DataFrame, folder: str, kind: str) -> str:
    name = f"{kind}-{time.time_ns()}"
    write(df, f"{folder}/{name}")
    return name
