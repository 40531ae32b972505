"""Removal of byte strings that an earlier document has, from longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document of a smaller id: if the
longest previous factor of a position, over documents of smaller ids, reaches ``LENGTH``. Positions are put in
suffix order (by their bytes, as far as ``LENGTH``, which decides that question); the previous and the next
position of a smaller document in that order give the longest previous factor.

This is done twice. Texts are packed into batches of a few megabytes, which are written once. The smallest hash of
the ``GRAM``-byte strings in a window names it, so equal windows have equal names wherever they stand. Batches post
the names they hold, as gaps between sorted tags and without document ids; back comes a bit for each name that
another batch has too. Then each batch orders its own windows under names that several of its documents have: only
the first of equal windows are left. Those under names that other batches share are dealt by name into pieces, and
each piece is ordered as a whole. So what stands in a third of all documents moves once a batch.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; rows without an id lose nothing and
take from none; rows of one id don't take from each other, repeated rows get the same result; a column of ``docs``
that has the name of a result is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from ._common import fresh, partitions, staged, table, text_bytes

LENGTH = 50
GRAM = 24
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
TAG_BITS = 28
HEAD = 32  # characters that bring texts into one batch; where they differ, the pieces still find what they share
AT_ONCE = 16  # batches
_OFFSETS = [*range(0, LENGTH - 8, 8), LENGTH - 8]
_ODD = [A.U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(z: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(z)), kind)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; shorter by 7."""
    x = data.astype(A.U)
    for n in (1, 2, 4):
        x = x[:-n] | x[n:] << A.U(8 * n) if len(x) > n else x[:0]
    return x


def window_names(data: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest hash of its grams."""
    if len(data) < LENGTH:
        return np.zeros(0, A.U)
    x, n = _eights(data), len(data) - GRAM + 1
    low = A.mix(x[:n] * _ODD[0] + x[8 : 8 + n] * _ODD[1] + x[GRAM - 8 : GRAM - 8 + n] * _ODD[2])
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    over = want - width
    return np.minimum(low[:-over], low[over:]) if over else low


def packed(docs: DataFrame, n_parts: int) -> DataFrame:
    """The texts by batches: (batch, ids, known, sizes, z). Texts of one beginning come together, so most near copies meet in a batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for rows in batches:
            data, at = A.flat(rows.column("text"))
            ids, known = rows.column("doc_id").fill_null(0).to_numpy(), rows.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for i, j in A.slices(at, BATCH_BYTES):
                row = (TaskContext.get().partitionId() << 32 | n, ids[i:j].tobytes(), known[i:j].tobytes(), np.diff(at[i : j + 1]).tobytes(), _pack(data[at[i] : at[j]]))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["batch", "ids", "known", "sizes", "z"])
                n += 1

    order = [F.xxhash64(F.substring("text", 1, HEAD)), F.xxhash64("text", "doc_id")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(cut, "batch long, ids binary, known binary, sizes binary, z binary")


class Batch:
    """Texts one after the other, and the runs of windows that have one name."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, z: bytes):
        self.ids, self.known, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(sizes, np.int64)
        self.data, self.at = _unpack(z), np.concatenate([[0], np.cumsum(self.sizes)])

    def copies(self) -> np.ndarray:
        """Which texts equal one of a smaller id."""
        first: dict[bytes, int] = {}
        names = [hashlib.blake2b(self.data[a:b], digest_size=16).digest() if k else b"" for a, b, k in zip(self.at[:-1].tolist(), self.at[1:].tolist(), self.known, strict=True)]
        for name, i, k in zip(names, self.ids.tolist(), self.known, strict=True):
            if k:
                first[name] = min(i, first.get(name, i))
        return np.array([bool(k) and first[name] < i for name, i, k in zip(names, self.ids.tolist(), self.known, strict=True)], bool) & (self.sizes >= LENGTH)

    def runs(self, n_buckets: int) -> None:
        """Sets ``begin``, ``end`` (windows), ``doc`` and ``key`` (bucket and tag of the name) of each run."""
        n = len(self.data)
        out = ~self.known | self.copies()
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.where(out, self.at[:-1], np.maximum(self.at[:-1], self.at[1:] - LENGTH + 1)), 1)
        np.add.at(edge, self.at[1:], -1)
        fine = np.cumsum(edge[:-1]) == 0
        begin, end, name = [], [], []
        for lo in range(0, max(n - LENGTH + 1, 0), A.SLICE):
            hi = min(lo + A.SLICE, n - LENGTH + 1)
            own, ok = window_names(self.data[lo : hi + LENGTH - 1]), fine[lo:hi]
            start = ok.copy()
            start[1:] &= (own[1:] != own[:-1]) | ~ok[:-1]
            stop = ok.copy()
            stop[:-1] &= start[1:] | ~ok[1:]
            begin.append(np.flatnonzero(start) + lo)
            end.append(np.flatnonzero(stop) + lo + 1)
            name.append(own[start])
        self.begin, self.end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, end))
        self.doc = np.searchsorted(self.at, self.begin, "right") - 1
        # names are minima and so not evenly spread: mixed again
        mixed = A.mix(np.concatenate([np.zeros(0, A.U), *name]))
        self.key = (mixed % A.U(n_buckets)).astype(np.int64) << TAG_BITS | (mixed >> A.U(64 - TAG_BITS)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets; none where there are none, as in a batch of short texts or of texts that share nothing."""
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[start].tolist(), start.tolist(), np.append(start[1:], len(bucket))[: len(start)].tolist(), strict=True)


def _gaps(tags: np.ndarray) -> bytes:
    """Sorted tags as gaps, low bytes first."""
    return _pack(np.diff(tags, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _tags(z: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpack(z).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def posted_names(batches: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, batch, tags): the names of each batch."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(rows):
            b = Batch(row["ids"], row["known"], row["sizes"], row["z"])
            b.runs(n_buckets)
            keys = np.unique(b.key)
            tags = keys & (1 << TAG_BITS) - 1
            out = [(bucket, row["batch"], _gaps(tags[i:j])) for bucket, i, j in _by_bucket(keys >> TAG_BITS)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "batch", "tags"])

    return batches.mapInArrow(cut, "bucket int, batch long, tags binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in batches:
        for i in range(len(rows)):
            yield {name: rows.column(name)[i].as_py() for name in rows.schema.names}


def shared_names(posted: DataFrame, n_buckets: int) -> DataFrame:
    """(batch, bucket, bits): which names of a batch, in the order of their tags, another batch has too."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        tags = [_tags(z) for z in rows.tags]
        every = np.concatenate(tags)
        order = np.argsort(every, kind="stable")
        same = np.diff(every[order]) == 0
        two = np.zeros(len(every), bool)
        two[order[1:][same]] = two[order[:-1][same]] = True
        ends = np.cumsum([len(x) for x in tags])
        bits = [two[e - len(x) : e] for x, e in zip(tags, ends, strict=True)]
        some = [x.any() for x in bits]
        return pd.DataFrame({"batch": rows.batch[some], "bucket": rows.bucket[some], "bits": [np.packbits(x).tobytes() for x in bits if x.any()]})

    return posted.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(judge, "batch long, bucket int, bits binary")


def suffix_order(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes from ``at`` on by their first ``LENGTH`` bytes, and which have less in common with the one before."""
    views = np.lib.stride_tricks.sliding_window_view(data, 8)
    order, new = np.arange(len(at)), np.zeros(len(at), bool)
    new[:1] = True
    for o in _OFFSETS:
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # those that tie with others so far
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        value = np.ascontiguousarray(views[at[order[open_]] + o]).view(">u8").ravel().astype(A.U)
        by = np.lexsort((value, group))
        order[open_], value = order[open_[by]], value[by]
        new[open_[1:]] |= value[1:] != value[:-1]
    return order, new


def _smaller_before(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The nearest place before each one that has a smaller value, not beyond a ``first``; else -1."""
    at = np.where(first, -1, np.arange(len(v)) - 1)
    todo = np.flatnonzero((at >= 0) & (v[at] >= v))
    while len(todo):
        at[todo] = at[at[todo]]  # all between have no smaller values
        todo = todo[(at[todo] >= 0) & (v[at[todo]] >= v[todo])]
    return at


def has_earlier(data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each position, over smaller documents, reaches ``LENGTH``."""
    if not len(at):
        return np.zeros(0, bool)
    order, new = suffix_order(data, at)
    own = doc[order]
    before = _smaller_before(own, new)
    after = _smaller_before(own[::-1], np.append(new[1:], True)[::-1])[::-1]
    out = np.zeros(len(at), bool)
    out[order] = (before >= 0) | (after >= 0)
    return out


def _windows(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs' windows one by one: run and position."""
    size = end - begin
    run = np.repeat(np.arange(len(size)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def _ranges(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(document, from, to) covered by windows that are sorted by document and position."""
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(doc) != 0) | (np.diff(at) > LENGTH)
    last = np.append(first[1:], True)[: len(at)]
    return np.stack([doc[first], at[first], at[last] + LENGTH], 1)


def stretches(batches: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    """What batches leave to the pieces, by bucket: (bucket, batch, bytes, info); and without bytes, what they remove themselves."""
    marks = shared.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(rows):
            b = Batch(row["ids"], row["known"], row["sizes"], row["z"])
            b.runs(n_buckets)
            keys = np.unique(b.key)
            two = np.zeros(len(keys), bool)
            where = {bucket: (i, j) for bucket, i, j in _by_bucket(keys >> TAG_BITS)}
            for mark in row["marks"] or ():
                i, j = where[mark["bucket"]]
                two[i:j] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=j - i).astype(bool)
            place = np.searchsorted(keys, b.key)
            # names that several documents of the batch have
            least, most = np.full(len(keys), len(b.ids)), np.full(len(keys), -1)
            np.minimum.at(least, place, b.doc)
            np.maximum.at(most, place, b.doc)
            some = np.flatnonzero(two[place] | (least < most)[place])
            run, at = _windows(b.begin[some], b.end[some])
            run = some[run]
            gone = has_earlier(b.data, at, b.ids[b.doc[run]])
            own = _ranges(b.doc[run[gone]], at[gone])
            whole = np.flatnonzero(b.copies())
            own = np.concatenate([own, np.stack([whole, b.at[whole], b.at[whole + 1]], 1)])
            out = [(row["batch"] % n_buckets, row["batch"], None, _pack(own))] if len(own) else []
            left = ~gone & two[place[run]]
            run, at = run[left], at[left]
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(run) != 0) | (np.diff(at) != 1)
            begin, count = at[first], np.diff(np.append(np.flatnonzero(first), len(at)))
            run = run[first]
            order = np.argsort(b.key[run] >> TAG_BITS, kind="stable")
            run, begin, count = run[order], begin[order], count[order]
            info, raw = np.stack([b.doc[run], b.ids[b.doc[run]], begin, count], 1), b.data.tobytes()
            for bucket, i, j in _by_bucket(b.key[run] >> TAG_BITS):
                text = b"".join([raw[x : x + c + LENGTH - 1] for x, c in zip(begin[i:j].tolist(), count[i:j].tolist(), strict=True)])
                out.append((bucket, row["batch"], _pack(np.frombuffer(text, np.uint8)), _pack(info[i:j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "bytes", "info"])

    return batches.join(marks, "batch", "left").mapInArrow(cut, "bucket int, batch long, bytes binary, info binary")


def repeats(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(batch, gone): ranges of bytes to remove; they may overlap."""

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows[rows.bytes.isna()]
        out = [done[["batch"]].assign(gone=done["info"])]
        if len(done) < len(rows):
            rows = rows[rows.bytes.notna()]
            data = np.concatenate([_unpack(z) for z in rows.bytes])
            infos = [_unpack(z, np.int64).reshape(-1, 4) for z in rows["info"]]
            batch, info = np.repeat(rows.batch.to_numpy(), [len(x) for x in infos]), np.concatenate(infos)
            count = info[:, 3]
            begin = np.concatenate([[0], np.cumsum(count + LENGTH - 1)[:-1]])
            which, at = _windows(begin, begin + count)
            gone = np.flatnonzero(has_earlier(data, at, info[which, 1]))
            which, at = which[gone], at[gone]
            at = at - begin[which] + info[which, 2]
            order = np.lexsort((at, info[which, 0], batch[which]))
            which, at = which[order], at[order]
            found = [(x, _pack(_ranges(info[which[i:j], 0], at[i:j]))) for x, i, j in _by_bucket(batch[which])]
            out.append(pd.DataFrame(found, columns=["batch", "gone"]))
        return pd.concat(out)

    return rows.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(judge, "batch long, gone binary")


def removed(docs: DataFrame, keep: bool) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, and if asked for ``md5`` of the text and ``kept`` bytes."""
    spark, size = docs.sparkSession, text_bytes(docs)
    n_buckets = partitions(spark, size, BUCKET_BYTES)
    batches = staged(packed(docs, partitions(spark, size)), "packed-texts", 1000)
    shared = shared_names(posted_names(batches, n_buckets), n_buckets)
    found = repeats(stretches(batches, shared, n_buckets), n_buckets).groupBy("batch").agg(F.collect_list("gone").alias("gone"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for row in _rows(rows):
            b = Batch(row["ids"], row["known"], row["sizes"], row["z"])
            edge = np.zeros(len(b.data) + 1, np.int32)
            for z in row["gone"] or ():
                own = _unpack(z, np.int64).reshape(-1, 3)
                np.add.at(edge, own[:, 1], 1)
                np.add.at(edge, own[:, 2], -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            begins = b.at[:-1][b.sizes > 0]
            first[begins] = gone[begins]
            n_removed, n_spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[b.at]) for x in (gone, first))
            left, ends = b.data[~gone].tobytes(), np.concatenate([[0], np.cumsum(b.sizes - n_removed)]).tolist()
            kept = [left[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            out = {"doc_id": pd.array(b.ids, "Int64"), "n_bytes": b.sizes, "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            out["doc_id"][~b.known] = pd.NA
            if keep:
                out |= {"md5": [hashlib.md5(b.data[i:j]).hexdigest() for i, j in zip(b.at.tolist(), b.at[1:].tolist(), strict=False)], "kept": kept}
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", md5 string, kept binary" if keep else "")
    return staged(batches.join(found, "batch", "left").mapInArrow(cut, schema), "spans", AT_ONCE)


def dedup_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept``, the bytes that stay, in place of the text, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    results = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    docs = docs.drop(*results)
    did, key, own = fresh(docs, "did", "md5", "own")
    found = removed(docs, True).dropDuplicates(["doc_id", "md5"]).select(F.col("doc_id").alias(did), F.col("md5").alias(key), *results)
    keyed = docs.withColumn(own, F.md5(F.coalesce("text", F.lit("")))).drop("text")
    out = keyed.join(found, keyed["doc_id"].cast("long").eqNullSafe(F.col(did)) & (F.col(own) == F.col(key)))
    return out.drop(did, key, own)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"), False)
