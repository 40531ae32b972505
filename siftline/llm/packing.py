"""Best-fit packing of token sequences, online with bounded space.

A document is its text's ids and the end mark. One that is longer than a sequence is cut into whole sequences and a
first piece with what is over. Each task packs its documents batch by batch, a batch's longest pieces first: at most ``OPEN_BINS`` bins are open, a
bitset has a bit for each amount of free space that some of them have, and a piece goes to the bin of the least
free space that holds it. Where none does, a bin is opened, and if too many are open the fullest one closes first.
A piece is placed as it comes, so a task holds the open bins' sizes and no pieces.

Bins that are open when a task ends are packed again as pieces of their own, those of ``FAN_IN`` tasks by one task
with the same rule, then those of ``FAN_IN`` such tasks, until one is left. So each task leaves few sequences that
aren't full, and what a task packs stays a fixed number of bins.

Ids are those of the tokenizer file's byte-level BPE; strings of its special tokens stand for these, as in the
library's own encoding. The file's merges are run by the tiktoken library, which gives the same ids about seven
times as fast (tests compare them). A text is encoded in stretches cut at single spaces between other characters,
where no token spans the cut.

Defined cases: null and empty texts are the end mark alone; rows without an id and repeated rows are documents
each; clashing columns aren't read; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import staged, table

CAPACITY = 1024
END = 2
OPEN_BINS = 512
FAN_IN = 16
STRETCH = 1 << 18  # characters encoded at a time
LONG = 2000
TASK, LEVEL = 32, 58  # a bin's number has its level of packing, its task and its place there from these bits on
# Fixed value: how the tokenizer cuts text before merging; quantifiers are possessive where that changes nothing.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_CUT = re.compile(r"[^\s\u180e] (?=[^\s\u180e])")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(2)
def encoding(path: str):
    """The tokenizer of a byte-level BPE file in which ids follow the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    byte = _bytes_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """``text`` in order; cut before a single space between other characters, the first one after ``most``."""
    at = 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most - 1)):
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _long_runs(text: str) -> bool:
    """Whether there may be a word or blank of over ``LONG`` bytes, for which fast merging takes the square of its length."""
    blank = np.frombuffer(text.encode(), np.uint8) <= 32
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    return len(blank) > LONG and int(np.diff(turns, prepend=-1, append=len(blank) - 1).max()) > LONG


def ids(path: str, text: str | None) -> np.ndarray:
    """A document's ids with the end mark, as little-endian 32-bit numbers."""
    out = []
    for part in stretches(text or ""):
        if _long_runs(part):
            out.append(np.array(_library(path).encode(part, add_special_tokens=False).ids, "<u4"))
        else:
            out.append(encoding(path).encode_to_numpy(part, allowed_special="all", disallowed_special=()))
    return np.concatenate([*out, np.array([END])]).astype("<u4")


class Bins:
    """Open bins by free space: ``put`` gives the bin and the place in it of a piece."""

    def __init__(self, first: int, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.next, self.capacity, self.most = first, capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.n = 0

    def _take(self, free: int) -> int:
        bin_ = self.free[free].pop()
        if not self.free[free]:
            self.bits ^= 1 << free
        self.n -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.next
            self.next += 1
        left = free - size
        if left:
            if self.n == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest one closes
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.n += 1
        return bin_, self.capacity - free

    def open(self) -> list[int]:
        return [b for bins in self.free for b in bins]


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``tokenizer`` is the path of its file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId() << TASK, capacity, open_bins)
        for rows in batches:
            out, docs_ = [], []
            for i, text in enumerate(rows.column("text")):
                tokens = ids(tokenizer, text.as_py())
                head = len(tokens) % capacity or capacity
                for piece, start in enumerate([0, *range(head, len(tokens), capacity)]):
                    part = tokens[start : start + (capacity if piece else head)]
                    out.append((piece, start, len(part), zlib.crc32(part)))
                    docs_.append(i)
            numbers = np.zeros((6, len(out)), np.int64)
            numbers[:4] = np.array(out, np.int64).reshape(-1, 4).T
            for i in np.argsort(-numbers[2], kind="stable").tolist():
                numbers[4:, i] = bins.put(int(numbers[2, i]))
            yield table_of(rows.column("doc_id").take(pa.array(docs_, pa.int64())), numbers, False)
        left = np.array(bins.open(), np.int64)
        zero = np.zeros_like(left)
        yield table_of(pa.nulls(len(left), doc_type), np.stack([zero, zero, zero, zero, left, zero]), True)

    def table_of(doc_ids: pa.Array, numbers: np.ndarray, still_open: bool) -> pa.RecordBatch:
        piece, *longs = (pa.array(x) for x in numbers)
        return pa.RecordBatch.from_arrays([doc_ids, piece.cast(pa.int32()), *longs, pa.array([still_open] * len(piece), pa.bool_())], names=names)

    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "still_open"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, place long, still_open boolean"
    rows = staged(docs.select("doc_id", "text").mapInArrow(pack, schema), "pack-pieces")
    pieces, task = rows.where("not still_open").drop("still_open"), F.expr(f"bin >> {TASK} & {(1 << LEVEL - TASK) - 1}")
    used = pieces.groupBy("bin").agg(F.sum("length").alias("used"))
    now = staged(rows.where("still_open").select("bin").join(used, "bin"), "pack-open")
    # where each bin that a task left open has come to stand
    moved = now.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"))

    def again(level: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            bins = Bins(level << LEVEL | int(key[0]) << TASK, capacity, open_bins)
            rows = rows.sort_values(["used", "bin"], ascending=False)
            put = [bins.put(int(n)) for n in rows.used]
            still = set(bins.open())
            return pd.DataFrame({"bin": rows.bin, "used": rows.used, "into": [b for b, _ in put], "by": [p for _, p in put], "still_open": [b in still for b, _ in put]})

        return run

    level, last = 0, now.select(F.max(task)).first()[0] or 0
    while last:  # the highest number of a task whose open bins are left
        level, last = level + 1, last // FAN_IN
        groups = now.select("bin", "used", F.floor(task / FAN_IN).alias("group")).groupBy("group")
        step = staged(groups.applyInPandas(again(level), "bin long, used long, into long, by long, still_open boolean"), "pack-again")
        later = step.select(F.col("bin").alias("into"), F.col("into").alias("to"), "by")
        moved = moved.join(later, "into", "left").select("bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        moved = staged(moved, "pack-moved")
        now = step.where("still_open").groupBy(F.col("into").alias("bin")).agg(F.sum("used").alias("used"))
    out = pieces.join(moved, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
