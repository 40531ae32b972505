"""Line deduplication by pairwise alignment.

What an aligned run can take away holds a shared block: the fewest lines in a row around a line that have
``MIN_BLOCK_CHARS`` characters together. A block's first holder, the text of the smallest id, stands for all
others, as it keeps the block. Rare blocks, those of up to ``RARE`` texts, choose whom a text is aligned with:
the first holder of each of them. Lines that this leaves although an earlier text holds a block around them have
common blocks only; those link their text to their first holders. So there are at most as many links as blocks.

Linked texts are aligned with patience diff over line hashes: lines that occur once in both, in the longest
increasing order, then the runs around them; where no line is unique, equal lines are told apart by their number.
An aligned run of lines with at least ``MIN_BLOCK_CHARS`` characters goes from the later text, with all copies of its
blocks there, and what is left of the blocks that both texts hold is aligned again, until there is none: a block in
another place is found in a later pass. Texts that equal an earlier one as a whole are settled before any alignment. Rows of a block, a
first holder or a text that very many share are dealt to several tasks in every join.

Defined cases: texts are compared with texts of smaller ids only, on the input as it is, so the first copy
of a line always stays; rows without an id, null and empty texts stay as they are; rows of one id are
judged each by itself, repeated rows alike; blank lines go only inside an aligned run; columns named like the two
counts are replaced by them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, hot, spread, staged, table

MIN_BLOCK_CHARS = 16
RARE = 64  # texts that hold a block
_BASE, _PRIME = 0x9E3779B97F4A7C15 % ((1 << 61) - 1), (1 << 61) - 1


def matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal lines in patience order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {x: p for p, x in enumerate(a[i:j], i) if in_a[x] == 1}
        pairs = [(where[x], q) for q, x in enumerate(b[k:m], k) if in_b[x] == 1 and x in where]
        if not pairs:  # equal lines by their number
            where = {x: p for p, x in zip(range(i, j), numbered(a[i:j]), strict=True)}
            pairs = [(where[x], q) for q, x in zip(range(k, m), numbered(b[k:m]), strict=True) if x in where]
        if not pairs:
            continue
        ends: list[int] = []
        tops: list[int] = []
        back: list[int] = []
        for n, (p, _) in enumerate(pairs):
            at = bisect_left(ends, p)
            back.append(tops[at - 1] if at else -1)
            if at == len(ends):
                ends.append(p)
                tops.append(n)
            else:
                ends[at], tops[at] = p, n
        n, chain = tops[-1], []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        i0, k0 = i, k
        for p, q in [*chain[::-1], (j, m)]:
            if i0 < p and k0 < q:
                todo.append((i0, p, k0, q))
            if p < j and q < m:
                out.append((p, q))
            i0, k0 = p + 1, q + 1
    return sorted(out)


def numbered(lines: list[int]) -> Iterator[tuple[int, int]]:
    """Each line with the number of equal ones before it."""
    seen: Counter = Counter()
    for x in lines:
        yield x, seen[x]
        seen[x] += 1


def runs(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """The aligned runs, as ranges of lines of ``b``."""
    first, last = 0, (-2, -2)
    for p, q in [*matched(a, b), (-9, -9)]:
        if (p, q) != (last[0] + 1, last[1] + 1):
            if last[1] >= 0:
                yield first, last[1] + 1
            first = q
        last = (p, q)


def repeated(a: list[int], a_sizes: list[int], b: list[int], sizes: list[int], least: int) -> list[int]:
    """The lines of ``b`` that alignment with ``a`` takes: runs of at least ``least`` characters and their copies in ``b``."""
    own = blocks(b, sizes, least)
    shared = [own[h] for h in blocks(a, a_sizes, least) if h in own]
    gone: set[int] = set()
    todo = [(0, len(b))]
    while todo:
        took: set[int] = set()
        for i, j in todo:
            for k, m in runs(a, b[i:j]):
                if sum(sizes[i + k : i + m]) >= least:
                    took.update(range(i + k, i + m))
                    for h in blocks(b[i + k : i + m], sizes[i + k : i + m], least):
                        took.update(own[h])
        gone |= took
        left = sorted({q for qs in shared for q in qs} - gone)
        if not took:  # short lines between them are in the way: each block is aligned by itself
            gone.update(left)
            break
        edges = [n for n, q in enumerate(left) if n == 0 or left[n - 1] != q - 1]
        todo = [(left[n], left[m - 1] + 1) for n, m in zip(edges, [*edges[1:], len(left)], strict=False)]
    return sorted(gone)


def blocks(hashes: list[int], sizes: list[int], least: int) -> dict[int, list[int]]:
    """By hash, the smallest blocks of at least ``least`` characters around each line, with these lines."""
    n = len(hashes)
    sums, heads, powers = [0], [0], [1]
    for h, size in zip(hashes, sizes, strict=True):
        sums.append(sums[-1] + size)
        heads.append((heads[-1] * _BASE + h) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    full = [p for p in range(n) if sizes[p]]
    out: dict[int, list[int]] = {}
    for q in range(n):
        i, before, end = q, bisect_left(full, q) - 1, n
        while True:
            j = max(q, bisect_left(sums, sums[i] + least) - 1)
            if j < end:
                out.setdefault((heads[j + 1] - heads[i] * powers[j + 1 - i]) % _PRIME, []).append(q)
                end = j
            if j == q or before < 0:
                break
            i, before = full[before], before - 1
    return out


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _times(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def removals(docs: DataFrame, least: int = MIN_BLOCK_CHARS) -> DataFrame:
    """For each text (``th``) that loses lines or has copies: ``rep``, its smallest id, the number of ``copies``, and by line whether it is ``gone``."""
    base = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null and text != ''")
    hashed = base.select("rep", F.md5("text").alias("th"), F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"), F.transform(_lines(F.col("text")), lambda x: F.length(F.trim(x))).alias("sz"))
    reps = staged(hashed.groupBy("th").agg(F.min("rep").alias("rep"), F.count("*").alias("copies"), F.first("hs").alias("hs"), F.first("sz").alias("sz")), "line-texts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(h, rep, th, qs) for rep, th, hs, sz in zip(rows.rep, rows.th, rows.hs, rows.sz, strict=True) for h, qs in blocks(hs.tolist(), sz.tolist(), least).items()]
            yield pd.DataFrame(found, columns=["h", "rep", "th", "qs"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            gone = [repeated(*(x.tolist() for x in r), least) for r in zip(rows.fhs, rows.fsz, rows.hs, rows.sz, strict=True)]
            out = pd.DataFrame({"th": rows.th, "g": gone})
            yield out[out.g.str.len() > 0]

    def flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"th": rows.th, "gone": [np.isin(np.arange(max(g) + 1), g) for g in rows.gone]})

    def aligned(links: DataFrame) -> DataFrame:
        side = reps.select(F.col("th").alias("fth"), F.col("hs").alias("fhs"), F.col("sz").alias("fsz"))
        pairs = spread(links.join(reps.select("th", "hs", "sz"), "th"), side, "fth", ["th"], hot(_times(links, "fth"), "fth", links.count()))
        return staged(pairs.select("th", "fhs", "fsz", "hs", "sz").mapInPandas(align, "th string, g array<int>"), "line-runs")

    def together(found: DataFrame) -> DataFrame:
        return found.select("th", F.explode("g").alias("g")).distinct().groupBy("th").agg(F.collect_list("g").alias("gone"))

    held = reps.select("rep", "th", "hs", "sz").mapInPandas(cut, "h long, rep long, th string, qs array<int>")
    first = held.groupBy("h").agg(F.min(F.struct("rep", "th")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = staged(first.select("h", "n", F.col("f.rep").alias("frep"), F.col("f.th").alias("fth")), "line-firsts")
    salted = hot(first, "h", first.agg(F.sum("n")).first()[0] or 0)
    shared = staged(spread(held, first, "h", ["th"], salted).where("frep < rep"), "line-blocks")
    links = staged(shared.where(F.col("n") <= RARE).select("th", "fth").distinct(), "line-links")
    found = aligned(links)
    left = shared.where(F.col("n") > RARE).join(together(found), "th", "left").where("gone is null or size(array_except(qs, gone)) > 0")
    more = staged(left.select("th", "fth").distinct().join(links, ["th", "fth"], "left_anti"), "line-links")
    gone = together(found.union(aligned(more))).mapInPandas(flagged, "th string, gone array<boolean>")
    return staged(reps.select("th", "rep", "copies").join(gone, "th", "left").where("copies > 1 or gone is not null"), "line-removals")


def dedup_lines(docs: DataFrame, least: int = MIN_BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and the counts ``n_lines`` and ``n_removed`` (in place of columns of these names)."""
    docs = docs.drop("n_lines", "n_removed")
    th, rep, gone, later, kept = fresh(docs, "th", "rep", "gone", "later", "kept")
    found = removals(docs, least)
    salted = hot(found.select(F.col("th").alias(th), F.col("copies").alias("n")), th, found.agg(F.sum("copies")).first()[0] or 0)
    found = found.select(F.col("th").alias(th), F.col("rep").alias(rep), F.col("gone").alias(gone))
    judged = F.coalesce((F.col("text") != "") & F.col("doc_id").isNotNull(), F.lit(False))
    other = F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string"))  # met by nothing, and by different tasks
    out = spread(docs.withColumn(th, F.when(judged, F.md5("text")).otherwise(other)), found, th, ["doc_id", "text"], salted, "left")
    n = F.when(F.col("text") != "", F.size(_lines(F.col("text")))).otherwise(0)
    out = out.withColumn(later, F.coalesce(F.col("doc_id").cast("long") > F.col(rep), F.lit(False)))
    left = F.filter(_lines(F.col("text")), lambda _, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False)))
    out = out.withColumn(kept, F.when(F.col(later), F.lit("")).when(F.col(gone).isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")))
    removed = F.coalesce(F.size(F.filter(F.col(gone), lambda g: g)), F.lit(0))
    removed = F.when(F.col(later), n).when(F.col(gone).isNull(), 0).otherwise(removed)
    columns = [F.col(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
