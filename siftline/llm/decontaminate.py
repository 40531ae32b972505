"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of 64 words. Their terms are the benchmark's words, weighed by inverse document
frequency over all passages; terms in more than ``STOP_SHARE`` of them are left out. Items of any length are cut
into pieces of a passage's length at most, each of which keeps its eight rarest. A randomised SVD of the
passages' normalised TF-IDF rows (a random range, one power step and a Rayleigh-Ritz step; the products are summed
over all passages on the executors) gives ``RANK`` latent directions. Texts are then searched in windows that
overlap by half, of 64 words for pieces of over 32 words and of 32 for others. Items whose piece has a latent cosine of
at least ``MIN_COSINE`` with a window are its candidates; only these are checked, against the window and its surroundings:

* the longest common subsequence of the item's words with them reaches ``MIN_LCS`` of the item, or
* ``MIN_LCS_ANSWER`` of it and nine tenths of its answer, the last quarter of its words, or
* (paraphrases) ``MIN_LCS_NEAR`` of it and nine tenths of its answer, both within a stretch a quarter longer than the item;
  for answers of at least ``LEAST_ANSWER`` words.

A leak without a candidate isn't found; ``recall`` counts, over all texts, the leaks by the first two rules and those of them
that have one. For that it looks for them by words alone: whoever leaks an item lacks few of its words, so one of any few more has to stand there. The
item's rarest words that many (``Item.anchors``) lead to all passages around them, and those whose surroundings hold
enough of the item's words are aligned.

Defined cases: null and empty texts are clean; an item without words matches nothing; ASCII letter case
and spacing don't count; repeated rows get the same result; without items all texts are clean; a column of
``docs`` that has the name of a result is replaced by it. The benchmark is the query set: its items go to all
tasks, in blocks of ``BLOCK_BYTES`` of text (an item that is longer is a block), each of which goes over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _arrays as A
from ._common import fresh, small_batches, staged, table

STRIDE = 16  # words
SHORT, LONG = 2, 4  # strides of a window; a passage is a long one
RANK = 96
STOP_SHARE = 0.04
MIN_TERMS = 8
MIN_COSINE = 0.4
MIN_LCS = 0.8
MIN_LCS_ANSWER = 0.6
MIN_LCS_NEAR = 0.45
MIN_ANSWER = 0.9
LEAST_ANSWER = 4
BLOCK_BYTES = 4 << 20
CACHED = 256  # passages multiplied at a time
PIECES = 1024  # compared at a time
_FILTER = 1 << 20


class Terms:
    """Benchmark words and their numbers."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.seen = np.zeros(_FILTER, bool)
        self.seen[(hashes & A.U(_FILTER - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that are terms, and the terms."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.seen[(words & A.U(_FILTER - 1)).astype(np.int64)])
        found = np.searchsorted(self.hashes, words[at])
        found[found == len(self.hashes)] = 0
        ok = self.hashes[found] == words[at]
        return at[ok], found[ok]


def _batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple]:
    """Slices of whole texts: batch, first row, word hashes, word ranges."""
    for batch in batches:
        data, at = A.flat(batch.column(column))
        for i, j in A.slices(at):
            hashes, bounds = A.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield batch, i, hashes, bounds


def _strides(bounds: np.ndarray, size: int = STRIDE) -> tuple[np.ndarray, int]:
    """The first stride of each text and the number of strides in all, of ``size`` words; after each text so many empty ones that no window reaches the next."""
    n = -(-np.diff(bounds) // size) + LONG
    first = np.concatenate([[0], np.cumsum(n)])
    return first[:-1], int(first[-1])


def _place(bounds: np.ndarray, at: np.ndarray, size: int = STRIDE) -> tuple[np.ndarray, int]:
    """The stride of each word position."""
    first, total = _strides(bounds, size)
    doc = np.searchsorted(bounds, at, "right") - 1
    return first[doc] + (at - bounds[doc]) // size, total


def term_rows(docs: DataFrame, terms: Terms) -> DataFrame:
    """The terms of all texts as a row for each slice of texts: how many each passage has (``counts``, with empty passages between texts), the terms, and the number of passages with words."""
    kind = _kind(terms)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, bounds in _batches(batches):
            at, found = terms.find(hashes)
            place, total = _place(bounds, at, LONG * STRIDE)
            counts = np.bincount(place, minlength=total).astype(np.uint8)
            n = int((-(-np.diff(bounds) // (LONG * STRIDE))).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([x.tobytes()], pa.binary()) for x in (counts, found.astype(kind)))], ["n", "counts", "term"])

    return docs.select("text").mapInArrow(cut, "n long, counts binary, term binary")


def _kind(terms: Terms) -> np.dtype:
    return np.min_scalar_type(len(terms.hashes))


def _unpacked(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Passage and term of each term that stands in a slice."""
    for c, t in zip(batch.column("counts"), batch.column("term"), strict=True):
        counts = np.frombuffer(c.as_buffer(), np.uint8)
        yield np.repeat(np.arange(len(counts)), counts), np.frombuffer(t.as_buffer(), kind).astype(np.int64)


def frequencies(rows: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many passages each term stands, over all texts, and the number of passages."""
    n, kind = len(terms.hashes), _kind(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n + 1, np.int64)
        for batch in batches:
            df[n] += sum(batch.column("n").to_pylist())
            for place, term in _unpacked(batch, kind):
                df[:n] += np.bincount(np.unique(place * n + term) % n, minlength=n)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "n"])

    out = np.zeros(n + 1, np.int64)
    for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        out[r.term] = r.n
    return out[:n], int(out[n])


def _passages(place: np.ndarray, term: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1 as (passage, term, weight)."""
    n = len(idf)
    key, tf = np.unique(place * n + term, return_counts=True)
    row, col = key // n, key % n
    weight = tf * idf[col]
    start = np.flatnonzero(np.diff(row, prepend=-9))
    norm = np.sqrt(np.add.reduceat(weight**2, start))
    size = np.diff(np.append(start, len(row)))
    return np.repeat(np.arange(len(start)), size), col, weight / np.repeat(norm, size)


def _times(rows: DataFrame, kind: np.dtype, number: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """XᵀX times ``basis``, summed over all passages."""
    n, r = basis.shape
    block = 512

    small = basis.astype(np.float32)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros((n, r)), False
        for batch in batches:
            for place, term in _unpacked(batch, kind):
                term = number[term]
                place, term = place[term >= 0], term[term >= 0]
                if not len(place):
                    continue
                rows_, cols, weights = _passages(place, term, idf)
                weights = weights.astype(np.float32)[:, None]
                cuts = np.searchsorted(rows_, np.arange(0, rows_[-1] + 1, CACHED))
                for a, b in zip(cuts, np.append(cuts[1:], len(rows_)), strict=True):
                    row, col, weight = rows_[a:b] - rows_[a], cols[a:b], weights[a:b]
                    y = np.add.reduceat(small[col] * weight, np.flatnonzero(np.diff(row, prepend=-1)))
                    order = np.argsort(col, kind="stable")
                    col, part = col[order], y[row[order]] * weight[order]
                    start = np.flatnonzero(np.diff(col, prepend=-1))
                    out[col[start]] += np.add.reduceat(part, start)
                some = True
        if some:
            cuts = range(0, n, block)
            yield pa.RecordBatch.from_arrays([pa.array([i // block for i in cuts]), pa.array([out[i : i + block].tobytes() for i in cuts], pa.binary())], ["b", "m"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"b": [parts.b.iloc[0]], "m": [sum(np.frombuffer(m) for m in parts.m).tobytes()]})

    out = np.zeros((n, r))
    few = rows.mapInArrow(multiply, "b long, m binary").groupBy("b").applyInPandas(add, "b long, m binary")
    for x in few.collect():  # terms x rank numbers
        part = np.frombuffer(x.m).reshape(-1, r)
        out[x.b * block : x.b * block + len(part)] = part
    return out


def latent(rows: DataFrame, kind: np.dtype, number: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular directions of the passages, terms x rank."""
    rank = min(rank, len(idf))
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((len(idf), rank)))[0]
    basis = np.linalg.qr(_times(rows, kind, number, idf, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _times(rows, kind, number, idf, basis))
    return basis @ turn[:, np.argsort(-values)]


def lcs(item: list[int], masks: dict[int, int], words: list[int]) -> int:
    """The length of the longest common subsequence, a word of ``words`` at a time over bit rows."""
    full = (1 << len(item)) - 1
    rest = full
    for w in words:
        if (m := masks.get(w)) is not None:
            u = rest & m
            rest = (rest + u | rest - u) & full
    return len(item) - rest.bit_count()


def pieces(words: np.ndarray) -> list[np.ndarray]:
    """The words in parts of about equal length, none longer than a passage."""
    return np.array_split(words, -(-len(words) // (LONG * STRIDE)))


class Item:
    def __init__(self, words: np.ndarray):
        self.words = words.tolist()
        self.answer = self.words[-max(1, len(self.words) // 4) :]
        self.masks, self.answer_masks = {}, {}
        for words_, masks in ((self.words, self.masks), (self.answer, self.answer_masks)):
            for i, w in enumerate(words_):
                masks[w] = masks.get(w, 0) | 1 << i
        n = len(self.words)
        self.sure = next(x for x in range(n + 1) if x / n >= min(MIN_LCS, MIN_LCS_ANSWER))
        self.least = min(self.sure, next(x for x in range(n + 1) if x / n >= MIN_LCS_NEAR)) if len(self.answer) >= LEAST_ANSWER else self.sure

    @property
    def margin(self) -> int:
        """How many words on both sides of a passage are aligned."""
        return max(SHORT * STRIDE, len(self.words))

    def anchors(self, often: list[int]) -> set[int]:
        """Places of words of which every leak has one: rare ones, by how ``often`` each stands in the texts."""
        n, m = len(self.words), len(self.answer)
        lost = n - next(x for x in range(n + 1) if x / n >= MIN_LCS)
        lost_answer = m - next(x for x in range(m + 1) if x >= MIN_ANSWER * m)
        return {*sorted(range(n), key=often.__getitem__)[: lost + 1], *sorted(range(n - m, n), key=often.__getitem__)[: lost_answer + 1]}

    def score(self, words: list[int]) -> tuple[float, bool]:
        share = lcs(self.words, self.masks, words) / len(self.words)
        if share >= MIN_LCS:
            return share, True
        return share, share >= MIN_LCS_ANSWER and lcs(self.answer, self.answer_masks, words) >= MIN_ANSWER * len(self.answer)


    def paraphrased(self, words: list[int]) -> bool:
        """Whether a stretch that is hardly longer than the item has the answer and enough of the rest."""
        n, m = len(self.words), len(self.answer)
        if m < LEAST_ANSWER or lcs(self.answer, self.answer_masks, words) < MIN_ANSWER * m:
            return False
        step = n // 4
        parts = (words[i : i + n + step] for i in range(0, max(1, len(words) - n), step))
        return any(lcs(self.answer, self.answer_masks, x) >= MIN_ANSWER * m and lcs(self.words, self.masks, x) >= MIN_LCS_NEAR * n for x in parts)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes, the group of each member and its place there."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Searcher:
    """All that a task needs to find items in texts."""

    def __init__(self, terms: Terms, number: np.ndarray, idf: np.ndarray, basis: np.ndarray, items: list[tuple[int, np.ndarray]], df: np.ndarray):
        self.terms, self.number = terms, number
        self.weighed = (basis * idf[:, None]).astype(np.float32)
        self.ids = [i for i, _ in items]
        self.items = [Item(w) for _, w in items]
        cut = [(k, piece) for k, (_, w) in enumerate(items) for piece in pieces(w)]
        short = np.array([len(x) <= SHORT * STRIDE for _, x in cut])
        vectors = np.stack([self.weighed[own[own >= 0]].sum(0) for own in (number[terms.find(w)[1]] for _, w in cut)])
        of = np.array([k for k, _ in cut], np.int64)
        self.queries = [(width, of[some], self._unit(vectors[some])) for width, some in ((SHORT, short), (LONG, ~short)) if some.any()]
        every = [terms.find(w)[1] for _, w in items]
        own = [np.unique(w, return_counts=True) for w in every]
        self.n_own = np.array([len(w) for w, _ in own], np.int64)
        self.own, self.times = (np.concatenate(x) for x in zip(*own, strict=True))
        self.margins, self.needs, self.sure_needs = np.array([[x.margin, x.least, x.sure] for x in self.items], np.int64).T
        links = np.unique([(w[i], k) for k, w in enumerate(every) for i in self.items[k].anchors(df[w].tolist())], axis=0)
        self.anchored, self.n_anchored = links[:, 1], np.bincount(links[:, 0], minlength=len(df))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _enough(self, keys: np.ndarray, n: int, items: np.ndarray, lo: np.ndarray, hi: np.ndarray, needs: np.ndarray) -> np.ndarray:
        """Whether the words from ``lo`` to ``hi`` can hold as many of the item's words as a leak needs: a word that stands there counts as often as the item has it."""
        out = np.zeros(len(items), bool)
        begin = np.cumsum(self.n_own) - self.n_own
        for i in range(0, len(items), 4096):
            k = items[i : i + 4096]
            group, place = _spread(self.n_own[k])
            own = begin[k][group] + place
            base = self.own[own] * n
            held = keys[np.searchsorted(keys, base + lo[i : i + 4096][group])] < base + hi[i : i + 4096][group]
            out[i : i + 4096] = np.bincount(group, held * self.times[own], len(k)) >= needs[k]
        return out

    def _around(self, begins: np.ndarray, ends: np.ndarray, items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of the windows from ``begins`` to ``ends`` with their surroundings, as far as an item's leak reaches."""
        first, _ = _strides(bounds)
        doc = np.searchsorted(first, begins, "right") - 1
        lo, hi = (bounds[doc] + (x - first[doc]) * STRIDE for x in (begins, ends))
        return np.maximum(lo - self.margins[items], bounds[doc]), np.minimum(hi + LONG * STRIDE + self.margins[items], bounds[doc + 1])

    def _checked(self, begins: np.ndarray, ends: np.ndarray, items: np.ndarray, at: np.ndarray, found: np.ndarray, bounds: np.ndarray, needs: np.ndarray) -> np.ndarray:
        """(window, item) of the windows from ``begins`` to ``ends`` that have enough of the item's words around them."""
        n = int(bounds[-1]) + 1
        order = np.argsort(found, kind="stable")
        keys = np.append(found[order] * n + at[order], np.iinfo(np.int64).max)
        ok = self._enough(keys, n, items, *self._around(begins, ends, items, bounds), needs)
        begins, ends, items = begins[ok], ends[ok], items[ok]
        group, nth = _spread(ends - begins + 1)
        pairs = np.unique((begins[group] + nth) * len(self.items) + items[group])
        window, items = np.divmod(pairs, len(self.items))
        ok = self._enough(keys, n, items, *self._around(window, window, items, bounds), needs)
        return np.stack([window[ok], items[ok]], 1)

    def sure(self, at: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(window, item) of all long windows that overlap by half and can be leaks by their words, without the latent space."""
        first, total = _strides(bounds)
        last = np.append(first[1:], total) - LONG - 1  # the last stride with words
        some = np.flatnonzero(self.n_anchored[found])
        place, _ = _place(bounds, at[some])
        group, nth = _spread(self.n_anchored[found[some]])
        begin = np.cumsum(self.n_anchored) - self.n_anchored
        pairs = np.unique(place[group] * len(self.items) + self.anchored[begin[found[some]][group] + nth])
        place, items = np.divmod(pairs, len(self.items))
        doc = np.searchsorted(first, place, "right") - 1
        reach = -(-self.margins[items] // STRIDE)
        begins, ends = np.maximum(place - LONG + 1 - reach, first[doc]), np.minimum(place + reach, last[doc])  # windows whose surroundings may hold the anchor
        pairs = self._checked(begins, ends, items, at, found, bounds, self.sure_needs)
        return pairs[(pairs[:, 0] - first[np.searchsorted(first, pairs[:, 0], "right") - 1]) % SHORT == 0]

    def candidates(self, at: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items that meet in the latent space."""
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        own = self.number[found]
        at, own = at[own >= 0], own[own >= 0]
        if len(at):
            place, total = _place(bounds, at)
            start = np.flatnonzero(np.diff(place, prepend=-1))
            strides = np.zeros((total + LONG, self.weighed.shape[1]), np.float32)
            strides[place[start]] = np.add.reduceat(self.weighed[own], start)
            first, _ = _strides(bounds)
            for width, of, queries in self.queries:
                step = width // 2
                doc, nth = _spread(-(-np.diff(bounds) // (STRIDE * step)))
                begins = first[doc] + nth * step
                vectors = strides[begins]
                for i in range(1, width):
                    vectors += strides[begins + i]
                least = MIN_COSINE * np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), np.float32(1e-6))[:, None]
                for i in range(0, len(of), PIECES):
                    near, piece = np.nonzero(vectors @ queries[i : i + PIECES].T >= least)
                    windows.append(begins[near])
                    items.append(of[i + piece])
        pairs = np.unique(np.concatenate(windows) * len(self.items) + np.concatenate(items))
        return np.divmod(pairs, len(self.items))

    def near(self, at: np.ndarray, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(window, item) of the candidates that can be leaks."""
        windows, items = self.candidates(at, found, bounds)
        order = np.lexsort((windows, items))
        windows, items = windows[order], items[order]
        new = np.ones(len(windows), bool)
        new[1:] = (np.diff(items) != 0) | (np.diff(windows) > LONG)  # windows in a row are first judged together
        last = np.append(new[1:], True)[: len(new)]
        return self._checked(windows[new], windows[last], items[new], at, found, bounds, self.needs)

    def find(self, hashes: np.ndarray, bounds: np.ndarray, by_words: bool = False) -> dict[int, dict[int, tuple[float, bool]]]:
        """By text, by item: the share of the item found and whether it counts as a leak; ``by_words`` the leaks that can be told without the latent space."""
        at, found = self.terms.find(hashes)
        out: dict[int, dict[int, tuple[float, bool]]] = {}
        if not len(at) or not len(self.items):
            return out
        pairs = (self.sure if by_words else self.near)(at, found, bounds)
        first, _ = _strides(bounds)
        docs = np.searchsorted(first, pairs[:, 0], "right") - 1
        lo, hi = self._around(pairs[:, 0], pairs[:, 0], pairs[:, 1], bounds)
        for doc, k, a, b in zip(docs.tolist(), pairs[:, 1].tolist(), lo.tolist(), hi.tolist(), strict=True):
            best = out.setdefault(doc, {})
            before, leak = best.get(k, (0.0, False))
            if not leak or before < 1:
                words = hashes[a:b].tolist()
                share, now = self.items[k].score(words)
                best[k] = max(before, share), leak or now or (not by_words and share >= MIN_LCS_NEAR and self.items[k].paraphrased(words))
        return out


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items by blocks of about ``BLOCK_BYTES`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def searcher(docs: DataFrame, benchmark: DataFrame) -> Searcher | None:
    rows = benchmark.collect()  # a block of items
    rows.sort(key=lambda r: (r.item_id, r.text))
    hashes, at = A.words(*A.flat(pa.array([r.text for r in rows], pa.string())))
    items = [(r.item_id, hashes[a:b]) for r, a, b in zip(rows, at[:-1], at[1:], strict=True) if b > a]
    if not items:
        return None
    terms = Terms(np.unique(hashes))
    passages = staged(term_rows(docs, terms), "passage-terms")
    df, total = frequencies(passages, terms)
    keep = df <= max(1, STOP_SHARE * total)
    for _, words in items:
        for piece in pieces(words):
            own = np.unique(terms.find(piece)[1])
            keep[own[np.argsort(df[own], kind="stable")[:MIN_TERMS]]] = True
    number = np.where(keep, np.cumsum(keep) - 1, -1)
    idf = np.log((1 + total) / (1 + df[keep])) + 1e-6
    basis = latent(passages, _kind(terms), number, idf)
    return Searcher(terms, number, idf, basis, items, df)


def _found(docs: DataFrame, search: Searcher | None, names: list[str]) -> DataFrame:
    """``docs`` with struct columns filled from the search; the text is read as Arrow, the rest stays in place.

    It is computed when the result is used, so the session keeps the smaller batches."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("items array<long>, best double")
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            items: list[list[int]] = [[] for _ in range(len(batch))]
            best = np.zeros(len(batch))
            data, at = A.flat(pa.array(batch, pa.string()))
            for i, j in A.slices(at) if search else ():
                for doc, hits in search.find(*A.words(data[at[i] : at[j]], at[i : j + 1] - at[i])).items():
                    items[i + doc] = sorted({search.ids[k] for k, (_, leak) in hits.items() if leak})
                    best[i + doc] = max(share for share, _ in hits.values())
            yield pd.DataFrame({"items": items, "best": best})

    (hit,) = fresh(docs, "hit")
    out = docs.withColumn(hit, look(F.col("text")))
    return out.select(*docs.columns, F.col(hit)["items"].alias(names[0]), F.col(hit)["best"].alias(names[1]))


def _leaks(docs: DataFrame, benchmark: DataFrame, names: list[str]) -> DataFrame:
    parts = blocks(benchmark)
    out = _found(docs, searcher(docs, parts[0]), names)
    for part in parts[1:]:
        more = fresh(out, "more_items", "more_share")
        out = _found(staged(out, "leaks"), searcher(docs, part), more)
        items, best = F.array_sort(F.array_union(names[0], more[0])), F.greatest(names[1], more[1])
        out = out.withColumns({names[0]: items, names[1]: best}).drop(*more)
    return out


def recall(docs: DataFrame, benchmark: DataFrame) -> tuple[int, int]:
    """The leaks by words over all texts, and how many of them the latent search finds."""
    small_batches(docs.sparkSession)
    of_all = found = 0
    for part in blocks(benchmark):
        if (search := searcher(docs, part)) is None:
            continue

        def count(batches: Iterator[pa.RecordBatch], search: Searcher = search) -> Iterator[pa.RecordBatch]:
            n = np.zeros(2, np.int64)
            for _, _, hashes, bounds in _batches(batches):
                told, got = ({(d, k) for d, hits in search.find(hashes, bounds, w).items() for k, (_, leak) in hits.items() if leak} for w in (True, False))
                n += len(told), len(told & got)
            yield pa.RecordBatch.from_arrays([pa.array(n[:1]), pa.array(n[1:])], ["of_all", "found"])

        row = docs.select("text").mapInArrow(count, "of_all long, found long").agg(F.sum("of_all"), F.sum("found")).first()
        of_all, found = of_all + (row[0] or 0), found + (row[1] or 0)
    return of_all, found


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the ids of the items that each text leaks and the largest share of an item found."""
    names = ["leaked_items", "best_share"]
    return _leaks(docs.drop(*names), benchmark, names)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    items, best = fresh(docs, "leaked_items", "best_share")
    found = _leaks(docs, benchmark, [items, best])
    return found.where(F.size(items) == 0).drop(items, best)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("leaked_items") > 0).cast("int").alias("contaminated"), "leaked_items", F.round("best_share", 6).alias("best_share"))
