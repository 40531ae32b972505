"""Text as flat arrays: word, shingle and document arithmetic over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 18  # bytes worked on at a time, so that temporary arrays stay in the processor's cache
_VALUES = np.arange(256, dtype=U)
_VALUES[65:91] += U(32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and where each begins; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (ASCII letters lower-cased), and the word ranges of the texts.

    Blocks of eight bytes are scrambled with their number before they are summed, and the sum with the length."""
    n = len(at) - 1
    keep = np.flatnonzero(~_IS_SPACE[data])
    if not len(keep):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    first = np.empty(len(keep), bool)
    first[0] = True
    first[1:] = np.diff(keep) > 1
    bounds = np.searchsorted(keep, at)
    first[bounds[:-1][bounds[:-1] < len(keep)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(keep)))
    place = np.arange(len(keep)) - np.repeat(starts, lengths)
    values = _VALUES[data[keep]] << ((place & 7) << 3).astype(U)
    blocks = np.flatnonzero((place & 7) == 0)
    number = (place[blocks] >> 3).astype(U)
    mixed = mix(np.add.reduceat(values, blocks) + (number + U(1)) * _ODD)
    sums = np.add.reduceat(mixed, np.searchsorted(blocks, starts))
    return mix(sums + lengths.astype(U) * _ODD), np.searchsorted(starts, bounds)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each position on; shorter by ``k - 1`` than ``hashes``."""
    out = hashes[: max(0, len(hashes) - k + 1)].copy()
    for i in range(1, k):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[i : i + len(out)]
    return mix(out)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct ``k``-word shingles, sorted; the whole sequence as one where it has fewer words."""
    every = rolled(hashes, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix(rolled(hashes[a:b], b - a) + U(b - a))
        else:
            yield every[:0]
