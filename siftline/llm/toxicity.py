"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts by smoothed log-odds, next to a
short fixed one. The features are densities of lexicon words, their nearness to second-person words,
rates of capitals, punctuation, repeated and disguised letters, and length. Features of a training row
use a lexicon learned from the other folds only. Scores are made monotone in the share of toxic labels
by pooling adjacent violators over out-of-fold predictions.

Defined cases: a null or empty text has the features of an empty text and gets a score; rows of
``labels`` whose id or label is null are ignored, repeated labels of an id count as toxic if one is, and of an
id's several texts the smallest is learned from; a column of ``docs`` named as the score is replaced by it;
without labels of both kinds every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, small_batches, table

#: At most so many labelled rows are fitted to: those with the smallest hash of their id.
MAX_TRAINING_ROWS = 6_000
THRESHOLD = 0.3
FOLDS = 4
MAX_LEXICON = 4_000
MIN_LIFT = 8
PREFIXES = (4, 5, 6, 7)  # bytes

# Words that count as abusive before anything is learned, and second-person words.
SEEDS = frozenset(b"idiot moron scum worthless loser stupid trash pathetic disgusting clown imbecile filthy dumb vermin crap bastard hate kill".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus su vosotros".encode().split())
DISGUISES = bytes.maketrans(b"013457@$!", b"oieastasi")

_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACES = b" \t\n\x0b\x0c\r"
#: All but letters becomes a space.
_WORDS = bytes(c if c in _LETTERS else 32 for c in range(256))
_SHOUTED = re.compile(rb"[A-Z]{3,}")
_DISGUISED = re.compile(rb"[0-9@$!*._-]+(?=[a-z\x80-\xff])")
NAMES = ("hits", "hit_rate", "strongest", "top_sum", "distinct_hits", "seed_rate", "near_second", "second_rate", "capital_rate", "shouted_rate", "exclaim_rate", "punct_rate", "disguised_rate", "disguised_hits", "repeat_rate", "log_words")


class Weights:
    """Weights of words by the lexicon; most words are turned away by their first bytes."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon, self.known = lexicon, {}
        self.heads = {term.rstrip(b"~")[: PREFIXES[0]] for term in lexicon} | {w[: PREFIXES[0]] for w in SEEDS | SECOND_PERSON}

    def __getitem__(self, word: bytes) -> float:
        if (weight := self.known.get(word)) is None:
            get = self.lexicon.get
            weight = max(get(word, 0.0), *[get(word[:n] + b"~", 0.0) for n in PREFIXES])
            if len(self.known) < 200_000:
                self.known[word] = weight
        return weight


def features(text: str | None, weight: Weights) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    low = raw.lower() if raw.isascii() else text.lower().encode("utf-8", "replace")
    words = low.translate(_WORDS).split()
    n, chars = max(1, len(words)), max(1, len(raw))
    heads, head = weight.heads, PREFIXES[0]
    special = {w for w in {*words} if w[:head] in heads}
    hit = {w: v for w in special if (v := weight[w]) > 0}
    seeds = SEEDS & special
    second = SECOND_PERSON & special
    hits = near = n_seeds = n_second = 0
    if hit or seeds:
        last_second, pending, counted = -99, [], hit.keys() | seeds
        for i, w in [(i, w) for i, w in enumerate(words) if w in special]:
            if w in second:
                n_second += 1
                last_second = i
                near += sum(i - p <= 5 for p in pending)
                pending = []
            if w in counted:
                hits += 1
                n_seeds += w in seeds
                if i - last_second <= 5:
                    near += 1
                else:
                    pending = [*pending[-8:], i]
    top = sorted(hit.values(), reverse=True)[:5]
    disguised = hidden = done = 0
    for m in _DISGUISED.finditer(low):
        begin = 1 + max(low.rfind(c, max(0, m.start() - 24), m.start()) for c in (b" ", b"\n"))
        if m.start() < done or not begin and m.start() >= 24:
            continue
        done = min((e for c in (b" ", b"\n") if (e := low.find(c, m.end(), m.end() + 24)) >= 0), default=min(len(low), m.end() + 24))
        plain = low[begin:done].translate(DISGUISES, b"*._-,;:?").strip()
        disguised += 1
        hidden += plain in SEEDS or plain[:head] in heads and weight[plain] > 0
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    punct = len(raw.translate(None, _LETTERS + _SPACES))
    return [min(hits, 50), hits / n, top[0] if top else 0.0, sum(top), min(len(hit), 30), n_seeds / n, near / n, n_second / n, capitals / chars, (len(_SHOUTED.findall(raw)) if capitals > 2 else 0) / n, raw.count(b"!") / chars, punct / chars, disguised / n, min(hidden, 9), (raw.count(b"!!") + raw.count(b"??") + raw.count(b"**")) / chars, math.log1p(len(words))]


def terms(text: str | None) -> set[bytes]:
    words = {*(text or "").lower().encode("utf-8", "replace").translate(_WORDS).split()}
    return words.union(*({w[:n] + b"~" for w in words if len(w) >= n} for n in PREFIXES))


def lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """The terms that set toxic texts apart most surely, with their log-odds."""
    found = []
    for term, a in toxic.items():
        b = clean.get(term, 0)
        if a < 3 or a * n_clean < MIN_LIFT * b * n_toxic:
            continue
        odds = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        if odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= 2.5:
            found.append((-odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)), term, min(odds, 8.0)))
    return {term: odds for _, term, odds in sorted(found)[:MAX_LEXICON]}


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32) -> dict:
    """Trees fitted to the gradient of the log-loss, with histograms over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    raw, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)

        def node(rows: np.ndarray, left: int, g=g, h=h) -> tuple:
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-3, -1, 0)
            if left and len(rows) >= 8:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[rows, j]
                    gl, hl = (np.bincount(b, v[rows], len(c) + 1).cumsum()[:-1] for v in (g, h))
                    n = np.bincount(b, minlength=len(c) + 1).cumsum()[:-1]
                    gain = np.where((n >= 3) & (len(rows) - n >= 3), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            _, j, k = best
            if j < 0:
                raw[rows] += rate * gs / (hs + 1)
                return (float(rate * gs / (hs + 1)),)
            go = binned[rows, j] <= k
            return j, float(cuts[j][k]), node(rows[go], left - 1), node(rows[~go], left - 1)

        grown.append(node(np.arange(len(y)), depth))
    return {"base": base, "trees": grown}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])

    def walk(node: tuple, rows: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] += node[0]
        elif len(rows):
            go = x[rows, node[0]] <= node[1]
            walk(node[2], rows[go])
            walk(node[3], rows[~go])

    for tree in model["trees"]:
        walk(tree, np.arange(len(x)))
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators; points to interpolate between: mean margin and share of toxic labels of each block."""
    blocks: list[list[float]] = []
    for r, t in sorted(zip(raw.tolist(), y.tolist(), strict=True)):
        blocks.append([r, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return [r / n for r, _, n in blocks], [(t + 0.02) / (n + 0.04) for _, t, n in blocks]


def fit(rows: list[tuple[str | None, int]]) -> dict:
    """A model from (text, toxic 0/1); in order of the rows, so that the same rows give the same model."""
    y = np.array([t for _, t in rows], float)
    if len(y) < 8 or not 0 < y.sum() < len(y):
        return {"lexicon": {}, "model": None, "share": float(y.mean()) if len(y) else 0.0}
    order = np.random.default_rng(7).permutation(len(y))
    fold = np.empty(len(y), int)
    for label in (0, 1):  # each fold has its share of either label
        own = order[y[order] == label]
        fold[own] = np.arange(len(own)) % FOLDS
    counts = [[Counter(), Counter()] for _ in range(FOLDS)]
    for (text, label), f in zip(rows, fold, strict=True):
        if label:
            counts[f][1].update(terms(text))
    toxic = sum((c[1] for c in counts), Counter())
    frequent = Counter({k: v for k, v in toxic.items() if v >= 3})
    for (text, label), f in zip(rows, fold, strict=True):
        if not label:
            counts[f][0].update(terms(text) & frequent.keys())
    clean = sum((c[0] for c in counts), Counter())
    n = [[int(((fold == f) & (y == t)).sum()) for t in (0, 1)] for f in range(FOLDS)]
    def but(total: Counter, part: Counter, keys: Counter) -> Counter:
        return Counter({k: total[k] - part.get(k, 0) for k in keys if k in total})

    x = np.zeros((len(y), len(NAMES)))
    for f in range(FOLDS):
        weight = Weights(lexicon(but(frequent, counts[f][1], frequent), but(clean, counts[f][0], frequent), sum(a[1] for i, a in enumerate(n) if i != f), sum(a[0] for i, a in enumerate(n) if i != f)))
        for i in np.flatnonzero(fold == f):
            x[i] = features(rows[i][0], weight)
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        raw[fold == f] = margin(boosted(x[fold != f], y[fold != f]), x[fold == f])
    at, share = isotonic(raw, y)
    return {"lexicon": lexicon(frequent, clean, int(y.sum()), int((1 - y).sum())), "model": boosted(x, y), "at": at, "share": share}


def predict(model: dict, texts: Iterator[str | None], memo: Weights) -> np.ndarray:
    x = np.array([features(t, memo) for t in texts], float).reshape(-1, len(NAMES))
    if model["model"] is None:
        return np.full(len(x), model["share"])
    return np.clip(np.interp(margin(model["model"], x), model["at"], model["share"]), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> list[tuple[str | None, int]]:
    """A bounded sample of labelled texts: ids first, so that only the texts of the sample move."""
    by_id = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("t")).where("i is not null and t in (0, 1)")
    chosen = by_id.where(usable).groupBy("i").agg(F.max("t").alias("t")).orderBy(F.xxhash64("i"), "i").limit(MAX_TRAINING_ROWS)
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("x"))
    rows = texts.join(F.broadcast(chosen), "i").groupBy("i", "t").agg(F.min("x").alias("x")).collect()  # MAX_TRAINING_ROWS ids, a text of each
    return [(r.x, r.t) for r in sorted(rows, key=lambda r: r.i)]


def with_score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with a score of each whole ``text``; the other columns stay as they are.

    It is computed when the result is used, so the session keeps the smaller batches."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Weights(model["lexicon"])
        for texts in batches:
            yield pd.Series(predict(model, texts, memo))

    return docs.withColumn(column, score(F.col("text")))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(training_rows(docs, labels, ~held_out("i")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with their own columns only."""
    (score,) = fresh(docs, "score")
    return with_score(docs, train(docs, labels), score).where(F.col(score) < threshold).drop(score)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
