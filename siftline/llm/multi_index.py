"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut in halves and each half is quantised by its own k-means centroids, fitted to a bounded
sample (``SAMPLE`` rows, those with the smallest hash); every vector is entered in the cell of its centroid
pair. A query walks centroid pairs by summed distance with a heap until the cells hold ``candidates``
vectors; those are ranked again by their cosine in double precision on the vectors as they came. How many
that takes depends on the data: within the sample, the share of vectors that a walk must pass before it has
the cells of ``RECALL`` of the true neighbours is measured by brute force, and used for all queries.

In a task the entries of its cells meet a block of queries in one matrix product, masked by the cells that each
query walks; all within rounding of the last place are scored again, so ties go by id however many there are.

Equal vectors share one entry that keeps the smallest ids (one more than asked for, so a query can pass
over itself), found under salted keys first. A cell's entries are dealt over parts of at most ``PART``, so no
cell meets in one task, and a task's result is a query's best few.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
those of another length than most have (the longer, if even); rows without an id take no part; rows of one
id and different vectors are entries each; fewer candidates give fewer rows; equal scores go by id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import staged, table

SAMPLE = 20_000
PART = 4096
SALTS = 16
PER_CELL = 48
BLOCK = 128  # queries ranked at a time
ROUNDING = 1e-9  # far over the error of a dot product of unit vectors
MAX_PARTS = 1 << 32
MAX_CENTROIDS = 1024
MIN_CANDIDATES = 512
RECALL = 0.96
PROBES = 200


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & fine)
    most = out.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return out.where(F.size("embedding") == (most.d if most else 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = x[rng.permutation(len(x))]
    centroids = np.unique(x, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:k]]
    for _ in range(rounds):
        own = nearest(x, centroids)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.stack([np.bincount(own, x[:, j], len(centroids)) for j in range(x.shape[1])], 1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 8192], centroids).argmin(1) for i in range(0, max(len(x), 1), 8192)])


class Index:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.counts: dict[int, int] = {}
        self.share = 1.0

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        x = _unit(vectors)
        return x[:, :h], x[:, h:]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = self.halves(vectors)
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def walk(self, da: np.ndarray, db: np.ndarray, candidates: int) -> list[int]:
        """Cells by summed distance, until they hold so many entries."""
        ia, ib = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        heap, out, total = [(da[ia[0]] + db[ib[0]], 0, 0)], [], 0
        while heap and total < candidates:
            _, i, j = heapq.heappop(heap)
            cell = int(ia[i] * len(db) + ib[j])
            if n := self.counts.get(cell):
                out.append(cell)
                total += n
            if i + 1 < len(ia) and j == 0:
                heapq.heappush(heap, (da[ia[i + 1]] + db[ib[0]], i + 1, 0))
            if j + 1 < len(ib):
                heapq.heappush(heap, (da[ia[i]] + db[ib[j + 1]], i, j + 1))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def fit(entries: DataFrame, n: int) -> Index:
    rows = entries.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toPandas()
    x = _unit(_matrix(rows.embedding))
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 1, MAX_CENTROIDS))
    h = (x.shape[1] + 1) // 2
    rest = x[:, h:] if x.shape[1] > 1 else np.zeros((len(x), 0))
    index = Index(kmeans(x[:, :h], k), kmeans(rest, k) if rest.shape[1] else np.zeros((1, 0)))
    index.share = needed(index, x)
    return index


def needed(index: Index, x: np.ndarray, top: int = 5) -> float:
    """The share of the sample that walks pass before they hold ``RECALL`` of its probes' true neighbours."""
    if len(x) <= top + 1:
        return 1.0
    cells = index.cells(x)
    count = np.bincount(cells, minlength=len(index.first) * len(index.second))
    passed = []
    step = max(1, min(50, (1 << 22) // len(count)))
    for lo in range(0, min(PROBES, len(x)), step):
        probes = np.arange(lo, min(lo + step, PROBES, len(x)))
        near = x[probes] @ x.T
        near[np.arange(len(probes)), probes] = -2
        a, b = index.halves(x[probes])
        far = (distances(a, index.first)[:, :, None] + distances(b, index.second)[:, None, :]).reshape(len(probes), -1)
        for i, d in enumerate(far):
            order = np.argsort(d, kind="stable")
            upto = np.empty(len(order))
            upto[order] = np.cumsum(count[order])
            passed += upto[cells[np.argpartition(-near[i], top)[:top]]].tolist()
    return float(np.quantile(passed, RECALL)) / len(x)


def neighbours(vectors: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` nearest of ``vectors`` to each of ``queries`` (rows of the same table), found by the index."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    vectors = staged(usable(vectors), "vectors")
    salted = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    few = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= top + 1)
    entries = few.groupBy("embedding").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, top + 1).alias("ids"))
    entries = staged(entries.withColumn("cid", F.col("ids")[0]), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    index = fit(entries, n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(cell=index.cells(_matrix(rows.embedding)))

    kind = dict(entries.dtypes)["embedding"]
    entries = staged(entries.mapInPandas(assign, f"embedding {kind}, ids array<long>, cid long, cell long"), "cells")
    index.counts = {r.cell: r.n for r in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CENTROIDS squared
    candidates = max(MIN_CANDIDATES, int(index.share * n))
    asked = staged(queries.select(F.col("vec_id").cast("long").alias("query_id")).distinct().join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id"), "queries")
    distinct = asked.groupBy("embedding").agg(F.min("query_id").alias("qid"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART)

    def parts(cell: int) -> int:
        return -(-index.counts[cell] // PART)

    def group(cell: int, part: int) -> int:
        return (cell * 1_000_003 + part) % groups

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                some = rows.iloc[at : at + 256]
                a, b = index.halves(_matrix(some.embedding))
                da, db = distances(a, index.first), distances(b, index.second)
                out = []
                for i, (q, v) in enumerate(zip(some.qid, some.embedding, strict=True)):
                    by: dict[int, list[int]] = {}
                    for c in index.walk(da[i], db[i], candidates):
                        for p in range(parts(c)):
                            by.setdefault(group(c, p), []).append(c * MAX_PARTS + p)
                    out += [(g, q, v, keys) for g, keys in by.items()]
                yield pd.DataFrame(out, columns=["g", "qid", "embedding", "keys"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            at = [(cell, c % parts(cell)) for c, cell in zip(rows.cid, rows.cell, strict=True)]
            yield rows.assign(key=[c * MAX_PARTS + p for c, p in at], g=[group(c, p) for c, p in at])[["g", "embedding", "ids", "key"]]

    asks = distinct.mapInPandas(route, f"g long, qid long, embedding {kind}, keys array<long>")
    held = entries.mapInPandas(deal, f"g long, embedding {kind}, ids array<long>, key long")

    def rank(entry: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entry) and len(ask):
            keys, place = np.unique(entry["key"].to_numpy(), return_inverse=True)
            v, q, cids = _matrix(entry.embedding), _matrix(ask.embedding), entry.ids.str[0].to_numpy(np.int64)
            unit_v, unit_q, m = _unit(v), _unit(q), min(len(v), top + 1)
            for lo in range(0, len(q), BLOCK):
                some = ask["keys"].iloc[lo : lo + BLOCK]
                asked_by = np.repeat(np.arange(len(some)), some.str.len().to_numpy(np.int64))
                wanted = np.concatenate(some.to_list())
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                walked = np.zeros((len(some), len(keys)), bool)
                walked[asked_by, at] = keys[at] == wanted
                near = np.where(walked[:, place], unit_q[lo : lo + BLOCK] @ unit_v.T, -9.0)
                least = np.partition(near, len(v) - m, axis=1)[:, len(v) - m]
                qi, vi = np.nonzero(near >= np.maximum(least - ROUNDING, -2.0)[:, None])  # all that can be among the best, ties too
                score = np.concatenate([cosine(q[lo + qi[i : i + 65536]], v[vi[i : i + 65536]]) for i in range(0, max(len(qi), 1), 65536)])
                order = np.lexsort((cids[vi], -score, qi))
                qi, vi, score = qi[order], vi[order], score[order]
                nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
                best = nth <= top
                out.append(pd.DataFrame({"qid": ask.qid.to_numpy()[lo + qi[best]], "score": score[best], "ids": entry.ids.to_numpy()[vi[best]]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "score": [], "ids": []})

    found = held.groupBy("g").cogroup(asks.groupBy("g")).applyInPandas(rank, "qid long, score double, ids array<long>")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = found.select("qid", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    found = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    named = asked.join(distinct, "embedding").select("query_id", "qid").join(found, "qid")
    own = named.select("query_id", F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, top).alias("best"))
    out = own.select("query_id", F.posexplode("best").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where("vec_id % 50 = 0"))
