"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words;
none gets more than twice its own words, and what is over is shared again by weight among the others.
Blocks of ``BLOCK`` words are apportioned to the sources by highest quotients, each source's blocks to
groups of its shards, and each group's blocks to its shards, by the same rule on the words there. A shard
is the stretch of words of its documents in seeded order, cut into blocks: whole passes over it take every
block, and the rest takes its first blocks, which are a random choice as the order is. So a source's words
come within a block or so of its target, and no document is taken over twice.

Quotients are compared as doubles, the same ones at every run: the divisor that the highest quotients imply is
found by bisection, and equal quotients go to the earlier entry.

Defined cases: null text has no words; a null source is a source; repeated rows are documents each; tables
without words take nothing; columns of ``docs`` that have the name of a result are replaced by it. The order is that of md5(seed:doc_id), then size, then the text's md5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import WORD, fresh, staged, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 16
SHARD_ROWS = 1000
GROUP_SHARDS = 1000
SEED = 11


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Fill by weight; a source at its most is set there and the rest shared again."""
    out = [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); equal quotients go to the earlier entry."""
    votes = np.asarray(votes, float)
    if seats <= 0 or not votes.sum() > 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.floor((votes / d + 1) / 2).astype(np.int64)  # quotients of at least d
    low, high = votes.sum() / (2 * seats + 2 * len(votes) + 2), 2 * votes.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    out = given(high)
    for _ in range(seats - out.sum()):
        out[np.argmax(votes / (2 * out + 1))] += 1
    return out


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def quotas(shards: DataFrame, sources: list[tuple[str | None, int]]) -> DataFrame:
    """The blocks of each shard: (no, g, s, z) gets ``quota``; ``no`` is the source's place."""
    want = targets([z for _, z in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    blocks = apportion(np.array(want), round(sum(want) / BLOCK)) if sources else np.zeros(0, np.int64)

    def to_groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        return rows.assign(quota=apportion(rows.z.to_numpy(), int(blocks[rows.no.iloc[0]])))

    def to_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s")
        return rows.assign(quota=apportion(rows.z.to_numpy(), int(rows.quota.iloc[0])))

    groups = shards.groupBy("no", "g").agg(F.sum("z").alias("z")).groupBy("no").applyInPandas(to_groups, "no int, g int, z long, quota long")
    return shards.join(groups.select("no", "g", "quota"), ["no", "g"]).groupBy("no", "g").applyInPandas(to_shards, "no int, g int, s int, z long, quota long")


def mixed(docs: DataFrame, keep_text: bool = True, shard_rows: int = SHARD_ROWS, group_shards: int = GROUP_SHARDS) -> DataFrame:
    """``docs`` with its size, its source's size and target, and the words ``taken``; without the texts where those aren't kept."""
    spark, docs = docs.sparkSession, docs.drop("size", "source_size", "target", "taken")
    no, g, s, size, order, tie, z, quota, upto, key, shards_of, total, goal = fresh(docs, "no", "g", "s", "words", "order", "tie", "z", "quota", "upto", "key", "n_shards", "source_words", "goal")
    text = F.col("text")
    sized = docs.withColumns({size: n_words(text), order: F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), tie: F.md5(F.coalesce(text, F.lit("")))})
    sized = staged(sized if keep_text else sized.drop("text"), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum(size).alias("z"), F.count("*").alias("n")).collect()  # a row for each source: the mixture's plan
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sources = [(r.source, r.z) for r in totals]
    want = targets([v for _, v in sources], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))])
    n_shards = [max(1, -(-r.n // shard_rows)) for r in totals]
    plan = spark.createDataFrame([(i, r.source, int(r.z), float(w), n) for i, (r, w, n) in enumerate(zip(totals, want, n_shards, strict=True))], f"{no} int, {key} string, {total} long, {goal} double, {shards_of} int")
    out = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col(key)))  # a row for each source
    shard = F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.col(shards_of)).cast("int")
    out = out.withColumn(s, shard).withColumn(g, F.expr(f"{s} div {group_shards}").cast("int"))
    shards = out.groupBy(F.col(no).alias("no"), F.col(g).alias("g"), F.col(s).alias("s")).agg(F.sum(size).alias("z"))
    given = quotas(shards, sources).select(F.col("no").alias(no), F.col("s").alias(s), F.col("z").alias(z), F.col("quota").alias(quota))
    out = out.join(given, [no, s])
    running = Window.partitionBy(no, s).orderBy(order, size, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(upto, F.sum(size).over(running))
    words = F.least(F.col(quota) * BLOCK, 2 * F.col(z))
    passes = F.when(F.col(z) > 0, F.floor(words / F.col(z))).otherwise(0)
    part = words - passes * F.col(z)  # the words of the first blocks, which the last pass takes
    extra = F.greatest(F.lit(0), F.least(F.col(size), part - (F.col(upto) - F.col(size))))
    taken = (passes * F.col(size) + F.when(F.col(z) > 0, extra).otherwise(0)).cast("long")
    return out.select(*(c for c in docs.columns if keep_text or c != "text"), F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(goal).alias("target"), taken.alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same by literal highest quotients. A shard group has all shards of a source up to a million rows.
OP7_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord, md5(coalesce(text, '')) AS tie FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS no FROM docs GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size AS cap FROM src),
lev AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS full_before, sum(weight) OVER q AS weight_left FROM w WHERE source_size > 0
  WINDOW p AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         q AS (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rate AS (
  SELECT (SELECT 1.5 * sum(source_size) FROM w) AS goal,
         (SELECT arg_min(((SELECT 1.5 * sum(source_size) FROM w) - full_before) / weight_left, cap / weight) FROM lev
          WHERE ((SELECT 1.5 * sum(source_size) FROM w) - full_before) / weight_left <= cap / weight) AS r),
t AS (SELECT w.*, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, weight * r) END::DOUBLE AS target FROM w, rate),
q1 AS (
  SELECT no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no) AS rk
  FROM t, range(0, (target / {BLOCK} + 3)::BIGINT) AS x(k)),
b AS (SELECT no, count(*) AS blocks FROM q1 WHERE rk <= round((SELECT sum(target) FROM t) / {BLOCK}) GROUP BY no),
d AS (
  SELECT docs.*, t.no, t.source_size, t.target, coalesce(b.blocks, 0) AS blocks,
         ('0x' || substr(ord, 1, 8))::BIGINT % greatest(1, (t.n + {SHARD_ROWS - 1}) // {SHARD_ROWS}) AS s
  FROM docs JOIN t ON docs.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.no = t.no),
sh AS (SELECT no, s, sum(size)::BIGINT AS z, max(blocks) AS blocks FROM d GROUP BY no, s),
q2 AS (
  SELECT no, s, blocks, row_number() OVER (PARTITION BY no ORDER BY z::DOUBLE / (2 * k + 1) DESC, s) AS rk
  FROM sh, range(0, z // {BLOCK} * 2 + 3) AS x(k)),
sq AS (SELECT no, s, count(*) AS quota FROM q2 WHERE rk <= blocks GROUP BY no, s),
e AS (
  SELECT d.*, sh.z, least(coalesce(sq.quota, 0) * {BLOCK}, 2 * sh.z) AS words,
         sum(size) OVER (PARTITION BY d.no, d.s ORDER BY ord, size, tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN sh ON sh.no = d.no AND sh.s = d.s LEFT JOIN sq ON sq.no = d.no AND sq.s = d.s)
SELECT doc_id, size, source_size, target,
       CASE WHEN z = 0 THEN 0 ELSE words // z * size + greatest(0, least(size, words % z - (upto - size))) END::BIGINT AS taken FROM e
"""
