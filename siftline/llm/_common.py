"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.sources.files import scratch

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPLIT_ROWS = 1000  # a key with fewer rows isn't dealt to several tasks
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> str:
    """From now on at most so many rows go to a Python worker at once, as texts may be long; what it was before."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before))))
    return before


def staged(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recomputation.

    ``rows`` go to a Python worker at once at most. The tables go when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = small_batches(spark, rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, n_bytes: int, per_task: int = 32 << 20) -> int:
    """Shuffle partitions: what the session sets, and more where a task would get over ``per_task`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_task), 1)


def hot(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key, salts): the keys of ``counts`` (key, n) with over ``SPLIT_ROWS`` and more than a partition's share of ``total`` rows, and over how many tasks they go.

    There are fewer of them than shuffle partitions, so the driver may have them and broadcast them; None if there are none."""
    spark = counts.sparkSession
    parts = partitions(spark, 0)
    few = counts.where((F.col("n") > SPLIT_ROWS) & (F.col("n") * parts > total)).select(key, "n").collect()
    rows = [(k, min(-(-n // SPLIT_ROWS), -(-n * parts // total))) for k, n in few]
    return spark.createDataFrame(rows, f"{key} {counts.schema[key].dataType.simpleString()}, salts int") if rows else None


def spread(rows: DataFrame, side: DataFrame, key: str, by: list[str], salted: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``key``; those of a hot key (``salted``) are dealt by the hash of ``by`` to tasks that all get its rows of ``side``."""
    if salted is None:
        return rows.join(side, key, how)
    k, salts, salt = fresh(rows.select("*", *(F.lit(0).alias(c) for c in side.columns if c not in rows.columns)), "k", "salts", "salt")
    few = F.broadcast(salted.select(F.col(key).alias(k), F.col("salts").alias(salts)))
    n = F.coalesce(salts, F.lit(1))
    dealt = rows.join(few, F.col(key) == F.col(k), "left").withColumn(salt, F.pmod(F.xxhash64(*by), n).cast("int")).drop(k, salts)
    copies = side.join(few, F.col(key) == F.col(k), "left").withColumn(salt, F.explode(F.sequence(F.lit(0), n - 1))).drop(k, salts)
    return dealt.join(copies, [key, salt], how).drop(salt)


def text_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
