"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, F.col("a") == F.col("v")).select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("v"), "m")
    out = edges.join(least, F.col("b") == F.col("v"))
    return out.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether each ``b`` has one ``a`` and none is an ``a``: as steps keep what is connected, the stars are the components."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.selectExpr("a", "0", "1"))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has a < b; each ``b`` gets its component's smallest member ``a``. Members that are smallest have no row.

    To add links to a result, give both together: that takes few steps."""
    now = staged(edges.where("a < b").select("a", "b").distinct(), "links")
    while not _is_forest(now):
        now = staged(_small(_large(now)), "stars")
    return now
