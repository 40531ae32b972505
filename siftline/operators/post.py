"""What follows ranking: thinning near hits, fusing queries, confidence and hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.config import DEFAULT, Settings


def thinned(hits: DataFrame, top_k: int, settings: Settings = DEFAULT) -> DataFrame:
    """Best first, hits less than ``near_lines`` lines from a kept one of their file go; then the best ``top_k``.

    Files don't affect each other, so each is folded by itself."""
    each = F.sort_array(F.collect_list(F.struct("rank", "start_line", "end_line", "raw_snippet", "score")))
    by_file = hits.groupBy("q", "filepath").agg(each.alias("all"))
    near = lambda kept, x: F.exists(kept, lambda y: F.abs(y.start_line - x.start_line) < settings.near_lines)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(near(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    rows = by_file.select("q", "filepath", F.explode(kept).alias("x")).select("q", "filepath", "x.*")
    again = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    return rows.withColumn("rank", again).where(F.col("rank") <= top_k)


def fused(hits: DataFrame, names: dict[int, str], top_k: int, settings: Settings = DEFAULT) -> DataFrame:
    """Reciprocal rank fusion of the queries' hits: sums of 1 / (k + rank); ties keep the first query's order."""
    spark = hits.sparkSession
    named = hits.join(F.broadcast(spark.createDataFrame(list(names.items()), "q int, query string")), "q")
    place = F.min(F.struct("q", "rank", "raw_snippet"))
    out = named.groupBy("filepath", "start_line", "end_line").agg(
        F.sum(1.0 / (settings.rrf_k + F.col("rank"))).alias("fusion_score"), F.min("score").alias("score"),
        F.transform(F.sort_array(F.collect_list(F.struct("q", "query"))), lambda x: x.query).alias("matched_queries"), place.alias("first"),
    )
    best = Window.orderBy(F.desc(F.round("fusion_score", 12)), "first.q", "first.rank")
    few = out.orderBy(F.desc(F.round("fusion_score", 12)), "first.q", "first.rank").limit(top_k)
    return few.withColumn("rank", F.row_number().over(best)).select("rank", "filepath", "start_line", "end_line", F.col("first.raw_snippet").alias("raw_snippet"), "score", "fusion_score", "matched_queries")


def confidence(hits: DataFrame, score: str = "score", settings: Settings = DEFAULT) -> DataFrame:
    """(q, label, top_score, runner_up_score, score_gap) for ranked hits of each query."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    by = lambda r: F.max(F.when(F.col("rank") == r, F.col(score)))
    few = hits.where("rank <= 2").groupBy("q").agg(F.count("*").alias("n"), at(1).alias("top_score"), at(2).alias("runner_up_score"), by(1).alias("x"), by(2).alias("y"))
    x, y = F.abs("x"), F.abs("y")
    inf = F.lit(float("inf"))
    ratio = F.when(y <= 1e-12, inf).otherwise(x / y) if score == "fusion_score" else F.when(y < 1e-9, F.when(x < 1e-9, 1.0).otherwise(inf)).otherwise(x / y)
    label = F.when(F.col("n") == 1, "single").when(ratio >= settings.dominant, "dominant").otherwise("close_contest")
    return few.select("q", label.alias("label"), "top_score", "runner_up_score", (F.col("runner_up_score") - F.col("top_score")).alias("score_gap"))


def needs_hint(n: Column, top_score: Column, top_k: int, settings: Settings = DEFAULT) -> Column:
    """Whether hits are too few or the best too weak; without hits there is no hint."""
    return (n > 0) & ((n < max(1, int(top_k * settings.sparse_share))) | (top_score > settings.weak_score))
