"""Corpora that the queries search: (filepath, text) from the driver's tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_DOCS = 2000
LETTERS, SIGNS = "aeioustnrl", "有効期限認証設定更新"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.format_string("docs/%s/%s_%s.md", "lang", "source", F.col("doc_id").cast("string")).alias("filepath"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.expr(f"doc_id div {FILE_DOCS}").alias("part")  # so no file grows with the table
    d = read(spark, sf_dir, "documents").groupBy("lang", "source", part).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return d.select(F.format_string("%s/%s_%d.md", "lang", "source", "part").alias("filepath"), F.array_join("x.text", "\n\n").alias("text"))


def web(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return read(spark, sf_dir, "pages").select(F.concat_ws("/", F.col("page_id").cast("string"), url).alias("filepath"), F.col("html").alias("text"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return d.select(F.format_string("chat/%s.txt", F.col("conv_id").cast("string")).alias("filepath"), F.array_join("x.text", "\n").alias("text"))


def idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "part")
    camel, snake = F.regexp_replace(F.initcap("p_name"), " ", ""), F.regexp_replace("p_name", " ", "_")
    return d.select(F.format_string("src/part_%s.py", F.col("p_partkey").cast("string")).alias("filepath"), F.concat(F.lit("def "), snake, F.lit("(): return "), camel, F.lit("()")).alias("text"))


def cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("text", F.translate(F.lower("text"), LETTERS, SIGNS))


SQL = {
    "docs": "SELECT 'docs/' || lang || '/' || source || '_' || doc_id || '.md' AS filepath, text FROM documents",
    "files": f"SELECT lang || '/' || source || '_' || doc_id // {FILE_DOCS} || '.md' AS filepath, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY lang, source, doc_id // {FILE_DOCS}",
    "chat": "SELECT 'chat/' || conv_id || '.txt' AS filepath, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "web": "SELECT page_id || '/' || coalesce(url, '') AS filepath, html AS text FROM pages",
    "idents": "SELECT 'src/part_' || p_partkey || '.py' AS filepath, 'def ' || replace(p_name, ' ', '_') || '(): return ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '()' AS text FROM part",
    "cjk": f"SELECT 'docs/' || lang || '/' || source || '_' || doc_id || '.md' AS filepath, translate(lower(text), '{LETTERS}', '{SIGNS}') AS text FROM documents",
}
