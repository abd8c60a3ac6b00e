"""Stored tokens: each distinct content is tokenised once, ever."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.functions.languages import detect_language
from twinscan.operators.tokenize import tokenize_by_language
from twinscan.schema import TOKENS
from twinscan.sources.tables import child_names


def content_hash(content) -> "F.Column":
    return F.sha2(content, 256)


def read_store(spark, path: str) -> DataFrame:
    if child_names(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], f"content_hash string, tokens {TOKENS.simpleString()}, language string")


def update_token_store(files: DataFrame, path: str) -> None:
    """Tokenise contents not stored yet and append them, partitioned by language. Safe to run again."""
    spark = files.sparkSession
    language = F.col("language") if "language" in files.columns else detect_language(F.col("path"))
    keyed = files.select(content_hash(F.col("content")).alias("content_hash"), language.alias("language"), "content")
    fresh = keyed.join(read_store(spark, path).select("content_hash", "language"), ["content_hash", "language"], "left_anti")
    unique = fresh.groupBy("content_hash", "language").agg(F.first("content").alias("content"))
    tokens = unique.select(
        "content_hash", tokenize_by_language(F.col("content"), F.col("language")).alias("tokens"), "language"
    )
    tokens.write.mode("append").partitionBy("language").parquet(path)


def stored_tokens(files: DataFrame, path: str) -> DataFrame:
    """Files (submission_id, path, content) with their stored tokens."""
    language = F.col("language") if "language" in files.columns else detect_language(F.col("path"))
    keyed = files.withColumn("language", language).withColumn("content_hash", content_hash(F.col("content"))).drop("content")
    return keyed.join(read_store(files.sparkSession, path), ["content_hash", "language"])
