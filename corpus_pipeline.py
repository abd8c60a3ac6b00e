"""From raw documents to packed sequences: five stages, each written as a table and read by the next.

Documents that a stage rejects go; texts that it cuts go on shorter; the last stage returns the packed pieces.
"""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinscan.llm.common import scratch_folder  # noqa: E402
from twinscan.llm.decontaminate import find_test_items  # noqa: E402
from twinscan.llm.language import UNDETERMINED, predict, train, training_part  # noqa: E402
from twinscan.llm.line_dedup import deduplicate_lines  # noqa: E402
from twinscan.llm.packing import pack_documents  # noqa: E402
from twinscan.llm.queries import tokenizer_path  # noqa: E402
from twinscan.llm.simhash import near_duplicates  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine up to which a text resembles no language.
NO_LIKENESS = 0.0
#: Share of words of test items from which a document goes as a whole; below it only those words go.
MAX_COVERAGE = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text resembles a language; others (no letters, nothing like any language) go."""
    judged = predict(docs, train(training_part(docs)), keep=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > NO_LIKENESS)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents hold stay only in the one with the largest id."""
    kept = deduplicate_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Documents without an id cannot be
    named and stay."""
    groups = near_duplicates(docs, shingle=4, radius=4, seed=42)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of test items: those largely made of them go, others lose those words."""
    found = find_test_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True, keep=("lang", "source"))
    clean = found.where(F.col("n_hit") <= MAX_COVERAGE * F.col("n_words"))
    return clean.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and place."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language profiles and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    folder = f"{scratch_folder(spark)}/twinscan-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
