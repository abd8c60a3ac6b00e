"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.llm.common import read_documents, scratch_folder


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.token_counts import count_tokens

    counted = count_tokens(read_documents(spark, folder), tokenizer_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.secrets import KINDS, find_secrets, listed, train

    docs = read_documents(spark, folder)
    found = find_secrets(docs, train(docs))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )


def op3_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.simhash import near_duplicates

    return near_duplicates(read_documents(spark, folder), shingle=4, radius=4, seed=42)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.language import held_out, predict, train, training_part

    docs = read_documents(spark, folder)
    known = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict(known, train(training_part(docs)), keep=("held_out",))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.line_dedup import deduplicate_lines

    lines = deduplicate_lines(read_documents(spark, folder), min_chars=40, min_documents=5)
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.packing import pack_documents

    return pack_documents(read_documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.token_files import read_token_files, write_token_files

    place = f"{scratch_folder(spark)}/twinscan-ids-{uuid.uuid4().hex}"
    write_token_files(read_documents(spark, folder), place, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, place)


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.substrings import remove_repeats

    return remove_repeats(read_documents(spark, folder), window=35, digest=True).withColumnRenamed("kept", "kept_sha256")


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.embeddings import near_duplicate_vectors

    return near_duplicate_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), threshold=0.93)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.decontaminate import find_test_items

    found = find_test_items(read_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.conversations import Repair, damaged, given

    turns = damaged(given(spark.read.parquet(f"{folder}/conversations.parquet")))
    return Repair(turns, texts=False).summaries()


def op12_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.byte_passages import remove_repeated_bytes

    cleaned = remove_repeated_bytes(read_documents(spark, folder), depth=200, digest=True)
    return cleaned.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from twinscan.llm.infill import infill, write_frames

    place = f"{scratch_folder(spark)}/twinscan-frames-{uuid.uuid4().hex}"
    write_frames(read_documents(spark, folder), place)
    return infill(spark, place, texts=False)


LLM_QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LLM_ORACLES: dict[str, str] = {
    "op5_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
        keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
