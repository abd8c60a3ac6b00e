"""Removal of lines that many documents share, by DataFrame functions only.

Long lines become pairs of 64-bit hashes of their keys. Occurrences are range-partitioned by (hash, document)
and sorted by position within, so one pass streams the first occurrence of a key in each document, and a
line that a third of all documents hold is spread over many partitions. First occurrences are counted per key
with partial aggregation. Dropped places are gathered per document only, and the result is a keep bitmap in
run lengths, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.llm.common import materialize

MIN_CHARS = 40
MIN_DOCUMENTS = 5

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. lower() is faster, and the same for ASCII."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text and a hash of the text, which tells rows with one id apart; columns to keep are one struct."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = F.struct(*keep) if keep else F.lit(None)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole).alias("row_hash"), whole.alias("text"), kept.alias("kept"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_hash, runs) of the rows that lose lines.

    A key of at least `min_chars` characters that at least `min_documents` documents hold stays only in the
    one with the largest id. `runs` is the keep bitmap in run lengths from line 0 on: kept, dropped, kept, ...
    (the first may be 0; lines after the last run stay). Rows with a null id count as no document and lose
    nothing; rows with the same id are one document.
    """
    lines = _rows(docs, doc_id, text).where("doc_id is not null").select("doc_id", "row_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    occurrences = materialize(keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_hash", "pos"))

    ranged = occurrences.select("h", "h2", "doc_id", "pos").repartitionByRange("h", "h2", "doc_id").sortWithinPartitions("h", "h2", "doc_id", "pos")
    first = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("h", "h2", "doc_id").orderBy("pos"))).where("nth = 1")
    shared = first.groupBy("h", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_documents)
    shared = materialize(shared.select(F.col("h").alias("s"), F.col("h2").alias("s2"), "keeper"))

    lost = occurrences.join(shared, (F.col("h") == F.col("s")) & (F.col("h2") == F.col("s2"))).where("doc_id <> keeper")
    by_row = lost.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # Starts of runs of dropped lines, then of the kept lines behind them; differences are the run lengths.
    starts = "filter(gone, (p, i) -> i = 0 or gone[i - 1] < p - 1)"
    ends = "transform(filter(gone, (p, i) -> i = size(gone) - 1 or gone[i + 1] > p + 1), p -> p + 1)"
    # Each stage is a column of its own: what a lambda takes from outside is read there, not computed.
    paired = by_row.select("doc_id", "row_hash", F.expr(f"arrays_zip({starts}, {ends})").alias("pairs"))
    edges = paired.select("doc_id", "row_hash", F.expr("flatten(transform(pairs, x -> array(x['0'], x['1'])))").alias("edges"))
    runs = "zip_with(edges, slice(concat(array(0), edges), 1, size(edges)), (e, before) -> e - before)"
    return edges.select("doc_id", "row_hash", F.expr(runs).alias("runs"))


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, row_hash, text, runs, kept) of each row; empty runs keep all lines. A null text is one empty
    line; `kept` is a struct of the columns `keep`."""
    dropped = dropped_lines(docs, min_chars, min_documents, doc_id, text).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "runs")
    rows = _rows(docs, doc_id, text, keep)
    same = (F.col("doc_id") == F.col("d")) & (F.col("row_hash") == F.col("r"))
    none = F.array().cast("array<int>")
    return rows.join(dropped, same, "left").select("doc_id", "row_hash", "text", F.coalesce("runs", none).alias("runs"), "kept")


def n_dropped(runs: Column) -> Column:
    return F.aggregate(F.filter(runs, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, x: a + x)


def kept_text(text: Column, runs: Column) -> Column:
    """The lines that a keep bitmap keeps, joined again. Each line meets its flag by place, so the work follows the
    number of lines; nothing outside a lambda is used inside, which would be made anew for each element."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    marked = F.zip_with(lines_of(text), flags, lambda line, keep: F.struct(line.alias("line"), F.coalesce(keep, F.lit(True)).alias("keep")))
    kept = F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["line"])
    return F.when(F.size(runs) == 0, text).otherwise(F.array_join(kept, "\n"))


def deduplicate_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, runs, kept_text, *keep) of each row of `docs`; see `dropped_lines`.

    Repeated rows give repeated results, an empty table an empty one; other columns are left out.
    """
    rows = keep_bitmaps(docs, min_chars, min_documents, doc_id, text, keep)
    return rows.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        n_dropped(F.col("runs")).alias("n_dropped"),
        "runs",
        kept_text(F.col("text"), F.col("runs")).alias("kept_text"),
        *[F.col("kept")[k].alias(k) for k in keep],
    )
