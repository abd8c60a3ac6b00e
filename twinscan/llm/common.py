"""Small shared helpers: column choice, row slices of bounded size, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.sources.tables import scratch_folder
from twinscan.sources.tables import write_once as materialize

__all__ = ["chosen", "delete", "materialize", "read_documents", "scratch_folder", "text_slices"]

#: UTF-8 bytes of text handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def chosen(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null becomes empty); whatever else the table holds is left out,
    so no other column can clash with the names an operator uses."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most `limit` bytes of text, so memory depends on neither
    the batch size nor the mean length."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def delete(spark: SparkSession, path: str) -> None:
    """Remove a stored intermediate table, wherever the cluster's shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
