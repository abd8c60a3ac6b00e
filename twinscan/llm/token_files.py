"""Token files: one concatenated id array per block, with Elias-Fano coded document boundaries.

A file set is a folder of Parquet files whose rows are blocks. Spark writes it through its commit protocol,
so a lost executor or a repeated task leaves no half-written block, on any store Spark can write. Columns:

    part, seq         order of the blocks (parts follow the order of the documents)
    before            ids of the part's blocks before this one
    n_docs, n_ids     documents and ids in the block
    docs              document ids, little-endian int64 (nulls are told by `null_docs`, at the front)
    low, high, low_bits   Elias-Fano code of the n_docs ends of documents within the block
    ids               little-endian unsigned ids of `width` bytes: 2 if every id of the vocabulary fits

The code keeps the lower `low_bits` of each end packed, and the upper ones in unary in a bit vector:
2 + log2(n_ids / n_docs) bits for each document rather than 64. `EliasFano.select` finds the end of any
document from counts of set bits per word, without decoding the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.llm.common import chosen, text_slices
from twinscan.llm.encoding import WordEncoder, encoder

#: Ids of a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20


class EliasFano:
    """Non-decreasing integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))])

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((int(at[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes())

    def select(self, k: np.ndarray) -> np.ndarray:
        """The values of ranks `k`: the place of the k-th set bit gives the upper part."""
        k = np.asarray(k, np.int64)
        word = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[word]
        bits = np.unpackbits(self.high[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1) == (left + 1)[:, None], axis=1) if len(k) else left
        upper = word * 64 + inside - k
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (upper << self.low_bits) + low


_BLOCK = "part int, seq int, before long, n_docs long, n_ids long, null_docs long, docs binary, low_bits int, low binary, high binary, width int, ids binary"


def _block(part: int, seq: int, before: int, docs: list, ids: np.ndarray, ends: np.ndarray, width: int) -> pa.RecordBatch:
    code = EliasFano.encode(ends)
    nulls = sum(x is None for x in docs)
    keys = np.array([x for x in docs if x is not None], "<i8")
    row = [part, seq, before, len(docs), len(ids), nulls, keys.tobytes(), code.low_bits, code.low.tobytes(), code.high.tobytes(), width, ids.astype(f"<u{width}").tobytes()]
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of all texts, `end_id` behind each, in ascending order of the document ids.

    Null ids come first; rows with one id follow in the order of a hash of their text, so any retry writes
    the same. A null text is `end_id` alone. Documents are range-partitioned, and the place of a part among
    all ids is not stored: a reader adds up the sizes of the parts. An empty table writes no block.
    """
    vocabulary = encoder(path, WordEncoder).tokenizer.get_vocab_size()
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    tie = F.xxhash64("text").alias("tie")
    ordered = chosen(docs, doc_id, text).select("doc_id", tie, "text").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = before = 0
        for rows in text_slices(batches):
            ids, counts = encoder(path, WordEncoder).encode(rows.column("text"))
            held.append(np.insert(ids, np.cumsum(counts), end_id))
            sizes.append(counts + 1)
            keys += rows.column("doc_id").to_pylist()
            total += len(held[-1])
            if total >= block_ids:
                yield _block(part, seq, before, keys, np.concatenate(held), np.cumsum(np.concatenate(sizes)), width)
                before, keys, held, sizes, total, seq = before + total, [], [], [], 0, seq + 1
        if keys:
            yield _block(part, seq, before, keys, np.concatenate(held), np.cumsum(np.concatenate(sizes)), width)

    ordered.select("doc_id", "text").mapInArrow(run, _BLOCK).write.mode("overwrite").parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files.

    `start` counts the ids of all documents before it. Sizes of parts are summed on the driver: one number
    for each range partition of the writer.
    """
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, so_far = {}, 0
    for row in sizes:
        base[row["part"]] = so_far
        so_far += row["n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_slices(batches, "ids"):
            for row in some.to_pylist():
                n = row["n_docs"]
                ends = EliasFano(n, row["low_bits"], row["low"], row["high"]).select(np.arange(n))
                starts = np.concatenate([[0], ends[:-1]]) if n else ends
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                keys = [None] * row["null_docs"] + np.frombuffer(row["docs"], "<i8").tolist()
                parts = [ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array(starts + base[row["part"]] + row["before"], pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
