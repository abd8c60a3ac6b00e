"""Which hashes of places in texts occur more than once, whatever the number of texts.

Texts are handled in slices. A slice sends its hashes in arrays, one row for each bucket of hashes; a bucket is small
however large the input, as their number follows the input. Buckets are chosen by one hash and compared by another, so
the chance of a false match in a bucket does not grow either. A place is one number in its slice; the slice sends a
directory of its documents along, by which the places that return are told apart again.

A hash that repeats within a slice is told there and sends a single witness with its number; a task that has sent one
remembers it, and only sends how often it came again at its end. So a passage that a third of all documents share costs
a bucket two entries a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import chosen, scratch_folder, text_slices

#: Witnessed hashes that a task remembers; forgetting one only sends it again.
REMEMBERED = 1 << 20
LONG, INT = pa.int64(), pa.int32()
_DIRECTORY = "keys array<long>, ties array<long>, sizes array<int>"
_FOUND = f"slice long, at array<int>, {_DIRECTORY}"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits, so that any of them may choose a bucket."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n, base, np.uint64))
    return out


def cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.flatnonzero(new)


def ragged(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, INT), pa.array(values, kind))


def flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks)]).astype(np.int64)


def distinguished(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, tie, doc_id, text): key and tie tell rows apart, also those without an id."""
    return chosen(docs, doc_id, text).select(
        F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text", F.isnull("doc_id")).alias("tie"), "doc_id", "text"
    )


def of_row() -> Column:
    """That a row of `distinguished` is the one that (k, t) names."""
    return (F.col("key") == F.col("k")) & (F.col("tie") == F.col("t"))


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))


def numbered(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices with a number each: the partition and their place in it."""
    first = TaskContext.get().partitionId() << 32
    return enumerate(text_slices(batches, limit=limit), first)


def directory(part: pa.RecordBatch, sizes: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The documents of a slice, and how many places each has."""
    return part.column("key"), part.column("tie"), pa.array(sizes, INT)


def identity(h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """One number for a hash in a bucket."""
    return mixed(h.astype(np.uint64) ^ (bucket.astype(np.uint64) << np.uint64(40)))


class Told:
    """Hashes that this task has sent witnesses of, and how often they came since."""

    def __init__(self) -> None:
        self.known, self.h, self.bucket, self.times = (np.zeros(0, x) for x in (np.uint64, np.uint64, np.int64, np.int64))

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Which of these are known; they are counted."""
        if not len(self.known):
            return np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
        found = self.known[at] == ids
        np.add.at(self.times, at[found], 1)
        return found

    def add(self, ids: np.ndarray, h: np.ndarray, bucket: np.ndarray) -> None:
        if len(self.known) + len(ids) <= REMEMBERED:
            columns = [np.concatenate(x) for x in ((self.known, ids), (self.h, h.astype(np.uint64)), (self.bucket, bucket.astype(np.int64)), (self.times, np.zeros(len(ids), np.int64)))]
            order = np.argsort(columns[0])
            self.known, self.h, self.bucket, self.times = (x[order] for x in columns)

    def rest(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, hash, times) of what came again, by bucket."""
        some = np.flatnonzero(self.times)
        some = some[np.argsort(self.bucket[some], kind="stable")]
        return self.bucket[some], self.h[some].astype(kind), self.times[some]


def entry_schema(kind: str) -> str:
    return f"bucket int, slice long, h array<{kind}>, at array<int>, {_DIRECTORY}"


def entries(number: int, documents: tuple[pa.Array, pa.Array, pa.Array], at: np.ndarray, h: np.ndarray, bucket: np.ndarray, buckets: int, told: Told) -> pa.RecordBatch:
    """Rows for buckets, from the places of a slice and their hashes (unsigned). The row without hashes holds the
    directory and the slice's own places that are known to repeat; any bucket passes it on."""
    ids = identity(h, bucket)
    known = told.has(ids)
    order = np.lexsort((h, bucket))
    order = order[~known[order]]
    first = cuts(bucket[order], h[order])
    many = np.diff(first, append=len(order))
    repeated = np.sort(np.concatenate([at[known], at[order[np.repeat(many > 1, many)]]]))
    sent = order[first]
    told.add(ids[sent[many > 1]], h[sent[many > 1]], bucket[sent[many > 1]])
    # One entry for each hash; one that is told already is a witness, with minus its number for a place.
    at_sent = np.where(many > 1, -many, at[sent])
    again = np.lexsort((at_sent, bucket[sent]))
    hashes = entry_rows(number, bucket[sent[again]], h[sent[again]], at_sent[again])
    own = [
        pa.array([number % buckets], INT),
        pa.array([number], LONG),
        pa.array([None], hashes.column("h").type),
        ragged(repeated, np.array([0, len(repeated)]), INT),
        *(pa.ListArray.from_arrays(pa.array([0, len(x)], INT), x) for x in documents),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(hashes.columns, own)], hashes.schema.names)


def entry_rows(number: int, bucket: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows for buckets (ascending) with hashes and places."""
    starts = cuts(bucket)
    edges, n = np.append(starts, len(bucket)), len(starts)
    kind, signed = (INT, np.int32) if h.dtype == np.uint32 else (LONG, np.int64)
    columns = [
        pa.array(bucket[starts], INT),
        pa.array([number] * n, LONG),
        ragged(h.view(signed), edges, kind),
        ragged(np.maximum(at, np.iinfo(np.int32).min), edges, INT),
        *(pa.nulls(n, pa.list_(x)) for x in (LONG, LONG, INT)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "slice", "h", "at", "keys", "ties", "sizes"])


def counted_again(told: Told, kind: type) -> pa.RecordBatch:
    """What a task sends at its end: how often the hashes it remembers came again."""
    bucket, h, times = told.rest(kind)
    return entry_rows(TaskContext.get().partitionId() << 32, bucket, h, -times)


#: The slice under which a bucket names its frequent hashes: identities as keys, numbers as ties.
FREQUENT = -1


def _frequent(h: np.ndarray, at: np.ndarray, bucket: int, least: int) -> pa.Table:
    """The hashes of a bucket that occur at least so often, as one row if there are any."""
    different, of = np.unique(h, return_inverse=True)
    n = np.bincount(of, np.where(at < 0, -at, 1), len(different)).astype(np.int64)
    some = n >= least
    ids = identity(different[some].astype(np.int32).view(np.uint32), np.full(int(some.sum()), bucket)).view(np.int64)
    edges = np.array([0, len(ids)] if len(ids) else [0])
    rows = len(edges) - 1
    lists = [ragged(ids, edges, LONG), ragged(n[some], edges, LONG)]
    return pa.table([pa.array([FREQUENT] * rows, LONG), pa.nulls(rows, pa.list_(INT)), *lists, pa.nulls(rows, pa.list_(INT))], ["slice", "at", "keys", "ties", "sizes"])


def repeated_in_bucket(group: pa.Table, *, least: int = 0) -> pa.Table:
    """For each slice, the places of the entries of a bucket whose hash occurs more than once; directories as they are.
    With `least`, also the hashes (of 32 bits) that occur at least so often."""
    own = group.filter(pc.is_valid(group.column("h")))
    h, at = flat(own.column("h")), flat(own.column("at"))
    of = np.repeat(own.column("slice").to_numpy(), pc.list_value_length(own.column("h")).to_numpy().astype(np.int64))
    frequent = [_frequent(h, at, group.column("bucket")[0].as_py(), least)] if least and len(h) else []
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    keep = order[same[:-1] | same[1:]] if len(order) else order
    keep = keep[at[keep] >= 0]
    keep = keep[np.lexsort((at[keep], of[keep]))]
    starts = cuts(of[keep])
    none = [pa.nulls(len(starts), pa.list_(x)) for x in (LONG, LONG, INT)]
    names = ["slice", "at", "keys", "ties", "sizes"]
    found = pa.table([pa.array(of[keep[starts]], LONG), ragged(at[keep], np.append(starts, len(keep)), INT), *none], names)
    return pa.concat_tables([found, group.filter(pc.is_null(group.column("h"))).select(names), *frequent])


def by_document(at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of places of a slice."""
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, at, side="right")
    return row, at - (ends - sizes)[row]


def slice_directory(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ties and sizes of the documents of the slice that a group belongs to."""
    own = group.filter(pc.is_valid(group.column("keys")))
    return flat(own.column("keys")), flat(own.column("ties")), flat(own.column("sizes"))


def _documents_of_slice(group: pa.Table) -> pa.Table:
    """(k, t, pos): all places that the buckets found in the documents of a slice."""
    keys, ties, sizes = slice_directory(group)
    row, pos = by_document(np.sort(flat(group.column("at"))), sizes)
    starts = cuts(row)
    return pa.table([pa.array(keys[row[starts]], LONG), pa.array(ties[row[starts]], LONG), ragged(pos, np.append(starts, len(row)), INT)], ["k", "t", "pos"])


def repeated_places(sent: DataFrame) -> DataFrame:
    """(k, t, pos), stored: for each row of `distinguished` that has any, its places whose hash repeats.
    A slice gets at most the entries it sent, so both groupings stay small."""
    return _places(sent.groupBy("bucket").applyInArrow(repeated_in_bucket, _FOUND))


def _places(found: DataFrame) -> DataFrame:
    by_slice = found.groupBy("slice").applyInArrow(_documents_of_slice, "k long, t long, pos array<int>")
    # Rows that are equal in everything may stand in two slices.
    return settled(by_slice.groupBy("k", "t").agg(F.flatten(F.collect_set("pos")).alias("pos")))


def places_and_frequent(sent: DataFrame, least: int, most: int) -> tuple[DataFrame, np.ndarray]:
    """What `repeated_places` gives, and the identities of the (at most `most`) most frequent hashes of those that occur
    `least` times or more. So any other occurs less than `least` times, or in less than one of `most` places."""

    def run(group: pa.Table) -> pa.Table:
        return repeated_in_bucket(group, least=least)

    found = settled(sent.groupBy("bucket").applyInArrow(run, _FOUND))
    listed = found.where(F.col("slice") == FREQUENT).select(F.explode(F.arrays_zip("keys", "ties")).alias("x"))
    frequent = listed.select("x.*").orderBy(F.desc("ties"), "keys").limit(most).collect()
    ids = np.sort(np.array([r["keys"] for r in frequent], np.int64).view(np.uint64))
    return _places(found.where(F.col("slice") != FREQUENT)), ids


def settled(df: DataFrame) -> DataFrame:
    """Store `df` in small files, and let Spark clean the shuffles it came from: they are of no further use, but the
    driver's collector would find that out only much later."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/twinscan-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
