"""Packing of token pieces into sequences of fixed capacity by hierarchical best fit.

Each partition packs its own pieces, longest first, each into the fullest bin that still holds it. Only bins
that are nearly full leave. The pieces of all others are dealt anew over tasks by a hash of their bin, as many
tasks as their number asks for, and packed again; rounds go on as long as the number of bins falls. Then
bins travel whole in the same way, which never makes more of them, until their number stops falling too. Sizes
and places travel, not tokens; a task's share is bounded, and the number of bins that go on is not.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import chosen, materialize, text_slices
from twinscan.llm.encoding import ByteEncoder, encoder

#: A task packs about FAN_IN * CARRIED pieces at once after the first packing.
FAN_IN = 16
CARRIED = 4_096
#: Pieces a task gathers, about, for each run of the first packing.
GATHERED = 10_000
#: Bins with at most this share of the capacity free are nearly full.
NEARLY = 1 / 128

_BIN = "grp long, bin long, done boolean, items array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long,offset:long>>"
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def _cutting(path: str, capacity: int, end_id: int, with_ids: bool = False) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of `token_pieces` does with its documents."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            ids, counts = encoder(path, ByteEncoder).encode(rows.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            out: list[tuple] = []
            begin = 0
            for key, n in zip(rows.column("doc_id").to_pylist(), (counts + 1).tolist()):
                start, piece = 0, 0
                while start < n:
                    stop = min(n, start + ((n - start) % capacity or capacity))
                    part = ids[begin + start : begin + stop].tobytes()
                    out.append((key, piece, start, stop - start, zlib.crc32(part)) + ((part,) if with_ids else ()))
                    start, piece = stop, piece + 1
                begin += n
            columns = list(zip(*out)) if out else [()] * (6 if with_ids else 5)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, *[pa.binary()] * with_ids])], names)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id behind them.
    A document of more than `capacity` ids is cut from its end into full pieces; the first may be shorter.
    A null text has the end id alone."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids
    return chosen(docs, doc_id, text).mapInArrow(_cutting(path, capacity, end_id, with_ids), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin with room. One stack of bins for each
    room left, and an integer whose bits say which stacks are filled."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = filled >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                filled &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            by_room[room].append(b)
            filled |= 1 << room
    return bins


def _packed(group: int, first: int, items: list[list[dict]], capacity: int, nearly: float) -> pa.Table:
    """Bins of these items (lists of pieces that stay together). `done` bins travel no further."""
    sizes = np.array([sum(x["length"] for x in item) for item in items], np.int64)
    bins = best_fit(sizes, capacity)
    used = np.array([sizes[b].sum() for b in bins], np.int64)
    done = used >= capacity - int(capacity * nearly)
    placed = []
    for b in bins:
        pieces, at = [x for i in b for x in items[i]], 0
        for x in pieces:
            x["offset"] = at
            at += x["length"]
        placed.append(pieces)
    n = len(bins)
    return pa.table(
        [
            pa.array([group] * n, pa.int64()),
            pa.array(range(first, first + n), pa.int64()),
            pa.array(done, pa.bool_()),
            pa.array(placed, pa.list_(_ITEM)),
        ],
        ["grp", "bin", "done", "items"],
    )


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = GATHERED) -> Iterator[list[dict]]:
    """The rows of these batches in lists of at least `rows`, but for the last one."""
    held: list[dict] = []
    for batch in batches:
        held += batch.to_pylist()
        if len(held) >= rows:
            yield held
            held = []
    if held:
        yield held


def _packing_first(capacity: int, nearly: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task of the first packing does with its pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = TaskContext.get().partitionId(), 0
        for held in _gathered(batches):
            out = _packed(group, first, [[x] for x in held], capacity, nearly)
            first += len(out)
            yield from out.to_batches()

    return run


def pack(pieces: DataFrame, capacity: int, nearly: float = NEARLY, fan_in: int = FAN_IN, carried: int = CARRIED) -> DataFrame:
    """Give each piece a sequence and a place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Each row of `pieces` (at most `capacity` long) is placed exactly once; sequences are filled without gaps
    from 0. Equal rows are separate items. An empty table gives an empty one.
    """
    return _merged(pieces.mapInArrow(_packing_first(capacity, nearly), _BIN), capacity, nearly, fan_in, carried)


def _merged(bins: DataFrame, capacity: int, nearly: float = NEARLY, fan_in: int = FAN_IN, carried: int = CARRIED) -> DataFrame:
    """The result of `pack` from the bins of its first packing."""

    def packing(whole: bool):
        def again(key: tuple, group: pa.Table) -> pa.Table:
            rows = sorted(group.select(["grp", "bin", "items"]).to_pylist(), key=lambda x: (x["grp"], x["bin"]))
            items = [x["items"] for x in rows] if whole else [[y] for x in rows for y in x["items"]]
            return _packed(key[0].as_py(), 0, items, capacity, nearly)

        return again

    def counted(bins: DataFrame) -> tuple[int, int, int, int]:
        """Bins, open bins and their pieces, highest group."""
        still = F.when(~F.col("done"), F.size("items"))
        return tuple(x or 0 for x in bins.agg(F.count("*"), F.count(still), F.sum(still), F.max("grp")).first())

    bins = materialize(bins)
    _, left, n_pieces, last = counted(bins)
    finished, groups, dealt = [bins.where("done")], last + 1, 0
    bins = bins.where("not done")
    for whole in (False, True):
        while left > 1:
            tasks, dealt = -(-n_pieces // (fan_in * carried)), dealt + 1
            place = F.lit(groups) + F.pmod(F.xxhash64(F.lit(dealt), "grp", "bin"), F.lit(tasks))
            packed = materialize(bins.groupBy(place.alias("place")).applyInArrow(packing(whole), _BIN))
            made, still, pieces_left, _ = counted(packed)
            if made >= left:
                break
            finished.append(packed.where("done"))
            bins, left, n_pieces, groups = packed.where("not done"), still, pieces_left, groups + tasks
    result = reduce(DataFrame.unionByName, [*finished, bins])
    sequence = F.shiftleft(F.col("grp"), 32) + F.col("bin")  # a group number is never given twice
    return result.select(sequence.alias("sequence_id"), F.explode("items").alias("x")).select(
        "x.doc_id", "x.piece", "x.start", F.col("x.length").cast("long").alias("length"), "x.ids_crc32", "sequence_id", "x.offset"
    )


def assemble(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of each sequence in their order, from `token_pieces(..., with_ids=True)`.
    A sequence is never longer than the capacity, so each group is small."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = packed.select("sequence_id", "offset", *[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    ids = pieces_with_ids.dropDuplicates(keys).join(placed, same)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return ids.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole documents, packed; see `token_pieces` and `pack`. A task cuts and packs in one Python
    worker: with one for each of both, an executor would keep twice as many."""
    cut, fit = _cutting(path, capacity, end_id), _packing_first(capacity, NEARLY)
    return _merged(chosen(docs, doc_id, text).mapInArrow(lambda batches: fit(cut(batches)), _BIN), capacity)
