"""Removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

A suffix counts only through its first `depth` bytes, so two suffixes fall in one group of the sort exactly if a
window of `depth` bytes begins at both. The first digit deals suffixes to tasks: the least `LEADER` bytes (by a hash)
inside the window, its leader. Equal windows have equal leaders at equal places, so they meet in one bucket, and
consecutive windows mostly share a leader, so that a bucket gets them as one strip of text. A leader that occurs once
ends there: first only hashes of leaders meet, and only strips over repeated leaders travel.

A leader may be frequent: the edges of a passage that many documents share have one leader, but other neighbours in each
of them. Suffixes over frequent leaders are dealt further by a second digit, a hash of the whole window, which is all
that travels of them; a bucket gets a few entries of each such window from a task, and the windows of one leader spread.

In a bucket the suffixes are sorted by most-significant-digit passes of eight bytes. A pass reorders only groups whose
digits differ and drops groups of one; after the last pass every group left is a repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import text_slices
from twinscan.llm.repeats import (
    INT,
    LONG,
    Told,
    bucket_count,
    by_document,
    counted_again,
    cuts,
    directory,
    distinguished,
    entries,
    entry_schema,
    flat,
    identity,
    mixed,
    numbered,
    of_row,
    places_and_frequent,
    powers,
    ragged,
    repeated_in_bucket,
    settled,
    slice_directory,
)

DEPTH = 200
#: Bytes that lead a window; shorter ones repeat by chance, longer ones change more often.
LEADER = 64
#: Bytes of a digit.
DIGIT = 8
#: UTF-8 bytes of text for one bucket of leaders, and for one bucket of strips.
LEADER_BUCKET, STRIP_BUCKET = 64 << 20, 2 << 20
#: Bytes of text handled at once, and those within which leaders are searched.
SLICE, BLOCK = 4 << 20, 1 << 20
#: Strips that a task remembers; forgetting one only sends it again.
REMEMBERED = 1 << 15
#: Occurrences from which a leader is frequent, and the most leaders that are (of those that occur most).
FREQUENT_FROM, MOST_FREQUENT = 1024, 1 << 20
_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _window_hashes(part: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of this many bytes."""
    values = part.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(part))[:-1], dtype=np.uint64)])
        return mixed((prefix[width:] - prefix[:-width]) * powers(pow(base, -1, 1 << 64), len(part))[: len(part) - width + 1])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, from the least so far in blocks from either side."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Strips:
    """The texts of a slice in a row, as strips: runs of consecutive windows with one leader."""

    def __init__(self, texts: list[bytes], depth: int, leader: int) -> None:
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text = b"".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        n = len(data) - depth + 1
        found = [self._block(data, start, min(start + BLOCK, n), depth, leader) for start in range(0, n, BLOCK)]
        first, last, at, h = (np.concatenate([np.zeros(0, x), *(f[i] for f in found)]) for i, x in enumerate((np.int64, np.int64, np.int64, np.uint64)))
        # Windows over the end of a text are none: a run loses them, and a run in two blocks is one strip.
        ends = np.cumsum(self.sizes)
        of = np.searchsorted(ends, at, side="right")
        first = np.maximum(first, (ends - self.sizes)[of]) if len(of) else first
        last = np.minimum(last, ends[of] - depth) if len(of) else last
        real = first <= last
        first, last, at, h = first[real], last[real], at[real], h[real]
        new = cuts(at)
        self.first, self.last, self.at, self.h = first[new], last[np.append(new[1:], len(at)) - 1] if len(at) else last, at[new], h[new]

    @staticmethod
    def _block(data: np.ndarray, start: int, stop: int, depth: int, leader: int) -> tuple[np.ndarray, ...]:
        """(first window, last window, leader's place, leader's hash) of the runs of the windows from `start`."""
        h = _window_hashes(data[start : stop + depth - 1], leader, _BASE)
        # The least hash leads; of equal ones, the first. Places fit the lower bits.
        bits = np.uint64(int(len(h)).bit_length())
        ranked = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_least(ranked, depth - leader + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        first = cuts(place)
        last = np.append(first[1:], len(place)) - 1
        return first + start, last + start, place[first] + start, h[place[first]]


    def windows(self, chosen: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of these strips: their places, and two hashes of each."""
        counts = self.last[chosen] - self.first[chosen] + 1
        at = np.repeat(self.first[chosen] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        data = np.frombuffer(self.text, np.uint8)
        h = np.zeros((2, len(at)), np.uint64)
        for start in range(0, len(data), BLOCK) if len(at) else ():
            low, high = np.searchsorted(at, [start, start + BLOCK])
            if low < high:
                part = data[start : start + BLOCK + depth - 1]
                for i, base in enumerate((_BASE, _OTHER_BASE)):
                    h[i, low:high] = _window_hashes(part, depth, base)[at[low:high] - start]
        return at, h[0], h[1]

    def low(self) -> np.ndarray:
        """Short hashes of the leaders; a false match only costs time."""
        return (self.h & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def bucket(self, buckets: int) -> np.ndarray:
        return ((self.h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def repeated_suffixes(text: bytes, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each of these places of a text, whether its `depth` bytes also begin at another of them: a radix sort by
    most significant digits, through `depth` bytes and no further."""
    data = np.frombuffer(text + bytes(DIGIT), np.uint8)
    words = np.lib.stride_tricks.as_strided(data[:DIGIT].view(">u8"), (len(data) - DIGIT + 1,), (1,))
    order = np.arange(len(starts))
    first = np.zeros(min(len(starts), 1), np.int64)  # where groups begin
    for at in range(0, depth, DIGIT):
        sizes = np.diff(first, append=len(order))
        alone = sizes < 2
        if alone.any():
            order = order[np.repeat(~alone, sizes)]
            sizes = sizes[~alone]
            first = np.cumsum(sizes) - sizes
        if not len(order):
            break
        digit = words[starts[order] + at].astype(np.uint64)
        if depth - at < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + at))
        split = np.repeat(np.minimum.reduceat(digit, first) != np.maximum.reduceat(digit, first), sizes)
        if split.any():
            group = np.repeat(np.arange(len(first)), sizes)
            some = np.flatnonzero(split)
            inside = some[np.lexsort((digit[some], group[some]))]
            order[some], digit[some] = order[inside], digit[inside]
            first = cuts(group, digit)
    out = np.zeros(len(starts), bool)
    sizes = np.diff(first, append=len(order))
    out[order[np.repeat(sizes > 1, sizes)]] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


_STRIP = "bucket int, slice long, at array<int>, n array<int>, lead int, data binary, h array<long>, keys array<long>, ties array<long>, sizes array<int>"
_STRIP_NAMES = [x.split()[0] for x in _STRIP.split(", ")]
_FOUND = "slice long, at array<int>, n array<int>, keys array<long>, ties array<long>, sizes array<int>"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_SPANS = "k long, t long, at array<int>, n array<int>"


def _ship(number: int, documents: tuple[pa.Array, ...], strips: Strips, chosen: np.ndarray, depth: int, buckets: int, sent: dict[bytes, int]) -> pa.RecordBatch:
    """Rows for buckets: each different strip over a repeated leader. A task sends a strip at most twice, the second
    time as a witness without a place; further ones are told here. The last row holds what the slice knows of itself."""
    first, last, at = strips.first[chosen].tolist(), strips.last[chosen].tolist(), strips.at[chosen].tolist()
    bucket = ((strips.h[chosen] >> np.uint64(20)) % np.uint64(buckets)).tolist()
    rows: list[tuple] = []
    told: list[tuple[int, int]] = []
    for a, b, lead, to in zip(first, last, at, bucket):
        data = strips.text[a : b + depth]
        times = sent.get(data, 0)
        if times:
            told.append((a, b - a + 1))
        if times < 2:
            rows.append((to, None if times else [a], None if times else [b - a + 1], lead - a, data))
            if len(sent) >= REMEMBERED:
                del sent[next(iter(sent))]
            sent[data] = times + 1
    own = [np.array([x[i] for x in told], np.int64) for i in range(2)]
    if len(own[0]):  # strips that follow each other are one run of windows
        new = np.append(True, own[0][1:] != own[0][:-1] + own[1][:-1])
        own = [own[0][new], np.add.reduceat(own[1], np.flatnonzero(new))]
    to, place, size, lead, data = zip(*rows) if rows else ((), (), (), (), ())
    n = len(rows)
    ints = pa.list_(INT)
    columns = [
        (pa.array(to, INT), pa.array([number % buckets], INT)),
        (pa.array([number] * n, LONG), pa.array([number], LONG)),
        (pa.array(place, ints), pa.array([own[0].tolist()], ints)),
        (pa.array(size, ints), pa.array([own[1].tolist()], ints)),
        (pa.array(lead, INT), pa.array([None], INT)),
        (pa.array(data, pa.binary()), pa.array([None], pa.binary())),
        (pa.nulls(n, pa.list_(LONG)), pa.nulls(1, pa.list_(LONG))),
        *((pa.nulls(n, pa.list_(x.type)), pa.ListArray.from_arrays(pa.array([0, len(x)], INT), x)) for x in documents),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], _STRIP_NAMES)


def _ones(lists: pa.Array) -> pa.Array:
    """Lists of ones, as long as these."""
    return pa.ListArray.from_arrays(lists.offsets, pa.array(np.ones(len(lists.values), np.int32)))


def _as_strips(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Hashes of windows in the form of strips; each place is one window."""
    held = {x: rows.column(x) for x in rows.schema.names} | {"lead": pa.nulls(len(rows), INT), "data": pa.nulls(len(rows), pa.binary()), "n": _ones(rows.column("at"))}
    return pa.RecordBatch.from_arrays([held[x] for x in _STRIP_NAMES], _STRIP_NAMES)


def _sorted_bucket(group: pa.Table, depth: int, leader: int) -> pa.Table:
    """For each slice, the runs of windows of its strips that repeat anywhere; what slices know passes on."""
    own = group.filter(pc.is_valid(group.column("data")))
    hashed = repeated_in_bucket(group.filter(pc.is_valid(group.column("h")))).combine_chunks()
    by_hash = hashed.append_column("n", _ones(hashed.column("at").combine_chunks()) if len(hashed) else pa.nulls(0, pa.list_(INT)))
    leads, slices, places = own.column("lead").to_pylist(), own.column("slice").to_pylist(), own.column("at").to_pylist()
    number: dict[bytes, int] = {}
    times: list[int] = []
    led: dict[bytes, list[int]] = {}
    strips = []
    for data, lead in zip(own.column("data").to_pylist(), leads):
        i = number.setdefault(data, len(times))
        if i == len(times):
            times.append(0)
            led.setdefault(data[lead : lead + leader], []).append(i)
        times[i] += 1
        strips.append(i)
    # Only strips that share their leader with a different one can hold windows of each other.
    text = list(number)
    flags = [np.full(len(x) - depth + 1, n > 1) for x, n in zip(text, times)]
    mixed_ = [i for group_ in led.values() if len(group_) > 1 for i in group_]
    if mixed_:
        sizes = np.array([len(text[i]) for i in mixed_])
        begin = np.cumsum(sizes) - sizes
        counts = sizes - depth + 1
        starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        repeated = repeated_suffixes(b"".join(text[i] for i in mixed_), starts, depth)
        for i, x in zip(mixed_, np.split(repeated, np.cumsum(counts)[:-1])):
            flags[i] |= x
    spans = [_runs(x) for x in flags]
    found = [(of, (spans[i][0] + at[0]).tolist(), spans[i][1].tolist()) for of, at, i in zip(slices, places, strips) if at is not None and len(spans[i][0])]
    of, at, n = zip(*found) if found else ((), (), ())
    ints = pa.list_(INT)
    none = [pa.nulls(len(found), pa.list_(x)) for x in (LONG, LONG, INT)]
    own_knowledge = group.filter(pc.and_(pc.is_null(group.column("data")), pc.is_null(group.column("h"))))
    by_sort = pa.table([pa.array(of, LONG), pa.array(at, ints), pa.array(n, ints), *none], _FOUND_NAMES)
    return pa.concat_tables([x.select(_FOUND_NAMES) for x in (by_sort, by_hash, own_knowledge)])


def _spans_of_slice(group: pa.Table) -> pa.Table:
    """(k, t, at, n): the runs of repeated windows of each document of a slice that has any."""
    keys, ties, sizes = slice_directory(group)
    at, n = flat(group.column("at")), flat(group.column("n"))
    order = np.argsort(at, kind="stable")
    row, pos = by_document(at[order], sizes)
    starts = cuts(row)
    edges = np.append(starts, len(row))
    return pa.table([pa.array(keys[row[starts]], LONG), pa.array(ties[row[starts]], LONG), ragged(pos, edges, INT), ragged(n[order], edges, INT)], ["k", "t", "at", "n"])


def _spans(n: int, at: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the maximal runs of bytes that these runs of windows cover, in a text of n bytes."""
    over = np.zeros(n + 1, np.int64)
    np.add.at(over, at, 1)
    np.add.at(over, at + counts - 1 + depth, -1)
    begin, size = _runs(np.cumsum(over)[:-1] > 0)
    return begin, begin + size


_NO_DOCUMENTS = pa.array([], LONG), pa.array([], LONG), pa.array([], INT)
_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept "


def remove_repeated_bytes(
    docs: DataFrame,
    depth: int = DEPTH,
    leader: int = LEADER,
    doc_id: str = "doc_id",
    text: str = "text",
    leader_bucket: int = LEADER_BUCKET,
    strip_bucket: int = STRIP_BUCKET,
    frequent_from: int = FREQUENT_FROM,
    digest: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row of `docs`. `spans` are the maximal runs of bytes removed from
    the UTF-8 text, `kept` the bytes left (binary, as a cut may lie inside a character), or with `digest` the SHA-256
    of them in hexadecimal digits.

    A byte goes if a string of `depth` bytes over it also begins at another place, of the same or another row; strings
    are those of the input, may overlap, and never cross texts. A null text is empty; a null id stays null; rows with
    the same id (or none) are different rows, and equal rows repeat each other; an empty table gives an empty one.
    Other columns are left out.
    """
    if not 0 < leader <= depth:
        raise ValueError("a leader is a part of the window")
    rows = distinguished(docs, doc_id, text)
    long = F.octet_length("text") >= depth
    leader_buckets, strip_buckets = bucket_count(docs, text, leader_bucket), bucket_count(docs, text, strip_bucket)

    def leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        for number, part in numbered(batches, SLICE):
            strips = Strips([x.encode() for x in part.column("text").to_pylist()], depth, leader)
            yield entries(number, directory(part, strips.sizes), strips.at, strips.low(), strips.bucket(leader_buckets), leader_buckets, told)
        yield counted_again(told, np.uint32)

    sent = rows.where(long).select("key", "tie", "text").mapInArrow(leaders, entry_schema("int"))
    places, frequent = places_and_frequent(sent, frequent_from, MOST_FREQUENT)

    def result(part: pa.RecordBatch, texts: list[bytes], spans: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
        kept = [b"".join(x[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(x)])) for x, (begins, ends) in zip(texts, spans)]
        edges = np.cumsum([0, *(len(b) for b, _ in spans)])
        flat_spans = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in spans)]) for i in range(2)]
        pairs = pa.StructArray.from_arrays([pa.array(x, LONG) for x in flat_spans], ["begin", "end"])
        return [
            part.column("doc_id"),
            pa.array([len(x) for x in texts], LONG),
            pa.array([int((e - b).sum()) for b, e in spans], LONG),
            pa.ListArray.from_arrays(pa.array(edges, INT), pairs),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary()),
        ]

    schema = _RESULT + ("string" if digest else "binary")
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a repeated leader are finished; the others take their text along."""
        for part in text_slices(batches, limit=SLICE):
            open_ = part.column("pos").is_valid()
            done = part.filter(pc.invert(open_))
            left = part.filter(open_)
            texts = [x.encode() for x in done.column("text").to_pylist()]
            carried = [left.column(x) for x in ("key", "tie", "doc_id", "text", "pos")]
            finished = result(done, texts, [nothing] * len(texts))
            lines = [pa.concat_arrays([pa.nulls(len(done), x.type), x]) for x in carried]
            lines += [pa.concat_arrays([x, pa.nulls(len(left), x.type)]) for x in finished[1:]]
            lines[2] = pa.concat_arrays([finished[0], carried[2]])
            yield pa.RecordBatch.from_arrays(lines, ["key", "tie", "doc_id", "text", "pos", *names[1:]])

    joined = rows.where(long).join(places, of_row(), "left").select("key", "tie", "doc_id", "text", "pos")
    short = rows.where(~long).select("key", "tie", "doc_id", "text", F.lit(None).cast("array<int>").alias("pos"))
    step_schema = "key long, tie long, doc_id long, text string, pos array<int>, " + schema.removeprefix("doc_id long, ")
    step = settled(joined.unionByName(short).mapInArrow(split, step_schema))
    unfinished = step.where("text is not null")

    def ship(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        told = Told()
        for number, part in numbered(batches, SLICE):
            strips = Strips([x.encode() for x in part.column("text").to_pylist()], depth, leader)
            lists = part.column("pos")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            begins = np.repeat(np.cumsum(strips.sizes) - strips.sizes, counts)
            chosen = np.flatnonzero(np.isin(strips.at, begins + lists.flatten().to_numpy()))
            leaders = identity(strips.low()[chosen], strips.bucket(leader_buckets)[chosen])
            often = np.isin(leaders, frequent)
            yield _ship(number, directory(part, strips.sizes), strips, chosen[~often], depth, strip_buckets, sent)
            if often.any():
                at, h, other = strips.windows(chosen[often], depth)
                bucket = (other % np.uint64(strip_buckets)).astype(np.int64)
                yield _as_strips(entries(number, _NO_DOCUMENTS, at, h, bucket, strip_buckets, told))

    def sort(group: pa.Table) -> pa.Table:
        return _sorted_bucket(group, depth, leader)

    shipped = unfinished.select("key", "tie", "text", "pos").mapInArrow(ship, _STRIP)
    by_slice = shipped.groupBy("bucket").applyInArrow(sort, _FOUND).groupBy("slice").applyInArrow(_spans_of_slice, _SPANS)
    # Rows that are equal in everything may stand in two slices.
    sets = by_slice.groupBy("k", "t").agg(F.collect_set(F.struct("at", "n")).alias("found"))
    spans = settled(sets.select("k", "t", F.flatten("found.at").alias("at"), F.flatten("found.n").alias("n")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE):
            texts = [x.encode() for x in part.column("text").to_pylist()]
            found = [
                _spans(len(x), at.values.to_numpy(), n.values.to_numpy(), depth) if at.is_valid else nothing
                for x, at, n in zip(texts, part.column("at"), part.column("n"))
            ]
            yield pa.RecordBatch.from_arrays(result(part, texts, found), names)

    last = unfinished.select("key", "tie", "doc_id", "text").join(spans, of_row(), "left").select("doc_id", "text", "at", "n")
    return step.where("text is null").select(*names).unionByName(last.mapInArrow(cut, schema))
