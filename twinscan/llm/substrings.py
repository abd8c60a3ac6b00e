"""Removal of word passages that occur more than once, found through difference-cover anchors.

D is a difference cover modulo v: any difference is one of two members. So for two occurrences of a passage,
at any places of any documents, some shift below v takes both to places that are in D modulo v. Only there
are short windows (anchors, `window - v + 1` words) hashed, and any repeated passage of `window` words has an
anchor that both occurrences share. Anchors that occur once end there. The others are extended: each passage
of `window` words that contains a repeated anchor is hashed in full and counted; what occurs twice is removed.

How repeated hashes are found among all documents is told in `repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import text_slices
from twinscan.llm.repeats import LONG, Told, bucket_count, directory, distinguished, entries, entry_schema, mixed, numbered, of_row, powers, repeated_places, settled

WINDOW = 35
# A perfect difference set modulo 21.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

#: UTF-8 bytes of text for one bucket of hashes (about 300 000 anchors).
BUCKET_BYTES = 8 << 20
#: Bytes of text handled at once: larger slices find more repeats before the shuffle.
SLICE = 8 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Words:
    """Word hashes of the texts of a slice in a row, with polynomial hashes of any window."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = [x.split() for x in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w) for ws in self.words for w in ws), np.uint64, int(self.sizes.sum()))
        self.row = np.repeat(np.arange(len(self.words)), self.sizes)
        self.pos = np.arange(len(self.hashes)) - self.starts[self.row]

    def window_hashes(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        """Hashes of the windows of `length` words that begin at these places (of one text each)."""
        base = _BASES[which]
        values = self.hashes if which == 0 else mixed(self.hashes + np.uint64(which))
        factors = powers(base, len(values))
        inverse = powers(pow(base, -1, 1 << 64), len(values))
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * factors[:-1], dtype=np.uint64)])
            return mixed((prefix[at + length] - prefix[at]) * inverse[at])


def _kept(words: list[bytes], gone: list[bool] | None, digest: bool) -> str:
    kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone) if not g])
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    digest: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of `docs`; `kept` are the words left, joined by spaces,
    or with `digest` the SHA-256 of that text in hexadecimal digits.

    A word goes if some passage of `window` words over it also begins at another place, of the same or another
    row; passages are those of the input. Words are what ASCII white space separates, unchanged. A null text
    has no words; a null id stays null; rows with the same id (or none) are different rows, and equal rows
    repeat each other; an empty table gives an empty one. Other columns are left out.
    """
    anchor = window - period + 1
    members = {d % period for d in cover}
    if anchor < 1 or {(a - b) % period for a in members for b in members} != set(range(period)):
        raise ValueError("cover is no difference cover, or the period is too long for the window")
    in_cover = np.isin(np.arange(period), list(members))
    rows = distinguished(docs, doc_id, text)
    buckets = bucket_count(docs, text, bucket_bytes)

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        for number, part in numbered(batches, SLICE):
            words = Words([x.encode() for x in part.column("text").to_pylist()])
            size = words.sizes[words.row]
            at = np.flatnonzero(in_cover[words.pos % period] & (size - words.pos >= anchor) & (size >= window))
            h = words.window_hashes(at, anchor, 0)
            low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # a false match only costs time
            bucket = (h >> np.uint64(32)) % np.uint64(buckets)
            yield entries(number, directory(part, words.sizes), at, low, bucket.astype(np.int64), buckets, told)

    # The shortest texts have too few words, whatever they are; they need neither hashes nor a join.
    long = F.octet_length("text") >= 2 * window - 1
    places = repeated_places(rows.where(long).select("key", "tie", "text").mapInArrow(anchors, entry_schema("int")))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without a repeated anchor are finished; the others take their text along."""
        for part in text_slices(batches, limit=SLICE):
            finished = part.column("pos").is_null().to_pylist()
            words = [x.encode().split() if f else [] for x, f in zip(part.column("text").to_pylist(), finished)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("key", "tie", "doc_id")),
                    pa.array([None if f else x for x, f in zip(part.column("text").to_pylist(), finished)], pa.string()),
                    part.column("pos"),
                    pa.array([len(w) for w in words], LONG),
                    pa.array([_kept(w, None, digest) if f else None for w, f in zip(words, finished)], pa.string()),
                ],
                ["key", "tie", "doc_id", "text", "pos", "n_words", "kept"],
            )

    joined = rows.where(long).join(places, of_row(), "left").select("key", "tie", "doc_id", "text", "pos")
    short = rows.where(~long).select("key", "tie", "doc_id", "text", F.lit(None).cast("array<int>").alias("pos"))
    step = settled(joined.unionByName(short).mapInArrow(split, "key long, tie long, doc_id long, text string, pos array<int>, n_words long, kept string"))
    unfinished = step.where("pos is not null")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full hashes of all passages over a repeated anchor."""
        told = Told()
        for number, part in numbered(batches, SLICE):
            words = Words([x.encode() for x in part.column("text").to_pylist()])
            lists = part.column("pos")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            base, last = np.repeat(words.starts, sizes), np.repeat(words.ends, sizes) - window
            place = base + lists.flatten().to_numpy()
            begin, end = np.maximum(base, place + anchor - window), np.minimum(last, place)
            over = np.zeros(len(words.hashes) + 2, np.int64)
            np.add.at(over, begin[begin <= end], 1)
            np.add.at(over, end[begin <= end] + 1, -1)
            at = np.flatnonzero(np.cumsum(over)[: len(words.hashes)] > 0)
            bucket = (words.window_hashes(at, window, 1) % np.uint64(buckets)).astype(np.int64)
            yield entries(number, directory(part, words.sizes), at, words.window_hashes(at, window, 0), bucket, buckets, told)

    found = repeated_places(unfinished.select("key", "tie", "text", "pos").mapInArrow(extend, entry_schema("long")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SLICE):
            out = []
            for x, at in zip(part.column("text").to_pylist(), part.column("pos")):
                words = x.encode().split()
                over = np.zeros(len(words) + 1, np.int64)
                if at.is_valid:
                    starts = at.values.to_numpy()
                    np.add.at(over, starts, 1)
                    np.add.at(over, starts + window, -1)
                gone = (np.cumsum(over)[:-1] > 0).tolist()
                out.append((len(words), sum(gone), _kept(words, gone, digest)))
            n, lost, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, LONG), pa.array(lost, LONG), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    last = unfinished.select("key", "tie", "doc_id", "text").join(found, of_row(), "left").select("doc_id", "text", "pos")
    done = step.where("pos is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return done.unionByName(last.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string"))
