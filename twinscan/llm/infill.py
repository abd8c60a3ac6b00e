"""Fill-in-the-middle transformation over seekable compressed texts.

A text is stored as independent zstandard frames of about `FRAME_CHARS` code points, with the units (tokens)
and code points that begin before each frame. A cut after k units is the place where unit k begins: a search in
those counts names its frame, and only that frame is decompressed to find the place. The transformed text is
then a sequence of byte ranges that stream frame by frame, so a digest never holds more than a frame.

A unit is a run of ASCII letters or one other code point, so units begin at each code point but a letter
behind a letter; a run may go on over any number of frames.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from twinscan.llm.common import chosen, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Code points of a frame.
FRAME_CHARS = 1 << 16
#: Percentages of the contract: texts left plain, and those of the others that begin with the suffix.
PLAIN_FROM, SPM_BELOW = 90, 20

_STORE = (
    "doc_id long, n_units long, n_chars long, n_bytes long, marked boolean, "
    "units array<long>, chars array<long>, bytes array<long>, frames array<binary>"
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Stored(NamedTuple):
    """A text as frames: counts before each frame, and of the whole text."""

    n_units: int
    n_chars: int
    n_bytes: int
    marked: bool
    units: list[int]
    chars: list[int]
    bytes: list[int]
    frames: list[bytes]


def _begins(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes of a UTF-8 text: where code points begin, and where units begin."""
    char = (text & 0xC0) != 0x80
    letter = _LETTER[text]
    unit = char.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return char, unit


def store_text(text: bytes, compressor: zstandard.ZstdCompressor, frame_chars: int = FRAME_CHARS) -> Stored:
    char, unit = _begins(np.frombuffer(text, np.uint8))
    n_chars, n_units = int(np.count_nonzero(char)), int(np.count_nonzero(unit))
    if n_chars <= frame_chars:
        edges = np.zeros(min(n_chars, 1), np.int64)
        units = edges
    else:
        edges = np.flatnonzero(char)[::frame_chars]
        units = np.concatenate([[0], np.cumsum(np.add.reduceat(unit.astype(np.int64), edges))[:-1]])
    starts = edges.tolist()
    ends = [*starts[1:], len(text)]
    return Stored(
        n_units,
        n_chars,
        len(text),
        any(x in text for x in (PREFIX, SUFFIX, MIDDLE)),
        units.tolist(),
        [i * frame_chars for i in range(len(starts))],
        starts,
        [compressor.compress(text[a:b]) for a, b in zip(starts, ends)],
    )


class Frames:
    """Reads a stored text: places of units, and byte ranges."""

    def __init__(self, stored: Stored) -> None:
        self.stored = stored
        self.decompressor = zstandard.ZstdDecompressor()
        self.opened: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.opened[0] != i:
            self.opened = (i, self.decompressor.decompress(self.stored.frames[i]))
        return self.opened[1]

    def place(self, unit: int) -> tuple[int, int]:
        """(code points, bytes) before the unit of this number; behind the last one, the size of the text."""
        s = self.stored
        if unit >= s.n_units:
            return s.n_chars, s.n_bytes
        # Frames inside a run begin no unit and share a count with the next one: the last with it holds the unit.
        i = bisect_right(s.units, unit) - 1
        data = np.frombuffer(self.frame(i), np.uint8)
        char, begins = _begins(data)
        if i and _LETTER[data[0]] and _LETTER[self._last_byte(i - 1)]:
            begins[0] = False
        at = int(np.flatnonzero(begins)[unit - s.units[i]])
        return s.chars[i] + int(np.count_nonzero(char[:at])), s.bytes[i] + at

    def _last_byte(self, i: int) -> int:
        opened = self.opened
        last = self.frame(i)[-1]
        self.opened = opened
        return last

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from `start` to `end`, in order, one frame at a time."""
        s = self.stored
        i = bisect_right(s.bytes, start) - 1
        while start < end:
            stop = min(end, s.bytes[i + 1] if i + 1 < len(s.bytes) else s.n_bytes)
            yield self.frame(i)[start - s.bytes[i] : stop - s.bytes[i]]
            start, i = stop, i + 1


class Infill(NamedTuple):
    """A transformed text: its form, the sizes of its parts, and its pieces (marks, or ranges of the stored text)."""

    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[bytes | tuple[int, int]]


def draws(doc_id: int | None) -> list[int]:
    """The four numbers drawn for a document; one without an id draws as if its id had no digits."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(frames: Frames, doc_id: int | None) -> Infill:
    s = frames.stored
    h1, h2, h3, h4 = draws(doc_id)
    if not s.n_units or s.marked or h3 % 100 >= PLAIN_FROM:
        return Infill(PLAIN, None, None, [(0, s.n_bytes)])
    first, second = sorted((h1 % (s.n_units + 1), h2 % (s.n_units + 1)))
    (a_chars, a), (b_chars, b) = frames.place(first), frames.place(second)
    prefix, middle, suffix = (0, a), (a, b), (b, s.n_bytes)
    if h4 % 100 < SPM_BELOW:
        return Infill(SPM, a_chars, b_chars - a_chars, [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return Infill(PSM, a_chars, b_chars - a_chars, [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def output(frames: Frames, infill: Infill) -> Iterator[bytes]:
    """The transformed text, streamed."""
    for piece in infill.pieces:
        if isinstance(piece, bytes):
            yield piece
        else:
            yield from frames.read(*piece)


def _find(stream: Iterable[bytes], marks: list[bytes]) -> list[int]:
    """Byte places of the first of each of these marks, one behind the other, in a stream."""
    found: list[int] = []
    held, before, done = b"", 0, 0  # `held` begins at byte `before`; bytes below `done` are searched
    for data in stream:
        held += data
        while len(found) < len(marks) and (at := held.find(marks[len(found)], done - before)) >= 0:
            found.append(before + at)
            done = before + at + len(marks[len(found) - 1])
        if len(found) == len(marks):
            break
        cut = max(done - before, len(held) - 2)  # marks have three bytes
        done = max(done, before + cut)
        held, before = held[cut:], before + cut
    return found


def _range(stream: Iterable[bytes], start: int, end: int | None) -> Iterator[bytes]:
    at = 0
    for data in stream:
        if end is not None and at >= end:
            return
        part = data[max(0, start - at) : None if end is None else end - at]
        at += len(data)
        if part:
            yield part


def restore(stream: callable, form: str) -> Iterator[bytes]:
    """The text that was transformed, from the output and its form alone. `stream()` gives the output's bytes
    from its beginning, as often as asked; texts that hold a mark themselves are left plain, so marks are unique."""
    if form == PLAIN:
        yield from stream()
        return
    marks = [PREFIX, SUFFIX, MIDDLE] if form == PSM else [SUFFIX, PREFIX, MIDDLE]
    first, second, third = _find(stream(), marks)
    one, two, middle = (first + 3, second), (second + 3, third), (third + 3, None)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    for part in (prefix, middle, suffix):
        yield from _range(stream(), *part)


def _digest(chunks: Iterable[bytes]) -> str:
    state = hashlib.sha256()
    for x in chunks:
        state.update(x)
    return state.hexdigest()


def write_frames(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", frame_chars: int = FRAME_CHARS) -> None:
    """Store each row of `docs` as compressed frames with counts, in Parquet (which compresses no further).

    A null text is empty and has no frame; a null id stays null; repeated rows and ids stay rows of their own; an
    empty table writes no rows; other columns are left out. No shuffle: one row in, one out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for part in text_slices(batches):
            rows = [store_text(x.encode(), compressor, frame_chars) for x in part.column("text").to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.binary())]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *Stored._fields])

    chosen(docs, doc_id, text).mapInArrow(run, _STORE).write.mode("overwrite").option("compression", "none").parquet(folder)


def infill(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of each stored row.

    `n` counts units; the two sizes are null for a plain row. `restored_sha256` is the digest of the text rebuilt
    from the output and the form. `output` is the transformed text; without `texts` no whole text is ever made.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = []
                for row in batch.slice(start, 256).to_pylist():
                    frames = Frames(Stored(*(row[x] for x in Stored._fields)))
                    made = transform(frames, row["doc_id"])
                    stream = lambda: output(frames, made)  # noqa: B023, E731
                    digests = _digest(stream()), _digest(restore(stream, made.form))
                    rows.append((row["doc_id"], row["n_units"], *made[:3], *digests, *([b"".join(stream()).decode()] if texts else [])))
                long, string = pa.int64(), pa.string()
                kinds = [long, long, string, long, long, string, string] + [string] * texts
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.read.schema(_STORE).parquet(folder).mapInArrow(run, schema)
