"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced.

Method: a text longer than `chunk` characters is cut at fixed places into chunks that overlap. Each is
encoded with offsets. Two neighbours are spliced at a place where both start a pre-token and that lies
further than `guard` from both cuts. Such a place is proven stable if its character is ASCII or stands behind ASCII
white space: neither joins the text before it in normalisation, pre-tokens are matched left to right without looking
back, so the left chunk is right up to that place, and the right chunk is right from it on. Where the overlap holds no
such place, it is widened to the left, twice as much each time; where the whole left chunk holds none, that chunk is
made anew, twice as long. So what is encoded again is in proportion to the text, whatever its script.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from twinscan.llm.common import chosen, text_slices
from twinscan.llm.encoding import WordEncoder, encoder

CHUNK = 32_768
OVERLAP = 2_048
#: Longer than any special string, so none is cut in two beyond it.
GUARD = 64
_SPACE = " \t\n\x0b\x0c\r"


class _Chunk:
    """Encoding of text[start:stop]: absolute starts of its tokens, and which of them begin a pre-token."""

    def __init__(self, tokenizer, text: str, start: int, stop: int) -> None:
        encoded = tokenizer.encode(text[start:stop], add_special_tokens=False)
        self.start, self.stop = start, stop
        self.ids = np.array(encoded.ids, np.uint32)
        self.starts = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0] + start
        words = np.array([-1 if x is None else x for x in encoded.word_ids], np.int64)
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        self.edges = self.starts[fresh]


def _common(text: str, left: _Chunk, right: _Chunk, guard: int) -> int | None:
    both = np.intersect1d(left.edges, right.edges)
    both = both[(both >= right.start + guard) & (both <= left.stop - guard)]
    return next((int(p) for p in both[::-1] if text[p].isascii() or p and text[p - 1] in _SPACE), None)


def encode_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> np.ndarray:
    """Ids of a text of any length, as encoding it in one piece would give them."""
    n = len(text)
    left = _Chunk(tokenizer, text, 0, min(n, chunk))
    done: list[np.ndarray] = []
    while left.stop < n:
        wide, at = overlap, None
        while at is None and wide < left.stop - left.start:
            right = _Chunk(tokenizer, text, left.stop - wide, min(n, left.stop + chunk))
            at, wide = _common(text, left, right, guard), wide * 2
        if at is None:  # its beginning is stable, nothing behind it
            left = _Chunk(tokenizer, text, left.start, min(n, 2 * left.stop - left.start))
            continue
        done.append(left.ids[left.starts < at])
        keep = right.starts >= at
        right.ids, right.starts, right.edges, right.start = right.ids[keep], right.starts[keep], right.edges[right.edges >= at], at
        left = right
    return np.concatenate([*done, left.ids])


def count_tokens(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of `docs`, by the word_bpe vocabulary in the file `path`.

    No shuffle; memory is bounded by a slice of rows or one text. A null text counts as empty (0, 0), a
    null id stays null, repeated rows give repeated results, an empty table an empty one, and other columns
    are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, WordEncoder)
        for rows in text_slices(batches):
            texts = rows.column("text")
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            long = np.flatnonzero(lengths > chunk)
            short = texts if not len(long) else pc.if_else(pc.greater(pc.utf8_length(texts), chunk), "", texts)
            counts = words.count(short)
            for i in long:
                counts[i] = len(encode_long(words.tokenizer, texts[int(i)].as_py(), chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return chosen(docs, doc_id, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
