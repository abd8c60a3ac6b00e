"""Removal of test items from training texts with a generalised suffix automaton over words.

All normalised test items go into one automaton whose letters are words. A training text is streamed through
it; at each word the automaton holds the longest run ending there that occurs in some item. A run of at
least `window` words, or one that ends with a whole shorter item, is hit, and the items it occurs in are read
from the state. Before streaming, stretches are left out in which no item has the neighbouring words next to
each other: no match can reach over such a place.

Words are compared as UTF-8 bytes after A-Z is lowered; all ASCII characters but letters and digits separate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import text_slices

WINDOW = 10
#: Words of test items in one automaton (about 1 kB each). A larger test set is worked through in blocks.
BLOCK_WORDS = 200_000

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Normalised words."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with what is needed to tell windows and items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str | None] = []
        ends: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        pairs = set()
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            ids = [self.words.setdefault(w, len(self.words)) for w in words]
            pairs.update(zip(ids, ids[1:]))
            self.shortest = min(self.shortest, len(ids))
            last = 0
            path = []
            for w in ids:
                last = self._extend(last, w)
                path.append(last)
            if len(ids) < window:
                whole[last] = whole.get(last, set()) | {item}
            else:
                for state in path[window - 1 :]:
                    ends.setdefault(state, set()).add(item)
        # A state met at the end of a prefix may have been cloned since: the item belongs to all states above it.
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for state in order:
            if state in ends and self.length[self.link[state]] >= window:
                ends.setdefault(self.link[state], set()).update(ends[state])
        self.ends = ends
        # Short items that end wherever a state ends, from its suffixes.
        self.short: list[frozenset[tuple[int, int]]] = [frozenset()] * len(self.link)
        for state in reversed(order):
            own = frozenset((self.length[state], i) for i in whole.get(state, ()))
            self.short[state] = self.short[self.link[state]] | own if own else self.short[self.link[state]]
        self.pairs = np.array(sorted(a * len(self.words) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        """Append `w` to the sequence that ends in `last`; the state of the longer sequence."""
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def matches(self, ids: np.ndarray, hit: np.ndarray) -> set[int]:
        """Mark the hit words of one text in `hit`; the items found. Unknown words are -1."""
        found: set[int] = set()
        known = ids >= 0
        if not len(ids) or not known.any():
            return found
        code = ids[:-1] * len(self.words) + ids[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined = (self.pairs[at] == code) & known[:-1] & known[1:]
        else:
            joined = np.zeros(len(code), bool)
        begins = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        long = stops - begins >= self.shortest
        seen: set[int] = set()
        for a, b in zip(begins[long].tolist(), stops[long].tolist()):
            self._stream(ids[a:b].tolist(), a, hit, seen, found)
        for state in seen:
            found |= self.ends.get(state, set())
        return found

    def _stream(self, ids: list[int], first: int, hit: np.ndarray, seen: set[int], found: set[int]) -> None:
        state = length = 0
        link, size, step, window = self.link, self.length, self.next, self.window
        for i, w in enumerate(ids, first + 1):
            while state and w not in step[state]:
                state = link[state]
                length = size[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= window:
                hit[i - window : i] = True  # the words before are marked already
                top = state
                while size[link[top]] >= window:
                    top = link[top]
                seen.add(top)
            if self.short[state]:
                for n, item in self.short[state]:
                    if n <= length:
                        hit[i - n : i] = True
                        found.add(item)


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Test items in blocks of about `block_words` words, read one partition at a time."""
    block: list[tuple[str | None, list[bytes]]] = []
    total = 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        words = words_of(row[1])
        if total and total + len(words) > block_words:
            yield block
            block, total = [], 0
        block.append((row[0], words))
        total += len(words)
    yield block


def find_test_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
    clean: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, n_words, n_hit, items, spans[, cleaned]) of each row of `docs`.

    `items` are the ids of the test items of which a window of `window` words (or the whole item, if it is
    shorter) occurs, as sorted distinct strings; items without id hit words but are not listed. `spans` are
    maximal runs of hit words as (start, stop) word numbers. `cleaned` is the text without its hit words, cut
    from the first byte of a span's first word to the last byte of its last.

    A null text has no words, a null id stays null, repeated rows give repeated results, empty tables give no
    hits or no rows, other columns are left out. No shuffle: the test set is sent to all tasks in blocks of
    bounded size, and each text meets one block after the other.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_id, item_text, block_words)]

    def automata(cache: dict[int, SuffixAutomaton]) -> Iterator[SuffixAutomaton]:
        for i, block in enumerate(blocks):
            if i not in cache:
                cache.clear()  # one at a time
                cache[i] = SuffixAutomaton(block.value, window)
            yield cache[i]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, SuffixAutomaton] = {}
        for rows in text_slices(batches):
            texts = rows.column("text").to_pylist()
            words = [words_of(x) for x in texts]
            hits = [np.zeros(len(w), bool) for w in words]
            named: list[set[str]] = [set() for _ in words]
            for automaton in automata(cache):
                get = automaton.words.get
                for w, hit, names in zip(words, hits, named):
                    ids = np.array([get(x, -1) for x in w], np.int64)
                    names.update(n for i in automaton.matches(ids, hit) if (n := automaton.names[i]) is not None)
            spans = [_runs(h) for h in hits]
            columns = [
                *(rows.column(c) for c in ("doc_id", *keep)),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([int(h.sum()) for h in hits], pa.int64()),
                pa.array([sorted(n) for n in named], pa.list_(pa.string())),
                pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ]
            out = ["doc_id", *keep, "n_words", "n_hit", "items", "spans"]
            if clean:
                columns.append(pa.array([_without(x, s) if s else x for x, s in zip(texts, spans)], pa.string()))
                out.append("cleaned")
            yield pa.RecordBatch.from_arrays(columns, out)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"doc_id long{kept}, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"
    return rows.mapInArrow(run, schema + ", cleaned string" * clean)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes of these runs of words."""
    data = text.encode()
    kept = np.frombuffer(data.translate(_KEEP), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = int(stops[b - 1])
    return b"".join([*out, data[at:]]).decode()
