"""Token ids of whole texts by the tokenizers library, with pieces remembered between texts.

Both vocabularies cut a text into pre-tokens before merging, and no pre-token reaches over certain
places, so a text may be cut there and the parts encoded alone, whatever surrounds them:

* word_bpe: at white space, which the pre-tokenizer drops (normalisation never joins over it);
* byte_bpe: before a space that follows a character that is no white space (only the first character of
  a pre-token may be a space, and its white-space look-ahead sees nothing beyond a run of white space).

Special strings hold no white space, so they stay inside one part and act as the library handles them.
Parts repeat far more than texts do; each worker remembers the ids of a bounded number of them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker remembers.
REMEMBERED = 500_000
#: Longer parts are encoded but not remembered.
LONGEST_KEPT = 64

_DOUBLE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_EDGE = "\x00"
# Fixed value: the published pre-token pattern of this vocabulary.
_BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Plain: characters up to U+024F whose lower case and class are the same in Python and in the library.
_NOT_PLAIN = re.compile("[^!-}\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]|<\\|")
_RUN = re.compile("[^a-z\xdf-\xf6\xf8-\u017f]*[a-z\xdf-\xf6\xf8-\u017f]+|[^a-z\xdf-\xf6\xf8-\u017f]+")
#: Stands between new runs; one token of its own, and in no plain part.
#: Stands between new runs; one token of its own, and in no plain part.
_MARK = "~"


def word_parts(texts: pa.Array) -> pa.ListArray:
    """Parts for word_bpe."""
    return pc.ascii_split_whitespace(texts)


def _edged(text: str) -> str:
    if _EDGE in text:
        return text.replace(_EDGE, _EDGE * 2)
    return _CUT.sub(_EDGE, text) if _DOUBLE.search(text) else text.replace(" ", _EDGE + " ")


def byte_parts(texts: pa.Array) -> pa.ListArray:
    """Parts for byte_bpe: each but the first begins with the space it follows. A text that holds the
    edge sign itself stays in one part."""
    values = texts.to_pylist()
    parts = pc.split_pattern(pa.array(map(_edged, values), pa.large_string()), _EDGE)
    odd = [i for i, x in enumerate(values) if _EDGE in x]
    if not odd:
        return parts
    lists = parts.to_pylist()
    for i in odd:
        lists[i] = [values[i]]
    return pa.array(lists, pa.large_list(pa.large_string()))


def load(path: str):
    """The tokenizer of a file, single-threaded: Spark runs one task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Kept:
    """Ids of strings, in one array. The first `limit` strings stay; further ones, and very long ones, only
    until `settle` is called for the next texts."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.extra: list[str] = []
        self.staying: tuple[int, int] | None = None

    def settle(self) -> None:
        for x in self.extra:
            self.place.pop(x, None)
        self.extra = []
        if self.staying:
            n, m = self.staying
            self.starts, self.lengths, self.flat = self.starts[:n], self.lengths[:n], self.flat[:m]
            self.staying = None

    def missing(self, strings: list[str]) -> list[str]:
        """Those not known. If most are not, the texts have changed: start afresh."""
        new = [x for x in strings if x not in self.place]
        if len(new) * 2 > len(strings) and len(self.place) >= self.limit:
            self.clear()
            return strings
        return new

    def add(self, strings: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        if self.staying is None and len(self.starts) + len(strings) > self.limit:
            self.staying = len(self.starts), len(self.flat)
        self.extra += strings if self.staying else [x for x in strings if len(x) > LONGEST_KEPT]
        self.place.update(zip(strings, range(len(self.starts), len(self.starts) + len(strings))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def places(self, strings: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, n)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places in a row, and the running total of their numbers (from 0)."""
        lengths = self.lengths[places]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.starts[places] - total[:-1], lengths) + np.arange(total[-1])], total


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


class PartEncoder:
    """Encodes texts exactly as `Tokenizer.encode(text, add_special_tokens=False)` does."""

    parts = staticmethod(word_parts)

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.tokenizer = load(path)
        self.kept = _Kept(remembered)

    def _learn(self, parts: list[str]) -> None:
        """Encode these parts and remember them."""
        self.kept.add(parts, *_flat([x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]))

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all parts, and the ends of the texts among them."""
        cut = self.parts(texts)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        coded = cut.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.kept.settle()
        if new := self.kept.missing(different):
            self._learn(new)
        return self.kept.places(different, len(different))[coded.indices.to_numpy(zero_copy_only=False)], ends

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null counts as empty."""
        places, ends = self._places(pc.fill_null(texts, ""))
        total = np.concatenate([[0], np.cumsum(self.kept.lengths[places])])
        return np.diff(total[ends], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text; null counts as empty."""
        places, ends = self._places(pc.fill_null(texts, ""))
        ids, total = self.kept.gather(places)
        return ids, np.diff(total[ends], prepend=0)


class WordEncoder(PartEncoder):
    """word_bpe. Parts of plain Latin letters are lower-cased and cut behind each run of letters, which
    always ends a pre-token; these runs repeat most, and many new ones are encoded in one call."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(path, remembered)
        self.runs = _Kept(remembered)
        self.mark, *rest = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.marked = not rest

    def _learn(self, parts: list[str]) -> None:
        plain = [x for x in parts if not _NOT_PLAIN.search(x)] if self.marked else []
        if len(plain) < len(parts):
            known = set(plain)
            super()._learn([x for x in parts if x not in known])
        if not plain:
            return
        runs = [_RUN.findall(x.lower()) for x in plain]
        counts = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        self.runs.settle()
        if new := self.runs.missing(list(set(chain.from_iterable(runs)))):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join([*new, ""])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            self.runs.add(new, ids[ids != self.mark], np.diff(at, prepend=-1) - 1)
        flat, total = self.runs.gather(self.runs.places(chain.from_iterable(runs), int(counts[-1])))
        self.kept.add(plain, flat, np.diff(total[counts], prepend=0))


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else 256 and up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteEncoder(PartEncoder):
    """byte_bpe. If ids follow the order of the merges, tiktoken gives the same ids from the same
    vocabulary, and is faster for single parts; parts that may hold a special string are left to tokenizers."""

    parts = staticmethod(byte_parts)

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        super().__init__(path, remembered)
        import json

        import tiktoken

        with open(path, encoding="utf-8") as handle:
            told = json.load(handle)
        byte_of, vocabulary = _byte_of(), told["model"]["vocab"]
        order = [vocabulary["".join(x if isinstance(x, list) else x.split(" "))] for x in told["model"]["merges"]]
        self.special = [x["content"] for x in told["added_tokens"]]
        self.quick = None
        if order == sorted(order):
            added = set(self.special)
            ranks = {bytes(map(byte_of.__getitem__, k)): i for k, i in vocabulary.items() if k not in added}
            self.quick = tiktoken.Encoding("own", pat_str=_BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, parts: list[str]) -> None:
        if self.quick is None:
            super()._learn(parts)
            return
        own = self.quick.encode_ordinary
        self.kept.add(parts, *_flat([self.tokenizer.encode(x, add_special_tokens=False).ids if any(s in x for s in self.special) else own(x) for x in parts]))


_ENCODERS: dict[tuple[str, type], PartEncoder] = {}


def encoder(path: str, kind: type[PartEncoder]) -> PartEncoder:
    """The worker's encoder, kept between its tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = kind(path)
    return _ENCODERS[path, kind]


def forget() -> None:
    """Drop the worker's encoders with all they remember, and hand back what Arrow holds unused. For steps that encode
    nothing: workers outlive a stage, and what each of its stages remembers would add up."""
    _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
