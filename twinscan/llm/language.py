"""Language by hyperdimensional profiles of letter n-grams.

Each letter has a random vector of +1 and -1. An n-gram is bound by multiplying its letters' vectors, each
permuted (rotated) by its place, so order counts. Bundling (adding) the vectors of a text's n-grams gives its
profile; the sum over a language's training texts is its prototype. A text gets the language whose prototype
has the largest cosine with its profile.

Other characters than letters become one space between words. Latin letters have a vector each, all others
share `OTHERS` vectors by their code point, so any script works.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import text_slices
from twinscan.llm.encoding import forget

DIMENSIONS = 1_024
NGRAM = 3
#: Training texts, about; taken by a hash of the id, so the choice depends on nothing else.
TRAINING_DOCUMENTS = 20_000
OTHERS = 64
UNDETERMINED = "und"

_LATIN_END = 0x250
_SYMBOLS = _LATIN_END + OTHERS
#: N-grams bound at once, which bounds memory for very long texts.
_AT_ONCE = 4_096


class Space:
    """Letter vectors and what is computed from them; equal for equal parameters, everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS, ngram: int = NGRAM, seed: int = 7) -> None:
        self.dimensions, self.ngram, self.seed = dimensions, ngram, seed
        letters = np.random.default_rng(seed).integers(0, 2, (_SYMBOLS, dimensions), np.int8) * 2 - 1
        self.placed = [np.roll(letters, ngram - 1 - i, axis=1) for i in range(ngram)]

    def __reduce__(self):
        return _space, (self.dimensions, self.ngram, self.seed)  # made anew in each worker, once

    def symbols(self, text: str) -> np.ndarray:
        """Symbol of each letter, and 0 for any stretch of other characters, also at both ends."""
        data = f" {text.lower()} "
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = np.where(points < _LATIN_END, points, _LATIN_END + points % OTHERS)
        symbol[~_letters(data, points)] = 0
        return symbol[np.concatenate([[True], (symbol[1:] != 0) | (symbol[:-1] != 0)])]

    def grams(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different n-grams as numbers, and how often each occurs."""
        n = len(symbols) - self.ngram + 1
        code = np.zeros(max(n, 0), np.int64)
        for i in range(self.ngram):
            code = code * _SYMBOLS + symbols[i : i + max(n, 0)]
        return np.unique(code, return_counts=True)

    def profile(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bundle of bound n-gram vectors."""
        total = np.zeros(self.dimensions)
        for a in range(0, len(grams), _AT_ONCE):
            code = grams[a : a + _AT_ONCE]
            bound = None
            for i in range(self.ngram):
                vector = self.placed[i][code // _SYMBOLS ** (self.ngram - 1 - i) % _SYMBOLS]
                bound = vector if bound is None else np.multiply(bound, vector, out=bound)
            total += counts[a : a + _AT_ONCE].astype(np.float32) @ bound.astype(np.float32)
        return total


@lru_cache(maxsize=4)
def _space(dimensions: int, ngram: int, seed: int) -> Space:
    return Space(dimensions, ngram, seed)


_IS_LETTER = np.zeros(_LATIN_END, bool)
_IS_LETTER[[i for i in range(_LATIN_END) if chr(i).isalpha()]] = True


def _letters(data: str, points: np.ndarray) -> np.ndarray:
    known = np.zeros(len(points), bool)
    latin = points < _LATIN_END
    known[latin] = _IS_LETTER[points[latin]]
    for i in np.flatnonzero(~latin).tolist():
        known[i] = data[i].isalpha()
    return known


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", space: Space | None = None) -> dict[str, np.ndarray]:
    """Prototype of each language of `docs`: tasks bundle their texts, and one vector a language and task is
    added up by dimension. Rows with null text or language, or without letters, teach nothing."""
    space = space or Space()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums: dict[str, np.ndarray] = {}
        for rows in text_slices(batches):
            symbols: dict[str, list[np.ndarray]] = {}
            for name, x in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                found = space.symbols(x)
                if found.any():
                    symbols.setdefault(name, []).append(found)
            for name, parts in symbols.items():
                sums[name] = sums.get(name, 0) + space.profile(*space.grams(np.concatenate(parts)))
        for name, total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(total)], ["lang", "dim", "value"])

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    parts = known.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    prototypes: dict[str, np.ndarray] = {}
    for row in parts.toLocalIterator():  # a vector of fixed length for each language
        prototypes.setdefault(row["lang"], np.zeros(space.dimensions))[row["dim"]] = row["value"]
    return dict(sorted(prototypes.items()))


def predict(
    docs: DataFrame, prototypes: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), space: Space | None = None
) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of each row of `docs`.

    `score` is the largest cosine, at least 0 and at most 1; equal cosines give the first language in order.
    A text that is null or has no letter is `und` with score 0, and so is any text if there is no prototype.
    Repeated rows give repeated results; other columns than `keep` are left out.
    """
    space = space or Space()
    names = list(prototypes)
    table = np.array([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in names]).reshape(len(names), space.dimensions)
    columns = [doc_id, *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in text_slices(batches, "text_"):
            best: list[str] = []
            scores: list[float] = []
            for x in rows.column("text_").to_pylist():
                symbols = space.symbols(x or "")
                if not names or not symbols.any():
                    best.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                profile = space.profile(*space.grams(symbols))
                cosines = table @ profile / (np.linalg.norm(profile) or 1.0)
                at = int(np.argmax(cosines))
                best.append(names[at])
                scores.append(float(min(1.0, max(0.0, cosines[at]))))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(best, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    chosen = docs.select(*columns, F.col(text).cast("string").alias("text_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "text_"), "lang_pred string, score double"])
    return chosen.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """A fifth of the ids by checksum, and null ids: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_part(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", bound: int = TRAINING_DOCUMENTS) -> DataFrame:
    """About `bound` labelled documents that are not held out, taken by a hash of the id."""
    usable = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id))
    share = bound / max(1, usable.count())
    return usable if share >= 1 else usable.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000))
