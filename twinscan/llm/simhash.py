"""SimHash fingerprints and their near-duplicates by tiled exact comparison.

Texts with one fingerprint are one class, so copies cost nothing further. The different fingerprints are
sorted by their population count and then by the counts of their four 16-bit words, and cut into tiles. Two
fingerprints within `radius` bits differ by at most `radius` in their counts, and so do the sums of the
differences of the words' counts; tile pairs, and blocks inside a pair, whose counts lie further apart are
skipped. All others are compared by exclusive-or and bit counts, whole blocks at a time. A task returns a
spanning forest of the links it found, never the pairs; components follow on Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import chosen, materialize, text_slices
from twinscan.llm.components import connected_components
from twinscan.llm.local_groups import Forest

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile (128 kB), and in a block inside it.
TILE, BLOCK = 16_384, 512


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the UTF-8 text: a bit is set if it is in over half of the hashes of the word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = (stops - np.diff(stops, prepend=0))[:n].tolist()
    ends = (stops[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n).astype(">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            found = np.array([fingerprint(x.encode(), shingle, seed) for x in rows.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return chosen(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long")


def _word_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view("<u2").reshape(-1, 4)).astype(np.int64)


def _tiles(classes: DataFrame, tile: int) -> DataFrame:
    """(tile, low, high, fps): runs of the sorted fingerprints; low and high are population counts."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch.column("fp").to_numpy())
            while held and (sum(map(len, held)) >= tile or batch is None):
                rows = np.concatenate(held)
                fps, held = rows[:tile], [rows[tile:]] if len(rows) > tile else []
                counts = np.bitwise_count(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([int(counts.min())], pa.int32()), pa.array([int(counts.max())], pa.int32()), pa.array([fps.tobytes()])],
                    ["tile", "low", "high", "fps"],
                )
                number += 1

    words = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(0xFFFF)) for s in (0, 16, 32)]
    order = [F.bit_count("fp").alias("c"), *[w.alias(f"c{i}") for i, w in enumerate(words)], F.col("fp")]
    names = ["c", "c0", "c1", "c2", "fp"]
    ordered = classes.select(*order).repartitionByRange(*names).sortWithinPartitions(*names)
    return ordered.select("fp").mapInArrow(cut, "tile long, low int, high int, fps binary")


def compare_tiles(a: np.ndarray, b: np.ndarray, same: bool, radius: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (fingerprint, fingerprint) of all pairs within `radius` bits between two tiles, or in one."""
    both = a if same else np.concatenate([a, b])
    base = 0 if same else len(a)
    forest = Forest(len(both))
    boxes = []
    for side in (a, b):
        counts = _word_counts(side)
        cuts = np.arange(0, len(side), block)
        boxes.append((cuts, np.minimum.reduceat(counts, cuts), np.maximum.reduceat(counts, cuts)))
    (cut_a, low_a, high_a), (cut_b, low_b, high_b) = boxes
    apart = np.maximum(0, np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None])).sum(axis=2)
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for i, j in zip(*np.nonzero(apart <= radius)):
        if same and j < i:
            continue
        at, bt = int(cut_a[i]), int(cut_b[j])
        near = np.bitwise_count(ua[at : at + block, None] ^ ub[None, bt : bt + block]) <= radius
        if near.any():
            x, y = np.nonzero(near)
            forest.add(x + at, y + bt + base)
    nodes, roots = forest.edges()
    return both[nodes], both[roots]


def near_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) of fingerprints (column fp, each once): links that join all that are within `radius` bits."""
    spark = classes.sparkSession
    tiles = materialize(_tiles(classes, tile))
    left = tiles.select(F.col("tile").alias("a"), F.explode(F.sequence("low", "high")).alias("c"))
    right = tiles.select(F.col("tile").alias("b"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("c"))
    pairs = left.join(right, "c").where("a <= b").select("a", "b").distinct()
    side_a = tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a"))
    side_b = tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.join(side_a, "a").join(side_b, "b").repartition(partitions, "a", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, fps_a, fps_b in zip(*(batch.column(k) for k in ("a", "b", "fps_a", "fps_b"))):
                one, two = (np.frombuffer(x.as_py(), np.int64) for x in (fps_a, fps_b))
                x, y = compare_tiles(one, two, a.as_py() == b.as_py(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return work.select("a", "b", "fps_a", "fps_b").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", tile: int = TILE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of `docs`.

    component_id is the smallest id reachable over links of at most `radius` bits. Texts without words (null
    ones too) have fingerprint zero and are linked like any other. A null id takes part in links but never
    names a component unless all its members are null. Repeated rows give repeated results, an empty table an
    empty one; other columns are left out.
    """
    prints = materialize(fingerprints(docs, shingle, seed, doc_id, text))
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(classes.select("fp"), radius, tile))
    linked = materialize(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(smallest, "root").select(F.col("fp").alias("of"), "least")
    answers = materialize(classes.join(named, F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(answers, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
