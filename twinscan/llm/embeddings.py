"""Near-duplicate vectors by PCA-ordered tiled comparison.

Only vectors of one group (label) and one length are compared. Equal vectors are one class first. Unit vectors
are rotated to the principal axes of a bounded sample and each group is cut into tiles along the first axis.
For two tiles the leading coordinates are multiplied first; what the rest could still add is at most the
product of the norms of the two remainders (Cauchy-Schwarz), so pairs that cannot reach the threshold stop
there, and tile pairs further apart along the first axis than the threshold allows are never formed. The
pairs left over are decided by the cosine of the original vectors in double precision. A task returns the
number of links of each vector and a spanning forest, never the pairs.

The rotation only decides where work stops early: any orthogonal matrix gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import materialize
from twinscan.llm.components import connected_components
from twinscan.llm.local_groups import Forest

THRESHOLD = 0.93
#: Vectors from which the axes are found; by a hash, about as many.
SAMPLE = 10_000
TILE = 1_024
#: Leading dimensions after which pairs are tested; then the rest in one step.
STEPS = (8, 24)
#: Room for rounding in the early stops.
SLACK = 1e-6
_AT_ONCE = 1 << 14


def _usable(vector: Column) -> Column:
    """Not null, all components present and finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes, the widest first."""
    if not len(vectors):
        return np.eye(vectors.shape[1])
    values, axes = np.linalg.eigh(vectors.T @ vectors)
    return axes[:, np.argsort(-values, kind="stable")]


def _fit(classes: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Axes for each vector length met among about `sample` vectors taken by a hash; others keep their own."""
    share = sample / max(1, classes.count())
    taken = classes if share >= 1 else classes.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    by_size: dict[int, list[np.ndarray]] = {}
    for row in taken.select("vector").toLocalIterator():
        v = np.array(row[0], np.float64)
        by_size.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {n: principal_axes(np.array(v)) for n, v in by_size.items()}


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with the same row of `b`, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def compare_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, same: bool, threshold: float, steps: tuple[int, ...] = STEPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the linked pairs between two tiles of vectors, or (each pair once) in one, in parts."""
    ra, rb = (x / np.linalg.norm(x, axis=1, keepdims=True) @ axes for x in (a, b))
    tail = [tuple(np.sqrt(np.maximum(0, 1 - np.cumsum(r * r, axis=1)[:, k - 1])) for r in (ra, rb)) for k in steps if k < a.shape[1]]
    cuts = [k for k in steps if k < a.shape[1]]
    if cuts:
        k = cuts[0]
        may = ra[:, :k] @ rb[:, :k].T + np.outer(*tail[0]) >= threshold - SLACK
    else:
        may = np.ones((len(a), len(b)), bool)
    if same:
        may = np.triu(may, 1)
    x, y = np.nonzero(may)
    for i in range(0, len(x), _AT_ONCE):
        p, q = x[i : i + _AT_ONCE], y[i : i + _AT_ONCE]
        if cuts:
            so_far = np.einsum("ij,ij->i", ra[p, : cuts[0]], rb[q, : cuts[0]])
            for before, k, (ta, tb) in zip(cuts, cuts[1:], tail[1:]):
                so_far = so_far + np.einsum("ij,ij->i", ra[p, before:k], rb[q, before:k])
                keep = so_far + ta[p] * tb[q] >= threshold - SLACK
                p, q, so_far = p[keep], q[keep], so_far[keep]
        linked = cosines(a[p], b[q]) >= threshold
        if linked.any():
            yield p[linked], q[linked]


_TILE = "tile long, label string, dims int, low double, high double, h1 array<long>, h2 array<long>, first array<long>, size array<long>, vectors binary"


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], tile: int) -> DataFrame:
    """Classes in runs of at most `tile`, of one label and length, ordered by the leading coordinate."""
    lead = {n: x[:, 0] for n, x in axes.items()}

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            out = []
            for v in vectors:
                x = v.values.to_numpy()
                out.append(float((x @ lead[len(x)] if len(x) in lead else x[0]) / np.linalg.norm(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "lead"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        for row in chain((r for b in batches for r in b.to_pylist()), [None]):
            if held and (row is None or len(held) >= tile or (row["label"], row["dims"]) != (held[0]["label"], held[0]["dims"])):
                names = ("h1", "h2", "first", "size")
                vectors = np.array([r["vector"] for r in held], "<f8").tobytes()
                head = [number, held[0]["label"], held[0]["dims"], held[0]["lead"], held[-1]["lead"]]
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], t) for v, t in zip(head, kinds)), *(pa.array([[r[k] for r in held]], pa.list_(pa.int64())) for k in names), pa.array([vectors])],
                    [x.split()[0] for x in _TILE.split(", ")],
                )
                number, held = number + 1, []
            if row is not None:
                held.append(row)

    order = ["label", "dims", "lead", "h1", "h2"]
    projected = classes.mapInArrow(project, "label string, dims int, h1 long, h2 long, vector array<double>, size long, first long, lead double")
    return projected.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _TILE)


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    sample: int = SAMPLE,
    tile: int = TILE,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of `vectors`.

    Vectors are linked if their labels are equal and not null, their lengths are equal and their cosine is at
    least `threshold`. Vectors that are null, zero or hold null, NaN or infinite components, and rows without
    label, have no links and are their own component. Rows that repeat a vec_id count as further vectors. A
    null vec_id takes part in links but never names a component unless all its members are null. An empty
    table gives an empty one; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    ok = F.col("label").isNotNull() & _usable(F.col("vector"))
    # -0.0 and 0.0 are one value. A class is known by its label and two independent hashes.
    rows = rows.select("vec_id", F.when(ok, F.col("label")).alias("label"), F.when(ok, F.transform("vector", lambda x: x + F.lit(0.0))).alias("vector"))
    rows = rows.select("vec_id", "label", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    keys = ["label", F.size("vector").alias("dims"), "h1", "h2", "vector"]
    classes = materialize(rows.where("label is not null").groupBy(*keys).agg(F.count("*").alias("size"), F.min("vec_id").alias("first")))
    axes = _fit(classes, sample)
    tiles = materialize(_tiles(classes, axes, tile))

    # Along any axis, unit vectors with cosine t are at most sqrt(2 - 2t) apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    meta = tiles.select("tile", "label", "dims", "low", "high")
    other = meta.toDF("tile_b", "label_b", "dims_b", "low_b", "high_b")
    near = (F.col("label") == F.col("label_b")) & (F.col("dims") == F.col("dims_b"))
    pairs = meta.join(other, near).where((F.col("tile") <= F.col("tile_b")) & (F.col("low_b") - F.col("high") <= reach) & (F.col("low") - F.col("high_b") <= reach))
    side_a = tiles.select("tile", "dims", F.col("size").alias("size_a"), F.col("vectors").alias("vectors_a"))
    side_b = tiles.select(F.col("tile").alias("tile_b"), F.col("size").alias("size_b"), F.col("vectors").alias("vectors_b"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.select("tile", "tile_b").join(side_a, "tile").join(side_b, "tile_b").repartition(partitions, "tile", "tile_b")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, root, links): links of a vector, or an edge of the forest. A node is its tile and place there."""
        for batch in batches:
            for row in range(len(batch)):
                one = {k: batch.column(k)[row] for k in batch.schema.names}
                a, b = (np.frombuffer(one[k].as_py(), "<f8").reshape(-1, one["dims"].as_py()) for k in ("vectors_a", "vectors_b"))
                size_a, size_b = (one[k].values.to_numpy() for k in ("size_a", "size_b"))
                same = one["tile"].as_py() == one["tile_b"].as_py()
                forest = Forest(len(a) if same else len(a) + len(b))
                links = np.zeros(len(forest.label), np.int64)
                base = 0 if same else len(a)
                for p, q in compare_tiles(a, b, axes.get(a.shape[1], np.eye(a.shape[1])), same, threshold):
                    links += np.bincount(p, size_b[q], len(links)).astype(np.int64) + np.bincount(q + base, size_a[p], len(links)).astype(np.int64)
                    forest.add(p, q + base)
                nodes = np.arange(len(a)) + one["tile"].as_py() * tile
                nodes = nodes if same else np.concatenate([nodes, np.arange(len(b)) + one["tile_b"].as_py() * tile])
                seen = np.flatnonzero(links)
                x, y = forest.edges()
                n, m = len(seen), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes[seen], nodes[x]])),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(nodes[y])]),
                        pa.concat_arrays([pa.array(links[seen]), pa.nulls(m, pa.int64())]),
                    ],
                    ["node", "root", "links"],
                )

    found = materialize(work.select("tile", "tile_b", "dims", "size_a", "size_b", "vectors_a", "vectors_b").mapInArrow(compare, "node long, root long, links long"))
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    places = tiles.select("label", "tile", F.posexplode(F.arrays_zip("h1", "h2", "first", "size")).alias("at", "x"))
    nodes = places.select("label", "x.h1", "x.h2", "x.first", "x.size", (F.col("tile") * tile + F.col("at")).alias("node"))
    nodes = materialize(nodes.join(links, "node", "left").join(roots, "node", "left"))
    least = nodes.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    answers = nodes.join(least, "root", "left").select(
        F.col("label").alias("l"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("least", "first").alias("c")
    )
    answers = materialize(answers)
    same = (F.col("label") == F.col("l")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    named = rows.select("vec_id", "label", "h1", "h2").join(answers, same, "left").select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("l").isNull(), F.col("vec_id")).otherwise(F.col("c")).alias("component_id"))
    return named.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
