"""Near-duplicate vectors and components against brute force."""

import numpy as np
from llm.helpers import Union

from twinscan.llm.components import connected_components
from twinscan.llm.embeddings import compare_tiles, cosines, near_duplicate_vectors, principal_axes


def test_vectors(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(40, 12))
    rows = [(v + rnd.normal(size=12) * rnd.choice([0, 0.05, 0.25]), int(i % 3)) for i, v in enumerate(np.repeat(base, 6, axis=0))]
    data = [(i, [float(x) for x in v.astype(np.float32)], label) for i, (v, label) in enumerate(rows)]
    data += [(900 + i, data[0][1], 0) for i in range(30)] + [(950, [x * 3 for x in data[0][1]], 0)]
    plain = len(data)
    odd = [None, [0.0] * 12, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, []]
    data += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(1010, data[0][1], None), (1011, [1.0, 2.0], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<float>, label int, tile string, size int")
    x = np.array([r[1] for r in data[:plain]])
    for threshold, tile in ((0.93, 1024), (0.6, 16)):
        groups, links = Union(), dict.fromkeys((r[0] for r in data), 0)
        for i in range(plain):
            for j in np.flatnonzero(cosines(np.repeat(x[i : i + 1], plain, axis=0), x) >= threshold):
                if i != j and data[i][2] == data[j][2]:
                    links[data[i][0]] += 1
                    groups.join(data[i][0], data[j][0])
        found = near_duplicate_vectors(frame, threshold, tile=tile).collect()
        assert len(found) == len(data)
        for r in found:
            assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], groups.find(r["vec_id"])), r
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_vectors_of_a_length_the_sample_missed(spark):
    rnd = np.random.default_rng(9)
    vectors = [rnd.normal(size=n) for n in (8, 5) for _ in range(30)]
    vectors += [v * 2 for v in vectors] + [v + 0.001 for v in vectors[::10]]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    wanted = sorted(map(tuple, near_duplicate_vectors(frame).collect()))
    assert sum(r[1] > 0 for r in wanted) >= 120
    for sample in (0, 1):
        assert sorted(map(tuple, near_duplicate_vectors(frame, sample=sample, tile=16).collect())) == wanted


def test_early_stops_lose_no_pair():
    rnd = np.random.default_rng(7)
    centre = rnd.normal(size=(20, 40))
    a, b = (centre[rnd.integers(0, 20, 150)] + rnd.normal(size=(150, 40)) * 0.3 for _ in range(2))
    axes = principal_axes(a / np.linalg.norm(a, axis=1, keepdims=True))
    for t in (0.5, 0.9, 0.99):
        pairs = {(int(x), int(y)) for p, q in compare_tiles(a, b, axes, False, t, (4, 12)) for x, y in zip(p, q)}
        full = {(i, int(j)) for i in range(150) for j in np.flatnonzero(cosines(np.repeat(a[i : i + 1], 150, axis=0), b) >= t)}
        assert pairs == full


def test_components(spark):
    rnd = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    groups = Union()
    for a, b in edges:
        groups.join(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: groups.find(x) for e in edges for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
