"""Similarity joins and scores against brute force in plain Python."""

import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from twinscan.operators import blocks, functions, graph, scoring, sequences
from twinscan.operators.pairs import candidate_counts, copy_class_members, threshold_pairs
from twinscan.operators.tokenize import tokenize_files


def jac(a, b):
    return len(a & b) / len(a | b)


def test_threshold_pairs_equal_all_pairs(spark):
    rng = random.Random(11)
    base = [frozenset(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    rows = []
    for i in range(300):
        s = set(base[rng.randrange(40)])
        for _ in range(rng.randrange(3)):
            s.symmetric_difference_update({f"w{rng.randrange(60)}"})
        rows.append((i, f"g{rng.randrange(5)}", sorted(s)))
    rows += [(1000 + i, f"g{i % 7}", ["hot", "copy", "of", "a", "third"]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, group_id string, parts array<string>").withColumn("scope", F.lit("s"))
    for t in (0.5, 0.7, 0.9):
        classes = {}
        for i, g, p in rows:
            classes.setdefault(frozenset(p), []).append((i, g))
        want = {}
        for a, b in combinations([c for c in classes if c], 2):
            if jac(a, b) >= t and len({g for _, g in classes[a] + classes[b]}) > 1:
                x, y = sorted([classes[a], classes[b]], key=lambda c: min((g, i) for i, g in c))
                (g1, low), (g2, high) = min((g, i) for i, g in x), max((g, i) for i, g in y)
                if g1 == g2:
                    high, low = min((g, i) for i, g in y)[1], max((g, i) for i, g in x)[1]
                sides = sorted([(low, len(x), min(x)[0]), (high, len(y), min(y)[0])])
                want[sides[0][0], sides[1][0]] = (sides[0][1], sides[1][1], sides[0][2], sides[1][2], round(jac(a, b), 9))
        for p, members in classes.items():
            if p and len({g for _, g in members}) > 1:
                ends = sorted(f((g, i) for i, g in members)[1] for f in (min, max))
                want[tuple(ends)] = (len(members), len(members), min(members)[0], min(members)[0], 1.0)
        got = {
            (r.left_id, r.right_id): (r.left_copies, r.right_copies, r.left_class, r.right_class, round(r.similarity, 9))
            for r in threshold_pairs(df, ["scope"], t).collect()
        }
        assert got == want
        group = {i: g for i, g, _ in rows}
        assert all(group[x] != group[y] for x, y in got)


def test_pairs_name_different_groups(spark):
    rows = [(1, "g1", ["a", "b", "c", "d"]), (2, "g2", ["a", "b", "c", "d"]), (3, "g1", ["a", "b", "c", "d"]), (4, "g1", ["a", "b", "c", "d", "e"])]
    df = spark.createDataFrame([("s", *r) for r in rows], "scope string, id long, group_id string, parts array<string>")
    got = {(r.left_id, r.right_id) for r in threshold_pairs(df, ["scope"], 0.7).collect()}
    assert got == {(1, 2), (2, 4)}
    members = {(r.id, r.class_id, r.copies) for r in copy_class_members(df, ["scope"]).collect()}
    assert members == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1)}


def test_all_members_of_source_classes_are_counted(spark):
    from twinscan.operators import blocks, scoring

    parts = ["a", "b", "c", "d", "e"]
    rows = [(i, f"g{i}", parts) for i in range(1, 6)] + [(6, "g6", [*parts, "f"]), (7, "g7", ["z"])]
    files = [("p", "python", i, g, x, ["t"], ["o"]) for i, g, x in rows]
    features = spark.createDataFrame(files, "project string, language string, file_id long, group_id string, parts array<string>, types array<string>, ops array<string>")
    scope = ["project", "language"]
    members = scoring.file_class_members(features, scope)
    assert {(r.file_id, r.class_id, r.copies) for r in members.collect()} == {(i, 1, 5) for i in range(1, 6)} | {(6, 6, 1), (7, 7, 1)}
    found = scoring.file_pairs(features, scope, 0.8)
    owned = members.withColumn("submission_id", members["file_id"] * 10)
    summed = blocks.class_summary(found.select("left_id", "right_id"), found, owned).collect()
    assert sorted((r.left_class, r.left_submissions, r.left_groups, r.right_class, r.right_submissions, r.right_files) for r in summed) == [(1, 5, 5, 1, 5, 5), (1, 5, 5, 6, 1, 1)]


def test_smaller_submissions_are_compared_too(spark):
    from twinscan.operators import sequences

    parts = {"big": [f"b{i}" for i in range(40)], "x": [*"abcdefghi"], "y": [*"abcdefghij"], "z": [*"abcdefghi"]}
    rows = [("p", s, "f", i, v, v, v, v, v, len(v)) for i, (s, v) in enumerate(parts.items())]
    names = "parts types structural flow ops".split()
    features = spark.createDataFrame(rows, "project string, submission_id string, path string, file_id long, " + ", ".join(f"{n} array<string>" for n in names) + ", n_tokens long")
    found = sequences.submission_pairs(sequences.submission_sets(features), 0.8)
    assert {(r.submission_id, r.compared_submission_id, r.left_copies, r.right_copies) for r in found.collect()} == {("x", "y", 2, 1), ("x", "z", 2, 2)}
    scored = sequences.compare_submissions(found, features).collect()
    assert sorted(r.jaccard_similarity for r in scored) == [0.9, 1.0]


def test_hot_parts_are_cut_into_a_grid(spark, monkeypatch):
    monkeypatch.setattr("twinscan.operators.pairs.HOT_PART", 3)
    rows = [("s", i, f"g{i}", ["all", "same", f"x{i}"]) for i in range(20)]
    df = spark.createDataFrame(rows, "scope string, id long, group_id string, parts array<string>")
    assert threshold_pairs(df, ["scope"], 0.5).count() == 190


def py_source(name, k, extra):
    lines = [f"import {name}", f"def {name}_one(a, b):", "    total = 0", "    for x in a:"]
    lines += ["        total = total + x * b"] * k
    lines += ["        if x > b and not a:", "            total -= 1", "    return total"]
    lines += ["", f"def {name}_two(a):", f"    v = {name}_one(a, 2)"] + [f"    assert v, '{extra}'"] * 2 + ["    return v", ""]
    return "\n".join(lines)


def fixture(spark):
    rows = []
    for i in range(12):
        rows.append((i, "p", f"g{i % 4}", f"s/f{i}.py", py_source("ab" if i % 2 else "cd", 1 + i % 5, i % 3)))
    return spark.createDataFrame(rows, "file_id long, project string, group_id string, path string, content string")


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def seq_score(a, b):
    if not a and not b:
        return 1.0
    return slow_lcs(a, b) / max(len(a), len(b)) if a and b else 0.0


def fuzzy(p1, p2):
    c1, c2 = [p for p in p1 if p.strip()], [p for p in p2 if p.strip()]
    s1, s2 = set(c1), set(c2)
    exact = jac(s1, s2)
    u1, u2 = s1 - s2, s2 - s1
    if not u1 or not u2:
        return exact
    total = 0.0
    for p in u1:
        best = 0.0
        for o in u2:
            if abs(len(p) - len(o)) / max(len(p), len(o)) <= 0.4 and jac(set(p), set(o)) >= 0.3:
                r = SequenceMatcher(None, p, o).ratio()
                best = max(best, r if r >= 0.6 else 0.0)
        total += best
    if not total:
        return exact
    w = 0.3 * len(u1) / max(len(c1), len(c2))
    return min(1.0, exact * (1 - w) + total / len(u1) * w)


def test_scores_equal_brute_force(spark):
    files = tokenize_files(fixture(spark))
    feats = {r.file_id: r for r in scoring.similarity_features(files.select("file_id", "group_id", "tokens")).collect()}
    scored = scoring.compare_files(files, ["project"], 0.5).collect()
    assert len(scored) > 5
    for r in scored:
        a, b = feats[r.left_id], feats[r.right_id]
        if a.parts == b.parts and r.left_copies > 1:
            assert r.overall_similarity == 1.0
        t = len(set(a.types) & set(b.types)) / len(set(a.types) | set(b.types))
        ratio = min(len(a.types), len(b.types)) / max(len(a.types), len(b.types))
        pen = 1.0 if ratio > 0.5 else 0.9 if ratio > 0.3 else 0.8
        j = fuzzy(a.parts, b.parts)
        assert abs(r.jaccard_similarity - j) < 1e-9
        want = (
            0.25 * j + 0.3 * seq_score(a.structural, b.structural) + 0.2 * seq_score(a.types, b.types)
            + 0.15 * seq_score(a.flow, b.flow) + 0.05 * seq_score(a.ops, b.ops) + 0.05 * t
        ) * pen
        assert abs(r.overall_similarity - want) < 6e-5
    assert {len(set(a.types)) for a in feats.values()} != {0}


def test_empty_files_score(spark):
    empty = spark.createDataFrame([(1, [""], [], [], [], [], 0)], "id int, parts array<string>, types array<string>, structural array<string>, flow array<string>, ops array<string>, n_tokens int")
    f = empty.select(F.struct("parts", "types", "structural", "flow", "ops", "n_tokens").alias("f1"))
    both = f.withColumn("f2", F.col("f1"))
    r = scoring.compare_similarity(both).first()
    assert (r.overall_similarity, r.jaccard_similarity, r.type_similarity, r.common_elements) == (0.76, 1.0, 0.0, 1)
    assert scoring.function_similarity(both).first().similarity_score == 0.0


def test_shared_blocks_equal_brute_force(spark):
    files = fixture(spark)
    found = functions.all_functions(files)
    pairs = spark.createDataFrame([(i, j) for i, j in combinations(range(12), 2)], "left_id long, right_id long")
    feats = [r for r in blocks.function_shapes(found).collect()]
    want = {}
    for x in feats:
        for y in feats:
            if x.file_id >= y.file_id:
                continue
            t = len(set(x.types) & set(y.types)) / len(set(x.types) | set(y.types))
            ratio = min(len(x.types), len(y.types)) / max(len(x.types), len(y.types))
            pen = 1.0 if ratio > 0.5 else 0.8 if ratio > 0.3 else 0.6
            s = (
                0.4 * seq_score(x.structural, y.structural) + 0.25 * seq_score(x.types, y.types) + 0.2 * seq_score(x.flow, y.flow)
                + 0.1 * seq_score(x.ops, y.ops) + 0.05 * t
            ) * pen
            if s > 0.7:
                key = (x.file_id, y.file_id, x["shape"], y["shape"])
                want[key] = want.get(key, 0) + 1
    shared = graph.number_blocks(blocks.shared_blocks(pairs, found)).cache()
    got = shared.select(F.sum("function_pairs"), F.count("*"), F.min("similarity_score")).first()
    assert (got[0], got[1]) == (sum(want.values()), len(want)) and got[2] > 0.7
    edges = graph.graph_edges(pairs, found, shared).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in edges}["similarity"] == len(want)


def test_function_extraction(spark):
    rows = [
        ("a.py", "class A:\n    def __init__(self):\n        pass\n\n    def go(self):\n        def inner():\n            return 1\n        return inner()\n\nx = 1\n", [("go", 4, 7), ("inner", 5, 6)]),
        ("b.js", "function one(a) {\n  if (a) { return '}'; }\n}\nconst two = (x) => {\n  return x;\n};\n", [("one", 0, 2), ("two", 3, 5)]),
        ("c.java", "class C {\n  public int sum(int a) {\n    while (a > 0) { a--; }\n    return a;\n  }\n}\n", [("sum", 1, 4)]),
        ("d.go", "func (r *T) Run(x int)\n{\n  x++\n}\n", [("Run", 0, 3)]),
        ("e.rb", "def hi\n  puts 1\nend\n", [("hi", 0, 2)]),
        ("f.graphql", "function odd(x) {\n}\n", [("odd", 0, 1)]),
        ("g.json", "function no(x) {\n}\n", []),
    ]
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(rows)], "file_id int, path string, content string")
    got = {}
    for r in functions.all_functions(df).collect():
        got.setdefault(r.file_id, []).append((r.function_name, r.start_line, r.end_line))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(w) for i, (_, _, w) in enumerate(rows) if w}
    assert functions.extract_functions_fallback(df, functions.extract_functions(df)).count() == 1


def test_candidate_counts(spark):
    rows = [("1", "p", "s", "a", "completed"), ("2", "p", "s", "a", "pending"), ("3", "p", "s", "b", "completed")]
    df = spark.createDataFrame(rows, "id string, project string, step string, group_id string, status string")
    r = candidate_counts(df).first()
    assert (r.other_group_pairs, r.completed_pairs) == (4, 4)


def test_submission_scores_equal_brute_force(spark):
    files = tokenize_files(fixture(spark)).withColumn("submission_id", F.col("group_id"))
    features = scoring.similarity_features(files.select("submission_id", "path", "tokens")).cache()
    pairs = spark.createDataFrame([("g0", "g1"), ("g0", "g2"), ("g1", "g3")], "submission_id string, compared_submission_id string")
    whole = {}
    for r in sorted(features.collect(), key=lambda r: r.path):
        w = whole.setdefault(r.submission_id, {k: [] for k in ("parts", "types", "structural", "flow", "ops")})
        for k in w:
            w[k] += r[k]
    got = sequences.compare_submissions(pairs, features).collect()
    assert len(got) == 3
    for r in got:
        a, b = whole[r.submission_id], whole[r.compared_submission_id]
        ratio = min(len(a["types"]), len(b["types"])) / max(len(a["types"]), len(b["types"]))
        want = (
            0.25 * jac(set(a["parts"]), set(b["parts"])) + 0.05 * jac(set(a["types"]), set(b["types"]))
            + 0.3 * seq_score(a["structural"], b["structural"]) + 0.2 * seq_score(a["types"], b["types"])
            + 0.15 * seq_score(a["flow"], b["flow"]) + 0.05 * seq_score(a["ops"], b["ops"])
        ) * (1.0 if ratio > 0.5 else 0.9)
        assert abs(r.overall_similarity - want) < 6e-5 and r.files1 == 3
    for r in sequences.submission_sequences(features).collect():
        assert r.types == whole[r.submission_id]["types"] and len(r.types) == r.n_types
