"""What keeps the disk of a job small: what is stored, what is shuffled, and how long it stays."""

import datetime
import os
import random
import threading
import time

from pyspark.sql import functions as F

from twinscan.functions import kernels
from twinscan.operators import pairs, scoring, sequences
from twinscan.operators.tokenize import tokenize_files
from twinscan.sources.tables import job, materialize, scratch_folder, step
from twinscan.streaming import incremental
from twinscan.streaming.arrival_index import ArrivalIndex


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}


def sets(spark):
    """Two scopes with the same contents, and one without a name."""
    rows = [(s, g * 100 + i, g, [f"w{j}" for j in range(i, i + 20)]) for g, s in enumerate(["x", "x", "y", "y", None, None]) for i in range(8)]
    return spark.createDataFrame(rows, "scope string, id long, group_id int, parts array<string>")


def test_shuffles_of_a_stored_table_go_with_its_write(spark):
    before = shuffle_files(spark)
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and stored.count() == 7
    assert not spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "true"


def test_tables_of_a_step_go_and_what_it_keeps_stays(spark):
    with job(spark) as folder:
        with step(spark) as keep:
            kept = keep(materialize(spark.range(5)).selectExpr("id + 1 AS id"))
        assert len(os.listdir(folder.removeprefix("file:"))) == 1 and kept.count() == 5


def test_pairs_leave_their_classes_and_candidates_alone(spark):
    with job(spark) as folder:
        found = pairs.threshold_pairs(sets(spark), ["scope"], 0.7)
        assert len(os.listdir(folder.removeprefix("file:"))) == 2
        got = {(r.scope, r.left_class, r.right_class) for r in found.collect()}
    # Of 20 words 20 - d are common: 17 of 23 reach the threshold, 16 of 24 do not. All contents stand in two groups; what
    # has no scope meets its copies only.
    alike = {(s, g * 100 + i, g * 100 + j) for s, g in (("x", 0), ("y", 2)) for i in range(8) for j in range(i, min(i + 4, 8))}
    assert got == alike | {(None, 400 + i, 400 + i) for i in range(8)}


def test_prefix_rows_are_met_by_one_number_and_the_smaller_set_with_fewer_of_them(spark):
    """Before, each row carried its scope, part, band and cell, and the side that probes was there twice."""
    rows = spark.createDataFrame([("x", i, [f"w{j}" for j in range(i, i + 40)]) for i in range(6)], "scope string, class_key long, parts array<string>")
    leading = materialize(pairs.prefixes(pairs._ordered(rows, ["scope"]), ["scope"], 0.7))
    met = pairs.meet(leading, ["scope"], 0.7, "jaccard")
    plan = met._jdf.queryExecution().sparkPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert join.count("spot") == 2 and "band" not in join and "part" not in join, plan
    assert leading.filter("pos = 0").count() == 6 and leading.count() == 6 * 13
    assert {(r.a_key, r.b_key) for r in met.collect()} >= {(i, j) for i in range(6) for j in range(i + 1, 6)}


def test_scored_files_are_two_ids_their_facts_and_sequences_once(spark):
    """Before, the parts and four sequences of either file went with every pair, twice."""
    codes = [f"def f{i}(a):\n    if a > {i % 3}:\n        a = {'-' if i % 2 else '+'}a\n    return a\nx{i // 4} = [1, 2]\n" for i in range(12)]
    rows = [(g * 100 + i, g, f"{i}.py", c, "p") for g in (0, 1) for i, c in enumerate(codes)]
    files = tokenize_files(spark.createDataFrame(rows, "file_id long, group_id int, path string, content string, project string"))
    with job(spark) as folder:
        scored = scoring.compare_files(files, ["project"], 0.3)
        assert len(os.listdir(folder.removeprefix("file:"))) == 2
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        leaves = [x for x in plan.splitlines() if "Relation" in x]
        assert leaves and not [x for x in leaves if "parts#" in x or "tokens#" in x], plan
        got = {(r.left_id, r.right_id): r for r in scored.collect()}
    features = scoring.similarity_features(files.select("file_id", "tokens"))
    wanted = spark.createDataFrame(list(got), "left_id long, right_id long")
    whole = scoring.compare_similarity(scoring.attach_features(wanted, features, "file_id"))
    names = [c for c in whole.columns if c not in ("left_id", "right_id")]
    assert len(got) >= 3 and any(r.jaccard_similarity < 1 for r in got.values())
    for r in whole.collect():
        assert [r[c] for c in names] == [got[r.left_id, r.right_id][c] for c in names]


def test_a_batch_leaves_the_index_and_its_pairs_only(spark, tmp_path):
    """Its own tables go with it, in its thread; contents without a project meet each other, and copies need no parts."""
    at = datetime.datetime(2024, 1, 1)
    words = [f"w{i}" for i in range(20)]
    sets = [words, [*words[1:], "new"], words, [f"v{i}" for i in range(20)]]
    rows = [(f"{p}{i}", p, f"g{i}", "s", at + datetime.timedelta(hours=i), s) for p in ("x", None) for i, s in enumerate(sets)]
    schema = "id string, project string, group_id string, step string, upload_time timestamp, parts array<string>"
    with job(spark) as folder:
        incremental.compare_batch(spark.createDataFrame(rows, schema), ArrivalIndex(spark, f"{tmp_path}/i", "r", 0, 4), f"{tmp_path}/p", 0.7)
        assert not os.path.exists(folder.removeprefix("file:")) or not os.listdir(folder.removeprefix("file:"))
        assert threading_scratch(spark) != folder
    got = {(r.submission_id, r.compared_submission_id) for r in incremental.read_pairs(spark, f"{tmp_path}/p").collect()}
    assert got == {(f"{p}{i}", f"{p}{j}") for p in ("x", None) for i, j in ((1, 0), (2, 0), (2, 1))}


def threading_scratch(spark):
    found = []
    thread = threading.Thread(target=lambda: found.append(scratch_folder(spark)))
    thread.start()
    thread.join()
    return found[0]


def test_submissions_are_keyed_without_holding_their_sequences(spark):
    """Equal concatenations have one key wherever files are cut; order, operators, parts and sizes count."""
    schema = "project string, submission_id string, path string, n_tokens int, parts array<string>, types array<string>, structural array<string>, flow array<string>, ops array<string>"

    def files(name, *cut, parts=("p", "q", " ")):
        return [("x", name, f"{i}.py", 2, list(parts) if i == 0 else ["q"], list(t), list(t.upper()), [], list(o)) for i, (t, o) in enumerate(cut)]

    rows = [
        *files("a", ("ab", "+"), ("ca", "-")), *files("same", ("abc", ""), ("a", "+-")), *files("parts", ("ab", "+"), ("ca", "-"), parts=["q", "p", "p"]),
        *files("order", ("ba", "+"), ("ca", "-")), *files("ops", ("ab", "-"), ("ca", "+")), *files("other", ("ab", "+"), ("ca", "-"), parts=["z"]),
        *files("more", ("ab", "+"), ("ca", "-"), ("", "")), *files("none", ("", ""), parts=[" "]),
    ]
    features = spark.createDataFrame(rows, schema)
    keys = {r.submission_id: r._key for r in sequences.submission_keys(features).collect()}
    assert keys["a"] == keys["same"] == keys["parts"] and len(set(keys.values())) == 6
    plan = sequences.submission_keys(features)._jdf.queryExecution().optimizedPlan().toString()
    collected = [x for x in plan.splitlines() if "collect_list" in x]
    assert collected and not [x for x in collected if "structural" in x or "flow" in x], plan
    sets = {r.id: (r.parts, r._key) for r in sequences.submission_sets(features).collect()}
    assert sets["a"] == (["p", "q"], keys["a"]) and sets["none"] == ([], keys["none"])


def test_rows_of_the_lcs_are_masked_now_and_then(spark):
    """Same lengths as one mask a step over long sequences, in clearly less time."""

    def masked_each_step(a, b):
        where, full = {}, (1 << len(a)) - 1
        for i, x in enumerate(a):
            where[x] = where.get(x, 0) | (1 << i)
        row = full
        began = time.process_time()
        for y in b:
            hit = row & where.get(y, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count(), time.process_time() - began

    rnd = random.Random(5)
    for n in (1, 64, 1023, 1024, 1025, 5000):
        a, b = ([rnd.randrange(4) for _ in range(n)] for _ in range(2))
        assert kernels.lcs_length(a, b) == masked_each_step(a, b)[0]
    a = [9, *[rnd.randrange(6) for _ in range(60_000)]]
    b = [8, *[rnd.randrange(6) for _ in range(60_000)]]
    times = []
    for _ in range(3):
        began = time.process_time()
        found = kernels.lcs_length(a, b)
        times.append(time.process_time() - began)
    wanted, took = masked_each_step(a, b)
    assert found == wanted and min(times) < 0.85 * took


def test_candidates_are_stored_before_sketches_travel(spark, monkeypatch):
    """The leading entries, the candidates and the sketches each stand on their own, so the shuffles of one step are gone in the next."""
    written = []
    store = pairs.materialize
    monkeypatch.setattr(pairs, "materialize", lambda df: (written.append(set(df.columns)), store(df))[1])
    assert pairs.threshold_pairs(sets(spark), ["scope"], 0.7).count() == 60
    assert [c for c in written if "lead" in c] and {"a_key", "b_key"} in written and [c for c in written if "sketch" in c]
