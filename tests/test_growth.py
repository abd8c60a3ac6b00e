"""What keeps joins and shuffles in proportion to the tables."""

import random

from pyspark.sql import functions as F

from twinscan.operators import blocks, functions, pairs, reports, sequences, submissions
from twinscan.operators.tokenize import token_rows, tokenize, tokenize_files, type_counts
from twinscan.plans.bindings import view
from twinscan.sources.tables import materialize, spread


def test_shared_tables_and_texts_are_never_broadcast(spark, tmp_path):
    """Their files and estimates are far smaller than their rows in memory."""
    rows = spark.range(100).select("id", F.array_repeat(F.lit("token"), 50).alias("parts"))
    stored, ids = materialize(rows), spark.range(100).select("id")
    spark.createDataFrame([(1, "small ring", "Brand#1", "LARGE", 3)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    texts = view(spark, str(tmp_path), "source_files").select("file_id", "content")
    features = rows.select(F.lit("a").alias("project"), F.col("id").cast("string").alias("submission_id"), F.lit("x").alias("path"), "parts", *[F.col("parts").alias(c) for c in ("types", "structural", "flow", "ops")], F.lit(50).alias("n_tokens"))
    pairs = spark.createDataFrame([("1", "2")], "submission_id string, compared_submission_id string")
    for joined, merges in (
        (ids.join(stored.groupBy("id").agg(F.first("parts").alias("p")), "id"), 1),
        (ids.withColumnRenamed("id", "file_id").join(texts, "file_id"), 1),
        (sequences.compare_submissions(pairs, features), 3),
    ):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") >= merges, plan
        assert merges > 1 or "BroadcastHashJoin" not in plan


def test_functions_of_a_file_pair_meet_without_a_shuffle_of_their_elements(spark, monkeypatch):
    """What is joined by file pair is one row a pair, not one per leading element; the blocks stay."""
    body = "    total = 0\n    for row in rows:\n        if row > limit:\n            total = total + row\n    return total\n"
    code = "".join(f"def f{i}(rows, limit):\n{body}{'    limit = rows' + chr(10) if i % 2 else ''}" for i in range(3))
    files = spark.createDataFrame([(1, "python", code), (2, "python", code)], "file_id long, language string, content string")
    found = functions.all_functions(files)
    written = []
    monkeypatch.setattr(blocks, "materialize", lambda df: (written.append(df), df)[1])
    out = blocks.shared_blocks(spark.createDataFrame([(1, 2)], "left_id long, right_id long"), found)
    assert sum(r.function_pairs for r in out.collect()) == 9
    assert [x for x in written if "held" in x.columns and x.count() == 2]


def test_whole_sets_travel_only_with_similar_pairs(spark):
    """The sketches lose no pair and leave few of the others, whatever the sizes of the sets."""
    rnd, threshold = random.Random(1), 0.7
    base = [[f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([1, 20, 70, 90, 200, 2000]))] for _ in range(60)]
    sets = [sorted({w if rnd.random() > 0.12 else f"w{rnd.randrange(5000)}" for w in rnd.choice(base)}) for _ in range(200)]
    rows = spark.createDataFrame([(i % 2, i, i, s) for i, s in enumerate(sets)], "project int, id long, group_id int, parts array<string>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault((i % 2, tuple(s)), i)
    alike = {
        (i, j) for (p, s), i in first.items() for (q, t), j in first.items()
        if p == q and i < j and len({*s} & {*t}) >= threshold * len({*s} | {*t})
    }
    found = pairs.threshold_pairs(rows, ["project"], threshold, across_groups=False)
    assert {(r.left_id, r.right_id) for r in found.filter("similarity < 1").collect()} == alike
    classes = materialize(pairs.copy_classes(rows, ["project"]))
    met = pairs.candidate_classes(classes, ["project"], threshold)
    left = pairs.sieve(met, classes, ["project"], threshold, "jaccard").count()
    assert len(alike) <= left < met.count() / 2


def test_comparisons_are_joined_with_submissions_without_sorting(spark):
    subs = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, link string")
    comps = spark.createDataFrame([("a", "1", "2", "done", 0)], "id string, submission_id string, compared_submission_id string, status string, created_at int")
    plans = [
        submissions.delete_submissions(subs, comps, subs.filter("id = '2'"))[1],
        reports.submission_similarities(comps, subs),
        pairs.enrich_with_submissions(comps, subs, ["link"]),
    ]
    for df, joins in zip(plans, (2, 1, 2)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("ShuffledHashJoin") == joins and "SortMergeJoin" not in plan
    assert plans[0].count() == 0


def test_texts_are_cut_once_for_their_token_rows(spark):
    """No filter on the tokens is pushed below the columns they are made of; files without tokens have no rows."""
    files = spark.createDataFrame([(1, "a.py", "x = 1\ny"), (2, "b.js", ""), (3, "c.py", None)], "file_id long, path string, content string")
    rows = token_rows(tokenize_files(files), "file_id")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and ("size(" in line or "split(" in line)], plan
    assert sorted((r.file_id, r.pos, r.type, r.text) for r in rows.collect()) == [
        (1, 0, "identifier", "x"), (1, 1, "assignment", "x = 1"), (1, 2, "integer", "1"), (1, 3, "identifier", "y"),
    ]


def test_members_of_classes_are_keyed_once(spark):
    """What both sides of the join read is stored; rows without a scope have classes, too."""
    rows = spark.createDataFrame([("a", 1, 1, ["x"]), ("a", 2, 1, ["x"]), (None, 3, 1, ["x"]), (None, 4, 2, ["x"])], "scope string, id long, group_id int, parts array<string>")
    members = pairs.copy_class_members(rows, ["scope"])
    assert "sha2(" not in members._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in members.collect()} == {("a", 1, 1, 1, 2), ("a", 2, 1, 1, 2), (None, 3, 1, 3, 2), (None, 4, 2, 3, 2)}


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group is cut into many slices by its bytes, of which one holds all rows."""
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 19)
    try:
        files = spark.read.parquet(str(tmp_path / "t"))
        assert files.rdd.getNumPartitions() >= 8
        held = [r["count"] for r in spread(files).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(held) == 200_000 and max(held) <= 200_000 / 4
    even = spark.range(800, numPartitions=8)
    assert spread(even) is even


def test_tokens_are_summed_up_in_their_row(spark):
    """What is grouped is a row per file and type; texts of files with the same key, or none, are counted once."""
    texts = [(1, "a b a\n1"), (2, "a"), (2, "b a\n\nc"), (None, "x"), (None, "x"), (3, None), (4, "")]
    files = spark.createDataFrame(texts, "file_id long, content string").select("file_id", tokenize(F.col("content"), "text").alias("tokens"))
    counts = type_counts(files, "file_id")
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert {tuple(r) for r in counts.select("file_id", "type", "n", "texts", "last_line").collect()} == {
        (1, "word", 3, 2, 0), (1, "integer", 1, 1, 1), (2, "word", 4, 3, 2), (None, "word", 2, 1, 0),
    }
