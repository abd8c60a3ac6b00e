"""Sources, rules, table updates and the stream."""

import datetime
import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from twinscan.operators import reports, rules, submissions
from twinscan.sources import manifest, tables, token_store
from twinscan.streaming.arrival_index import ArrivalIndex, compact
from twinscan.streaming.incremental import compare_batch, incremental_compare, read_pairs

MANIFEST_ROWS = "submission_id string, path string, is_dir boolean, size_bytes long, content string"


def test_manifest_and_archives(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg" / "empty").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("x = 1\r\n")
    (root / ".env").write_text("k")
    roots = spark.createDataFrame([("s1", str(root)), ("s2", str(tmp_path / "none"))], "submission_id string, root string")
    m = manifest.read_file_manifest(roots)
    got = {(r.submission_id, r.path, r.is_dir, r.error) for r in m.collect()}
    assert ("s1", "pkg/__init__.py", False, None) in got and ("s1", "pkg/empty", True, None) in got and ("s1", ".env", False, None) in got
    assert any(e == "notADirectory" for *_, e in got)
    src = manifest.source_files(m).collect()
    assert [(r.path, r.language, r.content) for r in src] == [("pkg/__init__.py", "python", "x = 1\n")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("top/a.py", "a")
        z.writestr("top/_b.py", "b")
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips" / "one.zip").write_bytes(data.getvalue())
    (tmp_path / "zips" / "plain.txt").write_bytes(b"hello")
    (tmp_path / "zips" / "bad.zip").write_bytes(data.getvalue()[:40] + b"PK\x05\x06" + b"\0" * 18)
    got = manifest.resolve_project_root(manifest.read_archives(spark, str(tmp_path / "zips")))
    rows = {(r.submission_id, r.path) for r in got.collect()}
    assert {("one", "a.py"), ("one", "_b.py"), ("plain", "plain.txt")} <= rows


def test_token_store_tokenises_new_content_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "x = 1"), ("c.js", "f(2);")], "path string, content string")
    token_store.update_token_store(df, path)
    token_store.update_token_store(df, path)
    assert spark.read.parquet(path).count() == 2
    assert token_store.stored_tokens(df, path).filter(F.size("tokens") > 0).count() == 3


def rule_data(spark):
    rows = [
        ("a", "README.md", False, 60 * 1024 * 1024, "Hello"), ("a", "src/app/main.py", False, 10, "def main():\n  pass"),
        ("a", "src/util.py", False, 10, "MAIN = 1"), ("a", "void", True, 0, None),
        ("b", "node_modules/x.js", False, 41 * 1024 * 1024, "x"), ("b", "deep/1/2/3/f.py", False, 5, "nothing"),
    ]
    subs = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "submission_id string, force_rules boolean")
    return spark.createDataFrame(rows, MANIFEST_ROWS), subs


def test_rules(spark):
    m, subs = rule_data(spark)
    by_id = lambda df: {r.submission_id: r for r in df.collect()}
    r = by_id(rules.rule_file_presence(m, subs, {"must_exist": ["README*", "src/**/*.py"], "forbidden": ["*.log"]}))
    assert r["a"].passed and r["b"].missing_files == ["README*", "src/**/*.py"] and not r["c"].passed
    r = by_id(rules.rule_max_archive_size(m, subs, {"max_size_mb": 50}))
    assert (r["a"].passed, r["a"].excess_mb, r["a"].file_count, r["b"].passed, r["c"].passed) == (False, 10.0, 3, True, True)
    params = {"required_directories": ["src", "src/app"], "forbidden_directories": ["node_modules"], "max_depth": 3, "allow_empty_dirs": False}
    r = by_id(rules.rule_directory_structure(m, subs, params))
    assert (r["a"].missing_directories, r["a"].emptyDirectoriesFound, r["a"].directoryDepthExceeded) == ([], 1, 0)
    assert (r["b"].missing_directories, r["b"].forbiddenDirectoriesFound, r["b"].directoryDepthExceeded) == (["src", "src/app"], 1, 1)
    checks = [{"file_pattern": "src/**/*.py", "text": "main", "case_sensitive": False}, {"file_pattern": "**/*.py", "regex": "^def \\w+", "multiline": True}]
    r = by_id(rules.rule_file_content(m, subs, {"checks": checks}))
    assert [(c.files, c.failed, c.code) for c in r["a"].checks] == [(2, 0, None), (2, 1, "contentCheckFailed")]
    assert r["b"].checks[0].code == "noMatchingFiles"
    assert rules.content_violations(m, {"checks": checks}).filter("submission_id = 'a'").first().path == "src/util.py"
    rules.register_rule("has_files", lambda man, s, p: s.join(man.groupBy("submission_id").count(), "submission_id", "left").select(
        "submission_id", F.col("count").isNotNull().alias("passed"), F.lit("noFiles").alias("code"), F.lit("").alias("message")))
    report = by_id(rules.validate_all(m, subs, [{"name": "has_files"}, {"name": "max_archive_size", "params": {"max_size_mb": -1}}]))
    assert [e.code for e in report["c"].errors] == ["noFiles", "invalidParameterValue"]
    assert (report["a"].failed_rule_count, report["a"].accepted, report["c"].accepted) == (1, False, True)


def test_rule_parameters():
    code = lambda n, p: (rules.validate_rule_params(n, p) or {}).get("code")
    assert code("file_presence", {"must_exist": "x"}) == "invalidParameterType"
    assert code("file_presence", {}) == "missingRequiredParameters"
    assert code("file_presence", {"must_exist": [1]}) == "invalidPatternType"
    assert code("max_archive_size", {"max_size_mb": 0}) == "invalidParameterValue"
    assert code("directory_structure", {"max_depth": 0}) == "invalidParameterValue"
    assert code("file_content", {"checks": [{"text": "a"}]}) == "missingFilePattern"
    assert code("file_content", {"checks": [{"file_pattern": "a"}]}) == "missingContentCheck"
    assert code("file_content", {"checks": [{"file_pattern": "a", "text": "b", "regex": "c"}]}) == "conflictingContentChecks"
    assert code("file_content", {"checks": [{"file_pattern": "a", "regex": "("}]}) == "invalidRegexPattern"
    assert code("file_content", {"checks": [{"file_pattern": "a", "text": "x"}]}) is None
    assert rules.unknown_rules([{"name": "nope"}, {}]) == ["nope", "(unnamed rule)"]


def test_a_job_leaves_no_intermediate_tables(spark):
    before = tables.scratch_folder(spark)
    with tables.job(spark) as folder:
        stored = tables.materialize(spark.range(10))
        assert stored.count() == 10 and os.listdir(folder) and folder.startswith(before)
        with tables.job(spark) as inner:
            tables.materialize(spark.range(1))
            assert inner.startswith(folder) and os.path.isdir(inner)
        assert not os.path.isdir(inner) and stored.count() == 10
    assert not os.path.isdir(folder) and tables.scratch_folder(spark) == before
    try:
        with tables.job(spark) as folder:
            tables.materialize(spark.range(1))
            raise KeyError
    except KeyError:
        assert not os.path.isdir(folder)


def test_submission_tables(spark, tmp_path):
    made = tables.new_submissions(spark.createDataFrame([("https://github.com/u/r", "p", "g", "s")], "link string, project string, group_id string, step string"))
    r = made.first()
    assert (r.link_type, r.status) == ("github", "pending") and len(r.id) == 36
    tables.append_by_step(made, str(tmp_path / "subs"))
    tables.append_by_step(made, str(tmp_path / "subs"))
    assert tables.read_table(spark, str(tmp_path / "subs")).filter("step = 's'").count() == 2
    bad = spark.createDataFrame([("http://github.com/a/b/tree/x", "x" * 1001, -1, 10001), ("s3://b/k", None, None, None)], "link string, description string, file_size_bytes long, file_count long")
    got = [r.errors for r in submissions.validate_submissions(bad).collect()]
    assert got == [["hostedLinkNotHttps", "linkNotRepositoryRoot", "negativeFileSize", "tooManyFiles", "descriptionTooLong"], []]
    comps = spark.createDataFrame([("c1", "pending", None)], "id string, status string, error_message string")
    new = spark.createDataFrame([("c1", "failed", "boom")], "id string, status string, error_message string")
    assert submissions.update_status(comps, new).first()[1:] == ("failed", "boom")
    none = reports.similarity_statistics(spark.createDataFrame([("p", "s", "pending", 0.0), ("p", "s", "completed", 0.8)], "project string, step string, status string, overall_similarity double")).first()
    assert (none.average_similarity, none.high_similarity_pairs, none.status_breakdown) == (0.4, 1, {"completed": 1, "pending": 1})


def test_stream_compares_once(spark, tmp_path):
    schema = "id string, project string, group_id string, step string, upload_time timestamp, parts array<string>"
    inbox = str(tmp_path / "in")

    def arrive(rows):
        spark.createDataFrame(rows, "id string, project string, group_id string, step string, t string, parts array<string>").select(
            "id", "project", "group_id", "step", F.col("t").cast("timestamp").alias("upload_time"), "parts").coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(schema).parquet(inbox)
        incremental_compare(stream, str(tmp_path / "h"), str(tmp_path / "p"), str(tmp_path / "c")).awaitTermination()
        return sorted((r.submission_id, r.compared_submission_id, r.jaccard_similarity) for r in read_pairs(spark, str(tmp_path / "p")).collect())

    words = list("abcdefghij")
    arrive([("1", "p", "g1", "s", "2024-01-01 00:00:00", words), ("2", "p", "g2", "s", "2024-01-01 00:00:01", words[:9]), ("9", "q", "g1", "s", "2024-01-01 00:00:01", words)])
    assert run() == [("2", "1", 0.9)]
    arrive([("3", "p", "g3", "s", "2024-01-01 01:00:00", words), ("4", "p", "g3", "s", "2024-01-01 01:00:01", words)])
    got = run()
    assert [g for g in got if g[0] in "34"] == [("3", "1", 1.0), ("3", "2", 0.9)]
    assert run() == got and os.path.isdir(tmp_path / "h")


ARRIVALS = "id string, project string, group_id string, step string, upload_time timestamp, parts array<string>"


def arrivals(n, seed):
    """Rows in time order: near copies, equal contents, second submissions of a group, nulls and empty sets."""
    rnd = random.Random(seed)
    stems = [[f"w{k}_{i}" for i in range(20)] for k in range(4)]
    out = []
    for i in range(n):
        parts = list(rnd.choice(stems))
        for _ in range(rnd.randint(0, 3)):
            parts[rnd.randrange(20)] = f"x{rnd.randrange(60)}"
        parts = sorted(set(parts)) if rnd.random() > 0.1 else []
        project = rnd.choice(["p", "p", "q", None])
        out.append((f"{i:04}", project, f"g{rnd.randrange(n)}", "s", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), parts))
    return out


def brute_pairs(rows, threshold):
    """First earlier row of another group with each distinct similar content."""
    kept, seen = [], set()
    for r in rows:
        if (r[1], r[3], r[2]) not in seen:
            seen.add((r[1], r[3], r[2]))
            kept.append(r)
    out = []
    for i, a in enumerate(kept):
        met = set()
        for b in kept[:i]:
            if (b[1], b[3]) != (a[1], a[3]) or b[2] == a[2] or frozenset(b[5]) in met or not a[5]:
                continue
            j = len(set(a[5]) & set(b[5])) / len(set(a[5]) | set(b[5]))
            if j >= threshold:
                met.add(frozenset(b[5]))
                out.append((a[0], b[0], round(j, 9)))
    return sorted(out)


def test_batches_by_index(spark, tmp_path):
    rows = arrivals(120, 3)

    def written(name):
        return sorted((r.submission_id, r.compared_submission_id, round(r.jaccard_similarity, 9)) for r in read_pairs(spark, str(tmp_path / name / "p")).collect())

    def run(name, sizes, again=()):
        at = 0
        for number, size in enumerate(sizes):
            frame = spark.createDataFrame(rows[at : at + size], ARRIVALS)
            for _ in range(2 if number in again else 1):
                compare_batch(frame, ArrivalIndex(spark, str(tmp_path / name / "i"), "r", number, 8), str(tmp_path / name / "p"), 0.7)
            at += size
        return written(name)

    expected = brute_pairs(rows, 0.7)
    assert len(expected) > 100
    assert run("one", [120]) == expected
    assert run("many", [1, 19, 20, 40, 40], again=(0, 3)) == expected
    # The index goes on from a compacted copy, and rows that were seen stay out under another run.
    compact(spark, str(tmp_path / "many" / "i"), str(tmp_path / "small"), 8)
    index = ArrivalIndex(spark, str(tmp_path / "small"), "next", 0, 8)
    compare_batch(spark.createDataFrame(rows[50:80], ARRIVALS), index, str(tmp_path / "again"), 0.7)
    assert read_pairs(spark, str(tmp_path / "again")).count() == 0
    late = ("new", "p", "other", "s", datetime.datetime(2025, 1, 1), next(r[5] for r in rows if r[1] == "p" and r[5]))
    compare_batch(spark.createDataFrame([late], ARRIVALS), ArrivalIndex(spark, str(tmp_path / "small"), "next", 1, 8), str(tmp_path / "again"), 0.7)
    got = [(r.submission_id, r.compared_submission_id, round(r.jaccard_similarity, 9)) for r in read_pairs(spark, str(tmp_path / "again")).collect()]
    assert sorted(got) == [x for x in brute_pairs([*rows, late], 0.7) if x[0] == "new"]


def test_a_batch_reads_only_the_slots_it_hits(spark, tmp_path):
    path = str(tmp_path / "i")
    for number in range(3):
        rows = [(f"{number}_{i}", "p", f"g{number}_{i}", "s", datetime.datetime(2024, 1, 1), [f"{number}_{i}_{k}" for k in range(10)]) for i in range(30)]
        compare_batch(spark.createDataFrame(rows, ARRIVALS), ArrivalIndex(spark, path, "r", number, 64), str(tmp_path / "p"), 0.7)
    index = ArrivalIndex(spark, path, "r", 3, 64)
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    whole = size(index.read("postings"))
    one = spark.createDataFrame([("p", "s", 1), ("p", "s", 2)], "project string, step string, part long")
    hit = index.read("postings", one.select(index.slot("project", "step", "part")))
    assert 0 < size(hit) <= whole * 4 / 64 + 2000
    none = spark.createDataFrame([], "slot int")
    assert index.read("contents", none).count() == 0 and not index.read("contents", none).inputFiles()
