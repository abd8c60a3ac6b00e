"""Rules kept as rows, against the rules judged one list at a time."""

import json

from pyspark.sql import functions as F

from twinscan.operators import rule_tables, rules
from tests.test_tables import rule_data

LISTS = [
    [
        {"name": "file_presence", "params": {"must_exist": ["README*", "src/**/*.py", "src/app/main.py"], "forbidden": ["*.log", "deep/1/*"]}},
        {"name": "max_archive_size", "params": {"max_size_mb": 50}},
        {"name": "directory_structure", "params": {"required_directories": ["src", "src/app", "app", "x*"], "forbidden_directories": ["node_modules", "deep/1"], "max_depth": 3, "allow_empty_dirs": False}},
        {"name": "file_content", "params": {"checks": [
            {"file_pattern": "src/**/*.py", "text": "main", "case_sensitive": False},
            {"file_pattern": "**/*.py", "regex": "^def \\w+", "multiline": True},
            {"file_pattern": "[RA]*.md", "text": "Hello"},
            {"file_pattern": "none/*", "text": "x"},
        ]}},
    ],
    [{"name": "file_content", "params": {"checks": [{"file_pattern": "**/*", "regex": "HELLO.*", "case_sensitive": False}]}}, {"name": "max_archive_size", "params": {}}],
]
FAULTY = [
    ("file_presence", {"must_exist": "x"}), ("file_presence", {}), ("file_presence", {"must_exist": [1]}), ("file_presence", None),
    ("file_presence", {"must_exist": [], "forbidden": ""}), ("max_archive_size", {"max_size_mb": 0}), ("max_archive_size", {"max_size_mb": "9"}),
    ("max_archive_size", {"max_size_mb": 0.5}), ("directory_structure", {"max_depth": 0}), ("directory_structure", {"max_depth": 1.5}),
    ("directory_structure", {"max_depth": 2, "allow_empty_dirs": "no"}), ("directory_structure", {"required_directories": ["a", None]}),
    ("directory_structure", {"allow_empty_dirs": False}), ("file_content", {"checks": []}), ("file_content", {"checks": {}}), ("file_content", {}),
    ("file_content", {"checks": ["x"]}), ("file_content", {"checks": [{"text": "a"}]}), ("file_content", {"checks": [{"file_pattern": "", "text": "a"}]}),
    ("file_content", {"checks": [{"file_pattern": 3, "text": "a"}]}), ("file_content", {"checks": [{"file_pattern": "a"}]}),
    ("file_content", {"checks": [{"file_pattern": "a", "text": "b", "regex": "c"}]}), ("file_content", {"checks": [{"file_pattern": "a", "text": 1}]}),
    ("file_content", {"checks": [{"file_pattern": "a", "regex": 1}]}), ("file_content", {"checks": [{"file_pattern": "a", "text": "x"}, {"file_pattern": "a", "regex": "("}]}),
    ("file_content", {"checks": [{"file_pattern": "a", "text": "x"}]}),
]


def as_table(spark, lists):
    rows = [(s, None if x is None else json.dumps(x)) for s, x in lists]
    return rule_tables.rules_from_json(spark.createDataFrame(rows, "submission_id string, rules string"))


def by_key(df):
    return {(r.submission_id, r.ord): r for r in df.collect()}


def test_equals_lists_judged_one_by_one(spark):
    manifest, subs = rule_data(spark)
    for own in LISTS:
        table = as_table(spark, [(s, own) for s in "abc"])
        got = by_key(rule_tables.judge(manifest, table))
        expected = rules.rule_results(manifest, subs, own).collect()
        assert len(got) == len(expected) == 3 * len(own)
        for r in expected:
            assert (got[r.submission_id, r.rule_ord].passed, got[r.submission_id, r.rule_ord].code) == (r.passed, r.code)


def test_each_submission_has_its_own_list(spark):
    manifest, subs = rule_data(spark)
    table = as_table(spark, [("a", LISTS[0]), ("b", LISTS[1] + [{"name": "file_presence", "params": {"forbidden": ["node_modules/**"]}}]), ("c", [{"name": "max_archive_size", "params": {"max_size_mb": -1}}])])
    results = rule_tables.judge(manifest, table).cache()
    got = {k: list(r.faults) for k, r in by_key(results).items()}
    assert got == {
        ("a", 0): [], ("a", 1): [f"bytes:{60 * 1024 * 1024 + 20}"], ("a", 2): ["missing:x*", "empty:1"],
        ("a", 3): ["1:contentCheckFailed:1", "3:noMatchingFiles"],
        ("b", 0): ["0:contentCheckFailed:2"], ("b", 1): [], ("b", 2): ["forbidden:node_modules/**"], ("c", 0): ["max_size_mb"],
    }
    assert by_key(results)["c", 0].code == "invalidParameterValue"
    told = {r.submission_id: r for r in rule_tables.report(results, subs).collect()}
    assert [(told[s].failed_rule_count, told[s].total_rule_count, told[s].passed, told[s].accepted) for s in "abc"] == [(3, 4, False, False), (2, 3, False, False), (1, 1, False, True)]
    assert [e.name for e in told["a"].errors] == ["max_archive_size", "directory_structure", "file_content"]


def test_faults_are_rows(spark):
    """The first fault of each list of parameters is that of the check on the driver."""
    manifest, _ = rule_data(spark)
    table = as_table(spark, [(f"s{i}", [{"name": n, "params": p}]) for i, (n, p) in enumerate(FAULTY)])
    got = by_key(rule_tables.judge(manifest, table))
    for i, (name, params) in enumerate(FAULTY):
        if params and "checks" in params and not isinstance(params["checks"], list) and not params["checks"]:
            expected = "invalidParameterType"
        else:
            expected = (rules.validate_rule_params(name, params or {}) or {}).get("code")
        r = got[f"s{i}", 0]
        assert (r.code if expected else r.code in (None, "fileContentValidationFailed", "repositorySizeExceeded")) == (expected or True), (name, params, r)


def test_lists_without_rules(spark):
    manifest, subs = rule_data(spark)
    none = spark.createDataFrame([("a", None), ("b", "[]"), ("c", "not json")], "submission_id string, rules string")
    results = rule_tables.judge(manifest, rule_tables.rules_from_json(none))
    assert results.count() == 0
    assert all(r.passed and r.accepted and r.errors == [] for r in rule_tables.report(results, subs).collect())
    odd = as_table(spark, [("c", [{"name": "nope"}, {"params": {}}, {"name": "max_archive_size"}])])
    results = rule_tables.judge(manifest, odd)
    assert {r.ord: (r.code, list(r.faults)) for r in results.collect()} == {0: ("unknownRule", ["name"]), 1: ("unknownRule", ["name"]), 2: (None, [])}
    assert [(r.passed, r.accepted) for r in rule_tables.report(results, subs).filter("submission_id = 'c'").collect()] == [(False, False)]


def test_a_rule_of_ones_own(spark):
    manifest, _ = rule_data(spark)

    def few_files(files, table):
        mine = table.of("few_files", F.try_variant_get("params", "$.most", "int").alias("most"))
        counts = files.filter("not is_dir").groupBy("submission_id").count()
        faults = F.when(F.coalesce("count", F.lit(0)) > F.col("most"), F.array(F.lit("files"))).otherwise(F.array().cast("array<string>"))
        return mine.join(counts, "submission_id", "left").select("submission_id", "ord", faults.alias("faults"), F.when(F.size(faults) > 0, "tooManyFiles").alias("code"))

    rule_tables.register_table_rule("few_files", few_files)
    try:
        table = as_table(spark, [("a", [{"name": "few_files", "params": {"most": 2}}]), ("b", [{"name": "few_files", "params": {"most": 2}}])])
        assert {k[0]: r.code for k, r in by_key(rule_tables.judge(manifest, table)).items()} == {"a": "tooManyFiles", "b": None}
    finally:
        del rule_tables.TABLE_RULES["few_files"]
