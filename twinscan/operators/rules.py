"""Validation rules over file manifests (submission_id, path, is_dir, size_bytes, content).

A rule judges all submissions in one aggregate over the manifest: flags and counts are combined
map-side, so one submission with most of the files is no bottleneck. Offending paths are a separate
table of rows, never a list inside one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions.paths import dir_pattern_match, glob_match
from twinscan.functions.text import decode_text

MEGABYTE = 1024 * 1024
DEFAULT_MAX_MB = 100  # fixed value
RESULT = ["submission_id", "passed", "code", "message"]


def entries(manifest: DataFrame) -> DataFrame:
    """Files, listed directories and the directories implied by paths: (submission_id, path, is_dir).

    Implied directories repeat; aggregates of flags do not mind.
    """
    parts = F.split("path", "/")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.named_struct(F.lit("path"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("is_dir"), F.lit(True)),
    )
    own = F.array(F.struct(F.col("path").alias("path"), F.col("is_dir").alias("is_dir")))
    every = F.when(F.size(parts) > 1, F.concat(own, parents)).otherwise(own)
    return manifest.select("submission_id", F.explode(every).alias("e")).select("submission_id", "e.*")


def directories(manifest: DataFrame) -> DataFrame:
    return entries(manifest).filter("is_dir").select("submission_id", F.col("path").alias("directory")).distinct()


def _any(condition: Column) -> Column:
    return F.coalesce(F.max(condition), F.lit(False))


def _listed(flags: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in flags]), lambda x: x.isNotNull())


def _or_false(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _result(df: DataFrame, passed: Column, code: str, good: Column, bad: Column) -> DataFrame:
    return (
        df.withColumn("passed", passed)
        .withColumn("code", F.when(~F.col("passed"), F.lit(code)))
        .withColumn("message", F.when(F.col("passed"), good).otherwise(bad))
    )


def rule_file_presence(manifest: DataFrame, subs: DataFrame, params: dict) -> DataFrame:
    """Every `must_exist` glob matches something, no `forbidden` glob does; the failing globs are listed."""
    must, never = params.get("must_exist") or [], params.get("forbidden") or []
    flags = {f"_m{i}": p for i, p in enumerate(must)} | {f"_f{i}": p for i, p in enumerate(never)}
    found = entries(manifest).groupBy("submission_id").agg(
        *[_any(glob_match(F.col("path"), F.lit(p))).alias(c) for c, p in flags.items()]
    )
    judged = subs.select("submission_id").join(found, "submission_id", "left").select(
        "submission_id",
        _listed([(p, ~_or_false(f"_m{i}")) for i, p in enumerate(must)]).alias("missing_files")
        if must else F.array().cast("array<string>").alias("missing_files"),
        _listed([(p, _or_false(f"_f{i}")) for i, p in enumerate(never)]).alias("forbidden_files")
        if never else F.array().cast("array<string>").alias("forbidden_files"),
    )
    errors = (F.size("missing_files") > 0).cast("int") + (F.size("forbidden_files") > 0).cast("int")
    return _result(
        judged,
        errors == 0,
        "fileValidationFailed",
        F.lit("files as asked for"),
        F.concat(errors.cast("string"), F.lit(" kind(s) of file fault: something missing or not allowed")),
    )


def rule_max_archive_size(manifest: DataFrame, subs: DataFrame, params: dict) -> DataFrame:
    """Total size of all files within `max_size_mb`."""
    limit = float(params.get("max_size_mb", DEFAULT_MAX_MB))
    files = manifest.filter(~F.col("is_dir")).groupBy("submission_id").agg(
        F.sum("size_bytes").alias("actual_size_bytes"), F.count("*").alias("file_count")
    )
    size = F.col("actual_size_bytes") / MEGABYTE
    judged = (
        subs.select("submission_id")
        .join(files, "submission_id", "left")
        .na.fill({"actual_size_bytes": 0, "file_count": 0})
        .withColumn("actual_size_mb", F.bround(size, 2))
        .withColumn("excess_mb", F.when(size > limit, F.bround(size - limit, 2)))
    )
    shown = F.concat(F.format_string("%.2f", size), F.lit(" MB in all, "))
    return _result(
        judged,
        size <= limit,
        "repositorySizeExceeded",
        F.concat(shown, F.lit(f"at most {limit:g} MB allowed")),
        F.concat(shown, F.lit(f"more than the {limit:g} MB allowed")),
    )


def directory_violations(manifest: DataFrame, params: dict) -> DataFrame:
    """Rows (submission_id, code, directory): forbidden, too deep or empty directories."""
    dirs = directories(manifest)
    forbidden, deepest = params.get("forbidden_directories") or [], params.get("max_depth")
    found = []
    if forbidden:
        hit = reduce(lambda x, y: x | y, [dir_pattern_match(F.col("directory"), F.lit(p)) for p in forbidden])
        found.append(("forbiddenDirectoriesFound", dirs.filter(hit)))
    if deepest is not None:
        found.append(("directoryDepthExceeded", dirs.filter(F.size(F.split("directory", "/")) > deepest)))
    if not params.get("allow_empty_dirs", True):
        parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
        filled = manifest.select("submission_id", parent.alias("directory"))
        implied = dirs.select("submission_id", F.regexp_extract("directory", "^(.*)/[^/]*$", 1).alias("directory"))
        found.append(
            ("emptyDirectoriesFound", dirs.join(filled.unionByName(implied), ["submission_id", "directory"], "left_anti"))
        )
    if not found:
        return dirs.limit(0).select("submission_id", F.lit("").alias("code"), "directory")
    parts = [df.select("submission_id", F.lit(code).alias("code"), "directory") for code, df in found]
    return reduce(DataFrame.unionByName, parts)


def rule_directory_structure(manifest: DataFrame, subs: DataFrame, params: dict) -> DataFrame:
    """Required directories exist; none is forbidden, too deep or (unless allowed) empty.

    A required pattern is also satisfied by any file or directory named like its last segment.
    """
    required = params.get("required_directories") or []
    path, is_dir = F.col("path"), F.col("is_dir")
    name = F.element_at(F.split(path, "/"), -1)

    def satisfied(p: str) -> Column:
        return glob_match(name, F.lit(p.split("/")[-1])) | (is_dir & dir_pattern_match(path, F.lit(p)))

    seen = entries(manifest).groupBy("submission_id").agg(
        F.count("*").alias("_entries"), *[_any(satisfied(p)).alias(f"_r{i}") for i, p in enumerate(required)]
    )
    codes = ["forbiddenDirectoriesFound", "directoryDepthExceeded", "emptyDirectoriesFound"]
    bad = directory_violations(manifest, params).groupBy("submission_id").agg(
        *[F.count_if(F.col("code") == c).alias(c) for c in codes]
    )
    missing = _listed([(p, ~_or_false(f"_r{i}")) for i, p in enumerate(required)]) if required else F.array().cast("array<string>")
    total = directories(manifest).groupBy("submission_id").agg(F.count("*").alias("total_directories"))
    judged = (
        subs.select("submission_id")
        .join(seen, "submission_id", "left")
        .join(bad, "submission_id", "left")
        .join(total, "submission_id", "left")
        .select(
            "submission_id",
            missing.alias("missing_directories"),
            *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*codes, "total_directories"]],
        )
    )
    errors = (F.size("missing_directories") > 0).cast("int")
    for c in codes:
        errors = errors + (F.col(c) > 0).cast("int")
    return _result(
        judged,
        errors == 0,
        "directoryStructureValidationFailed",
        F.concat(
            F.col("total_directories").cast("string"), F.lit(" directories, all as asked for")
        ),
        F.concat(errors.cast("string"), F.lit(" kind(s) of directory fault")),
    )


def _content_passes(check: dict, content: Column) -> Column:
    sensitive = check.get("case_sensitive", True)
    if "text" in check:
        if sensitive:
            return content.contains(check["text"])
        return F.lower(content).contains(check["text"].lower())
    flags = "Ud" + ("" if sensitive else "iu") + ("m" if check.get("multiline") else "") + ("s" if check.get("dotall") else "")
    return content.rlike(f"(?{flags}){check['regex']}")


def _text(manifest: DataFrame) -> Column:
    if manifest.schema["content"].dataType.typeName() == "binary":
        return decode_text(F.col("content"))
    return F.col("content")


def content_violations(manifest: DataFrame, params: dict) -> DataFrame:
    """Rows (submission_id, check_index, path) of files that match a check's glob and fail it."""
    failed = F.array(
        *[
            F.when(glob_match(F.col("path"), F.lit(c["file_pattern"])) & ~_content_passes(c, _text(manifest)), F.lit(i))
            for i, c in enumerate(params["checks"])
        ]
    )
    files = manifest.filter(~F.col("is_dir"))
    return files.select(
        "submission_id", F.explode(F.filter(failed, lambda i: i.isNotNull())).alias("check_index"), "path"
    )


def rule_file_content(manifest: DataFrame, subs: DataFrame, params: dict) -> DataFrame:
    """Each check: all files matching its glob hold the text or match the regex, and there is at least one."""
    checks = params["checks"]
    aggs = []
    matched = [F.col(f"_hit{i}") for i in range(len(checks))]
    rows = manifest.select(
        "submission_id",
        *[glob_match(F.col("path"), F.lit(c["file_pattern"])).alias(f"_hit{i}") for i, c in enumerate(checks)],
        *[
            (~F.col("is_dir") & ~_content_passes(c, _text(manifest))).alias(f"_fail{i}")
            for i, c in enumerate(checks)
        ],
    )
    for i in range(len(checks)):
        aggs += [
            F.count_if(matched[i]).alias(f"files_{i}"),
            F.count_if(matched[i] & F.col(f"_fail{i}")).alias(f"failed_{i}"),
        ]
    counted = rows.groupBy("submission_id").agg(*aggs)
    judged = subs.select("submission_id").join(counted, "submission_id", "left").na.fill(0)
    results = F.array(
        *[
            F.struct(
                F.lit(i).alias("check_index"),
                F.col(f"files_{i}").alias("files"),
                F.col(f"failed_{i}").alias("failed"),
                F.when(F.col(f"files_{i}") == 0, "noMatchingFiles").when(F.col(f"failed_{i}") > 0, "contentCheckFailed").alias("code"),
            )
            for i in range(len(checks))
        ]
    )
    judged = judged.select("submission_id", results.alias("checks"))
    errors = F.size(F.filter("checks", lambda c: c["code"].isNotNull()))
    return _result(
        judged,
        errors == 0,
        "fileContentValidationFailed",
        F.lit(f"contents pass all {len(checks)} checks"),
        F.concat(errors.cast("string"), F.lit(" content check(s) not passed")),
    )


Rule = Callable[[DataFrame, DataFrame, dict], DataFrame]
RULES: dict[str, Rule] = {
    "file_presence": rule_file_presence,
    "max_archive_size": rule_max_archive_size,
    "directory_structure": rule_directory_structure,
    "file_content": rule_file_content,
}


def register_rule(name: str, rule: Rule) -> None:
    """Add a rule of one's own: (manifest, submissions, params) -> rows with submission_id, passed, code, message."""
    RULES[name] = rule


def unknown_rules(rules: list[dict]) -> list[str]:
    return [r.get("name") or "(unnamed rule)" for r in rules if r.get("name") not in RULES]


# Parameter specification: rule -> parameter -> expected Python type(s) and its public name.
_TYPES = {
    "file_presence": {"must_exist": (list, "array"), "forbidden": (list, "array")},
    "max_archive_size": {"max_size_mb": ((int, float), "number")},
    "directory_structure": {
        "required_directories": (list, "array"),
        "forbidden_directories": (list, "array"),
        "max_depth": (int, "integer"),
        "allow_empty_dirs": (bool, "boolean"),
    },
    "file_content": {"checks": (list, "array")},
}
_ONE_OF = {
    "file_presence": ["must_exist", "forbidden"],
    "directory_structure": ["required_directories", "forbidden_directories", "max_depth"],
    "file_content": ["checks"],
}
_POSITIVE = {"max_archive_size": "max_size_mb", "directory_structure": "max_depth"}


def _check_error(i: int, check) -> dict | None:
    """First fault of one content check."""
    if not isinstance(check, dict):
        return {"code": "invalidCheckType", "check_index": i}
    pattern = check.get("file_pattern")
    if not pattern:
        return {"code": "missingFilePattern", "check_index": i}
    if not isinstance(pattern, str):
        return {"code": "invalidFilePattern", "check_index": i}
    given = [k for k in ("text", "regex") if k in check]
    if len(given) != 1:
        return {"code": "conflictingContentChecks" if given else "missingContentCheck", "check_index": i}
    kind = given[0]
    if not isinstance(check[kind], str):
        return {"code": "invalidTextType" if kind == "text" else "invalidRegexType", "check_index": i}
    if kind == "regex":
        try:
            re.compile(check["regex"])
        except re.error as e:
            return {"code": "invalidRegexPattern", "check_index": i, "regex_error": str(e)}
    return None


def validate_rule_params(name: str, params: dict) -> dict | None:
    """First fault of a rule's parameters as {code, ...}, or None. A handful of values on the driver."""
    for key, (types, label) in _TYPES.get(name, {}).items():
        value = params.get(key)
        optional = value is None or (types is list and not value and name != "file_content")
        if not optional and not isinstance(value, types):
            return {"code": "invalidParameterType", "parameter": key, "expected_type": label}
    positive = _POSITIVE.get(name)
    if positive and params.get(positive) is not None and not params[positive] >= (1 if positive == "max_depth" else 1e-300):
        return {"code": "invalidParameterValue", "parameter": positive, "constraint": "must be greater than 0"}
    if name in _ONE_OF and not any(params.get(k) for k in _ONE_OF[name]):
        return {"code": "missingRequiredParameters", "required_parameters": _ONE_OF[name]}
    for key, (types, _) in _TYPES.get(name, {}).items():
        if types is list and name != "file_content":
            for p in params.get(key) or []:
                if not isinstance(p, str):
                    return {"code": "invalidPatternType", "parameter": key, "expected_type": "string"}
    if name == "file_content":
        return next((e for e in (_check_error(i, c) for i, c in enumerate(params["checks"])) if e), None)
    return None


def rule_results(manifest: DataFrame, subs: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per submission and rule. A rule with faulty parameters fails everywhere with its code."""
    unknown = unknown_rules(rules)
    if unknown:
        raise ValueError(f"unknown rules {unknown}; available: {list(RULES)}")
    parts = []
    for ord_, rule in enumerate(rules):
        name, params = rule["name"], rule.get("params") or {}
        fault = validate_rule_params(name, params)
        if fault:
            rows = subs.select(
                "submission_id", F.lit(False).alias("passed"), F.lit(fault["code"]).alias("code"), F.lit(str(fault)).alias("message")
            )
        else:
            rows = RULES[name](manifest, subs, params).select(*RESULT)
        parts.append(rows.withColumn("rule_ord", F.lit(ord_)).withColumn("rule_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def validate_all(manifest: DataFrame, subs: DataFrame, rules: list[dict]) -> DataFrame:
    """Report per submission: failed and total rules, the errors in rule order and whether it is accepted.

    `subs` may carry `force_rules`; then failed rules are reported but do not reject.
    """
    results = rule_results(manifest, subs, rules)
    failed = ~F.col("passed")
    error = F.struct("rule_ord", "rule_name", "code", "message")
    report = results.groupBy("submission_id").agg(
        F.count_if(failed).alias("failed_rule_count"),
        F.count("*").alias("total_rule_count"),
        F.array_sort(F.collect_list(F.when(failed, error))).alias("errors"),
    )
    forced = subs.select("submission_id", (F.coalesce("force_rules", F.lit(False)) if "force_rules" in subs.columns else F.lit(False)).alias("_force"))
    return (
        report.join(forced, "submission_id")
        .withColumn("passed", F.col("failed_rule_count") == 0)
        .withColumn("accepted", F.col("passed") | F.col("_force"))
        .drop("_force")
    )
