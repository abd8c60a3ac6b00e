"""Path functions: project-relative paths, globs and directory patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscan.functions.text import one_of

# Name fragments and directory names that steer the search for the project root.
TEMP_MARKS = ["tmp", "temp", "tempfile"]
PROJECT_DIRS = [
    "src", "lib", "app", "main", "java", "python", "js", "ts", "components", "modules", "packages", "bin",
    "build", "target", "node_modules", ".git", "assets", "resources", "static",
]
SYSTEM_MARKS = ["tmp", "temp", "var", "usr", "opt", "home", "root"]


def path_parts(path: Column) -> Column:
    """Segments of a path; an absolute path starts with the segment '/'."""
    names = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), names)).otherwise(names)


def _has_mark(part: Column, marks: list[str]) -> Column:
    low = F.lower(part)
    hit = F.lit(False)
    for m in marks:
        hit = hit | low.contains(m)
    return hit


def _looks_generated(part: Column) -> Column:
    """Long random or UUID-like names made by temp-directory helpers."""
    dashes = F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit("")))
    plain = F.regexp_replace(part, "[-_]", "")
    return (F.length(part) >= 8) & (
        (dashes >= 2) | ((F.length(part) > 20) & plain.rlike(r"^[\p{L}\p{N}]+$"))
    )


def relative_path(path: Column) -> Column:
    """Path from the guessed project root: behind the last temp directory, else above the first
    source-like directory, else from the first non-system directory, else the last three names."""
    parts = path_parts(path)
    at = F.transform(parts, lambda p, i: F.named_struct(F.lit("i"), i, F.lit("p"), p))
    last_temp = F.array_max(F.transform(F.filter(at, lambda e: _has_mark(e["p"], TEMP_MARKS)), lambda e: e["i"]))
    after_temp = F.filter(
        at, lambda e: (e["i"] > last_temp) & ~e["p"].startswith(".") & ~_looks_generated(e["p"])
    )
    by_layout = F.filter(at, lambda e: one_of(F.lower(e["p"]), PROJECT_DIRS) & (e["i"] > 0))
    by_system = F.filter(at, lambda e: ~_has_mark(e["p"], SYSTEM_MARKS) & ~e["p"].startswith("."))
    root = F.coalesce(
        F.try_element_at(after_temp, F.lit(1))["i"],
        F.try_element_at(by_layout, F.lit(1))["i"] - 1,
        F.try_element_at(by_system, F.lit(1))["i"],
    )
    tail = F.filter(
        F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), lambda p: ~p.startswith(".")
    )
    return F.when(
        root.isNotNull(), F.array_join(F.slice(parts, root + 1, F.size(parts)), "/")
    ).otherwise(
        F.when((F.size(parts) >= 2) & (F.size(tail) > 0), F.array_join(tail, "/")).otherwise(
            F.element_at(F.split(path, "/"), -1)
        )
    )


def glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a glob: `*`, `?` and `[..]` stay inside a segment, `**` spans any
    number of segments (also none). Column to column, so patterns can come from a rules table."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    steps = [
        (r"^\*\*/", "\u0001"),
        (r"/\*\*/", "/\u0001"),
        (r"/\*\*$", "/\u0002"),
        (r"^\*\*$", "\u0002"),
        (r"\*+", "[^/]*"),
        (r"\?", "[^/]"),
        ("\u0001", "(?:[^/]+/)*"),
        ("\u0002", ".*"),
    ]
    for old, new in steps:
        quoted = F.regexp_replace(quoted, old, new)
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def glob_match(path: Column, pattern: Column) -> Column:
    return F.regexp_like(path, glob_regex(pattern))


def dir_pattern_match(path: Column, pattern: Column) -> Column:
    """Directory pattern: equality; one `*` is prefix and suffix of the whole path; a pattern with `/`
    is a leading or inner run of segments; a plain name is any segment."""
    halves = F.split(pattern, "[*]", -1)
    one_star = F.size(halves) == 2
    head = F.element_at(halves, 1)
    tail = F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))
    return (
        F.when(path == pattern, True)
        .when(one_star, path.startswith(head) & path.endswith(tail))
        .when(
            pattern.contains("/"),
            path.startswith(F.concat(pattern, F.lit("/")))
            | path.contains(F.concat(F.lit("/"), pattern, F.lit("/"))),
        )
        .otherwise(F.array_contains(F.split(path, "/"), pattern))
    )
