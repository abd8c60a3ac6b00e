"""Submission rows: validation, duplicates, lists, lookups, partial updates and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions.links import link_type
from twinscan.operators.pairs import first_per_key
from twinscan.schema import METRICS

# Limits of a submission.
MAX_SIZE_BYTES = 5 * 1024**3
MAX_FILES = 10_000
MAX_DESCRIPTION = 1000


def submission_errors(have: set[str]) -> Column:
    """Codes of the failed checks of a row, in a fixed order."""
    low = F.lower("link")
    hosted = low.contains("github.com") | low.contains("gitlab.com")
    s3 = low.startswith("s3://")
    checks = [
        ("emptyLink", F.coalesce(F.col("link"), F.lit("")) == ""),
        ("hostedLinkNotHttps", ~s3 & hosted & ~low.startswith("https://")),
        ("unsupportedLink", (low != "") & ~s3 & ~hosted),
        ("linkNotRepositoryRoot", hosted & (low.contains("/tree/") | low.contains("/blob/"))),
    ]
    if "file_size_bytes" in have:
        checks += [
            ("negativeFileSize", F.col("file_size_bytes") < 0),
            ("fileSizeTooLarge", F.col("file_size_bytes") > MAX_SIZE_BYTES),
        ]
    if "file_count" in have:
        checks += [("negativeFileCount", F.col("file_count") < 0), ("tooManyFiles", F.col("file_count") > MAX_FILES)]
    if "description" in have:
        checks += [("descriptionTooLong", F.length("description") > MAX_DESCRIPTION)]
    failed = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks])
    return F.filter(failed, lambda c: c.isNotNull())


def validate_submissions(subs: DataFrame) -> DataFrame:
    """Add `errors` (codes) and `valid`."""
    return subs.withColumn("errors", submission_errors(set(subs.columns))).withColumn("valid", F.size("errors") == 0)


def with_link_type(subs: DataFrame) -> DataFrame:
    given = F.col("link_type") if "link_type" in subs.columns else F.lit(None).cast("string")
    return subs.withColumn("link_type", F.coalesce(given, link_type(F.col("link"))))


def deduplicate_submissions(subs: DataFrame) -> DataFrame:
    """Keep the first submission of each project, group and step.

    A map-side combined minimum instead of a window, so a group with very many rows is no problem.
    """
    row = F.struct(*[F.col(c) for c in subs.columns])
    return (
        subs.groupBy("project", "group_id", "step")
        .agg(F.min_by(row, F.struct("upload_time", "id")).alias("_first"))
        .select("_first.*")
    )


def list_submissions(subs: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of submissions, newest first."""
    return subs.orderBy(F.desc("upload_time"), "id").offset(skip).limit(limit)


def lookup(rows: DataFrame, newest_first: bool = True, **equals) -> DataFrame:
    """Rows whose columns equal the given values, newest first; the filters reach the scan."""
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == value)
    if not newest_first:
        return rows
    return rows.orderBy(F.desc("upload_time" if "upload_time" in rows.columns else "overall_similarity"))


def first_of_step(subs: DataFrame) -> DataFrame:
    return first_per_key(subs, ["project", "group_id", "step"], F.col("upload_time"), F.col("id"))


def upsert_submissions(base: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """Partial update by id: fields present in `updates` replace the old ones, `updated_at` is set on every
    updated row, unknown ids are added. One full outer join; the result is a new snapshot."""
    stamp = F.localtimestamp() if now is None else now
    fields = [c for c in base.columns if c not in ("id", "updated_at")]
    new = updates.select("id", F.lit(True).alias("_u"), *[F.col(c).alias(f"_n_{c}") for c in updates.columns if c in fields])
    joined = base.join(new, "id", "full_outer")
    old_stamp = F.col("updated_at") if "updated_at" in base.columns else F.lit(None).cast("timestamp_ntz")
    return joined.select(
        "id",
        *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if f"_n_{c}" in new.columns else F.col(c) for c in fields],
        F.when(F.col("_u"), stamp).otherwise(old_stamp).alias("updated_at"),
    )


def upsert_results(comparisons: DataFrame, results: DataFrame) -> DataFrame:
    """Write scored results into their comparison rows: missing metrics become 0.0, state `completed`."""
    filled = [m for m in METRICS if m in comparisons.columns]
    new = results.select(
        "id", F.lit(True).alias("_done"), *[F.col(c).alias(f"_n_{c}") for c in results.columns if c in filled]
    )
    joined = comparisons.join(new, "id", "left")
    out = []
    for c in comparisons.columns:
        value = F.col(c)
        if c in filled:
            got = F.col(f"_n_{c}") if f"_n_{c}" in new.columns else F.lit(None).cast("double")
            value = F.when(F.col("_done"), F.coalesce(got, F.lit(0.0))).otherwise(value)
        elif c == "status":
            value = F.when(F.col("_done"), "completed").otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)


def update_status(comparisons: DataFrame, changes: DataFrame) -> DataFrame:
    """New state and, where given, error message by comparison id."""
    new = changes.select("id", F.col("status").alias("_s"), F.col("error_message").alias("_e"))
    joined = comparisons.join(new, "id", "left").withColumn("status", F.coalesce("_s", "status"))
    old = F.col("error_message") if "error_message" in comparisons.columns else F.lit(None).cast("string")
    return joined.withColumn("error_message", F.coalesce(F.col("_e"), old)).drop("_s", "_e")


def delete_submissions(subs: DataFrame, comparisons: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop submissions and every comparison that touches them on either side. The ids are hashed, a partition at a time,
    so the comparisons are shuffled but not sorted."""
    gone = ids.select("id").hint("shuffle_hash")
    left = comparisons.join(gone.withColumnRenamed("id", "submission_id"), "submission_id", "left_anti")
    left = left.join(gone.withColumnRenamed("id", "compared_submission_id"), "compared_submission_id", "left_anti")
    return subs.join(gone, "id", "left_anti"), left
