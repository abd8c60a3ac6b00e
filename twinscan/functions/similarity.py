"""Pair metrics as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions.kernels import near_matches
from twinscan.functions.text import strip
from twinscan.functions.tokens import part_set

# Weights and thresholds of the two scores.
SUBMISSION_WEIGHTS = {
    "jaccard": 0.25,
    "structural": 0.30,
    "type_sequence": 0.20,
    "flow": 0.15,
    "operation": 0.05,
    "type": 0.05,
}
FUNCTION_WEIGHTS = {"structural": 0.4, "type_sequence": 0.25, "flow": 0.2, "operation": 0.1, "type_set": 0.05}
FUZZY_SHARE = 0.3
SHARED_BLOCK_SCORE = 0.7
HIGH_SIMILARITY = 0.7


def _ratio(common: Column, total: Column) -> Column:
    return F.when(total > 0, common / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct values; both empty 1.0."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, 1.0).otherwise(common / F.greatest(total, F.lit(1)))


def exact_jaccard(parts1: Column, parts2: Column) -> Column:
    """Jaccard of signature parts without blank ones; both empty 1.0, one empty 0.0."""
    return set_jaccard(part_set(parts1), part_set(parts2))


def type_similarity(types1: Column, types2: Column) -> Column:
    """Jaccard of token types; both empty 0.0."""
    return _ratio(F.size(F.array_intersect(types1, types2)), F.size(F.array_union(types1, types2)))


def with_fuzzy_jaccard(df: DataFrame, name: str, parts1: Column, parts2: Column) -> DataFrame:
    """Add exact Jaccard, blended with the best near matches of the left parts that have no equal.

    Not symmetric. Only parts without an equal travel to the Arrow kernel, whatever their number.
    """

    def kept(parts: Column) -> Column:
        return F.size(F.filter(parts, lambda p: F.length(strip(p)) > 0))

    df = (
        df.withColumn("_s1", part_set(parts1))
        .withColumn("_s2", part_set(parts2))
        .withColumn("_only1", F.array_except("_s1", "_s2"))
        .withColumn("_only2", F.array_except("_s2", "_s1"))
        .withColumn("_exact", set_jaccard(F.col("_s1"), F.col("_s2")))
    )
    df = df.withColumn("_total", near_total(F.col("_only1"), F.col("_only2")))
    blended = fuzzy_jaccard(F.col("_exact"), F.col("_total"), F.size("_only1"), kept(parts1), kept(parts2))
    return df.withColumn(name, blended).drop("_s1", "_s2", "_only1", "_only2", "_exact", "_total")


def near_total(only1: Column, only2: Column) -> Column:
    """Sum of the best near matches of the parts of one set that the other has no equal of."""
    both = (F.size(only1) > 0) & (F.size(only2) > 0)
    return F.coalesce(near_matches(F.when(both, only1), F.when(both, only2)), F.lit(0.0))


def fuzzy_jaccard(exact: Column, total: Column, unmatched: Column, kept1: Column, kept2: Column) -> Column:
    """Exact Jaccard blended with near matches of `total`, for so many unmatched parts of the left set and non-blank parts
    on either side."""
    weight = FUZZY_SHARE * (unmatched / F.greatest(kept1, kept2, F.lit(1)))
    average = total / F.greatest(unmatched, F.lit(1))
    return F.when(total > 0, F.least(F.lit(1.0), exact * (1 - weight) + average * weight)).otherwise(exact)


def length_ratio(n1: Column, n2: Column) -> Column:
    return _ratio(F.least(n1, n2), F.greatest(n1, n2))


def length_penalty(ratio: Column, level: str = "submission") -> Column:
    medium, low = (0.9, 0.8) if level == "submission" else (0.8, 0.6)
    return F.when(ratio > 0.5, 1.0).when(ratio > 0.3, medium).otherwise(low)


def weighted_score(metrics: dict[str, str], weights: dict[str, float]) -> Column:
    """Weighted sum of metric columns. A 0.0 is a score like any other."""
    return reduce(lambda x, y: x + y, [F.col(metrics[k]) * F.lit(w) for k, w in weights.items()])


def combined_score(jaccard: Column, types: Column, shared: Column) -> Column:
    return F.bround(jaccard * 0.4 + types * 0.3 + shared * 0.3, 4)
