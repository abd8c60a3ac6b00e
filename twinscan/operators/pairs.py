"""Pair generation without comparing everything with everything.

Rows with the same content are collapsed into one class first, so a group of copies costs one row
however large it is. Similar classes are found by prefix filtering (AllPairs / PPJoin): sets are put
in one global order, rarest parts first; two sets can only reach the threshold if they share a part
among the first few. The join is on that part, and the survivors are verified exactly.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.functions.similarity import set_jaccard
from twinscan.sources.tables import materialize, step

HOT_PART = 5_000  # postings of a part above which its join group is cut into a grid
MOST_WORDS = 256  # longest sketch of a set, in words of 64 bits
EPS = 1e-9


def content_key(*columns: Column) -> Column:
    """256-bit key of arrays of strings, in the given order."""
    return F.sha2(F.concat_ws("\u0002", *[F.concat_ws("\u0001", c) for c in columns]), 256)


def copy_classes(rows: DataFrame, scope: list[str], key: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Collapse rows (scope, id, group_id, parts) of equal part sets to one row each.

    A class keeps the number of its rows and two of them, chosen by (group, id): its first, and its last.
    They stand in different groups unless all rows of the class stand in one. Parts are those of any row, combined
    before the shuffle, so a class travels once from each task, however many copies it has there; so are the columns
    `carry`, which rows of one key have alike.
    """
    carry = carry or []
    # 128 bits of the key as bytes.
    whole_key = content_key(F.sort_array("parts")) if key is None else key
    member = F.struct("group_id", "id")
    return (
        rows.withColumn("class_key", F.unhex(F.substring(whole_key, 1, 32)))
        .groupBy(*scope, "class_key")
        .agg(F.count("*").alias("copies"), F.min(member).alias("low"), F.max(member).alias("high"), F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("parts", *carry)])
        .select(
            *scope,
            "class_key",
            "copies",
            "id",
            F.col("low.id").alias("low_id"),
            F.col("low.group_id").alias("min_group"),
            F.col("high.id").alias("high_id"),
            F.col("high.group_id").alias("max_group"),
            "parts",
            *carry,
        )
    )


def copy_class_members(rows: DataFrame, scope: list[str], key: Column | None = None) -> DataFrame:
    """Each row (scope, id, group_id) with the name of its class, the smallest id in it, and their number:
    who stands behind a pair of classes. As many rows as given; copies are never expanded into pairs."""
    whole_key = content_key(F.sort_array("parts")) if key is None else key
    # Read twice below, and costly to make: both sides of the join, and its filters, would cut all texts again.
    keyed = materialize(rows.select(*scope, whole_key.alias("class_key"), "id", "group_id"))
    named = (
        keyed.groupBy(*scope, "class_key")
        .agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
        .select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("class_key").alias("_key"), "class_id", "copies")
    )
    same = F.col("class_key") == F.col("_key")
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keyed.join(named, same).select(*scope, "id", "group_id", "class_id", "copies")


def packed(n: Column, part: Column) -> Column:
    """An entry of an ordered set as one number: occurrences above, the 32 bits of the part's hash below."""
    low = part.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.least(n, F.lit(0x7FFFFFFF)).cast("bigint"), 32).bitwiseOR(low)


def _ordered(classes: DataFrame, scope: list[str]) -> DataFrame:
    """Hashes of each class's parts in the global order (document frequency, hash), as `packed` numbers.

    Frequencies come by an ordinary shuffled join, whose frequent parts adaptive execution splits. Two parts
    of one hash only make more candidates; all are verified on the parts themselves.
    """
    postings = classes.select(*scope, "class_key", F.explode(F.transform("parts", lambda p: F.hash(p))).alias("part"))
    counted = postings.groupBy("part").agg(F.count("*").alias("n")).withColumnRenamed("part", "_part")
    return (
        postings.join(counted, F.col("part") == F.col("_part"))
        .groupBy(*scope, "class_key")
        .agg(F.array_sort(F.collect_list(packed(F.col("n"), F.col("part")))).alias("parts"))
    )


def leading(ordered: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(scope, class_key, size, lead): the first entries of each set, of which similar sets share one."""
    size = F.size("parts")
    keep = size - F.ceil(size * threshold - EPS).cast("int") + 1
    lead = F.slice("parts", F.lit(1), F.greatest(keep, F.lit(1)))
    return ordered.filter(size > 0).select(*scope, "class_key", size.alias("size"), lead.alias("lead"))


def prefix_rows(leads: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold)) + EPS).cast("int")
    return leads.select(*scope, "class_key", "size", band.alias("band"), F.posexplode("lead").alias("pos", "entry")).select(
        *scope,
        "class_key",
        "size",
        "band",
        "pos",
        F.col("entry").bitwiseAND(F.lit(0xFFFFFFFF)).alias("part"),
        F.greatest(F.ceil(F.shiftright("entry", 32) / HOT_PART), F.lit(1)).cast("int").alias("cells"),
    )


def prefixes(ordered: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    return prefix_rows(leading(ordered, scope, threshold), scope, threshold)


def required_overlap(m: Column, n: Column, threshold: float, measure: str) -> Column:
    """Least number of common parts for the threshold: of the union (jaccard) or of the longer set."""
    if measure == "jaccard":
        return F.ceil((m + n) * (threshold / (1 + threshold)) - EPS)
    return F.ceil(F.greatest(m, n) * threshold - EPS)


def candidate_classes(classes: DataFrame, scope: list[str], threshold: float, measure: str = "jaccard") -> DataFrame:
    """Class pairs (a < b by key) that share a prefix part and pass the length and position bounds.

    Sizes are cut into bands by the threshold, so only equal or neighbouring bands meet; the groups of
    frequent parts are cut into a grid, however frequent they are.
    """
    # Read by both sides of the join; and the shuffles of all parts are gone before those of the candidates come.
    leads = materialize(leading(_ordered(classes, scope), scope, threshold))
    return meet(prefix_rows(leads, scope, threshold), scope, threshold, measure)


def meet(rows: DataFrame, scope: list[str], threshold: float, measure: str) -> DataFrame:
    """Join prefix rows with themselves inside the scope: the larger set of a pair (of equal ones, that with the greater
    key) probes, the other one is met in its own band and the next. As no probing set is smaller, a shorter prefix of the
    other is enough. A part of k cells has a grid of k x k tasks: the probing rows fill its rows, the others its columns,
    so neither side of any task grows with the part.

    All that has to be equal is one hash: rows that meet by chance only make more candidates, some of another scope."""
    every = F.sequence(F.lit(0), F.col("cells") - 1)
    own = F.pmod(F.xxhash64("class_key"), F.col("cells")).cast("int")
    size, rest = F.col("size"), (F.col("size") - F.col("pos")).alias("rest")
    within = [F.col(c).isNotNull() for c in scope]
    known = rows.filter(reduce(and_, within)) if within else rows
    common = [*[F.col(c) for c in scope], F.col("part"), F.col("class_key"), size, rest]

    def placed(side: DataFrame, *more: str) -> DataFrame:
        return side.select(F.xxhash64(*scope, "part", "band", "across", "down").alias("spot"), *more, "class_key", "size", "rest")

    probe = placed(known.select(*common, "band", own.alias("across"), F.explode(every).alias("down")), *scope)
    least = F.ceil(size * (2 * threshold / (1 + threshold)) - EPS) if measure == "jaccard" else F.ceil(size * threshold - EPS)
    index = placed(
        known.filter(F.col("pos") <= size - least)
        .select(*common, F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), own.alias("down"), "cells")
        .select("*", F.explode(every).alias("across"))
    )
    a = probe.select(*scope, "spot", F.col("class_key").alias("a_key"), F.col("size").alias("a_size"), F.col("rest").alias("a_rest"))
    b = index.select("spot", F.col("class_key").alias("b_key"), F.col("size").alias("b_size"), F.col("rest").alias("b_rest"))
    met = a.join(b, "spot").filter(
        (F.struct("a_size", "a_key") > F.struct("b_size", "b_key"))
        & (F.col("b_size") >= F.col("a_size") * threshold - EPS)
        & (F.least("a_rest", "b_rest") >= required_overlap(F.col("a_size"), F.col("b_size"), threshold, measure))
    )
    low, high = F.least("a_key", "b_key"), F.greatest("a_key", "b_key")
    return met.select(*scope, low.alias("a_key"), high.alias("b_key")).distinct()


def sketches(classes: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, class_key, size, sketch): each part turns one bit over, by its hash. What two sets have in common turns no
    bit of one sketch against the other, so these differ in at most as many bits as the sets in parts. About a bit a
    part; the number of words is a power of two, and a longer sketch folds into a shorter one."""
    size = F.size("parts")
    words = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(size / 64.0, F.lit(1.0))))), F.lit(MOST_WORDS)).cast("int")
    turned = classes.select(*scope, "class_key", size.alias("size"), words.alias("words"), F.explode(F.transform("parts", lambda p: F.xxhash64(p))).alias("h"))
    word = F.pmod(F.shiftrightunsigned("h", 6), F.col("words")).cast("int")
    by_word = turned.groupBy(*scope, "class_key", "size", "words", word.alias("word")).agg(
        F.bit_xor(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(63).cast("int"))).alias("bits")
    )
    held = by_word.groupBy(*scope, "class_key", "size", "words").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.col("words") - 1), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint")))
    return held.select(*scope, "class_key", "size", every.alias("sketch"))


def _differing_bits(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    words = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        place = F.sequence(F.lit(0), words - 1)
        parts = F.transform(place, lambda i: F.aggregate(F.filter(x, lambda _, j: j % words == i), zero, lambda s, v: s.bitwiseXOR(v)))
        return F.when(F.size(x) == words, x).otherwise(parts)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def sieve(candidates: DataFrame, classes: DataFrame, scope: list[str], threshold: float, measure: str) -> DataFrame:
    """Candidates without those whose sketches differ in more bits than sets of the threshold differ in parts. Whole sets
    then travel only with pairs that are nearly all similar."""
    small = materialize(sketches(classes, scope))
    for p in ("a", "b"):
        candidates = candidates.join(_side(small, scope, p), [*scope, f"{p}_key"])
    a, b = F.col("a_size"), F.col("b_size")
    most = a + b - 2 * required_overlap(a, b, threshold, measure)
    return candidates.filter(_differing_bits(F.col("a_sketch"), F.col("b_sketch")) <= most).select(*scope, "a_key", "b_key")


def _side(classes: DataFrame, scope: list[str], p: str) -> DataFrame:
    return classes.select(*scope, *[F.col(c).alias(f"{p}_{c}") for c in classes.columns if c not in scope]).withColumnRenamed(
        f"{p}_class_key", f"{p}_key"
    )


def threshold_pairs(
    rows: DataFrame,
    scope: list[str],
    threshold: float,
    measure: str = "jaccard",
    key: Column | None = None,
    across_groups: bool = True,
    carry: list[str] | None = None,
    differences: bool = False,
) -> DataFrame:
    """Exact similarity join of rows (scope, id, group_id, parts) at `threshold`.

    One result row per pair of classes, and one per class that itself holds a pair (similarity 1.0).
    `left_copies`/`right_copies` say how many rows each side stands for, `left_class`/`right_class` name the
    classes by their smallest ids; `copy_class_members` lists all members. With `across_groups` a pair counts only if it involves
    two different groups, and the two ids named are of different groups: the first of one class by (group,
    id) and the last of the other. Without it the smallest ids are named.

    Columns `carry`, which rows of one key have alike, come as `left_...` and `right_...`. With `differences` a pair has the
    number of parts in `common`, and those of one side only in `left_only` and `right_only`, so no set has to be fetched again.
    """
    carry = carry or []
    with step(rows.sparkSession) as keep:
        # From here on a class is a number.
        classes = keep(copy_classes(rows, scope, key, carry).drop("class_key").withColumn("no", F.monotonically_increasing_id()))
        inside = classes.filter(reduce(and_, [F.col(c).isNotNull() for c in scope])) if scope else classes
        # Parts of another scope are other parts.
        sets = inside.select(F.col("no").alias("class_key"), F.transform("parts", lambda p: F.hash(*scope, p)).alias("parts"))
        # Stored before the sieve: the shuffles of all prefixes are gone when sketches travel.
        met = materialize(candidate_classes(sets, [], threshold, measure))
        candidates = keep(sieve(met, sets, [], threshold, measure))
    sides = [classes.select(*[F.col(c).alias(f"{p}_key" if c == "no" else f"{p}_{c}") for c in classes.columns]) for p in "ab"]
    pairs = candidates.join(sides[0], "a_key").join(sides[1], "b_key")
    if measure == "jaccard":
        score = set_jaccard(F.col("a_parts"), F.col("b_parts"))
    else:
        score = F.size(F.array_intersect("a_parts", "b_parts")) / F.greatest(F.size("a_parts"), F.size("b_parts"))
    if scope:
        # Not a key of the join: both sides then travel as one and the same exchange.
        score = F.when(reduce(and_, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in scope]), score)
    pairs = pairs.withColumn("similarity", score).filter(F.col("similarity") >= threshold)
    pairs = pairs.withColumnsRenamed({f"a_{c}": c for c in scope})
    if differences:
        pairs = pairs.withColumn("common", F.size(F.array_intersect("a_parts", "b_parts")))
        pairs = pairs.withColumn("a_only", F.array_except("a_parts", "b_parts")).withColumn("b_only", F.array_except("b_parts", "a_parts"))
    if across_groups:
        # The smaller of the two first members names its side; the other side gives its last member. If those
        # are of one group, then both classes' ranges meet in it, and the members the other way round differ.
        low_first = F.struct("a_min_group", "a_low_id") <= F.struct("b_min_group", "b_low_id")
        straight = F.col("a_min_group") != F.col("b_max_group")
        crossed = F.col("b_min_group") != F.col("a_max_group")
        use_straight = straight & (low_first | ~crossed)
        pairs = pairs.filter(straight | crossed)
        named = {"a": F.when(use_straight, F.col("a_low_id")).otherwise(F.col("a_high_id")), "b": F.when(use_straight, F.col("b_high_id")).otherwise(F.col("b_low_id"))}
    else:
        named = {"a": F.col("a_id"), "b": F.col("b_id")}
    pairs = pairs.withColumn("a_named", named["a"]).withColumn("b_named", named["b"])
    swap = F.col("b_named") < F.col("a_named")

    def pick(c: str, first: bool) -> Column:
        x, y = (f"a_{c}", f"b_{c}") if first else (f"b_{c}", f"a_{c}")
        return F.when(swap, F.col(y)).otherwise(F.col(x))

    distinct_pairs = pairs.select(
        *scope,
        pick("named", True).alias("left_id"),
        pick("named", False).alias("right_id"),
        pick("copies", True).alias("left_copies"),
        pick("copies", False).alias("right_copies"),
        pick("id", True).alias("left_class"),
        pick("id", False).alias("right_class"),
        "similarity",
        *[pick(c, s == "left").alias(f"{s}_{c}") for c in (*carry, *["only"] * differences) for s in ("left", "right")],
        *["common"] * differences,
    )
    repeated = classes.filter((F.col("copies") > 1) & (F.size("parts") > 0))
    if across_groups:
        repeated = repeated.filter(F.col("min_group") != F.col("max_group"))
    copies = repeated.select(
        *scope,
        F.least("low_id", "high_id").alias("left_id"),
        F.greatest("low_id", "high_id").alias("right_id"),
        F.col("copies").alias("left_copies"),
        F.col("copies").alias("right_copies"),
        F.col("id").alias("left_class"),
        F.col("id").alias("right_class"),
        F.lit(1.0).alias("similarity"),
        *[F.col(c).alias(f"{s}_{c}") for c in carry for s in ("left", "right")],
        *[F.array().cast("array<string>").alias(f"{s}_only") for s in ("left", "right") if differences],
        *[F.size("parts").alias("common")] * differences,
    )
    return distinct_pairs.unionByName(copies)


def newest_per_step(subs: DataFrame) -> DataFrame:
    """The latest submission of each project step, by a map-side combined aggregate."""
    newest = F.max_by(F.struct("id", "group_id", "status"), F.struct("upload_time", "id"))
    return subs.groupBy("project", "step").agg(newest.alias("newest")).select(
        "project",
        "step",
        F.col("newest.id").alias("submission_id"),
        F.col("newest.group_id").alias("submission_group"),
    )


def candidate_pairs(newcomers: DataFrame, subs: DataFrame, rule: str = "other_group") -> DataFrame:
    """Each newcomer (one per project step) with the submissions of its step it is compared with.

    `other_group`: any state, another group. `completed`: completed ones, own group allowed.
    One newcomer per step keeps the result as large as the table, not its square.
    """
    peers = subs.select("project", "step", F.col("id").alias("compared_submission_id"), "group_id", "status")
    joined = peers.join(newcomers, ["project", "step"]).filter(
        F.col("compared_submission_id") != F.col("submission_id")
    )
    if rule == "other_group":
        joined = joined.filter(F.col("group_id") != F.col("submission_group"))
    else:
        joined = joined.filter(F.col("status") == "completed")
    return joined.select("project", "step", "submission_id", "compared_submission_id")


def candidate_counts(subs: DataFrame) -> DataFrame:
    """How many comparisons each step holds, counted from group sizes instead of listed pairs:
    ordered pairs of different groups are n^2 minus the sum of squared group sizes."""
    groups = subs.groupBy("project", "step", "group_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("done")
    )
    return groups.groupBy("project", "step").agg(
        F.sum("n").alias("submissions"),
        F.count("*").alias("groups"),
        (F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))).cast("bigint").alias("other_group_pairs"),
        (F.sum("n") * F.sum("done") - F.sum("done")).cast("bigint").alias("completed_pairs"),
    )


def exclude_existing(pairs: DataFrame, comparisons: DataFrame, symmetric: bool = False) -> DataFrame:
    """Drop pairs already compared: in this direction, or with `symmetric` in either."""
    ids = ["submission_id", "compared_submission_id"]
    done = comparisons.select(*ids)
    if not symmetric:
        return pairs.join(done, ids, "left_anti")
    low, high = F.least(*ids).alias("low"), F.greatest(*ids).alias("high")
    return (
        pairs.select("*", low, high)
        .join(done.select(low, high), ["low", "high"], "left_anti")
        .drop("low", "high")
    )


def enrich_with_submissions(comparisons: DataFrame, subs: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Attach the chosen columns of both submissions as structs `submission1`, `submission2`. Submissions are hashed, a
    partition at a time, so the comparisons are not sorted."""
    info = subs.select("id", F.struct("id", *[c for c in columns if c != "id"]).alias("info")).hint("shuffle_hash")
    first = info.select(F.col("id").alias("submission_id"), F.col("info").alias("submission1"))
    second = info.select(F.col("id").alias("compared_submission_id"), F.col("info").alias("submission2"))
    return comparisons.join(first, "submission_id", how).join(second, "compared_submission_id", how)


def smart_file_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Keep file pairs of one language where both files have functions."""
    info = files.filter(F.col("function_count") > 0).select("file_id", "language")
    left = info.select(F.col("file_id").alias("left_id"), F.col("language").alias("language"))
    right = info.select(F.col("file_id").alias("right_id"), F.col("language").alias("right_language"))
    return (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .filter(F.col("language") == F.col("right_language"))
        .drop("right_language")
    )


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") == 1).drop("_row")
