"""Submission-level sequences: the tokens of all files of a submission, in path order, at any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions import similarity as sim
from twinscan.functions.kernels import lcs_similarity
from twinscan.operators.pairs import content_key, threshold_pairs

SEQUENCES = ["types", "structural", "flow", "ops"]
# Four moduli below 2^31, so that products fit a long, and a base for each; together 124 bits.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579]
BASES = [1103515245, 1664525127, 1229782938, 1597334677]


def submission_sequences(features: DataFrame) -> DataFrame:
    """Per submission: each sequence concatenated in path order with its length. A row is one submission."""
    return (
        features.groupBy("submission_id")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.count("*").alias("files_count"),
            *[F.sum(F.size(s)).alias(f"n_{s}") for s in SEQUENCES],
            F.array_sort(F.collect_list(F.struct("path", *SEQUENCES))).alias("files"),
        )
        .select(
            "submission_id", "n_tokens", "files_count", *[f"n_{s}" for s in SEQUENCES],
            *[F.flatten(F.col(f"files.{s}")).alias(s) for s in SEQUENCES],
        )
    )


def sequence_hash(sequence: Column) -> Column:
    """A polynomial hash of a sequence by each of `PRIMES`, and what the hash of all that stands before it has to be multiplied
    by, as a struct. So the hash of a concatenation comes from those of its pieces, wherever they are cut."""
    start = F.struct(*[F.lit(x).cast("bigint").alias(f"{p}{i}") for i in range(len(PRIMES)) for p, x in (("h", 0), ("b", 1))])

    def add(s: Column, x: Column) -> Column:
        made = []
        for i, (p, b) in enumerate(zip(PRIMES, BASES)):
            made += [((s[f"h{i}"] * b + F.pmod(F.xxhash64(x, F.lit(i)), F.lit(p)) + 1) % p).alias(f"h{i}"), ((s[f"b{i}"] * b) % p).alias(f"b{i}")]
        return F.struct(*made)

    return F.aggregate(F.coalesce(sequence, F.array().cast("array<string>")), start, add)


def joined_hash(pieces: Column, name: str) -> Column:
    """The hash of the concatenation of pieces (structs with a `sequence_hash` each), as an array."""
    start = F.struct(*[F.lit(0).cast("bigint").alias(f"h{i}") for i in range(len(PRIMES))])

    def add(s: Column, x: Column) -> Column:
        return F.struct(*[((s[f"h{i}"] * x[name][f"b{i}"] + x[name][f"h{i}"]) % p).alias(f"h{i}") for i, p in enumerate(PRIMES)])

    total = F.aggregate(pieces, start, add)
    return F.array(*[total[f"h{i}"] for i in range(len(PRIMES))])


def submission_keys(features: DataFrame) -> DataFrame:
    """(project, submission_id, _key): submissions of one key have the same parts, concatenated sequences, tokens and number of
    files. Nothing of a submission is held in one row but three numbers and two hashes a file; types give structure and flow.
    Paths are taken to differ within a submission."""
    keys = ["project", "submission_id"]
    files = features.select("submission_id", "path", "n_tokens", *[sequence_hash(F.col(s)).alias(s) for s in ("types", "ops")])
    whole = files.groupBy("submission_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.count("*").alias("files_count"),
        F.array_sort(F.collect_list(F.struct("path", "types", "ops"))).alias("files"),
    )
    hashed = whole.select("submission_id", "n_tokens", "files_count", *[joined_hash(F.col("files"), s).cast("array<string>").alias(s) for s in ("types", "ops")])
    # Also those without a part that counts.
    parts = features.select(*keys, F.explode_outer("parts").alias("part")).distinct()
    usable = F.length(F.trim("part")) > 0
    hashes = [F.when(usable, F.xxhash64("part", F.lit(i))) for i in range(4)]
    sums = parts.groupBy(*keys).agg(
        F.count_if(usable).alias("n_parts"),
        *[F.sum(h.cast("decimal(20,0)")).alias(f"sum{i}") for i, h in enumerate(hashes[:2])],
        *[F.bit_xor(h).alias(f"xor{i}") for i, h in enumerate(hashes[2:])],
    )
    digits = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n_tokens", "files_count", "n_parts", "sum0", "sum1", "xor0", "xor1")]
    # Hashed by partition, so that neither side is sent to the driver for its small files.
    return sums.join(hashed.hint("shuffle_hash"), "submission_id").select(*keys, content_key(F.col("types"), F.col("ops"), F.array(*digits)).alias("_key"))


def submission_sets(features: DataFrame) -> DataFrame:
    """Rows of submissions (project, id, group_id, parts) for pairs and classes. Submissions of one `_key`
    have equal values of every metric against any third; their groups play no part."""
    usable = F.filter(F.array_distinct(F.flatten(F.collect_list("parts"))), lambda p: F.length(F.trim(p)) > 0)
    sets = features.groupBy("project", "submission_id").agg(F.array_sort(usable).alias("parts"))
    keyed = submission_keys(features).withColumnsRenamed({"project": "_project", "submission_id": "id"})
    same = (F.col("submission_id") == F.col("id")) & F.col("project").eqNullSafe(F.col("_project"))
    return sets.hint("merge").join(keyed, same).select("project", "id", F.lit("").alias("group_id"), "parts", "_key")


def submission_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Similar pairs of all submissions of a project, one row a pair of classes of equal submissions."""
    found = threshold_pairs(sets, ["project"], threshold, key=F.col("_key"), across_groups=False)
    return found.withColumnsRenamed({"left_id": "submission_id", "right_id": "compared_submission_id"}).drop("similarity")


def submission_parts(features: DataFrame) -> DataFrame:
    """Distinct signature parts of each submission as rows, so that no submission's set is held in one row."""
    return features.select("submission_id", F.explode("parts").alias("part")).distinct()


def part_overlap(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Exact Jaccard of submission pairs from their part rows, by joining and counting."""
    ids = ["submission_id", "compared_submission_id"]
    usable = parts.filter(F.length(F.trim("part")) > 0)
    sizes = usable.groupBy("submission_id").agg(F.count("*").alias("n"))
    # The compared side is repeated, not the one that may be paired with everything.
    theirs = pairs.select(*ids).join(
        usable.withColumnRenamed("submission_id", "compared_submission_id"), "compared_submission_id"
    )
    common = theirs.join(usable, ["submission_id", "part"], "left_semi").groupBy(*ids).agg(F.count("*").alias("common"))
    n1 = sizes.withColumnsRenamed({"n": "n1"})
    n2 = sizes.withColumnsRenamed({"submission_id": "compared_submission_id", "n": "n2"})
    out = (
        pairs.join(common, ids, "left")
        .join(n1, "submission_id", "left")
        .join(n2, "compared_submission_id", "left")
        .na.fill({"common": 0, "n1": 0, "n2": 0})
    )
    total = F.col("n1") + F.col("n2") - F.col("common")
    return out.withColumn(
        "jaccard_similarity", F.when(total == 0, 1.0).otherwise(F.col("common") / F.greatest(total, F.lit(1)))
    )


def submission_types(features: DataFrame) -> DataFrame:
    """Distinct token types of each submission; as many as the lexer knows, whatever the size."""
    rows = features.select("submission_id", F.explode(F.array_distinct("types")).alias("type")).distinct()
    return rows.groupBy("submission_id").agg(F.collect_list("type").alias("type_set"))


def compare_submissions(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """All metrics of submission pairs (submission_id, compared_submission_id) over their concatenated files.

    Jaccard is the exact one: part sets of whole submissions stay rows.
    """
    ids = ["submission_id", "compared_submission_id"]
    whole = submission_sequences(features).hint("merge").join(submission_types(features), "submission_id", "left")
    names = [c for c in whole.columns if c != "submission_id"]
    first = whole.select("submission_id", F.struct(*names).alias("s1"))
    second = whole.select(F.col("submission_id").alias("compared_submission_id"), F.struct(*names).alias("s2"))
    # Rows are whole submissions: never broadcast, however small the files are that they come from.
    overlap = part_overlap(pairs.select(*ids), submission_parts(features))
    joined = overlap.join(first.hint("merge"), "submission_id").join(second.hint("merge"), "compared_submission_id")
    s1, s2 = F.col("s1"), F.col("s2")
    none = F.array().cast("array<string>")

    def types(s):
        return F.coalesce(s["type_set"], none)

    def score(name: str):
        a, b = F.coalesce(s1[name], none), F.coalesce(s2[name], none)
        return lcs_similarity(a, b)

    metrics = {"structural": "structural", "type_sequence": "types", "flow": "flow", "operation": "ops"}
    scored = joined.select(
        *ids,
        "jaccard_similarity",
        sim.type_similarity(types(s1), types(s2)).alias("type_similarity"),
        *[score(s).alias(f"{m}_similarity") for m, s in metrics.items()],
        sim.length_ratio(s1["n_types"], s2["n_types"]).alias("length_ratio"),
        s1["n_tokens"].alias("tokens1"),
        s2["n_tokens"].alias("tokens2"),
        s1["files_count"].alias("files1"),
        s2["files_count"].alias("files2"),
    ).withColumn("length_penalty", sim.length_penalty(F.col("length_ratio")))
    total = sim.weighted_score({k: f"{k}_similarity" for k in sim.SUBMISSION_WEIGHTS}, sim.SUBMISSION_WEIGHTS)
    return scored.withColumn("overall_similarity", F.bround(total * F.col("length_penalty"), 4))
