"""Features per file, computed once, and the scores of pairs of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions import similarity as sim
from twinscan.functions import tokens as tok
from twinscan.functions.kernels import lcs_similarity
from twinscan.operators.pairs import content_key, copy_class_members, threshold_pairs
from twinscan.functions.text import strip
from twinscan.sources.tables import materialize, step

FEATURES = ["parts", "types", "structural", "flow", "ops", "n_tokens"]


def similarity_features(files: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Replace the token array by what the metrics need: signature parts and the four sequences."""
    prepared = files.withColumn("_p", tok.prepare_for_similarity(F.col(tokens)))
    p = F.col("_p")
    return prepared.select(
        *[c for c in files.columns if c != tokens],
        tok.split_signature(F.array_join(tok.signature_texts(p), tok.PART_SEPARATOR)).alias("parts"),
        tok.type_sequence(p).alias("types"),
        tok.structural_sequence(p).alias("structural"),
        tok.logical_flow(p).alias("flow"),
        tok.operations(p).alias("ops"),
        F.size(tokens).alias("n_tokens"),
    )


def shape_key() -> Column:
    """Two files of equal key have equal values of every metric against any third file."""
    return content_key(F.col("parts"), F.col("types"), F.col("ops"))


def attach_features(pairs: DataFrame, features: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Join feature structs `f1`, `f2` to (left_id, right_id) pairs; ids first, arrays last."""
    packed = features.select(F.col(key).alias("_k"), F.struct(*(columns or FEATURES)).alias("_f"))
    left = packed.select(F.col("_k").alias("left_id"), F.col("_f").alias("f1"))
    right = packed.select(F.col("_k").alias("right_id"), F.col("_f").alias("f2"))
    return pairs.join(left, "left_id").join(right, "right_id")


def compare_similarity(pairs: DataFrame, fuzzy: bool = True, rounded: bool = True) -> DataFrame:
    """All submission-level metrics of rows with feature structs `f1` and `f2`."""
    f1, f2 = F.col("f1"), F.col("f2")
    n1, n2 = F.size(f1["types"]), F.size(f2["types"])
    distinct1, distinct2 = F.array_distinct(f1["parts"]), F.array_distinct(f2["parts"])
    if fuzzy:
        scored = sim.with_fuzzy_jaccard(pairs, "jaccard_similarity", f1["parts"], f2["parts"])
    else:
        scored = pairs.withColumn("jaccard_similarity", sim.exact_jaccard(f1["parts"], f2["parts"]))
    scored = scored.select(
        "*",
        sim.type_similarity(f1["types"], f2["types"]).alias("type_similarity"),
        lcs_similarity(f1["structural"], f2["structural"]).alias("structural_similarity"),
        lcs_similarity(f1["types"], f2["types"]).alias("type_sequence_similarity"),
        lcs_similarity(f1["flow"], f2["flow"]).alias("flow_similarity"),
        lcs_similarity(f1["ops"], f2["ops"]).alias("operation_similarity"),
        sim.length_ratio(n1, n2).alias("length_ratio"),
        F.size(F.array_intersect(distinct1, distinct2)).alias("common_elements"),
        F.size(F.array_union(distinct1, distinct2)).alias("total_unique_elements"),
        F.size(f1["parts"]).alias("signature1_length"),
        F.size(f2["parts"]).alias("signature2_length"),
        n1.alias("tokens1_length"),
        n2.alias("tokens2_length"),
        F.array_intersect(f1["types"], f2["types"]).alias("common_types"),
        _signature(f1["parts"]).alias("signature1"),
        _signature(f2["parts"]).alias("signature2"),
    )
    return _overall(scored, rounded).drop("f1", "f2")


def _overall(scored: DataFrame, rounded: bool) -> DataFrame:
    """Add penalty and weighted score to rows with all metrics."""
    scored = scored.withColumn("length_penalty", sim.length_penalty(F.col("length_ratio")))
    total = sim.weighted_score({k: f"{k}_similarity" for k in sim.SUBMISSION_WEIGHTS}, sim.SUBMISSION_WEIGHTS)
    scored = scored.withColumn("overall_similarity", total * F.col("length_penalty"))
    if rounded:
        for c in (
            "overall_similarity", "structural_similarity", "type_sequence_similarity", "flow_similarity",
            "operation_similarity", "length_penalty", "length_ratio",
        ):
            scored = scored.withColumn(c, F.bround(c, 4))
    return scored


def _signature(parts: Column) -> Column:
    """Hash of a whole signature."""
    return F.sha2(F.array_join(parts, tok.PART_SEPARATOR), 256)


def function_similarity(pairs: DataFrame) -> DataFrame:
    """Function-level metrics of rows with feature structs `f1` and `f2`; all zero when a side has no token."""
    f1, f2 = F.col("f1"), F.col("f2")
    n1, n2 = F.size(f1["types"]), F.size(f2["types"])
    present = (f1["n_tokens"] > 0) & (f2["n_tokens"] > 0)

    def metric(c: Column) -> Column:
        return F.when(present, c).otherwise(F.lit(0.0))

    scored = pairs.select(
        "*",
        metric(lcs_similarity(f1["structural"], f2["structural"])).alias("structural_similarity"),
        metric(lcs_similarity(f1["types"], f2["types"])).alias("type_sequence_similarity"),
        metric(sim.type_similarity(f1["types"], f2["types"])).alias("type_set_similarity"),
        metric(lcs_similarity(f1["flow"], f2["flow"])).alias("flow_similarity"),
        metric(lcs_similarity(f1["ops"], f2["ops"])).alias("operation_similarity"),
        F.array_intersect(f1["types"], f2["types"]).alias("common_patterns"),
        sim.length_penalty(sim.length_ratio(n1, n2), "function").alias("_penalty"),
    )

    scored = scored.withColumn("_score", sim.weighted_score({k: f"{k}_similarity" for k in sim.FUNCTION_WEIGHTS}, sim.FUNCTION_WEIGHTS))
    return scored.withColumn(
        "similarity_score", F.when(present, F.col("_score") * F.col("_penalty")).otherwise(F.lit(0.0))
    ).drop("f1", "f2", "_penalty", "_score")


def file_rows(features: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of files for pairs and classes; files equal in every feature have one `_key`."""
    return features.select(
        *scope,
        F.col("file_id").alias("id"),
        "group_id",
        tok.part_set(F.col("parts")).alias("parts"),
        shape_key().alias("_key"),
    )


def file_pairs(features: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Pairs of distinct files (features with file_id, group_id) whose signature Jaccard reaches the
    threshold; files equal in every feature are one class."""
    return threshold_pairs(file_rows(features, scope), scope, threshold, key=F.col("_key"))


def file_class_members(features: DataFrame, scope: list[str]) -> DataFrame:
    """All files with their class, as `file_pairs` makes them: who stands behind its pairs."""
    return copy_class_members(file_rows(features, scope), scope, key=F.col("_key")).withColumnRenamed("id", "file_id")


def sequence_key() -> Column:
    """Two files of equal key have equal sequences: 128 bits of a hash of types and operators, which give the others."""
    return F.unhex(F.substring(content_key(F.col("types"), F.col("ops")), 1, 32))


def file_facts() -> Column:
    """What the metrics need of a file (features) besides its set of parts and its sequences, in few bytes."""
    blank = F.filter("parts", lambda p: F.length(strip(p)) == 0)
    return F.struct(
        F.unhex(_signature(F.col("parts"))).alias("signature"),
        F.size("parts").alias("parts"),
        F.size("types").alias("tokens"),
        (F.size("parts") - F.size(blank)).alias("kept"),
        F.size(F.array_distinct("parts")).alias("distinct"),
        F.array_distinct(blank).alias("blank"),
        sequence_key().alias("sequences"),
    )


def with_codes(features: DataFrame) -> DataFrame:
    """Add types as their different ones, `kinds`, and places in these, `codes`; what is made of types alone is made again
    where it is used."""
    kinds = features.withColumn("kinds", F.array_distinct("types"))
    return kinds.withColumn("codes", F.transform("types", lambda t: F.array_position("kinds", t).cast("int")))


def sequence_scores(wanted: DataFrame, sequences: DataFrame) -> DataFrame:
    """Metrics of pairs (left_sequences, right_sequences) of keys of coded sequences, each pair of keys once."""
    rows = wanted.distinct()
    for side in ("left", "right"):
        types = F.transform("codes", lambda c: F.get(F.col("kinds"), c - 1))
        mine = sequences.select(F.col("sequences").alias(f"{side}_sequences"), F.struct("kinds", types.alias("types"), "ops").alias(side))
        rows = rows.join(mine, f"{side}_sequences")
    made = [F.struct(f"{s}.*", tok.structural_of(F.col(f"{s}.types")).alias("structural"), tok.flow_of(F.col(f"{s}.types")).alias("flow")).alias(s) for s in ("left", "right")]
    rows = rows.select("left_sequences", "right_sequences", *made)
    f1, f2 = F.col("left"), F.col("right")
    return rows.select(
        "left_sequences",
        "right_sequences",
        sim.type_similarity(f1["kinds"], f2["kinds"]).alias("type_similarity"),
        *[lcs_similarity(f1[s], f2[s]).alias(f"{m}_similarity") for m, s in (("structural", "structural"), ("type_sequence", "types"), ("flow", "flow"), ("operation", "ops"))],
        F.array_intersect(f1["kinds"], f2["kinds"]).alias("common_types"),
    )


def compare_files(files: DataFrame, scope: list[str], threshold: float, fuzzy: bool = True) -> DataFrame:
    """Tokenised files (file_id, group_id, tokens) to scored pairs of similar files.

    A pair is two ids and the facts of both sides, found with it. Sets are compared where the pairs are found, sequences
    once for each different pair of them; neither travels with every pair again.
    """
    with step(files.sparkSession) as keep:
        features = with_codes(similarity_features(files.select(*scope, "file_id", "group_id", "tokens")))
        rows = materialize(
            features.select(
                *scope, F.col("file_id").alias("id"), "group_id", tok.part_set(F.col("parts")).alias("parts"),
                shape_key().alias("_key"), file_facts().alias("facts"), "kinds", "codes", "ops",
            )
        )
        sequences = keep(rows.select("facts.sequences", "kinds", "codes", "ops").dropDuplicates(["sequences"]))
        sets = rows.select(*scope, "id", "group_id", "parts", "_key", "facts")
        found = threshold_pairs(sets, scope, threshold, key=F.col("_key"), carry=["facts"], differences=True)
        exact, f1, f2 = F.col("similarity"), F.col("left_facts"), F.col("right_facts")
        if fuzzy:
            found = found.withColumn("_total", sim.near_total(F.col("left_only"), F.col("right_only")))
            exact = sim.fuzzy_jaccard(exact, F.col("_total"), F.size("left_only"), f1["kept"], f2["kept"])
        common = F.col("common") + F.size(F.array_intersect(f1["blank"], f2["blank"]))
        pairs = keep(
            found.select(
                *scope, "left_id", "right_id", "left_copies", "right_copies", "left_class", "right_class",
                exact.alias("jaccard_similarity"),
                sim.length_ratio(f1["tokens"], f2["tokens"]).alias("length_ratio"),
                common.alias("common_elements"),
                (f1["distinct"] + f2["distinct"] - common).alias("total_unique_elements"),
                *[f["parts"].alias(f"signature{i}_length") for i, f in ((1, f1), (2, f2))],
                *[f["tokens"].alias(f"tokens{i}_length") for i, f in ((1, f1), (2, f2))],
                *[f["signature"].alias(f"signature{i}") for i, f in ((1, f1), (2, f2))],
                f1["sequences"].alias("left_sequences"), f2["sequences"].alias("right_sequences"),
            ), hint=None
        )
    keys = ["left_sequences", "right_sequences"]
    scores = sequence_scores(pairs.select(*keys), sequences)
    # Hashed by partition: few pairs of sequences may stand behind many pairs of files, which are neither sorted nor sent to the driver.
    scored = pairs.join(scores.hint("shuffle_hash"), keys).drop(*keys)
    return _overall(scored.withColumns({c: F.lower(F.hex(c)) for c in ("signature1", "signature2")}), True)
