"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.functions import languages, links, similarity, text, tokens
from twinscan.operators import blocks, functions, graph, pairs, reports, rule_tables, rules, scoring, sequences, submissions
from twinscan.operators.tokenize import token_rows, tokenize, tokenize_files, type_counts
from twinscan.plans.bindings import table, view
from twinscan.sources import manifest as manifests
from twinscan.sources.tables import materialize, scratch_folder
from twinscan.sources.token_store import stored_tokens as read_tokens
from twinscan.sources.token_store import update_token_store
from twinscan.streaming.arrival_index import ArrivalIndex
from twinscan.streaming.incremental import incremental_compare, read_pairs, with_copies

DOCUMENT_THRESHOLD = 0.7
SOURCE_THRESHOLD = 0.8
SOURCE_SCOPE = ["project", "language"]

# The rule set every site of the pages table is checked with.
SITE_RULES = [
    {
        "name": "file_presence",
        "params": {"must_exist": ["*/*.html", "en/*", "**/index.html"], "forbidden": ["**/9*", "de/?", "[ef][rs]/*"]},
    },
    {"name": "max_archive_size", "params": {"max_size_mb": 0.05}},
    {
        "name": "directory_structure",
        "params": {"required_directories": ["en", "fr/*", "blog"], "forbidden_directories": ["es", "d*e"], "max_depth": 1},
    },
    {
        "name": "file_content",
        "params": {
            "checks": [
                {"file_pattern": "en/*", "text": "THE ", "case_sensitive": False},
                {"file_pattern": "**/*.html", "regex": "<h1>[A-Z][a-z]+"},
                {"file_pattern": "??/*", "regex": "^<!doctype html>.*</html>$", "case_sensitive": False, "dotall": True},
            ]
        },
    },
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- shared inputs ---------------------------------------------------------------------------------


def prose_tokens(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "prose_files").withColumn("tokens", tokenize(F.col("content"), "text"))


def prose_sets(spark: SparkSession, d: str) -> DataFrame:
    parts = tokens.part_set(tokens.signature_parts(F.col("tokens")))
    return prose_tokens(spark, d).select("project", F.col("file_id").alias("id"), "group_id", parts.alias("parts"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "source_files").withColumn("language", languages.detect_language(F.col("path")))


def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenize_files(source_files(spark, d))


def source_features(spark: SparkSession, d: str) -> DataFrame:
    return scoring.similarity_features(source_tokens(spark, d).select(*SOURCE_SCOPE, "file_id", "group_id", "tokens"))


def source_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return scoring.file_pairs(source_features(spark, d), SOURCE_SCOPE, SOURCE_THRESHOLD)


def source_pairs(spark: SparkSession, d: str) -> DataFrame:
    return source_class_pairs(spark, d).select("left_id", "right_id")


def site_manifest(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "page_files").select(
        "submission_id",
        "path",
        F.lit(False).alias("is_dir"),
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        "content",
    )


def sites(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "page_files").select("submission_id").distinct()


def submission_rows(spark: SparkSession, d: str) -> DataFrame:
    return submissions.with_link_type(view(spark, d, "submissions"))


def source_blocks(spark: SparkSession, d: str):
    """(file pairs, functions, numbered blocks), each written once since several branches read them."""
    file_pairs = materialize(source_pairs(spark, d))
    found = materialize(functions.all_functions(source_files(spark, d)))
    return file_pairs, found, materialize(graph.number_blocks(blocks.shared_blocks(file_pairs, found)))


# ---- scalar functions ------------------------------------------------------------------------------


@query
def lang_detect(spark, d):
    f = view(spark, d, "page_files")
    return f.select(
        "file_id",
        languages.detect_language(F.col("path")).alias("by_path"),
        languages.detect_language(F.col("path"), F.col("content")).alias("by_content"),
        languages.is_supported(F.col("path")).alias("supported"),
    )


@query
def supported_files(spark, d):
    return manifests.supported_files(site_manifest(spark, d)).select("submission_id", "path", "size_bytes")


@query
def resolve_root(spark, d):
    return manifests.resolve_project_root(site_manifest(spark, d)).select("submission_id", "path", "size_bytes")


@query
def link_classify(spark, d):
    s = view(spark, d, "submissions")
    s3 = links.parse_s3_url(F.col("link"))
    return s.select(
        "id",
        links.link_type(F.col("link")).alias("link_type"),
        links.repo_name(F.col("link")).alias("repo_name"),
        s3["bucket"].alias("bucket"),
        s3["key"].alias("object_key"),
        links.normalize_repo_url(F.col("link"), "github").alias("github_url"),
        links.normalize_repo_url(F.col("link"), "gitlab").alias("gitlab_url"),
    )


@query
def validate_submissions(spark, d):
    checked = submissions.validate_submissions(view(spark, d, "submissions"))
    return checked.select("id", F.array_join("errors", ",").alias("errors"), "valid")


# ---- tokens ----------------------------------------------------------------------------------------


@query
def tokenize_documents(spark, d):
    return type_counts(prose_tokens(spark, d), "project", "file_id")


@query
def tokenize_sources(spark, d):
    return token_rows(source_tokens(spark, d), "file_id").select("file_id", "pos", "type", "text", "start")


@query
def tokenize_pages(spark, d):
    rows = view(spark, d, "page_files").select("file_id", tokenize(F.col("content"), "markup").alias("tokens"))
    return type_counts(rows, "file_id").drop("last_line")


@query
def token_profile(spark, d):
    return reports.file_profile(prose_tokens(spark, d))


@query
def decode_text(spark, d):
    """Pages as the bytes a manifest holds, some in Latin-1 and with carriage returns, decoded again."""
    pages = view(spark, d, "page_files").withColumn("lines", F.replace("content", F.lit("<"), F.lit("\r\n<")))
    stored = F.when(F.col("file_id") % 3 == 0, F.encode("lines", "ISO-8859-1")).otherwise(F.encode("lines", "UTF-8"))
    return pages.select("file_id", F.md5(F.encode(text.decode_text(stored), "UTF-8")).alias("text_md5"))


@query
def stored_tokens(spark, d):
    """Token counts of all source files, read back from the token store; filling it twice stores nothing twice."""
    files = source_files(spark, d).select("file_id", "path", "language", "content")
    place = f"{scratch_folder(spark)}/twinscan-tokens-{uuid.uuid4().hex}"
    for _ in range(2):
        update_token_store(files, place)
    return read_tokens(files, place).select("file_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query
def combined_score(spark, d):
    c = view(spark, d, "comparisons")
    score = similarity.combined_score(F.col("jaccard_similarity"), F.col("type_similarity"), F.col("structural_similarity"))
    return c.select("id", score.alias("combined_score"))


@query
def prepare_similarity(spark, d):
    prepared = source_tokens(spark, d).select(F.explode(tokens.prepare_for_similarity(F.col("tokens"))).alias("t"))
    return prepared.groupBy("t.type", "t.text", "t.normalized").agg(F.count("*").alias("n"))


@query
def signature(spark, d):
    parts = tokens.signature_parts(F.col("tokens"))
    return source_tokens(spark, d).select(
        "file_id", tokens.similarity_signature(F.col("tokens")).alias("signature"), F.size(parts).alias("parts")
    )


def _sequence(spark, d, function):
    p = tokens.prepare_for_similarity(F.col("tokens"))
    return source_tokens(spark, d).select("file_id", F.array_join(function(p), " ").alias("sequence"))


@query
def type_sequence(spark, d):
    return _sequence(spark, d, tokens.type_sequence)


@query
def structural_sequence(spark, d):
    return _sequence(spark, d, tokens.structural_sequence)


@query
def flow_sequence(spark, d):
    return _sequence(spark, d, tokens.logical_flow)


@query
def operation_sequence(spark, d):
    return _sequence(spark, d, tokens.operations)


@query
def detokenize(spark, d):
    return source_tokens(spark, d).select("file_id", tokens.detokenize(F.col("tokens")).alias("text"))


@query
def code_blocks(spark, d):
    """All blocks of three lines of each text."""
    starts = F.sequence(F.lit(0), F.size(F.split("content", "\n")) - 1, F.lit(3))
    begun = view(spark, d, "prose_files").select("file_id", "content", F.explode(starts).alias("start_line"))
    return begun.select("file_id", "start_line", text.code_block(F.col("content"), F.col("start_line"), F.col("start_line") + 3).alias("block"))


@query
def import_extract(spark, d):
    f = view(spark, d, "source_files")
    return f.select("file_id", F.array_join(text.extract_imports(F.col("content")), ",").alias("imports"))


# ---- functions and blocks --------------------------------------------------------------------------


@query
def function_list(spark, d):
    found = functions.extract_functions(source_files(spark, d))
    return found.drop("function_id")


@query
def function_list_fallback(spark, d):
    """Functions by generic headers in the source files in which the script headers alone find nothing."""
    files = source_files(spark, d)
    scripts = functions.extract_functions(files.filter(F.col("language") != "python"))
    return functions.extract_functions_fallback(files, scripts).select(
        "file_id", "function_index", "function_name", "start_line", "end_line"
    )


@query
def function_counts(spark, d):
    files = source_files(spark, d)
    return functions.preprocess_files(files, functions.extract_functions(files)).select("file_id", "language", "function_count")


@query
def page_blocks(spark, d):
    return functions.html_blocks(view(spark, d, "page_files"))


@query
def call_edges(spark, d):
    return graph.function_call_edges(functions.extract_functions(source_files(spark, d)))


# ---- pairs -----------------------------------------------------------------------------------------


@query
def candidate_pairs(spark, d):
    s = view(spark, d, "submissions")
    return pairs.candidate_pairs(pairs.newest_per_step(s), s)


@query
def candidate_pairs_completed(spark, d):
    s = view(spark, d, "submissions")
    return pairs.candidate_pairs(pairs.newest_per_step(s), s, rule="completed")


@query
def candidate_counts(spark, d):
    return pairs.candidate_counts(view(spark, d, "submissions"))


@query
def exclude_existing(spark, d):
    c = view(spark, d, "comparisons").select("submission_id", "compared_submission_id", "project", "step", "status")
    waiting, done = c.filter("status <> 'completed'"), c.filter("status = 'completed'")
    return pairs.exclude_existing(waiting, done).select("submission_id", "compared_submission_id", "project", "step")


@query
def exclude_existing_symmetric(spark, d):
    c = view(spark, d, "comparisons").select("submission_id", "compared_submission_id", "project", "step", "status")
    waiting, done = c.filter("status <> 'completed'"), c.filter("status = 'completed'")
    return pairs.exclude_existing(waiting, done, symmetric=True).select("submission_id", "compared_submission_id", "project", "step")


@query
def document_pairs(spark, d):
    found = pairs.threshold_pairs(prose_sets(spark, d), ["project"], DOCUMENT_THRESHOLD)
    return found.withColumnRenamed("similarity", "jaccard_similarity")


@query
def copy_class_members(spark, d):
    """All documents with their class of equal part sets: the members that stand behind `document_pairs`."""
    return pairs.copy_class_members(prose_sets(spark, d), ["project"]).withColumnRenamed("id", "file_id")


@query
def source_class_members(spark, d):
    """All source files with their class and submission: the members that stand behind every pair of source files."""
    members = scoring.file_class_members(source_features(spark, d), SOURCE_SCOPE)
    return members.join(view(spark, d, "source_files").select("file_id", "submission_id"), "file_id")


@query
def document_alerts(spark, d):
    """The flagship: similar documents of one language with what is known of both sides, highest first."""
    found = document_pairs(spark, d)
    info = view(spark, d, "prose_files").select("file_id", "path", F.length("content").cast("bigint").alias("size"))
    left = info.select(F.col("file_id").alias("left_id"), F.col("path").alias("left_path"), F.col("size").alias("left_size"))
    right = info.select(F.col("file_id").alias("right_id"), F.col("path").alias("right_path"), F.col("size").alias("right_size"))
    return found.join(left, "left_id").join(right, "right_id").orderBy(F.desc("jaccard_similarity"), "left_id", "right_id")


@query
def document_similarity(spark, d):
    """All metrics of similar documents, with near matches; the longest sequences make SQL too slow."""
    return scoring.compare_files(prose_tokens(spark, d), ["project"], DOCUMENT_THRESHOLD).drop("common_types")


@query
def file_similarity(spark, d):
    scored = scoring.compare_files(source_tokens(spark, d), SOURCE_SCOPE, SOURCE_THRESHOLD, fuzzy=False)
    return scored.withColumn("common_types", F.array_join(F.array_sort("common_types"), ","))


@query
def fuzzy_similarity(spark, d):
    scored = scoring.compare_files(source_tokens(spark, d), SOURCE_SCOPE, SOURCE_THRESHOLD)
    return scored.select(*SOURCE_SCOPE, "left_id", "right_id", "jaccard_similarity", "overall_similarity")


@query
def smart_file_pairs(spark, d):
    files = source_files(spark, d)
    counted = functions.preprocess_files(files, functions.extract_functions(files))
    return pairs.smart_file_pairs(source_pairs(spark, d), counted)


@query
def submission_sequences(spark, d):
    features = scoring.similarity_features(source_tokens(spark, d).select("submission_id", "path", "file_id", "tokens"))
    out = sequences.submission_sequences(features)
    return out.select(
        "submission_id", "n_tokens", "files_count", *[f"n_{s}" for s in sequences.SEQUENCES],
        *[F.md5(F.array_join(s, " ")).alias(s) for s in sequences.SEQUENCES],
    )


def _largest_with_others(spark, d):
    """(pairs, features): each project's largest submission with all its others."""
    features = materialize(
        scoring.similarity_features(source_tokens(spark, d).select("project", "submission_id", "path", "file_id", "tokens"))
    )
    sizes = features.groupBy("project", "submission_id").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("project").agg(F.max_by("submission_id", F.struct("n", "submission_id")).alias("submission_id"))
    others = sizes.select("project", F.col("submission_id").alias("compared_submission_id"))
    return largest.join(others, "project").filter("submission_id <> compared_submission_id"), features


@query
def submission_overlap(spark, d):
    wanted, features = _largest_with_others(spark, d)
    return sequences.part_overlap(wanted, sequences.submission_parts(features))


@query
def similar_submissions(spark, d):
    """Part overlap of all similar pairs of submissions, whichever their sizes: one row a pair of classes."""
    _, features = _largest_with_others(spark, d)
    found = materialize(sequences.submission_pairs(sequences.submission_sets(features), SOURCE_THRESHOLD))
    return sequences.part_overlap(found, sequences.submission_parts(features))


@query
def submission_class_members(spark, d):
    """All submissions with their class of equal ones: the members that stand behind `similar_submissions`."""
    _, features = _largest_with_others(spark, d)
    rows = sequences.submission_keys(features).select("project", F.col("submission_id").alias("id"), F.lit("").alias("group_id"), "_key")
    return pairs.copy_class_members(rows, ["project"], key=F.col("_key")).drop("group_id").withColumnRenamed("id", "submission_id")


@query
def submission_similarity(spark, d):
    """All metrics of whole submissions, of each project's largest with all others and of all similar pairs
    (one a pair of classes); their long sequences make SQL too slow."""
    wanted, features = _largest_with_others(spark, d)
    ids = ["submission_id", "compared_submission_id"]
    similar = sequences.submission_pairs(sequences.submission_sets(features), SOURCE_THRESHOLD).select(*ids)
    known = wanted.select(*ids)
    turned = known.select(F.col(ids[1]).alias(ids[0]), F.col(ids[0]).alias(ids[1]))
    more = similar.join(known.unionByName(turned), ids, "left_anti")
    return sequences.compare_submissions(materialize(known.unionByName(more)), features)


# ---- shared blocks and graph -----------------------------------------------------------------------


@query
def shared_blocks(spark, d):
    found = functions.all_functions(source_files(spark, d))
    out = blocks.shared_blocks(source_pairs(spark, d), found)
    return out.withColumn("common_patterns", F.array_join(F.array_sort("common_patterns"), ","))


@query
def shared_block_code(spark, d):
    _, found, shared = source_blocks(spark, d)
    out = blocks.attach_code(shared, found)
    return out.select(
        "left_id", "right_id", "left_function", "right_function", "left_language", "right_language", "left_node_type",
        "right_node_type", "left_code_block", "right_code_block",
    )


def _summaries(spark, d):
    file_pairs, found, shared = source_blocks(spark, d)
    files = functions.preprocess_files(source_files(spark, d), found)
    return blocks.shared_block_summary(file_pairs, shared, files)


@query
def shared_block_summary(spark, d):
    return reports.summary_flags(_summaries(spark, d))


@query
def class_block_summary(spark, d):
    """`shared_block_summary` with the files, submissions and groups of the class behind either file."""
    class_pairs = materialize(source_class_pairs(spark, d))
    found = materialize(functions.all_functions(source_files(spark, d)))
    shared = graph.number_blocks(blocks.shared_blocks(class_pairs.select("left_id", "right_id"), found))
    files = functions.preprocess_files(source_files(spark, d), found)
    summaries = blocks.shared_block_summary(class_pairs.select("left_id", "right_id"), shared, files)
    return blocks.class_summary(summaries, class_pairs, source_class_members(spark, d))


@query
def rank_file_pairs(spark, d):
    return reports.rank_file_pairs(_summaries(spark, d))


@query
def multifile_summary(spark, d):
    return blocks.multifile_summary(_summaries(spark, d), view(spark, d, "source_files"))


@query
def best_match(spark, d):
    _, found, shared = source_blocks(spark, d)
    sides = [graph.best_match_per_function(shared, found, s) for s in ("left", "right")]
    return sides[0].unionByName(sides[1])


@query
def function_block_matches(spark, d):
    _, found, shared = source_blocks(spark, d)
    return graph.match_functions_to_blocks(shared, found, "left")


@query
def similarity_edges(spark, d):
    _, found, shared = source_blocks(spark, d)
    return graph.similarity_edges(shared, found)


@query
def graph_nodes(spark, d):
    file_pairs, found, shared = source_blocks(spark, d)
    return graph.graph_nodes(file_pairs, view(spark, d, "source_files"), found, shared)


@query
def graph_edges(spark, d):
    file_pairs, found, shared = source_blocks(spark, d)
    return graph.graph_edges(file_pairs, found, shared)


@query
def graph_summary(spark, d):
    file_pairs, found, shared = source_blocks(spark, d)
    files = functions.preprocess_files(source_files(spark, d), found)
    return graph.graph_summary(file_pairs, graph.graph_edges(file_pairs, found, shared), files)


def _combined_graph(spark, d):
    file_pairs, found, shared = source_blocks(spark, d)
    nodes = graph.graph_nodes(file_pairs, view(spark, d, "source_files"), found, shared)
    edges = graph.graph_edges(file_pairs, found, shared)
    return graph.combined_graph(file_pairs, nodes, edges)


@query
def combined_graph(spark, d):
    return _combined_graph(spark, d)[1]


@query
def combined_graph_nodes(spark, d):
    return _combined_graph(spark, d)[0]


@query
def best_file_pair(spark, d):
    scored = scoring.compare_files(source_tokens(spark, d), SOURCE_SCOPE, SOURCE_THRESHOLD, fuzzy=False)
    return reports.best_file_pair(scored)


@query
def comparison_details(spark, d):
    scored = scoring.compare_files(source_tokens(spark, d), SOURCE_SCOPE, SOURCE_THRESHOLD, fuzzy=False)
    out = reports.comparison_details(scored)
    x = F.col("similarity_details")
    return out.select(
        "left_id", "right_id", x["common_elements"].alias("common_elements"),
        x["processed_tokens_count"]["submission1"].alias("tokens1"),
        x["processed_tokens_count"]["submission2"].alias("tokens2"),
        x["similarity_breakdown"]["jaccard_similarity"].alias("jaccard_similarity"),
    )


# ---- reports ---------------------------------------------------------------------------------------


@query
def similarity_statistics(spark, d):
    s = reports.similarity_statistics(view(spark, d, "comparisons"))
    counts = F.map_entries("status_breakdown")
    shown = F.array_join(F.transform(counts, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return s.withColumn("status_breakdown", shown)


@query
def similarity_alerts(spark, d):
    a = reports.similarity_alerts(view(spark, d, "comparisons"), view(spark, d, "submissions"))
    return a.select(
        "similarity_id", "project", "step", "overall_similarity", "shared_blocks_count", "detected_at",
        F.col("submission1.id").alias("submission1"), F.col("submission1.link").alias("link1"),
        F.col("submission2.id").alias("submission2"), F.col("submission2.upload_time").alias("upload2"),
    )


@query
def similarity_overview(spark, d):
    o = reports.similarity_overview(view(spark, d, "comparisons"), view(spark, d, "submissions"))
    return o.select(
        "project", "step", "total_comparisons", "high_similarity_pairs", "total_flagged_pairs", "review_required",
        "investigation_priority", F.array_join(F.transform("alerts", lambda a: a["id"]), ",").alias("alerts"),
    )


@query
def bidirectional_similarities(spark, d):
    return reports.submission_similarities(view(spark, d, "comparisons"), view(spark, d, "submissions")).select(
        "similarity_id", "submission_id", "compared_submission_id", "compared_submission_link", "is_swapped",
        "overall_similarity", "status",
    )


@query
def similarity_totals(spark, d):
    seen = reports.submission_similarities(view(spark, d, "comparisons"), view(spark, d, "submissions"))
    return reports.similarity_totals(seen)


@query
def detailed_comparison(spark, d):
    out = reports.detailed_comparison(view(spark, d, "comparisons"), view(spark, d, "submissions"))
    return out.select(
        "similarity_id",
        F.col("submissions.submission1.link").alias("link1"),
        F.col("submissions.submission2.link").alias("link2"),
        F.col("similarity_metrics.overall_similarity").alias("overall_similarity"),
        F.col("similarity_metrics.flow_similarity").alias("flow_similarity"),
        F.col("analysis_metadata.status").alias("status"),
    )


@query
def submission_statistics(spark, d):
    s = reports.submission_statistics(submission_rows(spark, d))
    for c in ("status_breakdown", "step_breakdown", "link_type_breakdown"):
        shown = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        s = s.withColumn(c, F.array_join(shown, ","))
    return s


@query
def dedupe_submissions(spark, d):
    return submissions.deduplicate_submissions(view(spark, d, "submissions")).select("id", "project", "group_id", "step", "upload_time")


@query
def list_page(spark, d):
    return submissions.list_submissions(view(spark, d, "submissions"), skip=100, limit=5000).select("id", "upload_time", "link")


@query
def lookup_step(spark, d):
    found = submissions.lookup(view(spark, d, "submissions"), project="p1996", step="1-URGENT")
    return found.select("id", "group_id", "status", "upload_time")


@query
def lookup_group(spark, d):
    found = submissions.lookup(view(spark, d, "submissions"), newest_first=False, project="p1996", group_id="257")
    return found.select("id", "step", "status", "upload_time")


@query
def lookup_first_of_step(spark, d):
    """The first submission of every project, group and step."""
    return submissions.first_of_step(view(spark, d, "submissions")).select("project", "group_id", "step", "id", "upload_time", "status")


@query
def lookup_id(spark, d):
    return submissions.lookup(view(spark, d, "submissions"), newest_first=False, id="7").select("id", "project", "step", "group_id")


@query
def lookup_pair(spark, d):
    """Comparisons of one ordered pair: the other direction is another lookup."""
    found = submissions.lookup(view(spark, d, "comparisons"), newest_first=False, submission_id="7", compared_submission_id="491")
    return found.select("id", "overall_similarity", "status")


@query
def lookup_comparisons_of_step(spark, d):
    found = submissions.lookup(view(spark, d, "comparisons"), project="p1996", step="NO")
    return found.select("id", "submission_id", "compared_submission_id", "overall_similarity")


@query
def upsert_submissions(spark, d):
    base = view(spark, d, "submissions")
    changed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.lit("rejected"))).alias("status"),
        F.count("*").alias("file_count"),
    )
    out = submissions.upsert_submissions(base, changed, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "project", "status", "file_count", "link", "updated_at")


@query
def upsert_results(spark, d):
    c = view(spark, d, "comparisons")
    done = c.filter("status = 'pending'").select("id", F.col("type_similarity").alias("overall_similarity"), F.lit(None).cast("double").alias("jaccard_similarity"))
    return submissions.upsert_results(c, done).select("id", "status", "overall_similarity", "jaccard_similarity", "flow_similarity")


@query
def cascade_delete(spark, d):
    s, c = view(spark, d, "submissions"), view(spark, d, "comparisons")
    ids = s.filter("step = '5-LOW'").select("id")
    left_subs, left_comps = submissions.delete_submissions(s, c, ids)
    return left_subs.select(F.lit("submission").alias("kind"), "id").unionByName(
        left_comps.select(F.lit("comparison").alias("kind"), "id")
    )


@query
def files_count(spark, d):
    return reports.count_files(view(spark, d, "source_files"))


# ---- rules -----------------------------------------------------------------------------------------


def _rule(spark, d, i):
    rule = SITE_RULES[i]
    return rules.RULES[rule["name"]](site_manifest(spark, d), sites(spark, d), rule["params"])


@query
def rule_file_presence(spark, d):
    out = _rule(spark, d, 0)
    return out.withColumn("missing_files", F.array_join("missing_files", ",")).withColumn(
        "forbidden_files", F.array_join("forbidden_files", ",")
    )


@query
def rule_archive_size(spark, d):
    return _rule(spark, d, 1).drop("message")


@query
def rule_directory_structure(spark, d):
    return _rule(spark, d, 2).withColumn("missing_directories", F.array_join("missing_directories", ","))


@query
def rule_directory_violations(spark, d):
    return rules.directory_violations(site_manifest(spark, d), SITE_RULES[2]["params"])


@query
def rule_file_content(spark, d):
    out = _rule(spark, d, 3)
    shown = F.transform(
        "checks", lambda c: F.concat_ws(":", c["files"].cast("string"), c["failed"].cast("string"), F.coalesce(c["code"], F.lit("ok")))
    )
    return out.withColumn("checks", F.array_join(shown, ","))


@query
def rule_content_violations(spark, d):
    return rules.content_violations(site_manifest(spark, d), SITE_RULES[3]["params"])


@query
def rule_report(spark, d):
    out = rules.validate_all(site_manifest(spark, d), sites(spark, d), SITE_RULES)
    shown = F.transform("errors", lambda e: F.concat_ws(":", e["rule_name"], e["code"]))
    return out.select("submission_id", "failed_rule_count", "total_rule_count", "passed", F.array_join(shown, ",").alias("errors"))


def _site_lists() -> Column:
    """Each site's own list of rules as JSON, chosen by its name: the site rules, some others, or faulty ones."""
    html, english = SITE_RULES[3]["params"]["checks"][1], SITE_RULES[3]["params"]["checks"][0]
    other = [
        {"name": "file_content", "params": {"checks": [html, english]}},
        {"name": "file_presence", "params": {"must_exist": ["*/*", "fr/**"], "forbidden": ["de/?"]}},
        {"name": "directory_structure", "params": {"required_directories": ["en", "fr"], "max_depth": 2}},
    ]
    faulty = [
        {"name": "max_archive_size", "params": {"max_size_mb": -1}},
        {"name": "file_presence", "params": {"must_exist": "x"}},
        {"name": "file_content", "params": {"checks": [{"file_pattern": "en/*", "regex": "("}]}},
        {"name": "max_archive_size", "params": {"max_size_mb": 0.01}},
    ]
    site, rest = F.col("submission_id"), F.length("submission_id") % 3
    text = [F.lit(json.dumps(x)) for x in (SITE_RULES, other, faulty, [*faulty, {"name": "nope"}])]
    return F.when(rest == 0, text[0]).when(rest == 1, text[1]).when(site.endswith(".com"), text[3]).otherwise(text[2])


def _site_results(spark, d):
    lists = sites(spark, d).select("submission_id", _site_lists().alias("rules"))
    return rule_tables.judge(site_manifest(spark, d), rule_tables.rules_from_json(lists))


@query
def rule_table_results(spark, d):
    return _site_results(spark, d).withColumn("faults", F.array_join("faults", ","))


@query
def rule_table_report(spark, d):
    subs = sites(spark, d).withColumn("force_rules", F.col("submission_id").startswith("blog"))
    out = rule_tables.report(_site_results(spark, d), subs)
    shown = F.transform("errors", lambda e: F.concat_ws(":", e["ord"].cast("string"), e["name"], e["code"]))
    return out.withColumn("errors", F.array_join(shown, ","))


# ---- streaming -------------------------------------------------------------------------------------


@query
def incremental_compare_stream(spark, d):
    """Documents arrive as a stream of submissions and are compared with the earlier ones of their language."""
    base = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "documents").schema
    # As a pattern the path may be one file or a folder of files.
    arriving = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")
    rows = arriving.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("project"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("group_id"),
        F.lit("documents").alias("step"),
        F.timestamp_seconds(F.col("doc_id")).alias("upload_time"),
        tokens.part_set(tokens.signature_parts(tokenize(F.col("text"), "text"))).alias("parts"),
    )
    incremental_compare(rows, f"{base}/index", f"{base}/pairs", f"{base}/checkpoint", DOCUMENT_THRESHOLD).awaitTermination()
    return with_copies(read_pairs(spark, f"{base}/pairs"), ArrivalIndex(spark, f"{base}/index", "reader"))
