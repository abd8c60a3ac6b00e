"""Fixed row types of the data model."""

from pyspark.sql import types as T

TOKEN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
TOKENS = T.ArrayType(TOKEN)

MANIFEST = T.StructType(
    [
        T.StructField("submission_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)

SUBMISSION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("link_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("submitted_by", T.StringType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("upload_time", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("rule_results", T.StringType()),
    ]
)

METRICS = [
    "overall_similarity",
    "jaccard_similarity",
    "type_similarity",
    "structural_similarity",
    "type_sequence_similarity",
    "flow_similarity",
    "operation_similarity",
]

# The allowed states.
SUBMISSION_STATUS = ["pending", "processing", "completed", "failed", "rejected"]
SIMILARITY_STATUS = ["pending", "processing", "completed", "failed"]
