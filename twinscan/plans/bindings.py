"""How the given tables are read as submissions, comparisons, files and manifests.

Every expression here is plain SQL that Spark and other engines evaluate alike, one row in, one row
out, so the views cost no shuffle and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinscan.sources.tables import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_USER = "concat('u', CAST(o_custkey AS STRING), '/r', CAST(o_orderkey AS STRING))"

SUBMISSIONS = {
    "id": "CAST(o_orderkey AS STRING)",
    "project": "concat('p', CAST(year(o_orderdate) AS STRING))",
    "group_id": "CAST(o_custkey AS STRING)",
    "step": "o_orderpriority",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END",
    "upload_time": "o_orderdate",
    "file_size_bytes": "CAST(floor(o_totalprice * 12000) AS BIGINT)",
    "file_count": "CAST(floor(o_totalprice / 45) AS BIGINT)",
    "link": f"""CASE
        WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN concat('http://github.com/', {_USER})
        WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN concat('https://github.com/', {_USER}, '/tree/main')
        WHEN o_orderstatus = 'F' THEN concat('https://GitHub.com/', {_USER}, '.git')
        WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN concat('git@gitlab.com:', {_USER}, '.git')
        WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN concat('https://code.example.org/gitlab/', {_USER}, '/')
        WHEN o_orderstatus = 'O' THEN concat('https://gitlab.com/', {_USER})
        WHEN o_orderpriority = '5-LOW' THEN concat('ftp://files.example.org/', {_USER})
        WHEN o_orderpriority = '2-HIGH' THEN concat('s3://bucket', CAST(o_custkey AS STRING))
        ELSE concat('s3://bucket', CAST(o_custkey AS STRING), '/uploads/', CAST(o_orderkey AS STRING), '.zip')
    END""",
}

COMPARISONS = {
    "id": """concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(l_quantity AS INT) AS STRING), CAST(year(l_shipdate) AS STRING), CAST(dayofyear(l_shipdate) AS STRING))""",
    "submission_id": "CAST(l_orderkey AS STRING)",
    "compared_submission_id": "CAST(l_partkey AS STRING)",
    "project": "concat('p', CAST(year(l_shipdate) AS STRING))",
    "step": "concat(l_returnflag, l_linestatus)",
    "overall_similarity": "l_discount * 10",
    "jaccard_similarity": "l_tax * 10",
    "type_similarity": "l_quantity / 50",
    "structural_similarity": "l_discount * 5",
    "type_sequence_similarity": "l_tax * 5",
    "flow_similarity": "l_discount * 2",
    "operation_similarity": "l_tax * 2",
    "shared_blocks_count": "l_linenumber",
    "status": "CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'failed' END",
    "created_at": "l_shipdate",
}

# Documents as prose files: project = language of the text, group = source.
PROSE_FILES = {
    "file_id": "doc_id",
    "project": "lang",
    "group_id": "source",
    "path": "concat(lang, '/', source, '/', CAST(doc_id AS STRING), '.txt')",
    "content": "text",
}

# Pages as files of a site: submission = host, path from the address.
_PATH = "regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '/index.html')"
PAGE_FILES = {
    "file_id": "page_id",
    "submission_id": "regexp_extract(url, '^https?://([^/]+)', 1)",
    "path": _PATH,
    "content": "html",
}

# Parts as small source files, written out by a template from the row's own values.
_NL = "chr(10)"
_ADJ, _NOUN = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_BRAND, _KEY = "replace(lower(p_brand), '#', '_')", "CAST(p_partkey AS STRING)"
_SIZE, _KIND = "CAST(p_size AS STRING)", "lower(p_type)"
_TIMES = "CAST(floor(p_size / 10) AS INT)"


def _lines(*rows: str) -> str:
    return f"concat({', '.join(r + ', ' + _NL for r in rows)})"


_PYTHON = _lines(
    f"concat('import os, ', {_NOUN}, '_tools as tools')",
    f"concat('from ', {_KIND}, ' import ', {_ADJ}, '  # part ', {_KEY})",
    "''",
    f"concat('def load_', {_NOUN}, '(path):')",
    "'    with open(path) as handle:'",
    "'        rows = handle.read()'",
    f"concat('    assert rows, {_KIND[:0]}', {_BRAND})",
    f"concat('    raise ', {_ADJ}, '_', {_NOUN})",
    "'    return rows'",
    "''",
    f"concat('def total_', {_ADJ}, '(rows, limit):')",
    "'    total = 0'",
    "'    for row in rows:'",
    "'        if row > limit and not tools:'",
    f"concat('            total = total + row * ', {_SIZE})",
    "'        else:'",
    f"concat('            total -= 1', repeat(concat({_NL}, '    total = total + limit'), {_TIMES}))",
    "'    return total'",
    "''",
    f"concat('def main_', {_NOUN}, '(path):')",
    f"concat('    rows = load_', {_NOUN}, '(path)')",
    f"concat('    label = \"', {_BRAND}, '\"')",
    "'    print(label)'",
    f"concat('    return total_', {_ADJ}, '(rows, ', CAST(p_size AS STRING), '.5)')",
)
_SCRIPT = _lines(
    f"concat('import {{ ', {_ADJ}, ' }} from \"', {_NOUN}, '\";')",
    f"concat('// part ', {_KEY})",
    f"concat('function load_', {_NOUN}, '(path) {{')",
    f"concat('  try {{ open_', {_BRAND}, '(path); }}')",
    f"concat('  catch (', {_BRAND}, ') {{')",
    f"concat('    throw ', {_KIND}, '_', {_ADJ}, ';')",
    "'  }'",
    "'  return path;'",
    "'}'",
    "''",
    f"concat('function total_', {_ADJ}, '(rows, limit) {{')",
    "'  let total = 0;'",
    "'  for (const row of rows) {'",
    f"concat('    if (row > limit && row != ', {_SIZE}, ') {{')",
    "'      total += row * 2;'",
    f"concat('    }}', repeat(concat({_NL}, '    total = total + limit;'), {_TIMES}))",
    "'  }'",
    "'  return total;'",
    "'}'",
    "''",
    f"concat('function main_', {_NOUN}, '(path) {{')",
    f"concat('  const rows = load_', {_NOUN}, '(path);')",
    f"concat('  log_', {_NOUN}, '(\"', {_BRAND}, '\");')",
    f"concat('  return total_', {_ADJ}, '(rows, ', {_SIZE}, ');')",
    "'}'",
)
SOURCE_FILES = {
    "file_id": "p_partkey",
    "submission_id": "concat(p_type, '/', p_brand)",
    "project": "p_type",
    "group_id": "p_brand",
    "path": f"concat({_BRAND}, '/src/', {_NOUN}, '_', {_KEY}, CASE WHEN p_size <= 25 THEN '.py' ELSE '.js' END)",
    "content": f"CASE WHEN p_size <= 25 THEN {_PYTHON} ELSE {_SCRIPT} END".replace("{{", "{").replace("}}", "}"),
}

VIEWS = {
    "submissions": ("orders", SUBMISSIONS),
    "comparisons": ("lineitem", COMPARISONS),
    "prose_files": ("documents", PROSE_FILES),
    "page_files": ("pages", PAGE_FILES),
    "source_files": ("part", SOURCE_FILES),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    rows = table(spark, folder, source)
    named = [f"{e} AS {c}" for c, e in columns.items()]
    if "content" in columns:
        # A text counts as 20 bytes where sizes are estimated, so without the hint all of them would be broadcast.
        return spread(rows).selectExpr(*named).hint("merge")
    return rows.selectExpr(*named)


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"
