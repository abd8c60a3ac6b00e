"""Functions of source files, from a table of lines.

Each line yields its indentation, the blocks it opens and closes (by braces, or by words such as `do` and `end`, see
`block_words`) and, where a header is recognised, a function name. Block ends come from windows over (file, line) and
(file, level), which run on one shuffle of these few small columns: a block ends where the depth falls back to what it
was before. The source text itself is only joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscan.functions.languages import NO_FUNCTIONS, detect_language
from twinscan.functions.text import code_block, literal_map, one_of
from twinscan.operators.block_words import BODIED, ENDLESS, WORDED, begins_body, closed, only_declares, opened, plain_line, without_block_comments
from twinscan.operators.tokenize import HASH_LANGUAGES, flat_source

NAME = r"([\p{L}_][\p{L}\p{N}_]*)"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|synchronized)\s+)*"
_TYPED = r"^\s*" + _MODIFIERS + r"[A-Za-z_][\w<>\[\],.?:*& ]*[ *&>\]]" + NAME + r"\s*\([^;{}]*\)[^;(){}]*\{"
_SCRIPT = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*" + NAME + r"\s*\("
_SCRIPT_ARROW = (
    r"^\s*(?:export\s+)?(?:const|let|var)\s+" + NAME + r"\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|\w+\s*=>)"
)
_SCRIPT_METHOD = r"^\s*(?:static\s+|async\s+|get\s+|set\s+)*" + NAME + r"\s*\([^;()]*\)\s*\{"
_FUNCTION_WORD = r"^\s*" + _MODIFIERS + r"function\s+&?" + NAME + r"\s*\("
# Language -> (header pattern, node type); group 1 is the name.
HEADERS = {
    "python": (r"^\s*(?:async\s+)?def\s+" + NAME + r"\s*\(", "function_definition"),
    "javascript": (_SCRIPT, "function_declaration"),
    "typescript": (_SCRIPT, "function_declaration"),
    "java": (_TYPED, "method_declaration"),
    "csharp": (_TYPED, "method_declaration"),
    "groovy": (r"^\s*" + _MODIFIERS + r"(?:def|void|[A-Za-z_]\w*)\s+" + NAME + r"\s*\([^;{}]*\)\s*\{", "method_declaration"),
    "c": (_TYPED, "function_definition"),
    "cpp": (_TYPED, "function_definition"),
    "dart": (_TYPED, "function_signature"),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?" + NAME + r"\s*\(", "function_declaration"),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+" + NAME, "function_item"),
    "php": (_FUNCTION_WORD, "function_definition"),
    "solidity": (_FUNCTION_WORD, "function_definition"),
    "kotlin": (r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?" + NAME + r"\s*\(", "function_declaration"),
    "swift": (r"^\s*(?:\w+\s+)*func\s+" + NAME, "function_declaration"),
    "scala": (r"^\s*(?:\w+\s+)*def\s+" + NAME, "function_definition"),
    "ruby": (r"^\s*(?:(?:private|protected|public|private_class_method)\s+)?def\s+(?:self\.)?" + NAME, "method"),
    "lua": (r"^\s*(?:local\s+)?function\s+(?:\w+[.:])*" + NAME, "function_declaration"),
    "perl": (r"^\s*sub\s+" + NAME, "subroutine_declaration"),
    "r": (r"^\s*" + NAME + r"\s*<-\s*function\b", "binary_operator"),
    "julia": (r"^\s*function\s+" + NAME, "function_definition"),
    "matlab": (r"^\s*function\s+(?:[^=(]*=\s*)?" + NAME, "function_definition"),
    "fortran": (r"(?i)^\s*(?!end)(?:\w+(?:\s*\([^()]*\))?\s+)*(?:subroutine|function)\s+" + NAME, "subroutine_subprogram"),
    "ada": (r"(?i)^\s*(?:function|procedure)\s+" + NAME, "subprogram_declaration"),
    "pascal": (r"(?i)^\s*(?:class\s+)?(?:function|procedure)\s+(?:\w+\.)?" + NAME, "function_declaration"),
    "haskell": (r"^" + NAME + r"\s+[^=:|]*=", "function"),
    "ocaml": (r"^\s*let\s+(?:rec\s+)?" + NAME + r"\s+[^=]*=", "value_definition"),
    "bash": (r"^\s*(?:function\s+)?" + NAME + r"\s*\(\s*\)", "function_definition"),
}
# Further header forms of some languages, tried in this order.
MORE_HEADERS = {
    "javascript": [(_SCRIPT_ARROW, "arrow_function"), (_SCRIPT_METHOD, "method_definition")],
    "typescript": [(_SCRIPT_ARROW, "arrow_function"), (_SCRIPT_METHOD, "method_definition")],
}
GENERIC_HEADER = (r"^\s*(?:\w+\s+)*(?:def|func|fn|fun|function|sub|procedure|lambda)\s+" + NAME, "function_definition")
INDENTED = ["python", "haskell", "ocaml"]
# Names that are not taken as functions.
CONSTRUCTORS = ["__init__", "__construct", "constructor", "init", "initialize", "ctor"]
ANNOTATIONS = ["Test", "DisplayName", "Override", "Deprecated", "SuppressWarnings"]
NOT_NAMES = ["if", "for", "while", "switch", "catch", "return", "function", "else", "do", "try", "new", "with"]



def is_constructor(name: Column) -> Column:
    return name.isin(CONSTRUCTORS)


def _lookup(language: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(table), language)


def _headers(lines: DataFrame, mode: str) -> DataFrame:
    """Add `own` (name, node type) where a line opens a function by its language's forms and `generic` by
    the general one.

    The pattern is looked up by language; lines of one file follow each other, so it is compiled once a file.
    """
    depth = max(len(more) for more in MORE_HEADERS.values())
    forms = [HEADERS] + [
        {language: more[i] for language, more in MORE_HEADERS.items() if i < len(more)} for i in range(depth)
    ]
    language = F.col("language")
    none = F.lit(None).cast("struct<name:string,node_type:string>")

    def found(column: str, node: Column) -> Column:
        usable = (F.col(column) != "") & ~one_of(F.col(column), [*CONSTRUCTORS, *ANNOTATIONS, *NOT_NAMES])
        return F.when(usable, F.struct(F.col(column).alias("name"), node.alias("node_type")))

    own, generic = [], none
    if mode != "generic":
        for i, form in enumerate(forms):
            pattern = _lookup(language, {k: v[0] for k, v in form.items()})
            lines = lines.withColumn(f"_n{i}", F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1)))
            own.append(found(f"_n{i}", _lookup(language, {k: v[1] for k, v in form.items()})))
    if mode != "own":
        lines = lines.withColumn("_g", F.regexp_extract("text", GENERIC_HEADER[0], 1))
        generic = F.when(~one_of(language, NO_FUNCTIONS), found("_g", F.lit(GENERIC_HEADER[1])))
    return lines.withColumn("own", F.coalesce(*own) if own else none).withColumn("generic", generic)


# A round bracket that goes on over several lines, with one inner level, and the rest of its last line.
_OPEN_BRACKET = r"\([^()\n]*+(?:\([^()]*+\)[^()\n]*+)*+\n[^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^\n]*+"
# A brace that opens on the next filled line, maybe behind a clause.
_NEXT_LINE_BRACE = r"\)[^;{}()\n]*+\n\s*+(?:(?:throws|where|requires)\b[^;{}()]*+)?\{"


def _on_one_line(text: Column, pattern: str) -> Column:
    """Join what matches into its first line; as many empty lines follow, so all line numbers stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def joined(m: Column) -> Column:
        return F.concat(F.regexp_replace(m, r"\s*\n\s*", " "), F.repeat(F.lit("\n"), _count(m, "\n")))

    between = F.split(text, pattern, -1)
    pieces = F.zip_with(between, F.concat(F.transform(found, joined), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def logical_lines(text: Column, language: Column) -> Column:
    """Lines of a source text for finding headers: comments and strings of several lines are emptied,
    headers of several lines and their braces stand in their first line. Line numbers stay."""
    text = without_block_comments(text, language)
    flat = F.when(one_of(language, HASH_LANGUAGES), flat_source(text, "hash")).otherwise(flat_source(text, "slash"))
    return F.split(_on_one_line(_on_one_line(flat, _OPEN_BRACKET), _NEXT_LINE_BRACE), "\n")


def _blanked(line: Column, language: Column) -> Column:
    """The line without strings and comments, so that braces inside them do not count."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"|' + r"'(?:[^'\\]|\\.)*+'", '""')
    return F.when(one_of(language, HASH_LANGUAGES), F.regexp_replace(bare, "#.*", "")).otherwise(
        F.regexp_replace(bare, r"//.*|/\*.*?\*/", "")
    )


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _spans(files: DataFrame, mode: str) -> DataFrame:
    """Rows (file_id, name, node_type, start_line, end_line)."""
    language = F.col("language")
    lines = files.select("file_id", "language", F.posexplode(logical_lines(F.col("content"), language)).alias("line", "text"))
    worded = one_of(language, [*WORDED, *BODIED])
    lines = lines.withColumn("bare", F.when(worded, plain_line(F.col("text"), language)).otherwise(_blanked(F.col("text"), language)))
    lines = _headers(lines, mode)
    small = lines.select(
        "file_id",
        "line",
        F.when(one_of(language, INDENTED), "indent").otherwise("depth").alias("style"),
        one_of(language, BODIED).alias("bodied"),
        one_of(language, WORDED).alias("worded"),
        one_of(language, ENDLESS).alias("endless"),
        F.length(F.regexp_extract("text", r"^([ \t]*)", 1)).alias("indent"),
        F.col("text").rlike(r"\S").alias("filled"),
        F.when(worded, opened(F.col("bare"), language)).otherwise(_count(F.col("bare"), "{")).alias("opens"),
        F.when(worded, closed(F.col("bare"), language)).otherwise(_count(F.col("bare"), "}")).alias("closes"),
        begins_body(F.col("bare"), language).alias("body"),
        (one_of(language, BODIED) & F.col("bare").rlike(r"(?i)^\s*implementation\b")).alias("implementation"),
        F.when(~only_declares(F.col("bare"), language), F.col("own")).alias("own"),
        "generic",
    ).filter("filled")
    by_line = Window.partitionBy("file_id").orderBy("line")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("file_id")
    judged = small.select(
        "*",
        F.lag("indent").over(by_line).alias("last_indent"),
        F.lag("line").over(by_line).alias("last_line"),
        F.max("line").over(whole).alias("file_end"),
        F.max(F.when(F.col("implementation"), F.col("line"))).over(whole).alias("from_line"),
        F.when(F.max(F.col("own").isNotNull()).over(whole), F.col("own")).otherwise(F.col("generic")).alias("any_header"),
    ).withColumn("header", F.when(F.coalesce(F.col("line") > F.col("from_line"), F.lit(True)), F.col("any_header")))
    # Files that leave out the ends of functions: their headers open no block, and a function goes on to the next one.
    surplus = F.sum(F.col("opens") - F.col("closes")).over(whole)
    headers = F.count("header").over(whole)
    open_ended = judged.withColumn("no_ends", F.col("endless") & (headers > 0) & (surplus >= headers))
    counted = open_ended.withColumn("opens", F.col("opens") - (F.col("no_ends") & F.col("header").isNotNull()).cast("int"))
    placed = counted.select(
        "*",
        F.sum(F.col("opens") - F.col("closes")).over(so_far).alias("depth"),
        F.min(F.when(F.col("header").isNotNull(), F.col("line"))).over(by_line.rowsBetween(1, Window.unboundedFollowing)).alias("next_header"),
    )
    by_depth = F.col("style") == "depth"
    before = F.col("depth") - F.col("opens") + F.col("closes")
    level = F.when(by_depth, before).otherwise(F.col("indent")).cast("int")
    closed_from = F.when(by_depth, F.col("depth")).otherwise(F.col("indent")).cast("int")
    closed_to = F.when(by_depth, before - 1).otherwise(F.col("last_indent")).cast("int")
    closing_line = F.when(F.col("style") == "indent", F.col("last_line")).otherwise(F.col("line"))
    nothing = F.array().cast("array<int>")
    falls = F.when(closed_to >= closed_from, F.sequence(closed_from, F.greatest(closed_to, closed_from))).otherwise(nothing)
    # A header whose words open no block is a function of one expression.
    one_line = by_depth & (F.col("opens") == F.col("closes")) & ((F.col("opens") > 0) | (F.col("worded") & ~F.col("no_ends")))
    header = "struct<name:string,node_type:string>"
    event = f"array<struct<level:int,header:{header},body:boolean,closes_at:int>>"

    def event_of(at: Column, head: Column, body: Column, closes_at: Column) -> Column:
        return F.struct(at.alias("level"), head.alias("header"), body.alias("body"), closes_at.alias("closes_at"))

    none, no_line, empty = F.lit(None).cast(header), F.lit(None).cast("int"), F.array().cast(event)
    events = placed.select(
        "file_id",
        "line",
        "file_end",
        "bodied",
        F.when(F.col("no_ends"), F.coalesce(F.col("next_header") - 1, F.col("file_end"))).alias("known_end"),
        F.explode(
            F.concat(
                F.when(F.col("header").isNotNull(), F.array(event_of(level, F.col("header"), F.lit(False), no_line))).otherwise(empty),
                F.when(F.col("body"), F.array(event_of(level, none, F.lit(True), no_line))).otherwise(empty),
                F.transform(falls, lambda v: event_of(v, none, F.lit(False), closing_line)),
            )
        ).alias("e"),
        one_line.alias("one_line"),
    ).select("file_id", "line", "file_end", "bodied", "known_end", "one_line", "e.*")
    later = Window.partitionBy("file_id", "level").orderBy(F.desc("line")).rangeBetween(Window.unboundedPreceding, -1)
    ends = events.withColumn("next_close", F.min("closes_at").over(later)).filter(F.col("header").isNotNull() | F.col("body"))
    block_end = F.when(F.col("one_line"), F.col("line")).otherwise(F.coalesce("known_end", "next_close", "file_end"))
    return _to_bodies(ends.withColumn("block_end", block_end)).select(
        "file_id",
        F.col("header.name").alias("function_name"),
        F.col("header.node_type").alias("node_type"),
        F.col("line").alias("start_line"),
        "end_line",
    )


def _to_bodies(found: DataFrame) -> DataFrame:
    """Headers with their `end_line`: that of their own block, or in bodied languages that of the body that belongs to
    them. Headers and bodies of one level are pairs like brackets: a body belongs to the last header without one."""
    step = F.when(F.col("header").isNotNull(), 1).otherwise(-1)
    at_level = Window.partitionBy("file_id", "level").orderBy("line", "body")
    paired = found.withColumn("balance", F.sum(step).over(at_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A body brings the balance back to what it was before its header.
    pair = Window.partitionBy("file_id", "level", F.when(F.col("body"), F.col("balance")).otherwise(F.col("balance") - 1))
    following = pair.orderBy("line", "body").rowsBetween(1, Window.unboundedFollowing)
    body = F.min(F.when(F.col("body"), F.struct("line", "block_end"))).over(following)
    with_body = paired.withColumn("its_body", body).filter(F.col("header").isNotNull())
    return with_body.withColumn("end_line", F.when(F.col("bodied"), F.coalesce("its_body.block_end", "block_end")).otherwise(F.col("block_end")))


def _with_blocks(spans: DataFrame, files: DataFrame) -> DataFrame:
    function_id = F.concat_ws("_", "function_name", F.col("start_line").cast("string"))
    unique = spans.withColumn("function_id", function_id).dropDuplicates(["file_id", "function_id"])
    order = Window.partitionBy("file_id").orderBy("start_line", "function_name")
    numbered = unique.withColumn("function_index", F.row_number().over(order) - 1)
    return numbered.join(files, "file_id").select(
        "file_id",
        "function_index",
        "function_id",
        "function_name",
        "start_line",
        "end_line",
        code_block(F.col("content"), F.col("start_line"), F.col("end_line") + 1).alias("code_block"),
        "node_type",
        "language",
    )


def _with_language(files: DataFrame) -> DataFrame:
    if "language" in files.columns:
        return files
    return files.withColumn("language", detect_language(F.col("path")))


def extract_functions(files: DataFrame) -> DataFrame:
    """Functions of files (file_id, path or language, content) by the header of their language; 0-based lines."""
    known = _with_language(files).filter(one_of(F.col("language"), HEADERS)).select("file_id", "language", "content")
    return _with_blocks(_spans(known, "own"), known)


def extract_functions_fallback(files: DataFrame, found: DataFrame) -> DataFrame:
    """Generic headers for the files in which the language's own headers found nothing."""
    rest = (
        _with_language(files)
        .filter(~F.col("language").isin(NO_FUNCTIONS))
        .select("file_id", "language", "content")
        .join(found.select("file_id").distinct(), "file_id", "left_anti")
    )
    return _with_blocks(_spans(rest, "generic"), rest)


def all_functions(files: DataFrame) -> DataFrame:
    """Functions by language headers and, in files where these find none, by the generic ones: one pass."""
    known = _with_language(files).select("file_id", "language", "content")
    return _with_blocks(_spans(known, "both"), known)


def html_blocks(pages: DataFrame, tags: tuple[str, ...] = ("p", "li", "h1")) -> DataFrame:
    """Text blocks of markup pages, so that block matching also works where there are no functions."""

    def of(tag: str) -> Column:
        bodies = F.regexp_extract_all("content", F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
        return F.transform(
            bodies,
            lambda body, i: F.named_struct(F.lit("tag"), F.lit(tag), F.lit("block_index"), i, F.lit("block"), body),
        )

    found = [of(t) for t in tags]
    return pages.select("file_id", F.explode(F.concat(*found)).alias("b")).select("file_id", "b.*")


def preprocess_files(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Language and number of functions of every file; files without functions stay, with 0."""
    counts = functions.groupBy("file_id").agg(F.count("*").alias("function_count"))
    return (
        _with_language(files)
        .drop("content")
        .join(counts, "file_id", "left")
        .withColumn("function_count", F.coalesce("function_count", F.lit(0)))
    )
