"""Lexical tokenisation of whole files, inside one row: no shuffle, no Python.

Each line is cut by one regular expression per language family. Words that open a statement take the
statement's type and carry the logical line; calls, operators, literals and names keep their own text.

Lines on which a bracket or a sign stands where a value begins are read more closely: their lexemes include brackets,
and their shape (one letter for the kind of each lexeme) tells collections from blocks, indices and arguments, and
signs of a value from operators between two. A collection stands before its elements and carries its own text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.functions.languages import detect_language
from twinscan.functions.text import let, literal_map, one_of, strip
from twinscan.sources.tables import materialize

# Statement type of a keyword, and the words that are operators.
STATEMENT_WORDS = {
    "if": "if_statement",
    "elif": "elif_clause",
    "elsif": "elif_clause",
    "elseif": "elif_clause",
    "unless": "if_statement",
    "else": "else_clause",
    "for": "for_statement",
    "foreach": "for_statement",
    "while": "while_statement",
    "until": "while_statement",
    "repeat": "do_statement",
    "do": "do_statement",
    "switch": "switch_statement",
    "match": "switch_statement",
    "case": "case_statement",
    "break": "break_statement",
    "continue": "continue_statement",
    "return": "return_statement",
    "try": "try_statement",
    "except": "except_clause",
    "catch": "catch_clause",
    "finally": "finally_clause",
    "throw": "throw_statement",
    "raise": "raise_statement",
    "def": "function_definition",
    "function": "function_definition",
    "func": "function_definition",
    "fn": "function_definition",
    "fun": "function_definition",
    "sub": "function_definition",
    "procedure": "function_definition",
    "subroutine": "function_definition",
    "class": "class_definition",
    "import": "import_statement",
    "from": "import_from_statement",
    "with": "with_statement",
    "assert": "assert_statement",
    "yield": "yield_statement",
    "lambda": "lambda",
}
OPERATOR_WORDS = {
    "and": "boolean_operator",
    "or": "boolean_operator",
    "not": "boolean_operator",
    "in": "comparison_operator",
    "is": "comparison_operator",
}
WORD_TYPES = {**STATEMENT_WORDS, **OPERATOR_WORDS}

WORD = r"[\p{L}_][\p{L}\p{N}_]*"
NUMBER = r"[0-9]+[.][0-9]+|[0-9]+"
STRING = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'"
# Strings on one line, for finding what is no comment; possessive, so long ones need no deep recursion.
_STRING_LINE = r'"(?:[^"\\\n]|\\.)*+"|' + r"'(?:[^'\\\n]|\\.)*+'"
# What may go on over several lines, by family, among what must not be taken for it.
_SPANNING = {
    "hash": '"""[\\s\\S]*?"""|' + "'''[\\s\\S]*?'''|" + _STRING_LINE + "|#[^\\n]*+",
    "slash": r"/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*+`|" + _STRING_LINE + r"|//[^\n]*+",
    "dash": r"/\*[\s\S]*?\*/|" + _STRING_LINE + r"|--[^\n]*+",
}
OPERATOR = r"===|!==|==|!=|<=|>=|=>|->|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\*\*|//|[<>=!+\-*/%]"
# Family -> regular expression of one lexeme. Alternatives are tried in order.
_CODE = [STRING, NUMBER, WORD + r"[ ]*\(", WORD, OPERATOR]
LEXEMES = {
    "hash": "|".join(["#.*", *_CODE]),
    "slash": "|".join([r"//.*", r"/\*.*?\*/", *_CODE]),
    "dash": "|".join(["--.*", r"/\*.*?\*/", *_CODE]),
    "percent": "|".join(["%.*", *_CODE]),
    "semicolon": "|".join([";.*", *_CODE]),
    "bang": "|".join(["!.*", *_CODE]),
    "markup": "|".join(
        ["<!--.*?-->", "</[A-Za-z][A-Za-z0-9]*>", "<[A-Za-z][A-Za-z0-9]*", r"[A-Za-z\-]+=" + r'"[^"]*"', NUMBER, WORD]
    ),
    "text": "|".join([NUMBER, WORD, OPERATOR]),
}
# Families by language; every other language is a `slash` one.
HASH_LANGUAGES = [
    "python", "bash", "ruby", "perl", "r", "julia", "cmake", "make", "dockerfile", "yaml", "toml", "gomod",
]
SIGN_LANGUAGES = {"dash": ["sql", "haskell", "lua", "ada"], "percent": ["matlab"], "semicolon": ["asm"], "bang": ["fortran"]}
# What a comment starts with, by family.
COMMENT_STARTS = {"hash": ["#"], "slash": ["//", "/*"], "dash": ["--", "/*"], "percent": ["%"], "semicolon": [";"], "bang": ["!"]}
MARKUP_LANGUAGES = ["html", "xml", "vue", "svelte"]
TEXT_LANGUAGES = ["text", "markdown"]


#: Words behind which a value begins, and which are no calls with a bracket behind them.
VALUE_WORDS = ["return", "in", "yield", "and", "or", "not", "is", "await", "throw", "raise"]
#: A bracket or sign where a value may begin. Other lines have no collection and no sign of a value.
_MAY_NEST = (
    r"(?:^|[=(,\[:{?<>!&|+*/%-]|\b(?i:" + "|".join(VALUE_WORDS) + r")\b|\][ ]*[\p{L}_]*|[=(,][ ]*[\p{L}_][\p{L}\p{N}_.]*)[ ]*[\[{(+-]"
)
_NEST_LEXEMES = {
    family: pattern.replace(WORD + r"[ ]*\(", r"(?!(?i:" + "|".join(VALUE_WORDS) + r")\b)" + WORD + r"[ ]*\(") + r"|[\[\](){},:;]"
    for family, pattern in LEXEMES.items()
    if family not in ("markup", "text")
}
# Shapes: brackets, commas, colons and semicolons as they are, c a call with its bracket, e an equals sign, a and t arrows,
# r a word of VALUE_WORDS, k another word with a meaning, w a word, v a literal, o an operator, z a comment.
_VALUE_BEFORE = r"[eo(c\[{,:r;]"


def _balanced(levels: int = 4) -> tuple[str, str]:
    """Patterns over shapes: what stands inside brackets, and a group in brackets, so many levels deep."""
    inner = r"[^c(\[{)\]}]"
    group = ""
    for _ in range(levels):
        group = rf"(?:[c(]{inner}*+\)|\[{inner}*+\]|\{{{inner}*+\}})"
        inner = rf"(?:[^c(\[{{)\]}}]|{group})"
    return inner, group


_INSIDE, _GROUP = _balanced()


def language_family(language: Column) -> Column:
    return (
        F.when(one_of(language, HASH_LANGUAGES), "hash")
        .when(one_of(language, MARKUP_LANGUAGES), "markup")
        .when(one_of(language, TEXT_LANGUAGES), "text")
        .when(one_of(language, SIGN_LANGUAGES["dash"]), "dash")
        .when(one_of(language, SIGN_LANGUAGES["percent"]), "percent")
        .when(one_of(language, SIGN_LANGUAGES["semicolon"]), "semicolon")
        .when(one_of(language, SIGN_LANGUAGES["bang"]), "bang")
        .otherwise("slash")
    )


def _word_table() -> Column:
    return literal_map(WORD_TYPES)


def _operator_type(lexeme: Column) -> Column:
    return (
        F.when(one_of(lexeme, ["==", "!=", "===", "!==", "<", ">", "<=", ">="]), "comparison_operator")
        .when(one_of(lexeme, ["+=", "-=", "*=", "/=", "%=", "++", "--"]), "augmented_assignment")
        .when(one_of(lexeme, ["&&", "||", "!"]), "boolean_operator")
        .when(lexeme == "=", "assignment")
        .when(one_of(lexeme, ["=>", "->"]), "arrow")
        .otherwise("binary_operator")
    )


def _markup_token(lexeme: Column, row: Column) -> Column:
    kind = (
        F.when(lexeme.startswith("</"), "end_tag")
        .when(lexeme.startswith("<!--"), "comment")
        .when(lexeme.startswith("<"), "start_tag")
        .when(lexeme.endswith('"'), "attribute")
        .when(lexeme.rlike("^[0-9]"), _number_type(lexeme))
        .otherwise("word")
    )
    return F.struct(kind.alias("type"), lexeme.alias("text"), row.alias("start"), row.alias("end"))


def _number_type(lexeme: Column) -> Column:
    return F.when(lexeme.contains("."), "float").otherwise("integer")


def _text_token(lexeme: Column, keyword: Column, row: Column) -> Column:
    kind = (
        F.when(keyword.isNotNull(), keyword)
        .when(lexeme.rlike(r"^[\p{L}_]"), "word")
        .when(lexeme.rlike("^[0-9]"), _number_type(lexeme))
        .otherwise(_operator_type(lexeme))
    )
    return F.struct(kind.alias("type"), lexeme.alias("text"), row.alias("start"), row.alias("end"))


def _code_token(e: Column, line: Column, row: Column, family: str) -> Column:
    """Token of a lexeme `e` = (lex, word, kw): statement words carry the line they open."""
    lexeme, word, keyword = e["lex"], e["word"], e["kw"]
    comment = reduce(or_, [lexeme.startswith(sign) for sign in COMMENT_STARTS[family]])
    opens = one_of(keyword, dict.fromkeys(STATEMENT_WORDS.values())) & line.startswith(word)

    def token(kind, text) -> Column:
        return F.struct(kind.alias("type"), text.alias("text"), row.alias("start"), row.alias("end"))

    return (
        F.when(keyword.isNotNull(), token(keyword, F.when(opens, line).otherwise(word)))
        .when(comment, token(F.lit("comment"), lexeme))
        .when(lexeme.startswith('"') | lexeme.startswith("'"), token(F.lit("string"), lexeme))
        .when(word != lexeme, token(F.lit("call"), F.concat(word, F.lit("()"))))
        .when(lexeme.rlike(r"^[\p{L}_]"), token(F.lit("identifier"), lexeme))
        .when(lexeme.rlike("^[0-9]"), token(_number_type(lexeme), lexeme))
        .otherwise(token(_operator_type(lexeme), F.when(lexeme == "=", line).otherwise(lexeme)))
    )


def _read_words(lexemes: Column) -> Column:
    """(lex, word, kw) of each lexeme: a call without its bracket, and the type of a word with a meaning."""
    table = _word_table()
    starts_word = r"^[\p{L}_].*\($"
    words = F.transform(
        lexemes,
        lambda x: F.named_struct(
            F.lit("lex"), x, F.lit("word"), F.when(x.rlike(starts_word), F.rtrim(F.rtrim(x, F.lit("(")))).otherwise(x)
        ),
    )
    return F.transform(
        words,
        lambda e: F.named_struct(
            F.lit("lex"), e["lex"], F.lit("word"), e["word"], F.lit("kw"), F.try_element_at(table, e["word"])
        ),
    )


def _shape(e: Column, family: str) -> Column:
    lexeme = e["lex"]
    comment = reduce(or_, [lexeme.startswith(sign) for sign in COMMENT_STARTS[family]])
    return (
        F.when(one_of(lexeme, list("[](){},:;")), lexeme)
        .when(lexeme == "=", "e")
        .when(lexeme == "=>", "a")
        .when(lexeme == "->", "t")
        .when(comment, "z")
        .when(lexeme != e["word"], "c")
        .when(one_of(F.lower(lexeme), VALUE_WORDS), "r")
        .when(e["kw"].isNotNull(), "k")
        .when(lexeme.rlike(r"^[\p{L}_]"), "w")
        .when(lexeme.rlike(r"^[0-9\"']"), "v")
        .otherwise("o")
    )


def _collection(sign: Column, before: Column, two_before: Column, rest: Column, group: Column, family: str) -> Column:
    """Type of the collection that a bracket opens, or null. `rest` is the shape from the bracket on, `group` that of
    the whole bracket if the line closes it; before are the shapes of one and of two lexemes."""
    value = before.rlike("^" + _VALUE_BEFORE)
    closed, inside = group != "", F.substring(group, 2, 1_000_000)
    behind = F.substring(rest, F.length(group) + 1, 1)
    arrow = one_of(behind, ["a", "t", "{"])
    listed = rf"^{_INSIDE}*?," 
    keyed = ~closed | (F.length(group) == 2) | inside.rlike(rf"^(?:[^c(\[{{)\]}}:ae]|{_GROUP})*+[:ae]")
    # Literals behind a type: `[]int{1}`, `Point{1, 2}`, `new int[] {1}`. A block's brace ends its line.
    typed = F.lit(family == "slash") & two_before.rlike(r"^(?:\]w|[e(,cr:]w|.\])$") & (F.length(rest) > 1)
    braced = F.when(keyed, "dictionary").otherwise("set" if family == "hash" else "list")
    return (
        F.when((sign == "[") & (value | (before == "a")) & (behind != "w") & F.lit(family != "semicolon"), "list")
        .when((sign == "(") & value & closed & ~arrow & inside.rlike(listed), "tuple")
        .when((sign == "{") & (before.rlike(r"^[eo(c\[{,:r]") | typed), braced)
    )


def _nested_tokens(line: Column, goes_on: Column, row: Column, family: str) -> Column:
    """Tokens of a line with its collections and signs; `goes_on` is the shape of what the line before ends in."""
    case = line.rlike(r"^(?:case|default)\b")

    def at(found: Column, shape: Column, e: Column, i: Column) -> Column:
        lexeme = e["lex"]
        before = F.when(i == 0, goes_on).otherwise(F.substr(shape, i, F.lit(1)))
        two_before = F.when(i < 2, F.lit("")).otherwise(F.substr(shape, i - 1, F.lit(2)))
        rest = F.substr(shape, i + 1, F.lit(1_000_000))

        def token(kind: Column, text: Column) -> Column:
            return F.struct(kind.alias("type"), text.alias("text"), row.alias("start"), row.alias("end"))

        def opened(group: Column) -> Column:
            kind = _collection(lexeme, before, two_before, rest, group, family)
            size = F.when(group == "", F.size(found)).otherwise(F.length(group))
            text = F.array_join(F.transform(F.slice(found, i + 1, size), lambda x: x["lex"]), "")
            return F.when(kind.isNotNull() & ~((lexeme == "{") & case), token(kind, text))

        signed = one_of(lexeme, ["-", "+"]) & ((before == "") | before.rlike("^" + _VALUE_BEFORE))
        return (
            F.when(one_of(lexeme, ["[", "(", "{"]), let(F.regexp_extract(rest, "^" + _GROUP, 0), opened))
            .when(one_of(lexeme, list("]),}:;")), F.lit(None))
            .when(signed, token(F.lit("unary_operator"), lexeme))
            .otherwise(_code_token(e, line, row, family))
        )

    def read(found: Column) -> Column:
        shape = F.array_join(F.transform(found, lambda e: _shape(e, family)), "")
        return let(shape, lambda s: F.filter(F.transform(found, lambda e, i: at(found, s, e, i)), lambda t: t.isNotNull()))

    return let(_read_words(F.regexp_extract_all(line, F.lit(_NEST_LEXEMES[family]), F.lit(0))), read)


def _line_tokens(line: Column, goes_on: Column, row: Column, family: str) -> Column:
    """Tokens of one stripped line. Each stage is evaluated once per lexeme."""
    lexemes = F.regexp_extract_all(line, F.lit(LEXEMES[family]), F.lit(0))
    if family == "markup":
        return F.transform(lexemes, lambda x: _markup_token(x, row))
    if family == "text":
        table = _word_table()
        found = F.transform(lexemes, lambda x: F.named_struct(F.lit("lex"), x, F.lit("kw"), F.try_element_at(table, x)))
        return F.transform(found, lambda e: _text_token(e["lex"], e["kw"], row))
    plain = F.transform(_read_words(lexemes), lambda e: _code_token(e, line, row, family))
    return F.when(line.rlike(_MAY_NEST), _nested_tokens(line, goes_on, row, family)).otherwise(plain)


def flat_source(text: Column, family: str) -> Column:
    """The text with comments and strings of several lines emptied to one token in their first line, and
    empty lines behind it, so that line numbers stay."""
    pattern = _SPANNING[family]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def emptied(m: Column) -> Column:
        lines = F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))
        return F.when(lines == 0, m).otherwise(
            F.concat(F.when(m.startswith("/*"), "/* */").otherwise('""'), F.repeat(F.lit("\n"), lines))
        )

    pieces = F.zip_with(
        F.split(text, pattern, -1), F.concat(F.transform(found, emptied), F.array(F.lit(""))), lambda a, b: F.concat(a, b)
    )
    spans = {"hash": r"\"\"\"|'''", "slash": r"/\*|`", "dash": r"/\*"}[family]
    return F.when(text.rlike(spans), F.array_join(pieces, "")).otherwise(text)


def tokenize(text: Column, family: str) -> Column:
    """Token array of a text in one language family."""
    source = flat_source(text, family) if family in _SPANNING else text
    lines = F.transform(F.split(source, "\n"), strip)
    if family in ("markup", "text"):
        return F.flatten(F.transform(lines, lambda line, row: _line_tokens(line, F.lit(""), row, family)))
    # A line goes on from the one before if that ends in a sign that wants a value.
    ends = F.transform(lines, lambda line: F.regexp_extract(line, r"([=(,\[])$", 1))
    paired = F.zip_with(lines, F.concat(F.array(F.lit("")), ends), lambda line, before: F.struct(line.alias("line"), F.when(before == "=", "e").otherwise(before).alias("before")))
    known = F.filter(paired, lambda x: x["line"].isNotNull())
    return F.flatten(F.transform(known, lambda x, row: _line_tokens(x["line"], x["before"], row, family)))


def tokenize_by_language(text: Column, language: Column) -> Column:
    family = language_family(language)
    result = F.when(family == "hash", tokenize(text, "hash"))
    for name in ("slash", "markup", "text", *SIGN_LANGUAGES):
        result = result.when(family == name, tokenize(text, name))
    return result


def tokenize_files(files: DataFrame) -> DataFrame:
    """Add `tokens` to rows of (path, content[, language]); whole texts, whatever their length."""
    if "language" not in files.columns:
        files = files.withColumn("language", detect_language(F.col("path")))
    return files.withColumn("tokens", tokenize_by_language(F.col("content"), F.col("language")))


def token_rows(files: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per token with its position.

    The outer form: Spark gives the inner one filters on the size of the array and pushes them below all columns that
    it is made of, so every text was cut several times, its language and content made anew in each branch.
    """
    found = files.select(*keys, F.posexplode_outer("tokens").alias("pos", "token")).where("pos is not null")
    return found.select(*keys, "pos", "token.*")


def type_counts(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, type, n, texts, last_line) of rows with `tokens`: tokens, different texts and last line of each type.

    Each row is summed up in place, so what is grouped is a row per file and type, not one per token. Only where several
    rows have the same keys do their texts meet, one row each.
    """

    def summed(kind: Column) -> Column:
        own = F.filter("tokens", lambda t: t["type"] == kind)
        return let(
            own,
            lambda own: F.struct(
                kind.alias("type"),
                F.size(own).cast("bigint").alias("n"),
                F.array_max(F.transform(own, lambda t: t["start"])).alias("last_line"),
                F.array_distinct(F.transform(own, lambda t: t["text"])).alias("words"),
            ),
        )

    kinds = F.array_distinct(F.transform("tokens", lambda t: t["type"]))
    each = files.select(*keys, F.explode_outer(F.transform(kinds, summed)).alias("t")).where("t is not null")
    held = materialize(each.select(*keys, "t.*", F.size("t.words").cast("bigint").alias("texts")))
    named = [*keys, "type"]
    sums = materialize(
        held.groupBy(*named).agg(
            F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.max("last_line").alias("last_line"), F.count("*").alias("rows")
        )
    )
    once = sums.where("rows = 1").select(*named, "n", "texts", "last_line")
    if sums.where("rows > 1").isEmpty():
        return once
    several = sums.where("rows > 1").select(*[F.col(c).alias(f"_{c}") for c in named]).hint("shuffle_hash")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in named])
    met = held.join(several, same, "left_semi").select(*named, F.explode("words").alias("word"))
    united = met.groupBy(*named).agg(F.count_distinct("word").alias("texts"))
    again = sums.where("rows > 1").drop("texts").select(*[F.col(c).alias(f"_{c}") for c in named], "n", "last_line")
    return once.unionByName(united.join(again, same).select(*named, "n", "texts", "last_line"))
