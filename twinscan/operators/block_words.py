"""Words that open and close blocks, for languages whose blocks end by a word instead of a brace or an indentation.

A line counts how many blocks it opens and closes; the depth of blocks then comes from a running sum over lines, and
a block's partner is the next line at which the depth falls back, whatever the indentation. What only looks like an
opener (modifiers behind a statement, keys, indices) is taken out of the line first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscan.functions.text import literal_map, one_of

#: Languages whose function header opens the block that ends the function.
WORDED = ["ruby", "lua", "julia", "matlab", "fortran"]
#: Languages whose function header is followed by declarations, inner functions among them, and then by its body.
BODIED = ["pascal", "ada"]
#: Languages in which files may leave out the end of functions altogether.
ENDLESS = ["matlab"]

_AT_START = r"(?:^|[;=(,{]|->|\bthen\b|\belse\b|\breturn\b|&&|\|\||\bdo\b(?:\s*\|[^|]*\|)?)\s*"
_ROUND, _SQUARE, _CURLY = r"\([^()]*\)", r"\[[^\[\]]*\]", r"\{[^{}]*\}"
#: What is taken out of a line before counting, in this order.
_TAKEN_OUT: dict[str, list[tuple[str, str]]] = {
    "ruby": [
        # A loop's own `do`, and functions of one expression, which have no end.
        (r"(\b(?:while|until|for)\b[^;]*?)\bdo\b", "$1"),
        (r"\bdef\s+[\w.?!]+(?:\s*\([^)]*\))?\s*=\s", ""),
    ],
    "julia": [(_SQUARE, ""), (_SQUARE, "")],
    "matlab": [(_ROUND, ""), (_ROUND, ""), (_CURLY, ""), (_SQUARE, "")],
    "fortran": [(_ROUND, "@"), (_ROUND, "@"), (_ROUND, "@")],
    "ada": [
        (_ROUND, ""),
        (_ROUND, ""),
        (r"(?i)\bend\s+(?:if|loop|case|record|select)\b", "end"),
        (r"(?i)\bnull\s+record\b", ""),
    ],
    "pascal": [],
}
_OPENERS = {
    "ruby": _AT_START + r"(?:if|unless|while|until|for|case|begin)(?![\w:?!])|(?<![.:\w@$])(?:def|class|module|do)(?![\w:?!])",
    "lua": r"(?<![.:\w])(?:function|if|do|repeat)\b",
    "julia": r"(?<![.:\w])(?:function|macro|begin|let|quote|try|struct|module|baremodule|do|(?:abstract|primitive)\s+type)\b"
    + r"|(?:^|;|=|\belse\b)\s*(?:@\w+(?:\.\w+)*\s+)*(?:if|for|while)\b",
    "matlab": r"(?:^|[;,])\s*(?:function|if|for|parfor|while|switch|try|classdef|methods|properties|events|enumeration|spmd)\b",
    "fortran": r"(?i)^\s*(?:\w+\s*:\s*)?(?:if\s*@?\s*then\b|do\b(?!\s*=)|select\s*(?:case|type)\b|(?:where|forall)\s*@?\s*$|block\b|associate\b|interface\b"
    + r"|type\s*(?:,|::|[a-z])|program\b|module\s+(?!procedure\b))"
    + r"|(?i)^\s*(?!end)(?:[\w]+\s+)*(?:subroutine|function)\s+\w",
    "pascal": r"(?i)(?<![.\w&])(?:begin|case|try|asm|record)\b|=\s*(?:object|class|interface)\b(?!\s*(?:;|of\b))",
    "ada": r"(?i)\b(?:begin|if|loop|case|record|select|(?:package|task|protected)\s+(?:body\s+|type\s+)?[\w.]+\s+is(?!\s+(?:new|separate)\b))\b|\baccept\b.*\bdo\b",
}
_CLOSERS = {
    "ruby": r"(?<![.:\w@$])end(?![\w:?!])",
    "lua": r"(?<![.:\w])(?:end|until)\b",
    "julia": r"(?<![.:\w])end\b",
    "matlab": r"(?<![.\w])end(?:function|if|for|while|switch|_try_catch)?\b",
    "fortran": r"(?i)^\s*end\s*(?:if|do|select|where|forall|block|associate|interface|type|program|module|subroutine|function)?\b(?!\s*[=(])",
    "pascal": r"(?i)(?<![.\w&])end\b",
    "ada": r"(?i)\bend\b",
}
#: Where a body may begin, and headers that only declare a function.
_BODY = r"(?i)(?<![.\w&])begin\b"
_DECLARED = {
    "pascal": r"(?i);\s*(?:forward|external\b.*|abstract|virtual;\s*abstract)\s*;",
    "ada": r"(?i);\s*$(?<!\bis\b.{0,1000})|\bis\s+(?:new|separate|abstract|null)\b|\brenames\b",
}
#: Comments of these languages that may go on over several lines.
BLOCK_COMMENTS = {
    "lua": r"--\[\[[\s\S]*?\]\]",
    "ruby": r"(?m)^=begin\b[\s\S]*?^=end\b[^\n]*",
    "julia": r"#=[\s\S]*?=#",
    "matlab": r"(?m)^[ \t]*%\{[ \t]*$[\s\S]*?^[ \t]*%\}[ \t]*$",
    "pascal": r"\{[^}]*\}|\(\*[\s\S]*?\*\)",
}
_LINE_COMMENTS = {"lua": "--.*", "ada": "--.*", "matlab": "%.*", "fortran": "!.*", "pascal": "//.*", "julia": "#.*", "ruby": "#.*"}


def _by_language(language: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(table), language)


def without_block_comments(text: Column, language: Column) -> Column:
    """The text with comments of several lines emptied; line numbers stay."""
    pattern = F.coalesce(_by_language(language, BLOCK_COMMENTS), F.lit(r"\z."))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    breaks = F.transform(found, lambda m: F.repeat(F.lit("\n"), F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))))
    pieces = F.zip_with(F.call_function("split", text, pattern, F.lit(-1)), F.concat(breaks, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(one_of(language, BLOCK_COMMENTS) & F.regexp_like(text, pattern), F.array_join(pieces, "")).otherwise(text)


def plain_line(line: Column, language: Column) -> Column:
    """The line without strings, comments, and what only looks like an opener."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"|' + r"'(?:[^'\\]|\\.)*+'", "0")
    bare = F.call_function("regexp_replace", bare, F.coalesce(_by_language(language, _LINE_COMMENTS), F.lit(r"\z.")), F.lit(""))
    for i in range(max(map(len, _TAKEN_OUT.values()))):
        steps = {k: v[i] for k, v in _TAKEN_OUT.items() if i < len(v)}
        pattern, put = (_by_language(language, {k: v[j] for k, v in steps.items()}) for j in range(2))
        bare = F.when(one_of(language, steps), F.call_function("regexp_replace", bare, pattern, put)).otherwise(bare)
    return bare


def _counted(line: Column, language: Column, table: dict[str, str]) -> Column:
    pattern = F.coalesce(_by_language(language, table), F.lit(r"\z."))
    return F.size(F.regexp_extract_all(line, pattern, F.lit(0)))


def opened(line: Column, language: Column) -> Column:
    """Blocks that a plain line opens."""
    return _counted(line, language, _OPENERS)


def closed(line: Column, language: Column) -> Column:
    return _counted(line, language, _CLOSERS)


def begins_body(line: Column, language: Column) -> Column:
    return one_of(language, BODIED) & line.rlike(_BODY)


def only_declares(line: Column, language: Column) -> Column:
    return one_of(language, BODIED) & F.regexp_like(line, F.coalesce(_by_language(language, _DECLARED), F.lit(r"\z.")))
