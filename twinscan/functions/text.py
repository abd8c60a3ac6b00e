"""Small string helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# All Unicode white space, plus the four separator controls.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(d: dict[str, str]) -> Column:
    """Constant map column, parsed from one SQL text instead of one call per value."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in d.items()) + ")")


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once: an expression that a lambda takes from outside would be computed anew for
    each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def one_of(c: Column, values) -> Column:
    """Membership in a constant list, parsed from one SQL text like `literal_map`."""
    return F.array_contains(F.expr("array(" + ", ".join(_quoted(v) for v in values) + ")"), c)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def decode_text(content: Column) -> Column:
    """Binary to text: UTF-8 when valid, else Latin-1; line ends become a plain newline."""
    as_utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def code_block(text: Column, start: Column, end: Column) -> Column:
    """Lines [start, end) of `text` (0-based, clamped), joined again; empty when the range is."""
    lines = F.split(text, "\n")
    first = F.greatest(start, F.lit(0))
    size = F.least(end, F.size(lines)) - first
    return F.when(
        start.isNotNull() & end.isNotNull() & (size > 0) & (F.length(text) > 0),
        F.array_join(F.slice(lines, first + 1, F.greatest(size, F.lit(0))), "\n"),
    ).otherwise(F.lit(""))


def extract_imports(text: Column) -> Column:
    """Ordered distinct names of all import lines."""
    clauses = F.regexp_extract_all(text, F.lit(r"(?Ud)(?m)^(?:from\s+\S+\s+)?import\s+([^#\n]+)"), F.lit(1))
    names = F.flatten(
        F.transform(
            clauses,
            lambda clause: F.transform(
                F.split(clause, ","), lambda n: strip(F.element_at(F.split(strip(n), " as "), 1))
            ),
        )
    )
    return F.array_distinct(F.filter(names, lambda n: n != ""))
