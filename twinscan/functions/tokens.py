"""Column functions over token arrays (array<struct<type,text,start,end>>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscan.functions.text import literal_map, one_of, strip

# Token types that are dropped or replaced by a placeholder.
SKIPPED_TYPES = ["comment", "ERROR"]
PLACEHOLDERS = {"string": "<STRING>", "integer": "<NUMBER>", "float": "<NUMBER>", "identifier": "<VAR>"}
# Structural element of each token type; other types are upper-cased.
STRUCTURAL = {
    "function_definition": "FUNC_DEF",
    "method_definition": "FUNC_DEF",
    "if_statement": "CONDITIONAL",
    "elif_clause": "CONDITIONAL",
    "else_clause": "ELSE",
    "for_statement": "LOOP",
    "while_statement": "LOOP",
    "return_statement": "RETURN",
    "assignment": "ASSIGN",
    "augmented_assignment": "ASSIGN",
    "binary_operator": "OPERATOR",
    "unary_operator": "OPERATOR",
    "call": "CALL",
    "list": "COLLECTION",
    "tuple": "COLLECTION",
    "dictionary": "COLLECTION",
    "set": "COLLECTION",
    "string": "LITERAL",
    "integer": "LITERAL",
    "float": "LITERAL",
    "identifier": "VAR",
}
# Control-flow token types.
FLOW_TYPES = [
    "if_statement", "elif_clause", "else_clause", "for_statement", "while_statement", "break_statement",
    "continue_statement", "return_statement", "try_statement", "except_clause", "finally_clause", "do_statement",
    "switch_statement", "case_statement", "catch_clause", "throw_statement", "for_in_statement",
    "for_of_statement",
]
# Operator token types and texts of the two operator families, and the call-like types.
WORD_OPERATOR_TYPES = [
    "binary_operator", "unary_operator", "comparison_operator", "boolean_operator", "augmented_assignment",
]
SIGN_OPERATOR_TYPES = [
    "binary_expression", "unary_expression", "assignment_expression", "update_expression",
    "conditional_expression",
]
CALL_TYPES = ["method_invocation", "call", "assignment"]
WORD_MATH, SIGN_MATH = ["+", "-", "*", "/", "//", "%", "**"], ["+", "-", "*", "/", "%"]
COMPARE = ["==", "!=", "<", ">", "<=", ">="]
WORD_LOGIC, SIGN_LOGIC = ["and", "or", "not"], ["&&", "||", "!"]

# Token types whose text is rewritten, and (in normalize_structural) how.
REWRITTEN_TYPES = [
    "function_definition", "method_definition", "class_definition", "return_statement", "assignment",
    "if_statement", "elif_clause", "for_statement", "while_statement", "call",
]

PART_SEPARATOR = " | "


def prepare_for_similarity(tokens: Column) -> Column:
    """Drop comments and errors, replace literals and names by placeholders, keep the rest."""
    placeholder = literal_map(PLACEHOLDERS)

    def one(t: Column) -> Column:
        generic = F.try_element_at(placeholder, t["type"])
        return F.struct(
            t["type"].alias("type"),
            F.coalesce(generic, t["text"]).alias("text"),
            generic.isNotNull().alias("normalized"),
        )

    return F.transform(F.filter(tokens, lambda t: ~one_of(t["type"], SKIPPED_TYPES)), one)


def normalize_structural(text: Column, kind: Column) -> Column:
    """Rewrite a statement's text so that names and expressions no longer count."""

    def sub(pattern: str, to: str) -> Column:
        return F.regexp_replace(text, "(?Ud)" + pattern, to)

    more_words = F.size(F.split(strip(text), r"(?U)\s+")) > 1
    return (
        F.when(kind == "function_definition", sub(r"def\s+\w+\([^)]*\):", "def func(params):"))
        .when(kind == "method_definition", sub(r"def\s+\w+\(self[^)]*\):", "def method(self, params):"))
        .when(kind == "class_definition", sub(r"class\s+\w+:", "class Class:"))
        .when(kind == "return_statement", F.when(text.contains("return") & more_words, "return expr").otherwise(text))
        .when(kind == "assignment", sub(r"\w+\s*=\s*.+", "var = expr"))
        .when(kind.isin("if_statement", "elif_clause"), sub(r"(if|elif)\s+.+:", "$1 condition:"))
        .when(kind == "for_statement", sub(r"for\s+\w+\s+in\s+.+:", "for item in iterable:"))
        .when(kind == "while_statement", sub(r"while\s+.+:", "while condition:"))
        .when(kind == "call", sub(r"\w+\([^)]*\)", "func(args)"))
        .otherwise(text)
    )


def signature_texts(prepared: Column) -> Column:
    """One text per prepared token: the placeholder, or its type and its rewritten text."""

    def reduced(t: Column) -> Column:
        text = strip(t["text"])
        return (
            F.when(t["normalized"], F.struct(F.lit(None).cast("string").alias("type"), t["text"].alias("text")))
            .when(~one_of(t["type"], REWRITTEN_TYPES), F.struct(t["type"].alias("type"), text.alias("text")))
            .otherwise(F.struct(t["type"].alias("type"), normalize_structural(text, t["type"]).alias("text")))
        )

    return F.transform(
        F.transform(prepared, reduced),
        lambda r: F.when(r["type"].isNull(), r["text"]).otherwise(
            F.concat(r["type"], F.lit(":"), r["text"])
        ),
    )


def similarity_signature(tokens: Column) -> Column:
    return F.array_join(signature_texts(prepare_for_similarity(tokens)), PART_SEPARATOR)


def split_signature(signature: Column) -> Column:
    """Parts of a signature. Token text that itself holds the separator yields more parts."""
    return F.split(signature, r" \| ", -1)


def signature_parts(tokens: Column) -> Column:
    return split_signature(similarity_signature(tokens))


def part_set(parts: Column) -> Column:
    """Distinct non-blank parts, the set that similarity joins work on."""
    return F.array_distinct(F.filter(parts, lambda p: F.length(strip(p)) > 0))


def type_sequence(prepared: Column) -> Column:
    return F.transform(prepared, lambda t: t["type"])


def structural_of(types: Column) -> Column:
    table = literal_map(STRUCTURAL)
    return F.transform(types, lambda t: F.coalesce(F.try_element_at(table, t), F.upper(t)))


def structural_sequence(prepared: Column) -> Column:
    return structural_of(type_sequence(prepared))


def flow_of(types: Column) -> Column:
    return F.filter(types, lambda t: one_of(t, FLOW_TYPES))


def logical_flow(prepared: Column) -> Column:
    return flow_of(type_sequence(prepared))


def operations(prepared: Column) -> Column:
    """Operators by class, calls and assignments as METHOD_CALL, everything else left out."""

    def by_text(text: Column, math: list[str], logic: list[str]) -> Column:
        return (
            F.when(one_of(text, math), "MATH_OP")
            .when(one_of(text, COMPARE), "COMPARE_OP")
            .when(one_of(text, logic), "LOGIC_OP")
            .otherwise("OPERATOR")
        )

    def one(t: Column) -> Column:
        text = strip(t["text"])
        return (
            F.when(one_of(t["type"], WORD_OPERATOR_TYPES), by_text(text, WORD_MATH, WORD_LOGIC))
            .when(one_of(t["type"], SIGN_OPERATOR_TYPES), by_text(text, SIGN_MATH, SIGN_LOGIC))
            .when(one_of(t["type"], CALL_TYPES), "METHOD_CALL")
        )

    return F.filter(F.transform(prepared, one), lambda o: o.isNotNull())


def detokenize(tokens: Column) -> Column:
    texts = F.transform(tokens, lambda t: t["text"])
    return F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), " ")
