"""Secrets in texts: fixed patterns, and random-looking strings by two character Markov models.

Everything here is DataFrame functions. One model is learned from strings that the patterns label as secrets,
the other from ordinary words and numbers of the same texts, both from a bounded sample of documents. A run of key
characters that no pattern found is a secret if the log-likelihood ratio of the models, per step, is over a
threshold. The models are one table of numbers, as large as the alphabet squared.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.common import chosen

# The patterns of known secrets. The second and third count from their least length on, which
# gives the same matches as longer runs only, since both are maximal runs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"\b(?:[A-Za-z]{4,}|[0-9]{4,})\b"
#: Mean log-likelihood ratio of a step (natural logarithm) from which a run counts as random.
THRESHOLD = 0.75
#: Documents the models are learned from, about; taken by a hash of the id.
TRAINING_DOCUMENTS = 20_000

#: Weight of the single-character model against a step's own counts.
BACKOFF = 8.0

#: Characters '+' to 'z'.
_FIRST, _LETTERS = 43, 80


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)


def _steps(token: Column) -> Column:
    """Number of each pair of neighbouring characters."""
    codes = _codes(token)
    n = F.size(codes) - 1
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * _LETTERS + b)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: what a lambda takes from outside would be made anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_before(sizes: Column) -> Column:
    """For each number of an array, the sum of those before it; in blocks of about the root of their number, as no
    function keeps a running sum."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, v: a + v)

    def in_blocks(x: Column, width: Column) -> Column:
        count = F.ceil(F.size(x) / width).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(x, k * width + 1, width))

    def placed(blocks: Column, totals: Column) -> Column:
        starts = F.transform(totals, lambda _, k: total(F.slice(totals, F.lit(1), k)))
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b, lambda _, i: s + total(F.slice(b, F.lit(1), i)))))

    def summed(x: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x))).cast("int"))
        blocks = _let(width, lambda w: in_blocks(x, w))
        return _let(blocks, lambda b: _let(F.transform(b, total), lambda t: placed(b, t)))

    return _let(sizes, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(summed(x)))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, value) of all matches, in code points; value is a group of the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def sized(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), F.length)
        return F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("len")))

    def listed(sizes: Column) -> Column:
        before = _sums_before(F.transform(sizes, lambda x: x["gap"] + x["len"]))
        spans = F.zip_with(sizes, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("end")))
        return F.zip_with(spans, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))

    placed = _let(found, lambda matches: _let(sized(matches), listed))
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, assign, access, hex): matches of the fixed patterns in each text."""
    rows = chosen(docs, doc_id, text)
    found = rows.select("doc_id", "text", _matches(F.col("text"), ASSIGN, 1).alias("assign"), _matches(F.col("text"), ACCESS).alias("access"), _matches(F.col("text"), HEX).alias("hex"))
    return found.withColumn("assign", F.filter("assign", lambda m: F.length(m["value"]) >= ASSIGN_VALUE))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = TRAINING_DOCUMENTS) -> list[float]:
    """Log-likelihood ratio of each step, from about `bound` documents."""
    share = bound / max(1, docs.count())
    taken = docs if share >= 1 else docs.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000))
    base = base_matches(taken, doc_id, text)
    secrets = F.filter(F.transform(F.concat("assign", "access", "hex"), lambda m: m["value"]), lambda v: F.length(v) >= 12)
    words = F.regexp_extract_all(F.col("text"), F.lit(ORDINARY), F.lit(0))
    samples = F.concat(F.transform(secrets, lambda v: F.struct(F.lit(1).alias("random"), v.alias("token"))), F.transform(words, lambda v: F.struct(F.lit(0).alias("random"), v.alias("token"))))
    steps = base.select(F.explode(samples).alias("x")).groupBy("x.random", "x.token").count()
    counted = steps.select("random", "count", F.explode(_steps(F.col("token"))).alias("step")).groupBy("random", "step").agg(F.sum("count").alias("n"))
    tables = [[0.0] * _LETTERS**2 for _ in range(2)]
    for row in counted.collect():  # at most two rows for each step
        tables[row["random"]][row["step"]] += row["n"]
    return [round(r - o, 6) for o, r in zip(*map(_log_probabilities, tables))]


def _log_probabilities(steps: list[float]) -> list[float]:
    """log P(next | this), smoothed towards how often the next character follows any."""
    total = sum(steps)
    follows = [(sum(steps[i :: _LETTERS]) + 0.5) / (total + 0.5 * _LETTERS) for i in range(_LETTERS)]
    out = []
    for i in range(_LETTERS):
        row = steps[i * _LETTERS : (i + 1) * _LETTERS]
        out += [math.log((x + BACKOFF * p) / (sum(row) + BACKOFF)) for x, p in zip(row, follows)]
    return out


def _in_groups(spans: Column) -> Column:
    """(start, end, spans) of 64 neighbouring spans each, so that most of them are passed over at once."""

    def group(x: Column) -> Column:
        ends = F.array_max(F.transform(x, lambda b: b["end"]))
        return F.struct(F.element_at(x, 1)["start"].alias("start"), ends.alias("end"), x.alias("spans"))

    def cut(x: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int")), lambda k: F.slice(x, k * 64 + 1, 64))
        return F.transform(slices, group)

    none = F.array().cast("array<struct<start:int,end:int,spans:array<struct<start:int,end:int,value:string>>>>")
    return _let(spans, lambda x: F.when(F.size(x) == 0, none).otherwise(cut(x)))


def find_secrets(docs: DataFrame, ratios: list[float], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, assign, access, hex, random) of each row of `docs`: arrays of (start, end, value) in code
    points, end exclusive, each in order and without overlap; `random` spans overlap none of the others.

    A null text has none; a null id stays null; repeated rows give repeated results, an empty table an empty
    one; other columns are left out. No shuffle.
    """
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    rows = base_matches(docs, doc_id, text).withColumn("tried", _matches(F.col("text"), CANDIDATE))
    rows = rows.withColumn("known", _in_groups(F.sort_array(F.concat("assign", "access", "hex"))))

    def ratio(token: Column) -> Column:
        total = F.aggregate(_steps(token), F.lit(0.0), lambda a, s: a + F.get(table, s))
        return total / (F.length(token) - 1)

    def meets(span: Column, m: Column) -> Column:
        return (span["start"] < m["end"]) & (m["start"] < span["end"])

    def clear(m: Column) -> Column:
        return ~F.exists("known", lambda g: meets(g, m) & F.exists(g["spans"], lambda b: meets(b, m)))

    random = F.filter("tried", lambda m: clear(m) & (ratio(m["value"]) > threshold))
    return rows.select("doc_id", "assign", "access", "hex", random.alias("random"))


def listed(kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of the matches in columns of these names, by start, then kind, joined by commas."""

    def said(kind: str, place: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("kind"), F.concat_ws(":", F.lit(kind), m["start"], m["end"]).alias("said"))

    numbered = [F.transform(k, said(k, i)) for i, k in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*numbered)), lambda x: x["said"]), ",")
