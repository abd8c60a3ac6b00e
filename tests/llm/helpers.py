"""Small awkward tables and plain re-computations shared by the tests."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("h", T.StringType()),  # names that operators use inside
        T.StructField("bucket", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("key", T.StringType()),
    ]
)

WORDS = "the of und la een ring token Straße été niño ab12 x'y don't a.b".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", "\n", ", ", "  ", "\t"]) for _ in range(n))


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "h", 1, 2, "k") for i, t in zip(ids, texts)], SCHEMA)


def awkward() -> list[str | None]:
    """Null, empty, blank, very long, repeated and near texts."""
    base = [prose(i, 60 + i) for i in range(12)]
    return [None, "", " \n\t ", "x", *base, base[3], base[3], base[4] + " more", prose(99, 9000), "a" * 5000, "\U0001f600 ́é　z\x1cq\x00w"]


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Union:
    """Plain union-find; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
