"""Removal of repeated byte strings against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, prose, rows, table
from twinscan.llm import byte_passages
from twinscan.llm.byte_passages import Strips, remove_repeated_bytes, repeated_suffixes


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    windows = Counter(x[i : i + depth] for x in data for i in range(len(x) - depth + 1))
    out = []
    for x in data:
        gone = bytearray(len(x) + 1)
        for i in range(len(x) - depth + 1):
            if windows[x[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(a < b for a, b in zip(b"\0" + gone, gone))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), spans, kept))
    return out


def result(made):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in made.collect()]


def planted(seed):
    """Texts that share passages of all lengths around the depth, some with a changed byte."""
    rnd = random.Random(seed)
    shared = [prose(100 + seed * 10 + i, 40) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(1000 * seed + i, rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            x = rnd.choice(shared)
            a = rnd.randrange(len(x))
            parts += [x[a : a + rnd.randint(1, 160)], prose(rnd.randrange(10**6), rnd.randint(0, 6))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(("depth", "leader", "seed", "often"), [(50, 16, 1, 1024), (50, 50, 2, 1024), (23, 7, 3, 4), (8, 8, 4, 1024), (3, 1, 5, 30), (50, 16, 6, 2)])
def test_equals_a_count_of_windows(spark, monkeypatch, depth, leader, seed, often):
    monkeypatch.setattr(byte_passages, "SLICE", 3000)
    monkeypatch.setattr(byte_passages, "BLOCK", 700)
    texts = [*planted(seed), *awkward()[:16], "ab" * 400, "b" + "ab" * 300, "é" * 300, "x" * 20 + "é" * 100]
    ids = [None, None, *range(len(texts) - 4), 5, 5]
    made = remove_repeated_bytes(table(spark, texts, ids), depth=depth, leader=leader, leader_bucket=5000, strip_bucket=5000, frequent_from=often)
    expected = [(i, *x) for i, x in zip(ids, brute(texts, depth))]
    assert Counter(result(made)) == Counter(expected)
    assert any(0 < x[2] < x[1] for x in expected)


def test_contract_depth_and_copies(spark):
    """At 200 bytes: exact copies go whole, 199 shared bytes stay, a third of all rows being one text is no matter."""
    base = "".join(random.Random(3).choice("abcdefgh ") for _ in range(400))
    hot = prose(77, 80)
    texts = [base, "1" + base[:199] + "2", "3" + base[100:300] + "4", *[hot] * 40, "y" + hot, *(prose(500 + i, 90) for i in range(70)), None, ""]
    made = remove_repeated_bytes(table(spark, texts))
    assert Counter(result(made)) == Counter((i, *x) for i, x in enumerate(brute(texts, 200)))
    digests = remove_repeated_bytes(table(spark, texts), digest=True)
    assert sorted(rows(digests, "doc_id", "kept")) == sorted((i, hashlib.sha256(x[3]).hexdigest()) for i, x in enumerate(brute(texts, 200)))


def test_a_passage_in_many_texts(spark):
    """The edges of the passage have one leader in all texts; their windows are dealt further."""
    passage = prose(42, 60)
    texts = [prose(2000 + i, 25) + passage + prose(4000 + i, 25) for i in range(300)]
    expected = Counter((i, *x) for i, x in enumerate(brute(texts, 200)))
    for often in (50, 1 << 30):
        assert Counter(result(remove_repeated_bytes(table(spark, texts), frequent_from=often))) == expected


def test_null_ids_with_one_text(spark):
    texts = [prose(9, 60)] * 30 + [prose(8, 60)]
    made = remove_repeated_bytes(table(spark, texts, [None] * 31))
    assert Counter(result(made)) == Counter((None, *x) for x in brute(texts, 200))


def test_nothing(spark):
    assert remove_repeated_bytes(table(spark, [])).count() == 0
    assert result(remove_repeated_bytes(table(spark, [None, ""]))) in ([(0, 0, 0, 0, b""), (1, 0, 0, 0, b"")], [(1, 0, 0, 0, b""), (0, 0, 0, 0, b"")])


def test_windows_of_a_text_have_one_strip_each(monkeypatch):
    monkeypatch.setattr(byte_passages, "BLOCK", 97)
    texts = [prose(i, 40).encode() for i in range(5)] + [b"a" * 300, b"", b"short"]
    strips = Strips(texts, 60, 20)
    start = windows = 0
    for x in texts:
        windows += max(0, len(x) - 59)
        start += len(x)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(strips.first, strips.last)])
    assert len(covered) == windows == len(set(covered.tolist()))
    leaders: dict[bytes, set] = {}
    for a, b, at in zip(strips.first, strips.last, strips.at):
        for i in range(a, b + 1):
            assert i <= at <= i + 40
            leaders.setdefault(strips.text[i : i + 60], set()).add(int(at - i))
    assert all(len(x) == 1 for x in leaders.values())


@pytest.mark.parametrize("depth", [1, 5, 8, 9, 16, 21])
def test_radix_sort(depth):
    rnd = random.Random(depth)
    text = bytes(rnd.choice(b"ab\x00\xff") for _ in range(400)) * 2
    starts = np.array([i for i in range(len(text) - depth + 1) if rnd.random() < 0.5])
    counts = Counter(text[i : i + depth] for i in starts)
    assert repeated_suffixes(text, starts, depth).tolist() == [counts[text[i : i + depth]] > 1 for i in starts]
    assert repeated_suffixes(text, starts[:0], depth).tolist() == []


def test_op12_query(spark):
    from twinscan.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    docs = rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    got = rows(LLM_QUERIES["op12_suffix_array_dedup"](spark, folder), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = [(i, a, b, c, hashlib.sha256(kept).hexdigest()) for (i, _), (a, b, c, kept) in zip(docs, brute([t for _, t in docs], 200))]
    assert sorted(got) == sorted(expected)
