"""Conversation repair and fill-in-the-middle against plain re-computations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tests.llm.helpers import awkward, prose, rows, table
from twinscan.llm import audits, conversations, infill

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("conv", T.StringType()),  # names that the operator uses inside
        T.StructField("part", T.StringType()),
        T.StructField("done", T.StringType()),
    ]
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_damage(rows_):
    out = []
    for conv, turn, role, text in rows_:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def searched(turns):
    """The least (cost, audit) and the repaired turns by trying all edits, pruned by legal beginnings alone."""
    best = [None]

    def go(i, cost, audit, made):
        initials = "".join(r[:1] or " " for r, _ in made)
        if not re.fullmatch("s?(ua)*u?", initials) or best[0] and cost > best[0][0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", initials):
            best[0] = min(x for x in (best[0], (cost, audit, made)) if x)
        if len(audit) < 2 or audit[-2:] != "II":
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", made + [(role, "")])
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, cost + 3, audit + "D", made)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                go(i + 1, cost + extra, audit + "K", made + [(role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, audit + "R", made + [(other, text)])

    go(0, 0, "", [])
    return best[0]


def brute_repair(rows_):
    expected = {}
    after = plain_damage(rows_)
    for conv in {x[0] for x in rows_}:
        mine = sorted((x for x in after if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.md5(x[3].encode()).hexdigest()))
        seen, counts, judged = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
        for _, _, role, text in mine:
            dense = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not dense else "duplicate" if (role, text) in seen else "truncated" if dense[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        known = [x[1] for x in mine if x[1] is not None]
        initials = [x[2][:1] or " " for x in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = searched(judged)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        expected[conv] = (gaps, *counts.values(), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made)))
    return expected


def some_turns(seed, convs, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Yes.", "cut off", "  ", "", None, "Why? ", "a.b", "é…", "two\nlines."]
    out = []
    for conv in convs:
        for _ in range(rnd.randint(1, most)):
            turn = rnd.choice([None, *range(6), 9])
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            out.append((conv, turn, role, rnd.choice(texts)))
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check_repair(spark, data, **options):
    made = spark.createDataFrame([(*x, "c", "p", "d") for x in data], TURNS)
    repair = conversations.Repair(conversations.damaged(conversations.given(made)), **options)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in repair.summaries().collect()}
    expected = brute_repair(data)
    assert got == expected
    whole: dict = {}
    for r in sorted(repair.turns().collect(), key=lambda r: (r["part"], r["seq"], r["place"])):
        whole.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(sha("\n".join(whole.get(conv, []))) == x[-1] for conv, x in expected.items())


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_a_search_of_all_edits(spark, seed):
    check_repair(spark, some_turns(seed, [None, -3, *range(60)], 4))


def test_repair_in_pieces(spark):
    """One conversation over many partitions and pieces; duplicates and audits cross their edges."""
    rnd = random.Random(5)
    data = [(7, i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["One.", "Two!", f"{i}.", "cut", ""])) for i in range(10)]
    check_repair(spark, data + some_turns(9, [6, 8], 3), piece_turns=2)
    # Longer ones, against one piece.
    many = [(7, i // 2, rnd.choice(["user", "assistant", "user", "assistant", "tool"]), rnd.choice([f"{i % 40}.", f"{i}!", "cut", " "])) for i in range(300)]
    many += [(8, None, "user", "Same.")] * 100
    made = spark.createDataFrame([(*x, "c", "p", "d") for x in many], TURNS)
    turns = conversations.damaged(conversations.given(made))
    pieces = sorted(map(tuple, conversations.Repair(turns, texts=False, piece_turns=3).summaries().collect()))
    again = sorted(map(tuple, conversations.Repair(turns.coalesce(1), texts=False).summaries().collect()))
    assert pieces == again and len(pieces) == 2 and len(pieces[0][7]) >= 300


def test_repair_of_nothing(spark):
    assert conversations.Repair(conversations.given(spark.createDataFrame([], TURNS))).summaries().count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    made = spark.createDataFrame([(5, dropped, "user", "Hi.", "", "", "")], TURNS)
    got = conversations.Repair(conversations.damaged(conversations.given(made))).summaries().collect()
    assert [tuple(x) for x in got] == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 5])
def test_audits_compare_like_texts(prime):
    """Also with a prime so small that hashes collide all the time."""
    tree, rnd, nodes = audits.Audits(prime=prime, base=3), random.Random(1), [0]
    for _ in range(300):
        nodes.append(tree.add(rnd.choice(nodes[-20:]), rnd.choice(["D", "K", "R", "I", "KK", "KD"])))
    for _ in range(3000):
        a, b = rnd.choice(nodes), rnd.choice(nodes)
        assert tree.less(a, b) == (tree.text(a) < tree.text(b))


def test_op11_query(spark):
    from twinscan.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    short = {c for c in {x[0] for x in data} if sum(x[0] == c for x in data) <= 6}
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in LLM_QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert set(got) == {x[0] for x in data}
    for conv, row in brute_repair([x for x in data if x[0] in short]).items():
        assert got[conv] == row


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    made = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), sha(made), sha(text)


INFILL = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@pytest.mark.parametrize("frame_chars", [1, 7, 1 << 16])
def test_infill(spark, tmp_path, frame_chars):
    texts = [*awkward(), "a<P>b", "<S>", "x<M", "<", "<<", ">", "S>", "abc" * 300 + " é" + "z" * 900, *(prose(i, 30) for i in range(40))]
    if frame_chars == 1:
        texts = [x for x in texts if len(x or "") < 2000]
    ids = [None, -4, *range(len(texts) - 4), 3, 3]
    docs = table(spark, texts, ids)
    infill.write_frames(docs, str(tmp_path / "f"), frame_chars=frame_chars)
    made = infill.infill(spark, str(tmp_path / "f")).cache()
    key = str
    assert sorted(rows(made, *INFILL), key=key) == sorted([(i, *brute_infill(i, t)) for i, t in zip(ids, texts)], key=key)
    assert all(sha(r["output"]) == r["output_sha256"] for r in made.collect())
    assert {"plain", "psm", "spm"} == {r["form"] for r in made.collect()}


def test_infill_frames_are_seekable():
    import zstandard

    text = (prose(3, 4000) + "x" * 3000).encode()
    stored = infill.store_text(text, zstandard.ZstdCompressor(), 1000)
    assert len(stored.frames) > 10
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text.decode())
    for k in (0, 1, 500, stored.n_units - 1, stored.n_units):
        frames = infill.Frames(stored)
        opened = []
        plain = frames.decompressor.decompress
        frames.decompressor = type("Counting", (), {"decompress": lambda self, x: (opened.append(1), plain(x))[1]})()
        assert frames.place(k) == (len("".join(units[:k])), len("".join(units[:k]).encode()))
        assert len(opened) <= 2
    assert b"".join(infill.Frames(stored).read(1500, 5200)) == text[1500:5200]


def test_infill_of_nothing(spark, tmp_path):
    infill.write_frames(table(spark, []), str(tmp_path / "f"))
    assert infill.infill(spark, str(tmp_path / "f")).count() == 0


def test_op13_query(spark):
    from twinscan.llm.queries import LLM_QUERIES

    folder = "/root/testdata/sf0.001"
    docs = rows(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text")
    got = rows(LLM_QUERIES["op13_fill_in_middle"](spark, folder), *INFILL)
    assert sorted(got) == sorted((i, *brute_infill(i, t)) for i, t in docs)
