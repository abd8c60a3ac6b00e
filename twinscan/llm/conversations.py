"""Repair of the structure of conversations: faults of turns, and the cheapest edits to a legal order of roles.

Turns are range-partitioned by conversation and turn, so one conversation, however long, lies in as many
partitions as its share of all turns. A conversation that begins and ends inside one partition and fits one piece
is repaired there. Of the others each partition makes pieces of bounded size; what pieces must know of each other
is little: which turns stood in an earlier piece already (hashes meet by an aggregate), and for each state at the
beginning of a piece the cheapest audits to each state at its end. These are chained by conversation, without
texts; then every piece is repaired in its place, and only a digest passes over a whole conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.audits import NOTHING, apply, chain, code, solve
from twinscan.llm.common import materialize

BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
LEGAL_NEIGHBOURS = ("su", "ua", "au")
#: Turns, and characters of text, of a piece.
PIECE_TURNS, PIECE_CHARS = 1 << 13, 1 << 22

_ROWS = "conv long, turn long, role string, text string"


def given(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): only these columns; a null role or text becomes one space."""

    def words(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    return rows.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), words(role).alias("role"), words(text).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """What `given` returns, damaged by a checksum of conversation and turn. A turn that is dropped stays as a row without
    role and text, so that its conversation is not forgotten."""
    name = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv", "turn")])
    kind = (F.crc32(name.cast("binary")) % 20).alias("kind")
    marked = turns.select("*", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", SENTENCE_ENDS, "")).otherwise(F.col("text"))
    gone = F.col("kind") == 0
    changed = marked.select(
        "conv",
        "turn",
        F.when(gone, None).when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone, None).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def _in_order(turns: DataFrame) -> DataFrame:
    """By conversation and turn, nulls first; turns of one number by role, then by a hash of their text. Equal rows
    (only they share all of that) may stand in different partitions."""
    keys = [F.col(x).asc_nulls_first() for x in ("conv", "turn", "role", "tie", "row")]
    ranged = turns.select("*", F.md5(F.col("text").cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("row"))
    return ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "role", "text")


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _is_blank(text: str) -> bool:
    return not text.strip(BLANKS)


def _is_truncated(text: str) -> bool:
    return text.rstrip(BLANKS)[-1:] not in SENTENCE_ENDS


class _Piece:
    """Consecutive turns of one conversation."""

    def __init__(self, conv: int | None, seq: int) -> None:
        self.conv, self.seq = conv, seq
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = 0

    def add(self, turn: int | None, role: str | None, text: str | None) -> None:
        if role is None:
            return  # dropped
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


def _judged(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[str, str, list[int]]:
    """(initials, codes, [blank, duplicate, truncated]) of consecutive turns; `seen` holds the keys of earlier ones."""
    codes, counts = [], [0, 0, 0]
    seen = set(seen)
    for role, text in zip(roles, texts):
        key = _key(role, text)
        blank = _is_blank(text)
        repeated = not blank and key in seen
        cut = not blank and not repeated and _is_truncated(text)
        seen.add(key)
        for i, fault in enumerate((blank, repeated, cut)):
            counts[i] += fault
        codes.append(code(role[:1], blank or repeated, cut))
    # An empty role has no initial and stands between its neighbours like any other strange one.
    return "".join(r[:1] or " " for r in roles), "".join(codes), counts


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL_NEIGHBOURS for i in range(len(initials) - 1))


def _numbers(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """Smallest, largest and number of different turn numbers, of turns in order."""
    known = [x for x in turns if x is not None]
    return (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:]))) if known else (None, None, 0)


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return high - low + 1 - distinct if distinct else 0


def _written(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = "repaired array<struct<role: string, text: string>>"
_PIECES = (
    "done boolean, " + _SUMMARY + ", " + _REPAIRED + ", part int, seq int, first boolean, turns array<long>, roles array<string>, texts array<string>"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = []
    for field in schema.replace("role: string, text: string", "turn").split(", "):
        name, kind = field.split(" ", 1)
        if kind.startswith("array"):
            kind = kind[6:-1]
            fields.append((name, pa.list_(_TURN if kind.startswith("struct") else kinds[kind])))
        else:
            fields.append((name, kinds[kind]))
    return pa.schema(fields)


def _batches(rows: Iterable[dict[str, Any]], schema: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches; rows with pieces of text count as many."""
    kind, held, weight = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        weight += 1 + len(row.get("texts") or row.get("repaired") or ()) // 16
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, kind)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, kind)


def _finished(piece: _Piece) -> dict[str, Any]:
    """The result of a conversation that is one piece."""
    initials, codes, (blank, duplicate, truncated) = _judged(piece.roles, piece.texts, set())
    cost, _, audit = chain([[solve(codes), *[[None] * 4] * 3]])
    repaired = apply(audit[0], NOTHING, piece.roles, piece.texts)
    return {
        "done": True,
        "conv_id": piece.conv,
        "gaps": _gaps(*_numbers(piece.turns)),
        "blank": blank,
        "duplicate": duplicate,
        "truncated": truncated,
        "illegal": _illegal(initials),
        "cost": cost,
        "audit": audit[0],
        "repaired_sha256": hashlib.sha256(_written(repaired).encode()).hexdigest(),
        "repaired": [{"role": r, "text": t} for r, t in repaired],
    }


def _pieces(turns: DataFrame, texts: bool, piece_turns: int) -> DataFrame:
    """One row for each conversation that is finished, and the pieces of the others. A conversation is finished
    where it lies inside a partition, neither first nor last there, in one piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def result(piece: _Piece) -> dict[str, Any]:
            row = _finished(piece)
            return row if texts else row | {"repaired": None}

        def opened(piece: _Piece) -> dict[str, Any]:
            return {"done": False, "conv_id": piece.conv, "part": part, "seq": piece.seq, "turns": piece.turns, "roles": piece.roles, "texts": piece.texts}

        def rows() -> Iterator[dict[str, Any]]:
            piece, is_first = None, True
            for batch in batches:
                for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if piece is None:
                        piece = _Piece(conv, 0)
                    elif conv != piece.conv:
                        yield opened(piece) if is_first or piece.seq else result(piece)
                        piece, is_first = _Piece(conv, 0), False
                    elif len(piece.roles) >= piece_turns or piece.chars >= PIECE_CHARS:
                        yield opened(piece)
                        piece = _Piece(conv, piece.seq + 1)
                    piece.add(turn, role, text)
            if piece is not None:
                yield opened(piece)

        yield from _batches(rows(), _PIECES)

    return _in_order(turns).mapInArrow(run, _PIECES)


def _earlier(pieces: DataFrame) -> DataFrame:
    """(c, p, s, seen): for each open piece, the keys of its turns that an earlier piece of the conversation holds.
    A piece sends each key once, so however often a turn is repeated, a key meets as many rows as there are pieces."""
    kind = "conv long, part int, seq int, key binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                keys = {_key(r, t) for r, t in zip(row["roles"], row["texts"]) if not _is_blank(t)}
                n = len(keys)
                columns = [pa.array([row["conv_id"]] * n, pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(sorted(keys), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "seq", "key"])

    keys = pieces.select("conv_id", "part", "seq", "roles", "texts").mapInArrow(run, kind)
    first = keys.groupBy(F.col("conv").alias("of"), F.col("key").alias("k")).agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = keys.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("k"))).where(F.struct("part", "seq") > F.col("first"))
    return later.groupBy(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s")).agg(F.collect_list("key").alias("seen"))


_LINK = (
    "conv_id long, part int, seq int, low long, high long, distinct long, initials string, blank long, duplicate long, truncated long, "
    "costs array<long>, audits array<string>"
)
_CHAINED = "c long, p int, s int, entry int, audit string, head boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _link(row: dict[str, Any]) -> dict[str, Any]:
    """What a piece tells of itself: counts, its first and last initial, and the cheapest way from and to each state."""
    initials, codes, (blank, duplicate, truncated) = _judged(row["roles"], row["texts"], set(row["seen"] or ()))
    low, high, distinct = _numbers(row["turns"])
    ways = [solve(codes, entry, False) for entry in range(4)]
    flat = [x for way in ways for x in way]
    return {
        **{k: row[k] for k in ("conv_id", "part", "seq")},
        **{"low": low, "high": high, "distinct": distinct, "initials": initials, "blank": blank, "duplicate": duplicate, "truncated": truncated},
        "costs": [x and x[0] for x in flat],
        "audits": [x and x[1] for x in flat],
    }


def _chain_links(group: pa.Table) -> pa.Table:
    """The links of one conversation, chained: each piece's part of the audit, and the counts at its first piece."""
    links = sorted(group.to_pylist(), key=lambda x: (x["part"], x["seq"]))
    ways = [[[c if c is None else (c, a) for c, a in zip(x["costs"][i : i + 4], x["audits"][i : i + 4])] for i in range(0, 16, 4)] for x in links]
    # Turns inserted before the first one belong to no piece: an empty piece of their own, given to the first.
    cost, entries, audits = chain([[solve("") if e == NOTHING else [None] * 4 for e in range(4)], *ways])
    entries, audits = [entries[0], *entries[2:]], [audits[0] + audits[1], *audits[2:]]
    numbered = [x for x in links if x["low"] is not None]
    distinct = sum(x["distinct"] for x in numbered) - sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
    totals = {
        "gaps": _gaps(numbered[0]["low"], numbered[-1]["high"], distinct) if numbered else 0,
        "illegal": _illegal("".join(x["initials"] for x in links)),
        "cost": cost,
        **{k: sum(x[k] for x in links) for k in ("blank", "duplicate", "truncated")},
    }
    rows = [
        {"c": x["conv_id"], "p": x["part"], "s": x["seq"], "entry": entry, "audit": audit, "head": i == 0, **(totals if i == 0 else {})}
        for i, (x, entry, audit) in enumerate(zip(links, entries, audits))
    ]
    return pa.Table.from_pylist(rows, _arrow(_CHAINED))


def _joined(pieces: DataFrame, other: DataFrame) -> DataFrame:
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))
    return pieces.join(other, same, "left").drop("c", "p", "s")


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """One dict out for each row in, a row at a time: a row holds a whole piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield pa.RecordBatch.from_pylist([function(row) for row in batch.slice(i, 1).to_pylist()], kind)

    kind = _arrow(schema)
    return df.mapInArrow(run, schema)


_OPEN = "conv_id long, part int, seq int, head boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, " + _REPAIRED


def _repair_piece(row: dict[str, Any]) -> dict[str, Any]:
    repaired = apply(row["audit"], row["entry"], row["roles"], row["texts"])
    names = [x.split()[0] for x in _OPEN.split(", ")]
    return {k: row[k] for k in names if k in row} | {"repaired": [{"role": r, "text": t} for r, t in repaired]}


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result for each conversation, from its repaired pieces in order."""

    def rows() -> Iterator[dict[str, Any]]:
        row, state, audit, any_turn = None, None, [], False
        for batch in batches:
            for i in range(len(batch)):
                piece = batch.slice(i, 1).to_pylist()[0]
                if piece["head"]:
                    if row is not None:
                        yield row | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}
                    row = {k: piece[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                    state, audit, any_turn = hashlib.sha256(), [], False
                audit.append(piece["audit"])
                if piece["repaired"]:
                    state.update((any_turn * "\n" + _written([(x["role"], x["text"]) for x in piece["repaired"]])).encode())
                    any_turn = True
        if row is not None:
            yield row | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}

    yield from _batches(rows(), _SUMMARY)


class Repair:
    """Faults, cheapest repair and repaired turns of all conversations of a table in the form of `given`.

    Turns count in the order of their number, nulls first; those with one number by role, then by a hash of their
    text. A null conversation is one conversation; a row without role (see `damaged`) only names its conversation. An
    empty role has no legal place; equal rows are duplicates of each other; an empty table gives an empty result.
    """

    def __init__(self, turns: DataFrame, texts: bool = True, piece_turns: int = PIECE_TURNS) -> None:
        stored = materialize(_pieces(turns, texts, piece_turns))
        self._done = stored.where("done")
        pieces = stored.where("not done").select("conv_id", "part", "seq", "turns", "roles", "texts")
        links = materialize(_mapped(_joined(pieces, _earlier(pieces)), _link, _LINK))
        chained = links.groupBy("conv_id").applyInArrow(_chain_links, _CHAINED)
        self._open = _mapped(_joined(pieces.select("conv_id", "part", "seq", "roles", "texts"), chained), _repair_piece, _OPEN)

    def summaries(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
        names = [x.split()[0] for x in _SUMMARY.split(", ")]
        dealt = self._open.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
        return self._done.select(*names).unionByName(dealt.mapInArrow(_digests, _SUMMARY))

    def turns(self) -> DataFrame:
        """(conv_id, part, seq, place, role, text): the repaired turns, in the order of the three numbers; made with `texts`."""
        one = self._done.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), "repaired")
        every = one.unionByName(self._open.select("conv_id", "part", "seq", "repaired"))
        placed = every.select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "turn"))
        return placed.select("conv_id", "part", "seq", "place", "turn.role", "turn.text")
