"""The cheapest edits that make a conversation's turns legal, by a dynamic program over persistent audits.

The roles must read `(s?(ua)+)?`, so four states are enough: nothing yet, behind a system turn, behind a user
turn, behind an assistant turn. For each state the program holds the cheapest cost and the audit (the letters of
its edits) as one node of a tree: audits share their beginnings as linked nodes. A node knows its ancestors at
all powers of two and a rolling hash of its audit, so of two audits of equal cost the least is found by a search
for their longest common prefix in a logarithmic number of steps, and what hashes call equal is then verified.
"""

from __future__ import annotations

from collections import OrderedDict

#: States, in this order: nothing yet, after system, after user, after assistant. Legal ends are the first and last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A7C3E5D1
#: Conversations whose turns look alike have one answer; so many answers a worker remembers.
_REMEMBERED = 1 << 15


def turned(state: int) -> int:
    """The state behind the only user or assistant turn that may follow a state."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: str) -> int | None:
    """The state behind a turn kept with its role, or None where that is not legal."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial in "ua":
        after = turned(state)
        return after if "ua"[after - USER] == initial else None
    return None


class Audits:
    """A tree of audits. Nodes are numbers; 0 is the empty audit. A node adds a label of one or more letters."""

    def __init__(self, prime: int = _PRIME, base: int = _BASE) -> None:
        self.prime, self.base = prime, base
        self.label = [""]
        self.depth = [0]
        self.hash = [0]
        self.ups: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4, ... nodes above
        self.same: set[tuple[int, int]] = set()  # nodes verified to hold equal audits

    def add(self, parent: int, label: str) -> int:
        if not label:
            return parent
        h = self.hash[parent]
        for x in label:
            h = (h * self.base + ord(x)) % self.prime
        above = [parent]
        for k in range(self.depth[parent].bit_length()):
            ups = self.ups[above[k]]
            if len(ups) <= k:
                break
            above.append(ups[k])
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append(h)
        self.ups.append(tuple(above))
        return len(self.label) - 1

    def path(self, node: int, above: int = 0) -> list[str]:
        """The labels from (not with) the ancestor at depth `above` down to a node."""
        labels = []
        while self.depth[node] > above:
            labels.append(self.label[node])
            node = self.ups[node][0]
        return labels[::-1]

    def text(self, node: int) -> str:
        return "".join(self.path(node))

    def _raise(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.ups[node][gap.bit_length() - 1]
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two nodes hold the same audit, letter by letter up to a node they share."""
        seen = []
        while a != b and (a, b) not in self.same:
            if self.label[a] != self.label[b] or self.depth[a] != self.depth[b]:
                return False
            seen.append((a, b))
            a, b = self.ups[a][0], self.ups[b][0]
        self.same.update(seen)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of `a` comes before that of `b` in ASCII order."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._raise(a, depth), self._raise(b, depth)
        if self.hash[x] == self.hash[y]:
            shared = (x, y)
        else:
            for k in range(depth.bit_length() - 1, -1, -1):
                up, vp = self.ups[x], self.ups[y]
                if k < len(up) and self.hash[up[k]] != self.hash[vp[k]]:
                    x, y = up[k], vp[k]
            shared = (self.ups[x][0], self.ups[y][0])
        if not self._equal(*shared):  # a collision, or labels cut differently: compare the letters
            return self.text(a) < self.text(b)
        if shared != (x, y):
            one, other = self.label[x], self.label[y]
            if not one.startswith(other) and not other.startswith(one):
                return one < other
        above = self.depth[shared[0]]
        return "".join(self.path(a, above)) < "".join(self.path(b, above))


def _offer(audits: Audits, best: list[tuple[int, int] | None], state: int, cost: int, parent: int, letter: str) -> None:
    """Keep an audit for a state if it costs less than the one there, or as much and comes before it."""
    held = best[state]
    if held is None or cost < held[0]:
        best[state] = cost, audits.add(parent, letter)
    elif cost == held[0] and audits.less(node := audits.add(parent, letter), held[1]):
        best[state] = cost, node


def _insert(audits: Audits, best: list[tuple[int, int] | None]) -> None:
    """All turns that may be inserted at this place; longer insertions lead back to a state at a higher cost."""
    for state in (NOTHING, SYSTEM, ASSISTANT, USER):
        if best[state] is not None:
            cost, node = best[state]
            _offer(audits, best, turned(state), cost + INSERT_COST, node, INSERT)


def code(initial: str, must_go: bool, truncated: bool) -> str:
    """One letter for all that edits depend on: d (must be deleted), or s, u, a, x (any other role); capital if truncated."""
    if must_go:
        return "d"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if truncated else letter


def _solve(codes: str, entry: int, first: bool) -> list[tuple[int, str] | None]:
    audits = Audits()
    best: list[tuple[int, int] | None] = [None] * 4
    best[entry] = 0, 0
    if first:
        _insert(audits, best)
    for x in codes:
        new: list[tuple[int, int] | None] = [None] * 4
        extra = TRUNCATED_COST if x.isupper() else 0
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _offer(audits, new, state, cost + DELETE_COST, node, DELETE)
            if x == "d":
                continue
            after = kept(state, x.lower())
            if after is not None:
                _offer(audits, new, after, cost + extra, node, KEEP)
            if after != turned(state):
                _offer(audits, new, turned(state), cost + REROLE_COST + extra, node, REROLE)
        _insert(audits, new)
        best = new
    return [held and (held[0], audits.text(held[1])) for held in best]


_ANSWERS: OrderedDict[tuple[str, int, bool], list[tuple[int, str] | None]] = OrderedDict()


def solve(codes: str, entry: int = NOTHING, first: bool = True) -> list[tuple[int, str] | None]:
    """For each state at the end of these turns: the least cost and its least audit, from a state at their beginning.
    Turns are inserted before them only where they are the `first`."""
    key = (codes, entry, first)
    if len(codes) > 64:
        return _solve(*key)
    answer = _ANSWERS.get(key)
    if answer is None:
        answer = _ANSWERS[key] = _solve(*key)
        if len(_ANSWERS) > _REMEMBERED:
            _ANSWERS.popitem(last=False)
    else:
        _ANSWERS.move_to_end(key)
    return answer


def chain(pieces: list[list[list[tuple[int, str] | None]]]) -> tuple[int, list[int], list[str]]:
    """The cheapest way through consecutive pieces of a conversation: its cost, and for each piece the state at its
    beginning and its part of the audit. A piece gives, for each state at its beginning, what `solve` found."""
    audits = Audits()
    best: list[tuple[int, int] | None] = [None] * 4
    best[NOTHING] = 0, 0
    came: list[list[int]] = []  # for each piece and state behind it: the state before it
    parts: list[list[str]] = []
    for piece in pieces:
        new: list[tuple[int, int] | None] = [None] * 4
        origin, part = [0] * 4, [""] * 4
        for entry, held in enumerate(best):
            if held is None:
                continue
            for state, step in enumerate(piece[entry]):
                if step is None:
                    continue
                before = new[state]
                _offer(audits, new, state, held[0] + step[0], held[1], step[1])
                if new[state] != before:
                    origin[state], part[state] = entry, step[1]
        came.append(origin)
        parts.append(part)
        best = new
    state = NOTHING
    for other in ENDS:
        if best[state] is None or best[other] is not None and (best[other][0] < best[state][0] or best[other][0] == best[state][0] and audits.less(best[other][1], best[state][1])):
            state = other
    cost = best[state][0]
    entries, audit = [], []
    for origin, part in zip(came[::-1], parts[::-1]):
        audit.append(part[state])
        state = origin[state]
        entries.append(state)
    return cost, entries[::-1], audit[::-1]


def apply(audit: str, entry: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns: what an audit makes of these turns, from a state at their beginning."""
    out, state, at = [], entry, 0
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        if edit == INSERT:
            state = turned(state)
            out.append((names[state], ""))
            continue
        if edit == KEEP:
            state = kept(state, roles[at][:1])
            out.append((roles[at], texts[at]))
        elif edit == REROLE:
            state = turned(state)
            out.append((names[state], texts[at]))
        at += 1
    return out
