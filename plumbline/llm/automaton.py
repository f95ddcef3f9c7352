"""Several byte patterns as one minimal deterministic automaton in transition arrays.

The patterns use literals, ``[...]`` classes, groups, ``(?i:...)`` for ASCII letters in either case, ``|``, ``?``, ``*``,
``+`` and ``{n}``, ``{n,}``, ``{n,m}``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


class _Nfa:
    """Fragments are (start, end) pairs; an arc carries the set of bytes it takes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.arcs.append([])
        return len(self.free) - 1

    def take(self, allowed: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.arcs[a].append((allowed, b))
        return a, b

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class _Reader:
    """Recursive descent over one pattern; a repeated part is read again for each copy it needs."""

    def __init__(self, pattern: str, nfa: _Nfa) -> None:
        self.p, self.at, self.nfa, self.fold = pattern, 0, nfa, False

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def either(self) -> tuple[int, int]:
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        if len(options) == 1:
            return options[0]
        a, b = self.nfa.state(), self.nfa.state()
        for start, end in options:
            self.nfa.free[a].append(start)
            self.nfa.free[end].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.nfa.free[end].append(a)
            end = b
        return start, end

    def repeated(self) -> tuple[int, int]:
        begin, fold = self.at, self.fold
        self.atom()
        after = self.at
        low, high = 1, 1
        if self.peek() and self.peek() in "?*+":
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[self.p[self.at]]
            self.at += 1
        elif self.peek() == "{":
            stop = self.p.index("}", self.at)
            first, comma, last = self.p[self.at + 1 : stop].partition(",")
            low, high = int(first), int(last) if last else None if comma else int(first)
            self.at = stop + 1
        resume = self.at

        def copy() -> tuple[int, int]:
            self.at, self.fold = begin, fold
            out = self.atom()
            assert self.at == after
            return out

        nfa, start = self.nfa, self.nfa.state()
        end = start
        for _ in range(low):
            a, b = copy()
            nfa.free[end].append(a)
            end = b
        if high is None:
            a, b = copy()
            nfa.free[end].append(a)
            nfa.free[b].append(end)
        else:
            last = nfa.state()
            nfa.free[end].append(last)
            for _ in range(high - low):
                a, b = copy()
                nfa.free[end].append(a)
                nfa.free[b].append(last)
                end = b
            end = last
        self.at = resume
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.p[self.at]
        if c == "(":
            fold = self.fold
            self.at += 1
            if self.p.startswith("?i:", self.at):
                self.fold, self.at = True, self.at + 3
            elif self.p.startswith("?:", self.at):
                self.at += 2
            inner = self.either()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.at, self.fold = self.at + 1, fold
            return inner
        if c == "[":
            return self.nfa.take(self.cased(self.class_()))
        return self.nfa.take(self.cased({self.byte()}))

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(x).swapcase()) for x in found if chr(x).isascii() and chr(x).isalpha()}
        return frozenset(found)

    def byte(self) -> int:
        c = self.p[self.at]
        self.at += 1
        if c == "\\":
            c = self.p[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.p[self.at - 2 : self.at], 16)
            return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))
        if ord(c) > 127:
            raise ValueError(f"only ASCII in patterns: {self.p!r}")
        return ord(c)

    def class_(self) -> set[int]:
        self.at += 1
        negated = self.peek() == "^"
        self.at += negated
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.at += 1
                high = self.byte()
            found |= set(range(low, high + 1))
        self.at += 1
        return set(range(256)) - found if negated else found


@dataclass(frozen=True)
class Automaton:
    """States are numbered so that those which accept come last.

    ``step[state * width + kind[byte]]`` is the next state times ``width``; ``accepts[state]`` has bit r set where
    rule r ends; ``breaks[byte]`` tells that the byte leads from every state to the first one, so that no match holds it.
    """

    step: np.ndarray
    kind: np.ndarray
    width: int
    accepts: np.ndarray
    first_accept: int
    start: int
    dead: int
    breaks: np.ndarray

    @cached_property
    def plain(self) -> tuple[list[int], bytes]:
        """``step`` and ``kind`` for walks of a few bytes."""
        return self.step.tolist(), self.kind.tobytes()

    @property
    def states(self) -> int:
        return len(self.accepts)

    def longest(self, data: bytes, at: int, stop: int) -> int:
        """End of the longest match from ``at`` on, or -1 (for an automaton built with ``anchored``)."""
        state, end = self.start * self.width, -1
        step, kind = self.plain
        dead, accepting = self.dead * self.width, self.first_accept * self.width
        for i in range(at, stop):
            state = step[state + kind[data[i]]]
            if state == dead:
                break
            if state >= accepting:
                end = i + 1
        return end


def compile_rules(patterns: list[str], anchored: bool = False) -> Automaton:
    """One automaton for all patterns. Unless ``anchored``, a match may begin at any byte."""
    nfa = _Nfa()
    begin = nfa.state()
    ends: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        reader = _Reader(pattern, nfa)
        start, end = reader.either()
        if reader.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {reader.at}")
        nfa.free[begin].append(start)
        ends[end] = ends.get(end, 0) | 1 << rule
    if not anchored:
        nfa.arcs[begin].append((frozenset(range(256)), begin))

    # Bytes that no arc tells apart share a column.
    sets = sorted({allowed for arcs in nfa.arcs for allowed, _ in arcs}, key=sorted)
    signs = [tuple(b in s for s in sets) for b in range(256)]
    columns = {sign: k for k, sign in enumerate(dict.fromkeys(signs))}
    kind = np.array([columns[s] for s in signs], np.uint8)
    sample = [signs.index(sign) for sign in columns]

    # Subset construction.
    first = nfa.closure([begin])
    number, order, rows = {first: 0}, [first], []
    for subset in order:
        row = []
        for byte in sample:
            reached = nfa.closure({t for s in subset for allowed, t in nfa.arcs[s] if byte in allowed})
            if reached not in number:
                number[reached] = len(order)
                order.append(reached)
            row.append(number[reached])
        rows.append(row)
    table = np.array(rows, np.int64)
    accepts = np.array([sum({ends[s] for s in subset if s in ends}) for subset in order], np.int64)

    # Minimisation: split blocks of states until successors agree block by block.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    leaders = np.unique(block, return_index=True)[1]
    accepts, table = accepts[leaders], block[table[leaders]]
    new = np.empty(len(leaders), np.int64)
    new[np.argsort(accepts > 0, kind="stable")] = np.arange(len(leaders))
    old = np.argsort(new)
    accepts, table, start = accepts[old], new[table[old]], int(new[block[0]])
    home = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    rest = start if not anchored else int(home[0]) if len(home) else -1
    breaks = (table == rest).all(axis=0)[kind]
    width = len(columns)
    return Automaton(
        (table * width).astype(np.int32).ravel(),
        kind,
        width,
        accepts,
        int((accepts == 0).sum()),
        start,
        int(home[0]) if len(home) else -1,
        breaks,
    )


def accepting_places(automaton: Automaton, data: np.ndarray, lane: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Every byte index at which some rule ends, and the bits of the rules, in order; one pass over the bytes.

    The text is cut into lanes at bytes from which the automaton always starts anew, and all lanes step together.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = automaton.kind[data]
    cuts = np.flatnonzero(automaton.breaks[data]) + 1
    if len(cuts):
        picked = np.searchsorted(cuts, np.arange(lane, n, lane))
        cuts = np.unique(cuts[picked[picked < len(cuts)]])
        cuts = cuts[cuts < n]
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    state = np.full(len(starts), automaton.start * automaton.width, np.int32)
    limit, places, marks = automaton.first_accept * automaton.width, [], []
    for i, k in enumerate(active):
        at = starts[:k] + i
        now = automaton.step[state[:k] + kinds[at]]
        state[:k] = now
        hit = np.flatnonzero(now >= limit)
        if len(hit):
            places.append(at[hit])
            marks.append(automaton.accepts[now[hit] // automaton.width])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, what = np.concatenate(places), np.concatenate(marks)
    order = np.argsort(where)
    return where[order], what[order]
