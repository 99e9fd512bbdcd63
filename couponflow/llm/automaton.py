"""One deterministic automaton for several byte patterns, and a vectorised pass with it.

Patterns are regular expressions of literals, ``\\xHH`` and ``\\.`` escapes, classes, groups, ``|`` and
``? * + {n} {n,}``, over ASCII. Each is compiled to a nondeterministic automaton that may start anywhere, by
subset construction on classes of equal bytes, and by minimisation, which refines a partition of the
states. These are then combined, one by one, over the pairs of states that can be reached, and minimised
again (subsets of all patterns at once would be far more). The result is one transition array; each
state also has the bit mask of the patterns that end there.

A pass over a buffer advances many lanes at once. A lane assumes that the one before it ends in the start
state; lanes for which this was wrong run again from the true state until all agree, so the result is
that of one pass from the first byte to the last, whatever the bytes are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LANE = 2048


@dataclass
class _Nfa:
    """Positions with byte sets; ``moves[s]`` is (bytes, next state), ``empty[s]`` free moves."""

    moves: list[list[tuple[int, int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


class _Pattern:
    """Recursive descent over one pattern; builds fragments from a start state to a returned end."""

    def __init__(self, text: str, nfa: _Nfa):
        self.text, self.at, self.nfa = text, 0, nfa

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def character(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c != "x":
            return ord(c)
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def byte_set(self) -> int:
        """Bit mask of the bytes of one atom that is not a group."""
        if self.peek() != "[":
            return 1 << self.character()
        self.take()
        found = 0
        while self.peek() != "]":
            low = high = self.character()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.character()
            found |= (1 << (high + 1)) - (1 << low)
        self.take()
        return found

    def choice(self, start: int) -> int:
        ends = [self.sequence(start)]
        while self.peek() == "|":
            self.take()
            ends.append(self.sequence(start))
        if len(ends) == 1:
            return ends[0]
        end = self.nfa.state()
        for e in ends:
            self.nfa.empty[e].append(end)
        return end

    def sequence(self, start: int) -> int:
        # A state of its own, so that loops of one branch are not seen by the others.
        at = self.nfa.state()
        self.nfa.empty[start].append(at)
        while self.peek() not in ("", "|", ")"):
            at = self.repeated(at)
        return at

    def atom(self, start: int) -> int:
        if self.peek() == "(":
            self.take()
            end = self.choice(start)
            self.take()
            return end
        chosen = self.byte_set()
        end = self.nfa.state()
        self.nfa.moves[start].append((chosen, end))
        return end

    def repeated(self, start: int) -> int:
        begin = self.at
        end = self.atom(start)
        after = self.at

        def again(frm: int) -> int:
            self.at = begin
            made = self.atom(frm)
            self.at = after
            return made

        mark = self.peek()
        if mark == "?":
            self.nfa.empty[start].append(end)
        elif mark in ("*", "+"):
            loop = end if mark == "+" else start
            if mark == "*":
                self.nfa.empty[end].append(start)
                end = start
            else:
                self.nfa.empty[again(loop)].append(loop)
        elif mark == "{":
            close = self.text.index("}", after)
            least, comma, _ = self.text[after + 1 : close].partition(",")
            for _ in range(int(least) - 1):
                end = again(end)
            if comma:
                self.nfa.empty[again(end)].append(end)
            self.at = close + 1
            return end
        else:
            return end
        self.at = after + 1
        return end


def _closure(nfa: _Nfa) -> list[int]:
    """Bit mask of the states reachable by free moves, per state."""
    masks = []
    for s in range(len(nfa.moves)):
        seen, todo = 1 << s, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        masks.append(seen)
    return masks


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + byte_class[byte]]`` is the next state; 0 is the start."""

    byte_class: np.ndarray
    classes: int
    table: np.ndarray
    accepts: np.ndarray  # bit mask of patterns, per state
    resets: np.ndarray  # per byte: whether it leads from every state to the start

    @staticmethod
    def compile(patterns: list[str]) -> Automaton:
        combined = Automaton._of(patterns[0])
        for number, pattern in enumerate(patterns[1:], 1):
            combined = combined._with(Automaton._of(pattern), number)
        return combined

    def _with(self, other: Automaton, number: int) -> Automaton:
        """Both at once; ``other``'s pattern gets bit ``number``."""
        pairs = self.byte_class.astype(np.int64) * other.classes + other.byte_class
        kinds, byte_class = np.unique(pairs, return_inverse=True)
        own = self.table.reshape(-1, self.classes)[:, kinds // other.classes].astype(np.int64)
        others = other.table.reshape(-1, other.classes)[:, kinds % other.classes]
        known = np.zeros(1, dtype=np.int64)
        rows = np.empty((0, len(kinds)), dtype=np.int64)
        while len(rows) < len(known):
            fresh = known[len(rows) :]
            after = own[fresh // other.states] * other.states + others[fresh % other.states]
            rows = np.concatenate([rows, after])
            known = np.concatenate([known, np.setdiff1d(after, known)])
        order = np.argsort(known)
        rows = order[np.searchsorted(known[order], rows)]
        accepts = self.accepts[known // other.states] | other.accepts[known % other.states] << number
        return Automaton._minimal(byte_class.astype(np.int32), rows, accepts)

    @staticmethod
    def _of(pattern: str) -> Automaton:
        nfa = _Nfa()
        root = nfa.state()
        ends = [_Pattern(pattern, nfa).choice(root)]
        closure = _closure(nfa)
        # Bytes that no byte set tells apart share a class.
        sets = sorted({chosen for moves in nfa.moves for chosen, _ in moves})
        signature = [tuple(s >> b & 1 for s in sets) for b in range(256)]
        numbers = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
        byte_class = np.array([numbers[sig] for sig in signature], dtype=np.int32)
        first_byte = {numbers[sig]: b for b, sig in reversed(list(enumerate(signature)))}
        n = len(numbers)
        steps = [
            [
                ([c for c in range(n) if chosen >> first_byte[c] & 1], closure[t])
                for chosen, t in moves
            ]
            for moves in nfa.moves
        ]
        accept = [sum(1 << i for i, e in enumerate(ends) if mask >> e & 1) for mask in closure]
        begin = closure[root]
        number = {begin: 0}
        todo, rows, accepts = [begin], [], []
        for subset in todo:  # grows while it is read
            after = [begin] * n  # a match may start at every byte
            ends_here, rest = 0, subset
            while rest:
                s = (rest & -rest).bit_length() - 1
                rest &= rest - 1
                for reached, mask in steps[s]:
                    for c in reached:
                        after[c] |= mask
            for c, mask in enumerate(after):
                if mask not in number:
                    number[mask] = len(todo)
                    todo.append(mask)
                after[c] = number[mask]
            rest = subset
            while rest:
                ends_here |= accept[(rest & -rest).bit_length() - 1]
                rest &= rest - 1
            rows.append(after)
            accepts.append(ends_here)
        return Automaton._minimal(byte_class, np.array(rows), np.array(accepts))

    @staticmethod
    def _minimal(byte_class: np.ndarray, rows: np.ndarray, accepts: np.ndarray) -> Automaton:
        """Merge states until states of one part agree on the part of every next state."""
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            view = np.concatenate([part[:, None], part[rows]], axis=1)
            _, first, finer = np.unique(view, axis=0, return_index=True, return_inverse=True)
            finer = finer.ravel()
            if len(first) == part.max() + 1:
                break
            part = finer
        order = np.argsort(first != first[finer[0]], kind="stable")  # the start state's part is 0
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        table = rank[finer[rows[first[order]]]]
        to_start = (table == 0).all(axis=0)
        return Automaton(
            byte_class,
            rows.shape[1],
            np.ascontiguousarray(table.astype(np.int32)).ravel(),
            accepts[first[order]].astype(np.int32),
            to_start[byte_class],
        )

    @property
    def states(self) -> int:
        return len(self.accepts)

    def _advance(self, symbols, begins, ends, state) -> tuple[np.ndarray, np.ndarray]:
        """Last state and pattern bits of each lane; lanes are run longest first."""
        order = np.argsort(begins - ends, kind="stable")
        at, length = begins[order].copy(), (ends - begins)[order]
        state = state[order].copy()
        found = np.zeros(len(order), dtype=np.int32)
        running = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(order) else []
        for live in running:
            now = state[:live]
            now *= self.classes
            now += symbols.take(at[:live])
            state[:live] = self.table.take(now)
            found[:live] |= self.accepts.take(state[:live])
            at[:live] += 1
        last, bits = np.empty_like(state), np.empty_like(found)
        last[order], bits[order] = state, found
        return last, bits

    def scan(self, data: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``begin, end, bits`` of lanes in which a pattern ends; ``data``: bytes."""
        if not len(data):
            return (np.empty(0, np.int64),) * 3
        symbols = self.byte_class.take(data)
        good = np.flatnonzero(self.resets.take(data) | (data == 32)) + 1
        wish = np.arange(lane, len(data), lane)
        near = good[np.minimum(np.searchsorted(good, wish), len(good) - 1)] if len(good) else wish
        cuts = np.unique(np.where((near >= wish) & (near < wish + lane), near, wish))
        begins = np.concatenate(([0], cuts[cuts < len(data)]))
        ends = np.concatenate((begins[1:], [len(data)]))
        start = np.zeros(len(begins), dtype=np.int32)
        last, bits = self._advance(symbols, begins, ends, start)
        while True:
            true_start = np.concatenate(([0], last[:-1])).astype(np.int32)
            wrong = np.flatnonzero(true_start != start)
            if not len(wrong):
                break
            start[wrong] = true_start[wrong]
            last[wrong], bits[wrong] = self._advance(symbols, begins[wrong], ends[wrong], start[wrong])
        hit = np.flatnonzero(bits)
        return begins[hit], ends[hit], bits[hit]
