"""Byte automata of several regular expressions: Thompson construction, subset construction, minimisation."""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import or_

import numpy as np

FULL = (1 << 256) - 1


class Pattern:
    """A byte regular expression of literals, escapes, classes, groups, |, ?, *, + and {m}, {m,}, {m,n}."""

    def __init__(self, source: str, ignore_case: bool = False):
        self.source, self.at, self.fold = source, 0, ignore_case
        self.tree = self._either()
        if self.at < len(source):
            raise ValueError(f"unexpected {source[self.at]!r} at {self.at} of {source}")

    def _peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.source[self.at - 1]

    def _either(self) -> tuple:
        options = [self._row()]
        while self._peek() == "|":
            self._take()
            options.append(self._row())
        return ("or", options) if len(options) > 1 else options[0]

    def _row(self) -> tuple:
        items = []
        while self._peek() and self._peek() not in "|)":
            item = self._atom()
            while self._peek() and self._peek() in "?*+{":
                item = self._repeated(item)
            items.append(item)
        return ("row", items)

    def _repeated(self, item: tuple) -> tuple:
        sign = self._take()
        if sign != "{":
            return ("times", item, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[sign])
        end = self.source.index("}", self.at)
        low, comma, high = self.source[self.at : end].partition(",")
        self.at = end + 1
        return ("times", item, int(low), int(high) if high else None if comma else int(low))

    def _mask(self, chars: set[int]) -> tuple:
        if self.fold:
            chars = {ord(f(chr(c))) for c in chars for f in (str.lower, str.upper)} if all(c < 128 for c in chars) else chars
        return ("bytes", sum(1 << c for c in chars))

    def _escape(self) -> int:
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.source[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def _atom(self) -> tuple:
        c = self._take()
        if c == "(":
            tree = self._either()
            if self._take() != ")":
                raise ValueError(f"a group does not end: {self.source}")
            return tree
        if c == "[":
            chars: set[int] = set()
            while self._peek() != "]":
                low = self._escape() if (x := self._take()) == "\\" else ord(x)
                if self._peek() == "-" and self.source[self.at + 1 : self.at + 2] != "]":
                    self._take()
                    high = self._escape() if (x := self._take()) == "\\" else ord(x)
                    chars |= set(range(low, high + 1))
                else:
                    chars.add(low)
            self._take()
            return self._mask(chars)
        return self._mask({self._escape() if c == "\\" else ord(c)})


@dataclass
class Nfa:
    empty: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[int, int]]] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, reverse: bool) -> tuple[int, int]:
        """First and last state of the tree's machine; reverse: of the language read from its end."""
        kind = tree[0]
        first = self.state()
        if kind == "bytes":
            last = self.state()
            self.moves[first].append((tree[1], last))
        elif kind == "row":
            last = first
            for item in reversed(tree[1]) if reverse else tree[1]:
                a, b = self.add(item, reverse)
                self.empty[last].append(a)
                last = b
        elif kind == "or":
            last = self.state()
            for item in tree[1]:
                a, b = self.add(item, reverse)
                self.empty[first].append(a)
                self.empty[b].append(last)
        else:
            _, item, low, high = tree
            last = first
            for _ in range(low):
                a, b = self.add(item, reverse)
                self.empty[last].append(a)
                last = b
            if high is None:
                a, b = self.add(item, reverse)
                self.empty[last].append(a)
                self.empty[b].append(a)
                end = self.state()
                self.empty[last].append(end)
                self.empty[b].append(end)
                last = end
            else:
                end = self.state()
                self.empty[last].append(end)
                for _ in range(high - low):
                    a, b = self.add(item, reverse)
                    self.empty[last].append(a)
                    self.empty[b].append(end)
                    last = b
                last = end
        return first, last


@dataclass
class Dfa:
    """moves[state, byte class], the start is state 0; accepts[state] has bit k where pattern k ends."""

    moves: np.ndarray
    accepts: np.ndarray
    byte_class: np.ndarray

    @property
    def dead(self) -> int:
        """A state that nothing leaves and that accepts nothing, or -1."""
        loops = (self.moves == np.arange(len(self.moves))[:, None]).all(axis=1) & (self.accepts == 0)
        return int(np.argmax(loops)) if loops.any() else -1

    def resets(self) -> np.ndarray:
        """Bytes after which the machine is in its start state, whatever came before."""
        back = (self.moves == 0).all(axis=0)
        return back[self.byte_class]

    def by_byte(self) -> list[list[int]]:
        return self.moves[:, self.byte_class].tolist()


def compile_patterns(patterns: list[Pattern], anywhere: bool, reverse: bool = False) -> Dfa:
    """One minimal automaton of all patterns; anywhere: it reports matches that end at a byte, wherever they begin."""
    nfa, ends = Nfa(), {}
    start = nfa.state()
    if anywhere:
        nfa.moves[start].append((FULL, start))
    for k, p in enumerate(patterns):
        a, b = nfa.add(p.tree, reverse)
        nfa.empty[start].append(a)
        ends[b] = ends.get(b, 0) | 1 << k
    masks = {m for row in nfa.moves for m, _ in row}
    kinds: dict[tuple, int] = {}
    byte_class = np.array([kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256)], np.int32)
    sample = [int(np.argmax(byte_class == c)) for c in range(len(kinds))]

    # sets of states are integers: bit s stands for state s
    closures: list[int] = []
    for s in range(len(nfa.empty)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closures.append(sum(1 << x for x in seen if nfa.moves[x] or x in ends))
    steps = []
    for row in nfa.moves:
        to = [0] * len(kinds)
        for m, t in row:
            for c, b in enumerate(sample):
                if m >> b & 1:
                    to[c] |= closures[t]
        steps.append(to)

    names, order_found, rows, bits = {closures[start]: 0}, [closures[start]], [], []
    for here in order_found:
        to, got, rest = [0] * len(kinds), 0, here
        while rest:
            low = rest & -rest
            s = low.bit_length() - 1
            to = list(map(or_, to, steps[s]))
            got |= ends.get(s, 0)
            rest ^= low
        for x in to:
            if x not in names:
                names[x] = len(names)
                order_found.append(x)
        rows.append([names[x] for x in to])
        bits.append(got)
    moves = np.array(rows, np.int32)
    accepts = np.array(bits, np.int64)

    # Moore's refinement: states are merged while they accept alike and lead to merged states alike
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1]
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    order[part[0]] = 0
    order[[p for p in range(len(order)) if p != part[0]]] = np.arange(1, len(order))
    chosen = np.empty(len(order), np.int64)
    chosen[order[part]] = np.arange(len(part))
    return Dfa(order[part][moves[chosen]].astype(np.int32), accepts[chosen], byte_class)


def longest(table: list[list[int]], accepts: list[int], dead: int, data: bytes, start: int, pattern: int = 0) -> int:
    """End of the longest match of the pattern that begins at start, or -1."""
    state, best = 0, -1
    for i in range(start, len(data)):
        state = table[state][data[i]]
        if state == dead:
            break
        if accepts[state] >> pattern & 1:
            best = i + 1
    return best


class Scanner:
    """Finds where matches begin by one pass over the bytes of all texts from the end, many lanes side by side.

    The automaton must be that of the patterns read from their end, with anywhere.
    """

    def __init__(self, dfa: Dfa, lanes: int = 2048):
        self.lanes, width = lanes, dfa.moves.shape[1]
        self.flat = (dfa.moves * width).ravel()
        self.accept = np.repeat(dfa.accepts, width)
        self.hit = self.accept != 0
        self.byte_class = dfa.byte_class
        self.reset = dfa.resets()
        if not self.reset.any():
            raise ValueError("no byte resets the automaton, so texts can't be told apart")
        self.gap = bytes([int(np.argmax(self.reset))])

    def begins(self, texts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each text with matches the ascending places where some begin, and the bits of their patterns.

        The texts are joined by a byte that resets the automaton, and cut into lanes just behind such bytes, so every
        lane starts in the start state; a lane much longer than others (no such byte for long) is walked alone.
        """
        joined = np.frombuffer(self.gap.join(texts) + self.gap, np.uint8)
        data = joined[::-1]
        cuts = np.flatnonzero(self.reset[data]) + 1
        step = max(256, len(data) // self.lanes)
        wanted = np.searchsorted(cuts, np.arange(step, len(data), step))
        bounds = np.unique(np.concatenate([[0], cuts[np.minimum(wanted, len(cuts) - 1)], [len(data)]]))
        starts, sizes = bounds[:-1], np.diff(bounds)
        classes = self.byte_class[data]
        long = sizes > 4 * step
        spots: list[tuple[np.ndarray, np.ndarray]] = []
        for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
            state, at, masks = 0, [], []
            for i, c in enumerate(classes[a : a + n].tolist(), a):
                state = self.flat[state + c]
                if self.hit[state]:
                    at.append(i)
                    masks.append(self.accept[state])
            spots.append((np.array(at, np.int64), np.array(masks, np.int64)))
        starts, sizes = starts[~long], sizes[~long]
        if len(starts):
            order = np.argsort(-sizes, kind="stable")
            starts, sizes = starts[order], sizes[order]
            state = np.zeros(len(starts), np.int32)
            live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes with more than j bytes
            for j in range(sizes[0]):
                n = live[j]
                state = self.flat[state[:n] + classes[starts[:n] + j]]
                at = self.hit[state]
                if at.any():
                    rows = np.flatnonzero(at)
                    spots.append((starts[rows] + j, self.accept[state[rows]]))
        places = len(data) - 1 - np.concatenate([np.zeros(0, np.int64), *(p for p, _ in spots)])
        masks = np.concatenate([np.zeros(0, np.int64), *(m for _, m in spots)])
        if not len(places):
            return {}
        order = np.argsort(places, kind="stable")
        places, masks = places[order], masks[order]
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, places, side="right")
        found, first = np.unique(owner, return_index=True)
        return {t: (places[a:b] - (ends[t] - len(texts[t]) - 1), masks[a:b]) for t, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(places)], strict=True)}
