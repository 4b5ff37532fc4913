"""Rules written as regular expressions, compiled together into one transition table.

Each rule becomes a deterministic automaton that finds its leftmost, longest, non-overlapping
matches: it remembers the earliest start that is still alive, commits to it once it matches,
and starts afresh at the byte that ends the match. The automata of all rules run as one: a
combined state is a tuple of their states, reachable tuples are numbered breadth first, and
states that behave alike are merged. A state's output says which rules' matches ended at the
byte just read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Charset = frozenset[int]


class _Nfa:
    """Thompson's construction; edges carry a set of bytes, None is a free edge."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0
        self.edges: list[list[tuple[Charset | None, int]]] = []
        self.start, self.accept = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"Rule {pattern!r}: cannot read from position {self.at}.")

    def _node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def _peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        branches = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            branches.append(self._sequence())
        if len(branches) == 1:
            return branches[0]
        first, last = self._node(), self._node()
        for start, end in branches:
            self.edges[first].append((None, start))
            self.edges[end].append((None, last))
        return first, last

    def _sequence(self) -> tuple[int, int]:
        first = last = self._node()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            start, end = self._atom()
            least, endless = self._repeat()
            after = self.at
            for copy in range(max(least, 1)):
                if copy:
                    self.at = begin
                    start, end = self._atom()
                self.edges[last].append((None, start))
                if least == 0:
                    self.edges[last].append((None, end))
                last = end
            self.at = after
            if endless:
                self.edges[last].append((None, start))
        return first, last

    def _repeat(self) -> tuple[int, bool]:
        sign = self._peek()
        if sign == "{":
            close = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at + 1 : close].partition(",")
            if high:
                raise ValueError(f"Rule {self.pattern!r}: an upper bound is not supported.")
            self.at = close + 1
            return int(low), bool(comma)
        if sign in ("?", "*", "+") and sign:
            self.at += 1
            if sign == "?":
                return 0, False
            return (0, True) if sign == "*" else (1, True)
        return 1, False

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.at += 3 if self.pattern.startswith("(?:", self.at) else 1
            inner = self._choice()
            if self._peek() != ")":
                raise ValueError(f"Rule {self.pattern!r}: a group is not closed.")
            self.at += 1
            return inner
        bytes_ = self._charset() if self._peek() == "[" else frozenset([self._byte()])
        first, last = self._node(), self._node()
        self.edges[first].append((bytes_, last))
        return first, last

    def _byte(self) -> int:
        sign = self._peek()
        self.at += 1
        if sign == "\\":
            if self._peek() == "x":
                self.at += 3
                return int(self.pattern[self.at - 2 : self.at], 16)
            self.at += 1
            return ord(self.pattern[self.at - 1])
        return ord(sign)

    def _charset(self) -> Charset:
        self.at += 1
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.pattern[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            found.update(range(low, high + 1))
        self.at += 1
        return frozenset(found)

    def closure(self, nodes: set[int]) -> frozenset[int]:
        pending, seen = list(nodes), set(nodes)
        while pending:
            for bytes_, target in self.edges[pending.pop()]:
                if bytes_ is None and target not in seen:
                    seen.add(target)
                    pending.append(target)
        return frozenset(seen)

    def move(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for n in nodes for b, t in self.edges[n] if b is not None and byte in b})

    def charsets(self) -> set[Charset]:
        return {b for out in self.edges for b, _ in out if b is not None}


class _Leftmost:
    """States of one rule: the live starts, earliest first, and whether the first has matched."""

    def __init__(self, nfa: _Nfa) -> None:
        self.nfa = nfa
        self.fresh = nfa.closure({nfa.start})
        if nfa.accept in self.fresh:
            raise ValueError(f"Rule {nfa.pattern!r} matches nothing at all.")
        self.begin = ((self.fresh,), False)

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        starts, matched = state
        live: list[frozenset[int]] = []
        seen: set[int] = set()
        for nodes in starts:
            rest = self.nfa.move(nodes, byte) - seen
            if rest:
                live.append(rest)
                seen |= rest
        if matched and not live:
            return self.step(self.begin, byte)[0], True
        accepting = [self.nfa.accept in nodes for nodes in live]
        if matched and not accepting[0] or any(accepting[1:]) and not accepting[0]:
            raise ValueError(f"Rule {self.nfa.pattern!r} would have to look back from where it fails.")
        if accepting and accepting[0]:
            return ((live[0],), True), False
        return ((*live, *([self.fresh] if self.fresh - seen else [])), False), False


@dataclass(frozen=True)
class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state times ``classes``.

    States from ``first_event`` on (also times ``classes``) report the ends of matches:
    bit r of ``ends`` at such a state stands for rule r. After a byte of ``resets`` every
    state goes on like the first one, so texts may be cut behind it.
    """

    table: np.ndarray
    class_of: np.ndarray
    classes: int
    first_event: int
    ends: np.ndarray
    resets: np.ndarray

    def scan(self, text: np.ndarray, stride: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Where matches ended (index of the byte behind them), ascending, and the rules' bits.

        Reads each byte once. The text is cut behind reset bytes into pieces of about
        ``stride`` bytes, which advance side by side.
        """
        cuts = np.flatnonzero(self.resets[text]) + 1
        if cuts.size:
            at = np.searchsorted(cuts, np.arange(stride, text.size, stride))
            cuts = np.unique(cuts[at[at < cuts.size]])
        starts = np.concatenate([[0], cuts[cuts < text.size]])
        lengths = np.diff(np.append(starts, text.size))
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        kinds = self.class_of[text]
        state = np.zeros(at.size, np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if at.size else 0), side="left")
        places, bits = [], []
        for live in active.tolist():
            at, state = at[:live], state[:live]
            state = self.table.take(state + kinds.take(at))
            hit = np.flatnonzero(state >= self.first_event)
            if hit.size:
                places.append(at[hit])
                bits.append(self.ends[state[hit] // self.classes])
            at = at + 1
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = np.concatenate(places), np.concatenate(bits)
        ascending = np.argsort(where)
        return where[ascending], what[ascending]


def compile_rules(patterns: list[str]) -> Automaton:
    """Subset construction over all rules at once, then minimisation."""
    rules = [_Leftmost(_Nfa(p)) for p in patterns]
    charsets = sorted({c for r in rules for c in r.nfa.charsets()}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    class_of = np.array([kinds.setdefault(tuple(b in c for c in charsets), len(kinds)) for b in range(256)], np.int32)
    samples = [int(np.flatnonzero(class_of == k)[0]) for k in range(len(kinds))]
    memo: dict[tuple, tuple[tuple, bool]] = {}

    def step(rule: int, state: tuple, kind: int) -> tuple[tuple, bool]:
        key = (rule, state, kind)
        if key not in memo:
            memo[key] = rules[rule].step(state, samples[kind])
        return memo[key]

    begin = (tuple(r.begin for r in rules), 0)
    numbers, rows, queue = {begin: 0}, [], [begin]
    for states, _ in queue:
        row = []
        for kind in range(len(kinds)):
            moved = [step(r, s, kind) for r, s in enumerate(states)]
            target = (tuple(m[0] for m in moved), sum(1 << r for r, m in enumerate(moved) if m[1]))
            if target not in numbers:
                numbers[target] = len(queue)
                queue.append(target)
            row.append(numbers[target])
        rows.append(row)
    return _minimised(np.array(rows), np.array([ends for _, ends in queue]), class_of)


def _minimised(table: np.ndarray, ends: np.ndarray, class_of: np.ndarray) -> Automaton:
    """Merge states with equal output whose successors are merged alike, until none differ."""
    group, count = np.unique(ends, return_inverse=True)[1], 0
    while group.max() + 1 != count:
        count = group.max() + 1
        group = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
    first = np.unique(group, return_index=True)[1]
    output = ends[first]
    # The first state comes first, states with output last.
    order = np.lexsort((first, output > 0))
    new = np.empty_like(order)
    new[order] = np.arange(order.size)
    merged = new[group[table[first[order]]]]
    classes = table.shape[1]
    resets = np.array([(merged[merged[:, k]] == merged[0]).all() for k in range(classes)])
    return Automaton(
        (merged * classes).astype(np.int32).ravel(),
        class_of,
        classes,
        int((output == 0).sum()) * classes,
        output[order].astype(np.int64),
        resets[class_of],
    )


class Backwards:
    """Finds where a match begins, given where it ends: the rule read from its end."""

    def __init__(self, pattern: str) -> None:
        self.nfa = _Nfa(pattern)
        self.into: list[list[tuple[Charset | None, int]]] = [[] for _ in self.nfa.edges]
        for source, out in enumerate(self.nfa.edges):
            for bytes_, target in out:
                self.into[target].append((bytes_, source))
        self.last = self._closure({self.nfa.accept})
        self.memo: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def _closure(self, nodes: set[int]) -> frozenset[int]:
        pending, seen = list(nodes), set(nodes)
        while pending:
            for bytes_, source in self.into[pending.pop()]:
                if bytes_ is None and source not in seen:
                    seen.add(source)
                    pending.append(source)
        return frozenset(seen)

    def start(self, text: bytes, end: int, least: int) -> int:
        """The smallest start, ``least`` or later, of a match that ends before ``end``; -1 if none."""
        nodes, found, at = self.last, -1, end
        while at > least and nodes:
            at -= 1
            key = (nodes, text[at])
            if key not in self.memo:
                self.memo[key] = self._closure(
                    {s for n in nodes for b, s in self.into[n] if b is not None and text[at] in b}
                )
            nodes = self.memo[key]
            if self.nfa.start in nodes:
                found = at
        return found
