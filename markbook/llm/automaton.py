"""Generalised suffix automata over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """The suffix automaton of several sequences; ``ends`` holds where each one ends.

    State 0 is the root.  ``follow[s]`` maps a symbol to the next state, ``link[s]``
    is the state of the longest suffix in another class, ``length[s]`` the longest
    sequence of the class.
    """

    def __init__(self) -> None:
        self.follow: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.seen_in: dict[int, set[int]] = {}

    def _state(self, follow: dict, link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, before: int, old: int, symbol: Hashable) -> int:
        """A class for the part of ``old`` that ``before`` reaches."""
        new = self._state(dict(self.follow[old]), self.link[old], self.length[before] + 1)
        self.link[old] = new
        while before >= 0 and self.follow[before].get(symbol) == old:
            self.follow[before][symbol] = new
            before = self.link[before]
        return new

    def _extend(self, last: int, symbol: Hashable) -> int:
        known = self.follow[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
        new = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and symbol not in self.follow[at]:
            self.follow[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            old = self.follow[at][symbol]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, old, symbol)
        return new

    def add(self, symbols: Iterable[Hashable], number: int | None = None) -> int:
        """Add a sequence; each class on its way remembers its number.  Returns its last state."""
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)
            if number is not None:
                self.seen_in.setdefault(last, set()).add(number)
        return last

    def step(self, state: int, matched: int, symbol: Hashable) -> tuple[int, int]:
        """State and length of the longest suffix of what was read that occurs in a sequence."""
        follow, link = self.follow, self.link
        while state and symbol not in follow[state]:
            state = link[state]
            matched = self.length[state]
        to = follow[state].get(symbol)
        return (0, 0) if to is None else (to, matched + 1)

    def numbers_below(self, least: int) -> dict[int, frozenset[int]]:
        """Per state of length ``least`` or more: the numbers of all sequences it occurs in."""
        sets: dict[int, set[int]] = {s: set(n) for s, n in self.seen_in.items()}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if s in sets and self.length[up] >= least:
                sets.setdefault(up, set()).update(sets[s])
        return {s: frozenset(n) for s, n in sets.items() if self.length[s] >= least}
