"""Generalised suffix automaton over hashable symbols (words), with occurrence counts and matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences; state 0 is the empty string.

    ``length[v]`` is the longest string of state v, ``link[v]`` its suffix link, ``count[v]`` how often the strings of v
    occur (after ``finish``), each added sequence counting ``times``.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, symbol: Hashable, q: int) -> int:
        """The state that stands for (longest of p) + symbol; splits q off if q also holds longer strings."""
        nxt, link, length = self.next, self.link, self.length
        if length[q] == length[p] + 1:
            return q
        copy = self._state(length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, sequence: Sequence[Hashable], times: int = 1) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for symbol in sequence:
            there = nxt[last].get(symbol)
            if there is not None:
                last = self._split(last, symbol, there)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in nxt[p]:
                    nxt[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, symbol, nxt[p][symbol])
                last = new
            self.count[last] += times

    def finish(self) -> None:
        """Carry counts along the suffix links; call once, after the last ``add``."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def holder(self, v: int, size: int) -> int:
        """The state that holds the suffix of length ``size`` of the strings of v (size at most length[v])."""
        link, length = self.link, self.length
        while length[link[v]] >= size:
            v = link[v]
        return v

    def statistics(self, sequence: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest suffix ending at each position that occurs in the added sequences."""
        nxt, link, length, v, size = self.next, self.link, self.length, 0, 0
        for symbol in sequence:
            while v and symbol not in nxt[v]:
                v = link[v]
                size = length[v]
            there = nxt[v].get(symbol)
            if there is None:
                v = size = 0
            else:
                v = there
                size += 1
            yield size, v

    def repeated(self, sequence: Sequence[Hashable], size: int) -> list[int]:
        """Starts of the windows of ``size`` symbols of an added sequence that occur more than once."""
        nxt, link, length, count, v, found = self.next, self.link, self.length, self.count, 0, []
        for i, symbol in enumerate(sequence):
            v = nxt[v][symbol]
            while length[link[v]] >= size:
                v = link[v]
            if i + 1 >= size and count[v] > 1:
                found.append(i + 1 - size)
        return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
