"""Generalised suffix automaton over token ids."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np


class SuffixAutomaton:
    """All substrings of several token sequences in a linear number of states; it is packed before use."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _extend(self, last: int, token: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        if token in edges[last]:
            q = edges[last][token]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, token, q)
        new = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in edges[p]:
            edges[p][token] = new
            p = link[p]
        if p >= 0:
            q = edges[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, token, q)
        return new

    def _clone(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        while p >= 0 and self.edges[p].get(token) == q:
            self.edges[p][token] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, tokens: list[int]) -> int:
        """Adds a sequence and returns the state of the whole of it (valid until the next add)."""
        state = 0
        for token in tokens:
            state = self._extend(state, token)
        return state

    def _shortest_above(self, state: int, n: int) -> int:
        """The state of the suffix of length n of what leads to a state, which is at least that long."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def packed(self, sequences: list[list[int]], window: int) -> Packed:
        """The automaton as arrays, with the sequences whose windows occur on the states of these windows; call after all adds."""
        items: dict[int, set[int]] = {}
        for k, tokens in enumerate(sequences):
            n = min(window, len(tokens))
            state = 0
            for i, token in enumerate(tokens):
                state = self.edges[state][token]
                if i + 1 >= n:
                    items.setdefault(self._shortest_above(state, n) << 32 | n, set()).add(k)
        keys = np.fromiter((s << 32 | t for s, own in enumerate(self.edges) for t in own), np.int64)
        targets = np.fromiter((q for own in self.edges for q in own.values()), np.int32)
        order = np.argsort(keys)
        at = sorted(items)
        held = [sorted(items[s]) for s in at]
        return Packed(keys[order], targets[order], np.array(self.link, np.int32), np.array(self.length, np.int32), np.array(at, np.int64), np.cumsum([0, *map(len, held)]), np.array([k for x in held for k in x], np.int32), sorted({min(window, len(s)) for s in sequences if s}))


class Packed:
    """A suffix automaton in arrays: edges sorted by (state, token), suffix links, lengths, and the sequences of each (state, window length)."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, link: np.ndarray, length: np.ndarray, window_at: np.ndarray, items_from: np.ndarray, items: np.ndarray, windows: list[int]) -> None:
        self.arrays = keys, targets, link, length, window_at, items_from, items
        self.windows = windows
        self._view()

    def _view(self) -> None:
        # Views give plain integers, which bisect compares faster than numpy's.
        self.keys, self.targets, self.link, self.length, self.window_at, self.items_from, self.items = map(memoryview, self.arrays)

    def __getstate__(self):
        return self.arrays, self.windows

    def __setstate__(self, state) -> None:
        self.arrays, self.windows = state
        self._view()

    def step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        """The longest match after one more token: state and its length."""
        keys, n = self.keys, len(self.keys)
        while True:
            key = state << 32 | token
            i = bisect_left(keys, key)
            if i < n and keys[i] == key:
                return self.targets[i], matched + 1
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]

    def found(self, state: int, matched: int) -> Iterator[tuple[int, memoryview]]:
        """The windows that end here: length and the sequences that hold each."""
        for n in reversed(self.windows):
            if n > matched:
                continue
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            key = state << 32 | n
            i = bisect_left(self.window_at, key)
            if i < len(self.window_at) and self.window_at[i] == key:
                yield n, self.items[self.items_from[i] : self.items_from[i + 1]]
