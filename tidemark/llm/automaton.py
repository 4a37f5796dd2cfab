"""Generalised suffix automaton over token sequences."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """All token substrings of a bounded set of sequences, with where each ends.

    States are the classes of substrings with the same end positions. ``ends(state)`` gives the (sequence,
    end) pairs of a state's substrings; they are gathered along suffix links on first use and kept.
    """

    def __init__(self, sequences: list[list]):
        self.length = [0]
        self.link = [-1]
        self.next: list[dict] = [{}]
        own: list[list[tuple[int, int]]] = [[]]
        for s, seq in enumerate(sequences):
            last = 0
            for i, token in enumerate(seq):
                last = self._extend(last, token, own)
                own[last].append((s, i + 1))
        children: list[list[int]] = [[] for _ in self.length]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                children[parent].append(state)
        self._own, self._children = own, children
        self._ends: dict[int, np.ndarray] = {}

    def _clone(self, q: int, length: int, own: list) -> int:
        c = len(self.length)
        self.length.append(length)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        own.append([])
        self.link[q] = c
        return c

    def _extend(self, last: int, token, own: list) -> int:
        q = self.next[last].get(token)
        if q is not None:
            # The path exists already from an earlier sequence.
            if self.length[q] == self.length[last] + 1:
                return q
            c = self._clone(q, self.length[last] + 1, own)
            p = last
            while p >= 0 and self.next[p].get(token) == q:
                self.next[p][token] = c
                p = self.link[p]
            return c
        cur = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.next.append({})
        own.append([])
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            if self.length[q] != self.length[p] + 1:
                c = self._clone(q, self.length[p] + 1, own)
                while p >= 0 and self.next[p].get(token) == q:
                    self.next[p][token] = c
                    p = self.link[p]
                q = c
            self.link[cur] = q
        return cur

    def ends(self, state: int) -> np.ndarray:
        """Rows (sequence, end) where the substrings of ``state`` end, ends counted in tokens from the start."""
        got = self._ends.get(state)
        if got is None:
            out, stack = [], [state]
            while stack:
                s = stack.pop()
                out.extend(self._own[s])
                stack.extend(self._children[s])
            got = self._ends[state] = np.array(sorted(set(out)), np.int64).reshape(-1, 2)
        return got

    def matches(self, tokens: list, least: int) -> list[tuple[int, int, int]]:
        """Maximal matches of ``tokens`` as (end, length, state), each at least ``least`` long.

        A match is reported where it can't be extended to the right; its state is that of its own length.
        """
        out = []
        state = size = 0
        nxt, link, length = self.next, self.link, self.length
        for i, token in enumerate(tokens):
            to = nxt[state].get(token)
            if to is None:
                if size >= least:
                    out.append((i, size, state))
                while state and token not in nxt[state]:
                    state = link[state]
                    size = length[state]
                to = nxt[state].get(token)
                if to is None:
                    state = size = 0
                    continue
            state = to
            size += 1
        if size >= least:
            out.append((len(tokens), size, state))
        return out

    def grams(self, tokens: list, least: list[int]) -> set[int]:
        """States of the substrings of ``tokens`` that end after token i and are ``least[i]`` long, where they occur at all.

        Unlike ``matches`` this goes up to the short state, which every sequence that holds the substring shares,
        also where some other sequence matches further.
        """
        out = set()
        state = size = 0
        nxt, link, length = self.next, self.link, self.length
        for i, token in enumerate(tokens):
            to = nxt[state].get(token)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(token)
            if to is None:
                continue
            state = to
            size += 1
            if size >= least[i]:
                s = state
                while length[link[s]] >= least[i]:
                    s = link[s]
                out.add(s)
        return out
