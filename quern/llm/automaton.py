"""Levenshtein automata intersected with a lexicon trie, determinised as tokens demand.

A state of the product holds pairs (trie node, errors so far). Its transitions
on a character are a match, a substitution, an insertion, a deletion and a swap
of neighbours; only pairs within a term's allowance survive. Whole terms accept
at a token's end, stems accept as soon as they are spelled out exactly. States
become rows of one integer table, so a batch of tokens runs through it in
lockstep: one table look-up per character that is still alive.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

DEAD, UNKNOWN = -1, -2


def allowance(term: str) -> int:
    """Edits allowed for a whole term: one from five letters, two from nine."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """``terms`` are (text, is_stem); ``scan`` numbers them in this order."""

    def __init__(self, terms: Iterable[tuple[str, bool]]):
        self.terms = list(terms)
        letters = sorted({c for t, _ in self.terms for c in t})
        self.classes = np.zeros(0x110000, np.int16)
        for k, c in enumerate(letters, 1):
            self.classes[ord(c)] = k
        self.letter = [None, *letters]
        # A node: children by class, allowance left below it, (term, is_stem) ending here.
        self.child: list[dict[int, int]] = [{}]
        self.most: list[int] = [0]
        self.ends: list[list[tuple[int, bool]]] = [[]]
        for number, (text, stem) in enumerate(self.terms):
            node, k = 0, 0 if stem else allowance(text)
            self.most[0] = max(self.most[0], k)
            for c in map(self.classes.__getitem__, map(ord, text)):
                if int(c) not in self.child[node]:
                    self.child[node][int(c)] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                    self.ends.append([])
                node = self.child[node][int(c)]
                self.most[node] = max(self.most[node], k)
            self.ends[node].append((number, stem))
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.table = np.full((64, len(self.letter)), UNKNOWN, np.int32)
        self.stem = np.full(64, -1, np.int32)  # a stem spelled out
        self.whole = np.full(64, -1, np.int32)  # a term at a token's end
        self.edits = np.zeros(64, np.int8)
        self.start = self._state(self._closed({(0, 0, -1)}))

    def _closed(self, pairs: set[tuple[int, int, int]]) -> frozenset:
        """With deletions of lexicon characters, without pairs that a better one covers."""
        todo = list(pairs)
        while todo:
            node, e, swap = todo.pop()
            if swap >= 0:
                continue
            for child in self.child[node].values():
                if e + 1 <= self.most[child] and (child, e + 1, -1) not in pairs:
                    pairs.add((child, e + 1, -1))
                    todo.append((child, e + 1, -1))
        best: dict[tuple[int, int], int] = {}
        for node, e, swap in pairs:
            best[node, swap] = min(e, best.get((node, swap), e))
        return frozenset((node, e, swap) for (node, swap), e in best.items())

    def _state(self, members: frozenset) -> int:
        if not members:
            return DEAD
        if members not in self.states:
            k = self.states[members] = len(self.members)
            self.members.append(members)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, UNKNOWN)])
                self.stem, self.whole = (np.concatenate([x, np.full_like(x, -1)]) for x in (self.stem, self.whole))
                self.edits = np.concatenate([self.edits, np.zeros_like(self.edits)])
            ends = [(e, number, stem) for node, e, swap in members if swap < 0 for number, stem in self.ends[node]]
            stems = [number for e, number, stem in ends if stem and e == 0]
            whole = [(e, number) for e, number, stem in ends if not stem and e <= allowance(self.terms[number][0])]
            if stems:
                self.stem[k] = min(stems)
            if whole:
                self.edits[k], self.whole[k] = min(whole)
        return self.states[members]

    def _step(self, state: int, c: int) -> int:
        out: set[tuple[int, int, int]] = set()
        for node, e, swap in self.members[state]:
            if swap >= 0:  # the second half of a swap: this character came first in the term
                if (child := self.child[node].get(c)) is not None and (last := self.child[child].get(swap)) is not None and e <= self.most[last]:
                    out.add((last, e, -1))
                continue
            if (child := self.child[node].get(c)) is not None:
                out.add((child, e, -1))
            if e < self.most[node]:
                out.add((node, e + 1, -1))  # an extra character
                out.update((child, e + 1, -1) for child in self.child[node].values() if e + 1 <= self.most[child])
                if c:
                    out.add((node, e + 1, c))
        return self._state(self._closed(out))

    def scan(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the number of the term that it matches (or -1), and the edits."""
        term, edits = np.full(len(start), -1, np.int32), np.zeros(len(start), np.int8)
        alive, state = np.arange(len(start)), np.full(len(start), self.start, np.int32)
        classes, k = self.classes[points], 0
        while len(alive):
            done = end[alive] - start[alive] == k
            at, s = alive[done], state[done]
            hit = self.whole[s] >= 0
            term[at[hit]], edits[at[hit]] = self.whole[s[hit]], self.edits[s[hit]]
            alive, state = alive[~done], state[~done]
            c = classes[start[alive] + k]
            to = self.table[state, c]
            if (miss := np.flatnonzero(to == UNKNOWN)).size:
                for pair in np.unique(state[miss].astype(np.int64) << 16 | c[miss]):
                    a, b = int(pair >> 16), int(pair & 0xFFFF)
                    target = self._step(a, b)  # may grow the table
                    self.table[a, b] = target
                to = self.table[state, c]
            live = to != DEAD
            alive, state = alive[live], to[live]
            stem = self.stem[state] >= 0
            term[alive[stem]] = self.stem[state[stem]]
            alive, state, k = alive[~stem], state[~stem], k + 1
        return term, edits
