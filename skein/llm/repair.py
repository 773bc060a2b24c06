"""Re-Pair grammars over many token sequences at once, in numpy.

Textbook Re-Pair replaces the most frequent pair, one at a time.  Here each
round replaces, in every sequence together, all pairs that are more frequent
than both pairs they overlap with; rounds follow until no pair occurs twice.
A rule is known by its expansion, not by how it was derived.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = ((left << np.uint64(1)) ^ (right * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Grammar:
    """State of the inference: the sequences and, for each symbol, its expansion's length."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, n_symbols: int, n_owners: int, marks: np.ndarray | None = None):
        self.symbols, self.owner = symbols.astype(np.int64), owner.astype(np.int64)
        self.length = np.ones(n_symbols, np.int64)
        #: A hash of each symbol's expansion; with ``marks`` of what the symbols stand for, a sequence has the same grammar beside any others.
        self.marks = np.arange(1, n_symbols + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) if marks is None else marks
        self.n_owners = n_owners
        self.rules = np.zeros(n_owners, np.int64)  # rules that each owner uses
        self.final = np.zeros(n_owners, np.int64)  # length of each owner's start rule
        self.rounds: list[tuple[int, np.ndarray, np.ndarray]] = []  # first new symbol, what each stands for

    def _select(self, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose pair is replaced in this round, and the pair's number within its scope."""
        s = self.symbols
        inside = self.owner[:-1] == self.owner[1:]
        m = len(self.length)
        pair = s[:-1] * m + s[1:]
        n_scopes = int(scope.max()) + 1
        if m * m * n_scopes < 2**62:
            key = pair * n_scopes + scope[:-1]
        else:
            key = pd.factorize(pair)[0] * n_scopes + scope[:-1]
        at = np.flatnonzero(inside)
        code, _ = pd.factorize(key[at])
        count = np.bincount(code)
        weight = np.zeros(len(s) + 1, np.int64)
        # Ties go by a scattered number of the pair: in order, a phrase seen twice would take a round for each
        # of its pairs; by what the pair stands for, copies of a phrase are cut alike in every sequence.
        scattered = (_joined(self.marks[s[at]], self.marks[s[at + 1]]) >> np.uint64(32)).astype(np.int64)
        weight[at + 1] = np.where(count[code] > 1, (count[code] << 32) | scattered, 0)
        # Runs of one pair (a a a a): every second place.
        start = np.flatnonzero(np.append(True, weight[1:] != weight[:-1]))
        value = weight[start]
        before, after = np.append(0, value[:-1]), np.append(value[1:], 0)
        size = np.diff(np.append(start, len(weight)))
        good = (value > before) & (value > after)
        offset = np.arange(len(weight)) - np.repeat(start, size)
        chosen = np.flatnonzero(np.repeat(good, size) & (offset % 2 == 0)) - 1
        full = np.full(len(s), -1, np.int64)
        full[at] = code
        number = full[chosen]
        often = np.bincount(number, minlength=len(count)) > 1
        keep = often[number]
        return chosen[keep], number[keep]

    def infer(self, shared: bool = False, on_rule=None) -> Grammar:
        """Replace pairs until none occurs twice in its sequence, or (``shared``) in all sequences together.

        ``on_rule(rule numbers, owners)`` hears of each replacement.  Rules are
        counted only where they belong to one sequence.
        """
        while len(self.symbols) > 1:
            scope = np.zeros(len(self.symbols), np.int64) if shared else self.owner
            places, number = self._select(scope)
            if not len(places):
                break
            s = self.symbols
            a, b = s[places], s[places + 1]
            rule, pairs = pd.factorize(a * len(self.length) + b)
            first = len(self.length)
            left, right = np.divmod(pairs, first)
            self.rounds.append((first, left, right))
            self.length = np.append(self.length, self.length[left] + self.length[right])
            self.marks = np.append(self.marks, _joined(self.marks[left], self.marks[right]))
            if not shared:
                _, once = np.unique(number, return_index=True)
                self.rules += np.bincount(self.owner[places[once]], minlength=self.n_owners)
            s[places] = first + rule
            if on_rule is not None:
                on_rule(first + rule, self.owner[places])
            keep = np.ones(len(s), bool)
            keep[places + 1] = False
            self.symbols, self.owner = s[keep], self.owner[keep]
            if not shared:
                # Sequences where nothing happened are done.
                busy = np.zeros(self.n_owners, bool)
                busy[self.owner[np.searchsorted(np.flatnonzero(keep), places)]] = True
                rest = ~busy[self.owner]
                self._park(rest)
        self._park(np.ones(len(self.symbols), bool))
        self._unpark()
        return self

    _parked: list | None = None

    def _park(self, rest: np.ndarray) -> None:
        if rest.any():
            self._parked = self._parked or []
            self._parked.append((self.symbols[rest], self.owner[rest]))
            self.final += np.bincount(self.owner[rest], minlength=self.n_owners)
            self.symbols, self.owner = self.symbols[~rest], self.owner[~rest]

    def _unpark(self) -> None:
        if self._parked:
            self.symbols = np.concatenate([s for s, _ in self._parked])
            self.owner = np.concatenate([o for _, o in self._parked])
            order = np.argsort(self.owner, kind="stable")
            self.symbols, self.owner, self._parked = self.symbols[order], self.owner[order], None
            self.final = np.bincount(self.owner, minlength=self.n_owners)

    def covered(self, known: np.ndarray) -> np.ndarray:
        """Tokens of each symbol's expansion that stand under a known symbol."""
        out = np.where(known, self.length, 0)
        for first, left, right in self.rounds:
            here = slice(first, first + len(left))
            out[here] = np.maximum(out[here], out[left] + out[right])
        return out

    def size_ratio(self, n_tokens: np.ndarray) -> np.ndarray:
        """Size of each grammar (start rule and two symbols a rule) over the sequence's length."""
        return (self.final + 2 * self.rules) / np.maximum(n_tokens, 1)
