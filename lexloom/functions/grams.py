"""Indexes of a word list by n-grams and beginnings, which score all its words against one word, or many words, at once.

The scores are those of similar.ngram_score without weights and similar.left_common: a gram of the word that a listed word
has adds one to it, so only the lists of the grams of the word are read, not the listed words.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


class GramIndex:
    """words: as they are compared (small letters); starts: as their beginnings are, with the lowered first letters."""

    def __init__(self, words: list[str], order: int = 3):
        self.order, self.size = order, np.array([len(w) for w in words], np.int64)
        found: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            for g in {w[i : i + n] for n in range(1, order + 1) for i in range(len(w) - n + 1)}:
                found.setdefault(g, []).append(k)
        self.having = {g: np.array(ks, np.intp) for g, ks in found.items()}

    def scores(self, word: str) -> np.ndarray:
        """ngram_score(order, word, w, LONGER_WORSE) for every listed word w; 0 for an empty one."""
        n, total, open_ = len(word), np.zeros(len(self.size), np.int64), None
        for k in range(1, self.order + 1):
            lists = [rows for i in range(n - k + 1) if (rows := self.having.get(word[i : i + k])) is not None]
            if not lists:
                break
            hits = np.bincount(np.concatenate(lists), minlength=len(self.size))
            total += hits if open_ is None else hits * open_
            open_ = (hits >= 2) if open_ is None else open_ & (hits >= 2)
        return np.where(self.size > 0, total - np.maximum(0, self.size - n - 2), 0)


class Beginnings:
    """left_common of one word with every listed word."""

    def __init__(self, words: list[str], lower, from_end: bool):
        self.from_end, self.n = from_end, len(words)
        if from_end:
            keys = [(w[-1:], k) for k, w in enumerate(words)]
        else:
            keys = [(x + w[1:], k) for k, w in enumerate(words) for x in {w[:1], lower(w[:1])}]
        keys.sort()
        self.keys, self.rows = [x for x, _ in keys], np.array([k for _, k in keys], np.int64)

    def common(self, word: str) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for k in range(1, 2 if self.from_end else len(word) + 1):
            start = word[-1:] if self.from_end else word[:k]
            a = bisect_left(self.keys, start)
            b = bisect_left(self.keys, start + "\U0010ffff", a) if start else a
            if a == b:
                break
            out[self.rows[a:b]] += 1
        return out


class GramTable:
    """The parts of GramIndex and Beginnings as tables, for short lists and many words at once."""

    def __init__(self, words: list[str], lower, order: int = 3):
        small = [lower(w) for w in words]
        self.size = np.array([len(w) for w in words], np.int16)
        self.grams = [self._table([{w[i : i + n] for i in range(len(w) - n + 1)} for w in small]) for n in range(1, order + 1)]
        self.starts = self._table([{x[:n] for x in (w, lower(w[:1]) + w[1:]) for n in range(1, len(x) + 1)} for w in words])

    @staticmethod
    def _table(parts: list[set[str]]) -> tuple[dict[str, int], np.ndarray]:
        """Numbers of parts, and whether each (or, in the last row, an unknown one) is in each word."""
        numbers = {x: k for k, x in enumerate(dict.fromkeys(x for own in parts for x in own))}
        table = np.zeros((len(numbers) + 1, len(parts)), np.int8)
        for k, own in enumerate(parts):
            table[[numbers[x] for x in own], k] = 1
        return numbers, table

    @staticmethod
    def _sums(table: tuple[dict[str, int], np.ndarray], parts: list[list[str]]) -> np.ndarray:
        """How many parts of each word (at most 127) each listed word has."""
        numbers, rows = table
        none, longest = len(numbers), max(map(len, parts))
        ids = np.array([[numbers.get(x, none) for x in own] + [none] * (longest - len(own)) for own in parts], np.intp)
        out = np.zeros((len(parts), rows.shape[1]), np.int8)
        for k in range(longest):
            out += rows[ids[:, k]]
        return out

    def most(self, words: list[str]) -> np.ndarray:
        """For every word (a row) and listed word at least ngram_score(len(word), word, w, ANY_MISMATCH) + left_common."""
        hits = [self._sums(t, [[w[i : i + n] for i in range(len(w) - n + 1)] for w in words]) for n, t in enumerate(self.grams, 1)]
        total, open_ = hits[0].astype(np.int16), None
        for before, own in zip(hits, hits[1:]):
            open_ = before >= 2 if open_ is None else open_ & (before >= 2)
            total += own * open_
        last = hits[-1].astype(np.int16) * open_
        total += last * np.maximum(last - 1, 0) // 2  # each further order has fewer hits than the one before
        gap = np.abs(np.array([len(w) for w in words], np.int16)[:, None] - self.size) - 2
        return total - np.maximum(gap, 0) + self._sums(self.starts, [[w[:n] for n in range(1, len(w) + 1)] for w in words])
