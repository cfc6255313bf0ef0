"""A finite set of words, and whether any of them is one step from a given word: a test that never says no wrongly."""

from __future__ import annotations

from collections.abc import Iterable


class NearWords:
    """words: the set itself; short: all its words less one letter; letters: the letters of each in order."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self.short = frozenset(x for w in self.words for x in less_one(w))
        self.letters = frozenset("".join(sorted(w)) for w in self.words)
        self.spaced, self.dashed = (any(c in w for w in self.words) for c in " -")


def less_one(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]
