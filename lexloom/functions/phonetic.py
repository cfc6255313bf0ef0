"""Phonetic codes by rules in the manner of aspell's tables.

A rule is a pattern and what replaces it. In a pattern, letters stand for themselves; one (set) for any of its letters; each
- gives a matched letter back; < puts the replacement in front of what is left; ^ ties the rule to the word's start, ^^ also
starts the search for the next rule anew, $ ties it to the end; a digit is the priority (5 if none). Rules of a letter are
tried in the file's order, and where a rule matches, a longer rule for its last letter with at least its priority goes first.
Letters that no rule matches have no code.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class _Rule:
    letters: str
    choice: str  # the set after the letters
    back: int
    again: bool
    priority: int
    start: int  # 0, 1 for ^, 2 for ^^
    end: bool
    out: str

    @property
    def length(self) -> int:
        return len(self.letters) + bool(self.choice)


def _read(pattern: str, out: str) -> _Rule:
    k = 0
    while k < len(pattern) and pattern[k] not in "(-<^$0123456789":
        k += 1
    letters, rest, choice = pattern[:k], pattern[k:], ""
    if rest.startswith("("):
        choice, _, rest = rest[1:].partition(")")
    back = len(rest) - len(rest.lstrip("-"))
    rest = rest[back:]
    again = rest.startswith("<")
    rest = rest[again:]
    priority = int(rest[0]) if rest[:1].isdigit() else 5
    rest = rest[1:] if rest[:1].isdigit() else rest
    start = 2 if rest.startswith("^^") else 1 if rest.startswith("^") else 0
    return _Rule(letters, choice, back, again, priority, start, rest.endswith("$"), out)


class Phonetic:
    """Codes of words, which should be in capitals."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.by_first: dict[str, list[_Rule]] = {}
        for pattern, out in rows:
            if pattern:
                r = _read(pattern, out)
                for c in r.letters[:1] or r.choice:
                    self.by_first.setdefault(c, []).append(r)

    def _matches(self, r: _Rule, word: str, i: int, at_start: bool) -> bool:
        n = r.length
        if not word.startswith(r.letters, i) or r.choice and word[i + len(r.letters) : i + n] not in tuple(r.choice):
            return False
        if r.start and not (i == 0 or at_start and r.start):
            return False
        used = n - r.back if r.back < n else n
        return not r.end or i + n >= len(word) and used >= 0

    def code(self, word: str) -> str:
        out: list[str] = []
        i, fresh, turns = 0, True, 0
        while i < len(word) and turns < 1000:
            turns += 1
            found = None
            for r in self.by_first.get(word[i], ()):
                if self._matches(r, word, i, fresh and i == 0):
                    if not self._outdone(r, word, i):
                        found = r
                        break
            if found is None:  # letters without a rule have no sound
                i, fresh = i + 1, False
                continue
            n = found.length
            if found.again and not fresh_loop(found, word, i):
                # What comes back is coded anew, so a last letter of the code that it would repeat goes.
                if out and found.out and out[-1] in (word[i], found.out[0]):
                    out.pop()
                word = word[:i] + found.out + word[i + n - found.back if found.back < n else i + n :]
                if not found.out:
                    continue
                fresh = False
                continue
            for c in found.out:
                if not out or out[-1] != c:
                    out.append(c)
            if found.start == 2:
                word, i, fresh = word[i + max(1, n - found.back) :], 0, True
                continue
            i, fresh = i + max(1, n - found.back), False
        return "".join(out)

    def _outdone(self, r: _Rule, word: str, i: int) -> bool:
        """Whether a rule that starts at the last matched letter is longer than it and at least as strong."""
        n = r.length
        if n < 2 or r.back or i + n - 1 >= len(word):
            return False
        at = i + n - 1
        for other in self.by_first.get(word[at], ()):
            if other.length > 1 and other.priority >= r.priority and not other.start and self._matches(other, word, at, False):
                return True
        return False


def fresh_loop(r: _Rule, word: str, i: int) -> bool:
    """Whether feeding a replacement back would change nothing."""
    return word.startswith(r.out, i) and len(r.out) == r.length - r.back
