"""A dictionary of invented words for benchmarks: as many entries as a desktop dictionary of English has."""

from __future__ import annotations

import random

from lexloom.plans.dictionary import Dictionary

ENTRIES = 49_568
SYLLABLES = "ka to ri men sa lo ve du pi ra ne so ti gu ba shi ol er an in es th ph con de pro gla stri ma bel tor fen wick ho ney dra lu".split()
TRY = "esianrtolcdugmphbyfvkwz"


def words(entries: int = ENTRIES, seed: int = 1) -> list[str]:
    r, out = random.Random(seed), {}
    while len(out) < entries:
        out["".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 2, 2, 3, 3, 3, 4, 4, 5))))] = None
    return list(out)


def files(entries: int = ENTRIES) -> tuple[str, str]:
    """Rules (three suffix groups and two prefixes, replacements) and the lexicon."""
    r = random.Random(2)
    aff = f"""SET UTF-8
TRY {TRY}
REP 4
REP f ph
REP ph f
REP ei ie
REP k ck
PFX A Y 1
PFX A 0 re .
PFX U Y 1
PFX U 0 un .
SFX S Y 4
SFX S y ies [^aeiou]y
SFX S 0 s [aeiou]y
SFX S 0 es [sxzh]
SFX S 0 s [^sxzhy]
SFX D Y 3
SFX D 0 d e
SFX D y ied [^aeiou]y
SFX D 0 ed [^ey]
SFX G Y 2
SFX G e ing e
SFX G 0 ing [^e]
"""
    flags = ("", "", "S", "S", "SD", "SDG", "ASDG", "US")
    return aff, "\n".join([str(entries), *(w + (f"/{f}" if (f := r.choice(flags)) else "") for w in words(entries))]) + "\n"


def dictionary(entries: int = ENTRIES) -> Dictionary:
    return Dictionary.parse(*files(entries))
