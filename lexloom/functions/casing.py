"""Letter case, one character for one: the mapping that dictionaries use, in Python and as columns.

Only mappings from one character of the basic plane to one other are used, so a word keeps its length. Azeri, Turkish and
Crimean Tatar pair i with İ and ı with I.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, INIT, ALL, MIXED, MIXED_INIT = range(5)
TURKIC = ("az", "tr", "crh")


@lru_cache(maxsize=4)
def tables(turkic: bool = False) -> tuple[dict[str, str], dict[str, str]]:
    """(to upper, to lower) for every character that has a different one-character form."""
    up, low = {}, {}
    for k in range(0x10000):
        c = chr(k)
        if 0xD800 <= k < 0xE000:
            continue
        u, v = c.upper(), c.lower()
        if len(u) == 1 and u != c and ord(u) < 0x10000:
            up[c] = u
        if len(v) == 1 and v != c and ord(v) < 0x10000:
            low[c] = v
    low["İ"] = "i"
    if turkic:
        up["i"], low["I"] = "İ", "ı"
    return up, low


class Case:
    """Case functions of one language."""

    def __init__(self, lang: str = ""):
        self.turkic = lang.split("_")[0].lower() in TURKIC
        up, low = tables(self.turkic)
        self._up, self._low = str.maketrans(up), str.maketrans(low)
        self._u, self._l = up, low

    def upper(self, s: str) -> str:
        return s.translate(self._up)

    def lower(self, s: str) -> str:
        return s.translate(self._low)

    def init(self, s: str) -> str:
        return s[:1].translate(self._up) + s[1:]

    def init_small(self, s: str) -> str:
        return s[:1].translate(self._low) + s[1:]

    def kind(self, s: str) -> int:
        """NONE, INIT, ALL, MIXED or MIXED_INIT; characters without case go with either."""
        if not s or s.islower():
            return NONE
        caps = sum(1 for c in s if c in self._l)
        if not caps:
            return NONE
        first = s[0] in self._l
        neutral = sum(1 for c in s if c not in self._l and c not in self._u)
        if caps == 1 and first:
            return INIT
        if caps == len(s) or caps + neutral == len(s):
            return ALL
        return MIXED_INIT if first and caps > 1 else MIXED


def _pairs(table: dict[str, str]) -> tuple[str, str]:
    keys = sorted(table)
    return "".join(keys), "".join(table[k] for k in keys)


def lower_col(c: Column, turkic: bool = False) -> Column:
    a, b = _pairs(tables(turkic)[1])
    return F.translate(c, a, b)


def upper_col(c: Column, turkic: bool = False) -> Column:
    a, b = _pairs(tables(turkic)[0])
    return F.translate(c, a, b)


def init_col(c: Column, turkic: bool = False) -> Column:
    return F.concat(upper_col(F.substring(c, 1, 1), turkic), F.substring(c, 2, 2**31 - 1))


def kind_col(c: Column, turkic: bool = False) -> Column:
    """The case class of a column of words: none, init, all, mixed or mixed_init."""
    up, low = tables(turkic)
    n = F.length(c)
    caps = n - F.length(F.translate(c, "".join(sorted(low)), ""))
    cased = n - F.length(F.translate(c, "".join(sorted({*low, *up})), ""))
    first = F.length(F.translate(F.substring(c, 1, 1), "".join(sorted(low)), "")) == 0
    plain = c.rlike(r"^[\p{Ll}\p{Lo}\p{M}\p{Nd}'’.,-]*$")  # no letter of these is a capital; most words end here
    return (
        F.when(plain | (caps == 0), "none")
        .when((caps == 1) & first, "init")
        .when((caps == n) | (caps + n - cased == n), "all")
        .when(first, "mixed_init")
        .otherwise("mixed")
    )
