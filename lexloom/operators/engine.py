"""The single-word engine: a compiled dictionary that checks one word at a time.

It holds what the relational plans can't say in joins (compounds of any number of parts, break points inside words, the
order of first matches) and is the yardstick for those that can. It is built once from rules and lexicons, is not changed
afterwards, keeps no state between calls and reads no clock, so its answers depend on the word alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from lexloom.functions.casing import ALL, INIT, MIXED, MIXED_INIT, NONE, Case
from lexloom.sources.rules import DEFAULT_BREAKS, DEFAULT_FORBIDDEN, KEYBOARD, ONLY_UPCASE, Affix, Entry, Rules, condition_regex

#: Where in a compound a part stands; ALONE: not in a compound.
ALONE, BEGIN, END, OTHER = range(4)
MAX_BYTES, MAX_BYTES_8BIT, MAX_BREAKS, MAX_PARTS, MAX_SHARPS = 300, 100, 10, 100, 5
#: A compound search gives up after so many part lookups; a fixed count, so the answer is the same everywhere.
MAX_STEPS, MAX_STEPS_OF_CANDIDATE = 20_000, 1_000
_NUMBER = re.compile("[0-9٠-٩۰-۹]+(?:[,.-][0-9٠-٩۰-۹]+)*")


@dataclass(frozen=True)
class Result:
    """The verdict on a word. root is set for affixed and compound words."""

    correct: bool
    compound: bool = False
    forbidden: bool = False
    warn: bool = False
    root: str = ""


_LISTED = Result(True)


@dataclass(frozen=True)
class Hit:
    """How a word comes from an entry: prefix, outer suffix and inner suffix, each None if absent."""

    entry: Entry
    prefix: Affix | None = None
    suffix: Affix | None = None
    inner: Affix | None = None


class _State:
    """What one check learns on its way."""

    __slots__ = ("forbidden", "compound", "warn", "init_query", "orig_cap", "root", "hit", "steps")

    def __init__(self):
        self.forbidden = self.compound = self.warn = self.init_query = self.orig_cap = False
        self.root, self.hit, self.steps = "", None, 0


class _GiveUp(Exception):
    """A compound search that some part has ended for the whole word."""


class Converter:
    """ICONV or OCONV: at each place the longest pattern; _ at a pattern's ends ties it to the word's ends."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.table: dict[str, list[str | None]] = {}
        for pattern, out in rows:
            kind = (1 if pattern.startswith("_") else 0) + (2 if pattern.endswith("_") and len(pattern) > 1 else 0)
            p = (pattern[1:] if kind & 1 else pattern)
            p = (p[:-1] if kind & 2 else p).replace("_", " ")
            if p:
                self.table.setdefault(p, [None] * 4)[kind] = out
        self.longest = max(map(len, self.table), default=0)

    def __call__(self, word: str) -> str:
        if not self.table:
            return word
        out, i = [], 0
        while i < len(word):
            for n in range(min(self.longest, len(word) - i), 0, -1):
                outs = self.table.get(word[i : i + n])
                if outs is None:
                    continue
                new = pick(outs, i == 0, i + n == len(word))
                if new is not None and (new or n):
                    out.append(new)
                    i += n
                    break
            else:
                out.append(word[i])
                i += 1
        return "".join(out)


def pick(outs, start: bool, end: bool):
    """The output for a context (middle, start, end, whole), falling back to less tied ones; None if there is none."""
    kind = (1 if start else 0) + (2 if end else 0)
    while kind and not outs[kind]:
        kind = 0 if kind == 2 and not start else kind - 1
    return outs[kind] or None


class Engine:
    """A dictionary: rules and the entries of one or more lexicons."""

    def __init__(self, rules: Rules, entries: list[Entry], changes: tuple = ()):
        self.rules = r = rules
        get = r.get
        self.case = Case(get("LANG", ""))
        self.lang = get("LANG", "")
        self.hungarian = self.lang.startswith("hu")
        self.forbidden_flag = get("FORBIDDENWORD") or DEFAULT_FORBIDDEN
        for name in ("NEEDAFFIX", "ONLYINCOMPOUND", "CIRCUMFIX", "KEEPCASE", "NOSUGGEST", "NONGRAMSUGGEST", "SUBSTANDARD", "WARN", "FORCEUCASE"):
            setattr(self, name.lower(), get(name))
        self.cf, self.cb, self.cm, self.ce = get("COMPOUNDFLAG"), get("COMPOUNDBEGIN"), get("COMPOUNDMIDDLE"), get("COMPOUNDEND")
        self.permit, self.forbid, self.cpd_root = get("COMPOUNDPERMITFLAG"), get("COMPOUNDFORBIDFLAG"), get("COMPOUNDROOT")
        self.cpd_min, self.word_max = get("COMPOUNDMIN") or 3, get("COMPOUNDWORDMAX") or -1
        self.max_syllables, self.vowels = r.syllables
        self.has_compounds = bool(self.cf or self.cb or r.compound_rules)
        self.fullstrip, self.rtl = bool(get("FULLSTRIP")), bool(get("COMPLEXPREFIXES"))
        self.ignore = get("IGNORE", "")
        self.breaks = list(DEFAULT_BREAKS) if r.breaks is None else r.breaks
        self.keyboard, self.try_chars = get("KEY", KEYBOARD), get("TRY", "")
        self.dash_language = "-" in self.try_chars or "a" in self.try_chars
        self.iconv, self.oconv = Converter(r.iconv), Converter(r.oconv)
        self.encodable = r.charset
        self.words: dict[str, list[Entry]] = {}
        self.order: list[Entry] = []
        for e in entries:
            self._put(e)
        for kind, *args in changes:
            getattr(self, f"_change_{kind}")(*args)
        self._index()
        self._right = self._listed_right()

    # lexicon

    def _put(self, e: Entry) -> None:
        self._add(e)
        kind = self.case.kind(e.word)
        if (kind in (MIXED, MIXED_INIT) or kind == ALL and e.flags) and self.forbidden_flag not in e.flags:
            self._add(Entry(self.case.init(self.case.lower(e.word)), e.flags | {ONLY_UPCASE}, e.morph, e.no, e.dic))

    def _add(self, e: Entry) -> None:
        row = self.words.setdefault(e.word, [])
        if row and row[0].dic != e.dic:
            if any(x.dic == e.dic for x in row):
                pass
        if ONLY_UPCASE in e.flags:
            if any(x.dic == e.dic for x in row):
                return  # the word is there as it is, or hidden already
        else:
            hidden = [x for x in row if x.dic == e.dic and ONLY_UPCASE in x.flags]
            for x in hidden:  # a real word replaces a hidden one
                row.remove(x)
                self.order.remove(x)
        if not e.flags and any(not x.flags and x.dic == e.dic for x in row):
            return
        row.append(e)
        self.order.append(e)

    def _index(self) -> None:
        conts = set()
        self._prefixes: dict[str, list] = {}
        self._suffixes: dict[str, list] = {}
        self._by_flag: dict[int, list] = {}
        for a in self.rules.affixes:
            rx = condition_regex(a.cond, a.kind)
            item = (a, re.compile(rx).search if rx else None)
            (self._prefixes if a.kind == "P" else self._suffixes).setdefault(a.append, []).insert(0, item)
            self._by_flag.setdefault(a.flag, []).insert(0, item)
            conts |= a.cont
        self._conts = conts
        self._prefix_sizes = sorted({len(a) for a in self._prefixes})
        self._suffix_sizes = sorted({len(a) for a in self._suffixes})

    def _listed_right(self) -> frozenset:
        """Words that are right because they are listed, whatever else the rules say; none where words are changed first."""
        if self.iconv.table or self.ignore or self.rtl:
            return frozenset()
        plain, hidden, out = _State(), _State(), set()
        hidden.init_query = True
        for word, rows in self.words.items():
            if len(word) > 60 or word[0] == " " or word[-1] == ".":
                continue
            st = hidden if self.case.kind(word) == INIT else plain
            for dic in sorted({e.dic for e in rows}):
                own = [e for e in rows if e.dic == dic]
                found = next((e for e in own if not self._skipped(e, st)), None)
                if self.forbidden_flag in own[0].flags or found and self.warn and self.warn in found.flags:
                    break
                if found:
                    out.add(word)
                    break
        return frozenset(out)

    def entries(self, word: str) -> list[Entry]:
        """All homonyms of a word in the first lexicon that has it."""
        row = self.words.get(word)
        if not row:
            return []
        dic = min(e.dic for e in row)
        return [e for e in row if e.dic == dic]

    # changes, for the first lexicon only

    def _change_add(self, word: str, flags: frozenset = frozenset(), morph: str = "") -> None:
        if not flags:
            row = self.words.get(word, [])
            for k, e in enumerate(row):
                if e.dic == 0 and self.forbidden_flag in e.flags:
                    row[k] = Entry(e.word, e.flags - {self.forbidden_flag}, e.morph, e.no, 0)
                    self.order[self.order.index(e)] = row[k]
                    return
        self._put(Entry(word, flags, morph, len(self.order), 0))

    def _change_like(self, word: str, example: str) -> None:
        for e in self.words.get(example, []):
            if e.dic == 0:
                self._put(Entry(word, e.flags, "", len(self.order), 0))
                return
        self._change_add(word)

    def _change_remove(self, word: str) -> None:
        row = self.words.get(word, [])
        for k, e in enumerate(row):
            if e.dic == 0 and self.forbidden_flag not in e.flags:
                row[k] = Entry(e.word, e.flags | {self.forbidden_flag}, e.morph, e.no, 0)
                self.order[self.order.index(e)] = row[k]

    # affixes

    def _prefix_rules(self, word: str):
        for n in self._prefix_sizes:
            if n > len(word):
                return
            yield from self._prefixes.get(word[:n], ())

    def _suffix_rules(self, word: str):
        for n in self._suffix_sizes:
            if n > len(word):
                return
            yield from self._suffixes.get(word[len(word) - n :], ())

    def _before(self, word: str, item) -> str | None:
        """The word without an affix; None if nothing would be left or the condition fails."""
        a, cond = item
        n = len(word) - len(a.append)
        if not (n > 0 or n == 0 and self.fullstrip):
            return None
        if a.kind == "P":
            base = a.strip + word[len(a.append) :]
        else:
            base = word[:n] + a.strip
        return base if cond is None or cond(base) else None

    def _suffix_ok(self, a: Affix, prefix: Affix | None, cclass: int, place: int) -> bool:
        """Whether a suffix may stand here at all."""
        cont = a.cont
        if cclass and not cont and a.append == "":
            return False
        if place == BEGIN and not (self.permit and self.permit in cont):
            return False
        c = self.circumfix
        if c and ((prefix is not None and c in prefix.cont) != (c in cont)):
            return False
        if place == ALONE and self.onlyincompound in cont and self.onlyincompound:
            return False
        if a.append and place == END and prefix is None and self.onlyincompound and self.onlyincompound in cont:
            return False
        need = self.needaffix
        return bool(cclass) or not (need and need in cont) or prefix is not None and need not in prefix.cont

    def suffixed(self, word: str, prefix: Affix | None = None, cross: bool = False, cclass: int = 0, need: int = 0, place: int = ALONE, bad: int = 0) -> Iterator[Hit]:
        """Entries that make the word with one suffix, under a prefix if given."""
        only = self.onlyincompound if place == ALONE else 0
        for item in self._suffix_rules(word):
            a = item[0]
            if cross and not a.cross or not self._suffix_ok(a, prefix, cclass, place):
                continue
            if cclass and cclass not in a.cont:
                continue
            base = self._before(word, item)
            if base is None:
                continue
            for e in self.entries(base):
                if a.flag not in e.flags and not (prefix is not None and a.flag in prefix.cont):
                    continue
                if cross and not (prefix.flag in e.flags or prefix.flag in a.cont):
                    continue
                if only and only in e.flags or bad and bad in e.flags:
                    continue
                if need and need not in e.flags and need not in a.cont:
                    continue
                yield Hit(e, prefix, a)

    def twice_suffixed(self, word: str, prefix: Affix | None = None, cross: bool = False, need: int = 0) -> Iterator[Hit]:
        """Entries that make the word with two suffixes, the outer one continuing the inner one."""
        for item in self._suffix_rules(word):
            a = item[0]
            if a.flag not in self._conts or cross and not a.cross:
                continue
            base = self._before(word, item)
            if base is None:
                continue
            under = prefix is not None and prefix.flag not in a.cont
            for h in self.suffixed(base, prefix if under else None, cross and under, a.flag, need):
                yield Hit(h.entry, prefix, a, h.suffix)

    def _prefix_ok(self, a: Affix, place: int) -> bool:
        if place == ALONE and self.onlyincompound and self.onlyincompound in a.cont:
            return False
        return place != END or bool(self.permit) and self.permit in a.cont

    def prefixed(self, word: str, need: int = 0, place: int = ALONE, bad: int = 0) -> Iterator[Hit]:
        """Entries that make the word with a prefix, or with a prefix and a suffix."""
        for item in self._prefix_rules(word):
            a = item[0]
            if not self._prefix_ok(a, place):
                continue
            base = self._before(word, item)
            if base is None:
                continue
            for e in self.entries(base):
                if a.flag not in e.flags or self.needaffix and self.needaffix in a.cont or bad and bad in e.flags:
                    continue
                if need and need not in e.flags and need not in a.cont:
                    continue
                if self.circumfix and self.circumfix in a.cont:
                    continue
                yield Hit(e, a)
            if a.cross:
                yield from self.suffixed(base, a, True, 0, need, place, bad)

    def affixed(self, word: str, need: int = 0, place: int = ALONE, bad: int = 0) -> Iterator[Hit]:
        """All derivations of a word, in the order of trial: prefixes, suffixes, two suffixes, prefix and two suffixes."""
        yield from self.prefixed(word, need, place, bad)
        yield from self.suffixed(word, need=need, place=place, bad=bad)
        if self._conts:
            yield from self.twice_suffixed(word, need=need)
            for item in self._prefix_rules(word):
                a = item[0]
                if a.cross and self._prefix_ok(a, ALONE):
                    base = self._before(word, item)
                    if base is not None:
                        yield from self.twice_suffixed(base, a, True, need)

    # one form of a word

    def _clean(self, word: str) -> str:
        return "".join(c for c in word if c not in self.ignore) if self.ignore else word

    def form(self, word: str, st: _State) -> Entry | None:
        """The entry that makes exactly this form right: direct, affixed or a compound."""
        word = self._clean(word)
        if not word:
            return None
        if self.rtl:
            word = word[::-1]
        found = None
        rows = self.words.get(word, ())
        for dic in sorted({e.dic for e in rows}):
            own = [e for e in rows if e.dic == dic]
            if self.forbidden_flag in own[0].flags:
                st.forbidden = True
                return None
            found = next((e for e in own if not self._skipped(e, st)), None)
            if found:
                return found
        avoid = ONLY_UPCASE if st.init_query else 0
        hit = next(self.affixed(word, bad=avoid), None)
        if hit and not (self.onlyincompound and self.onlyincompound in hit.entry.flags):
            if self.forbidden_flag in hit.entry.flags:
                st.forbidden = True
                return None
            st.root, st.hit = self._shown(hit.entry.word), hit
            return hit.entry
        if self.has_compounds:
            e = self._compound(word, st)
            if e:
                st.root, st.compound = self._shown(e.word), True
                return e
        return None

    def _shown(self, word: str) -> str:
        return word[::-1] if self.rtl else word

    def _skipped(self, e: Entry, st: _State) -> bool:
        f = e.flags
        return bool(self.needaffix and self.needaffix in f or self.onlyincompound and self.onlyincompound in f or st.init_query and ONLY_UPCASE in f)

    # compounds

    def _compound(self, word: str, st: _State) -> Entry | None:
        """Two parts first; more only if the word isn't simply a misspelling of something."""
        st.steps = 0
        try:
            e = self.parts(word, st, two=True)
        except _GiveUp:
            e = None
        if e is None:
            try:
                e = self.parts(word, st)
            except _GiveUp:
                e = None
            if e and not word[:1].isdigit() and self.simple_fault(word):
                e = None
        if e is None and self.hungarian and word.endswith("-"):
            try:
                e = self.parts(word[:-1], st, number=-5, moving=True)
            except _GiveUp:
                e = None
        return e

    def simple_fault(self, word: str) -> bool:
        """Whether the cheap suggestions find something for a word; set by the suggester."""
        return False

    def syllables(self, word: str) -> int:
        return sum(1 for c in word if c in self.vowels) if self.max_syllables else 0

    def _bad_part(self, e: Entry, suggesting: bool) -> bool:
        f = e.flags
        return self.forbidden_flag in f or ONLY_UPCASE in f or bool(suggesting and self.nosuggest and self.nosuggest in f)

    def _rule_match(self, parts: tuple, whole: bool) -> bool:
        """Whether entries follow a compound rule, to its end or as far as they go."""
        return any(_follows(rule, parts, whole) for rule in self.rules.compound_rules)

    def parts(
        self, word: str, st: _State, number: int = 0, syl: int = 0, rule: tuple | None = None, depth: int = 0, moving: bool = False,
        suggesting: bool = False, two: bool = False,
    ) -> Entry | None:
        """The first part's entry if the word is a compound. rule: the parts so far if they follow a compound rule."""
        if depth + 1 >= MAX_PARTS:
            return None
        n = len(word)
        last = n - self.cpd_min + 1
        reach = last + 1 if self.rules.get("SIMPLIFIEDTRIPLE") else last
        for i in range(self.cpd_min, max(reach, 0)):
            if i > n - 1 or i >= last and not (i > 2 and word[i - 1] == word[i - 2]):
                break
            ways = [rule is not None] if rule is not None or not self.rules.compound_rules or number else [False, True]
            for by_rule in ways:
                stop = False
                for pattern in [None, *([p for p in self.rules.compound_patterns if p[4]] if not by_rule else [])]:
                    if pattern is None:
                        left, right, text, at = word[:i], word[i:], word, i
                    else:
                        if not word.startswith(pattern[4], i):
                            continue
                        left, right = word[:i] + pattern[0], pattern[2] + word[i + len(pattern[4]) :]
                        text, at = left + right, len(left)
                    st.steps += 1
                    if st.steps > (MAX_STEPS_OF_CANDIDATE if suggesting else MAX_STEPS):
                        raise _GiveUp
                    e, stop = self._split(word, text, left, right, at, pattern, by_rule, rule, st, number, syl, depth, moving, suggesting, two)
                    if e:
                        return e
                    if stop:
                        break
        return None

    def _first_part(self, left: str, by_rule, rule, pattern, number, moving, suggesting):
        """(entry, its hit, whether affixes made it, stop) for the first part; entry None if there is none."""
        homonyms = self.entries(left)
        if homonyms and self.forbid and self.forbid in homonyms[0].flags and not moving:
            return None, None, False, True
        for e in homonyms:
            f = e.flags
            if moving:
                break
            if self.needaffix and self.needaffix in f or pattern and pattern[1] and pattern[1] not in f:
                continue
            if by_rule:
                ok = self._rule_match((*(rule or ()), e), False)
            else:
                ok = self.cf and self.cf in f or self.cb and number == 0 and self.cb in f or self.cm and number != 0 and self.cm in f
            if ok:
                break
        else:
            e = None
        if homonyms and moving:
            e = homonyms[0]
        if e is not None:
            if self.forbidden_flag in e.flags or self.needaffix and self.needaffix in e.flags or ONLY_UPCASE in e.flags or suggesting and self.nosuggest and self.nosuggest in e.flags:
                return None, None, False, True
            return e, None, False, False
        if by_rule:
            return None, None, False, True
        place = OTHER if moving else BEGIN
        hit = None
        if self.cf:
            hit = next(self.prefixed(left, self.cf, place), None)
            if hit is None:
                hit = next(self.suffixed(left, need=self.cf, place=place), None)
                if hit is None and self.rules.get("COMPOUNDMORESUFFIXES"):
                    hit = next(self.twice_suffixed(left, need=self.cf), None)
                if hit and not moving and (self.forbid and self.forbid in hit.suffix.cont or self.ce and self.ce in hit.suffix.cont):
                    hit = None
        for flag in ((self.cb,) if number == 0 else (self.cm,)):
            if hit is None and flag:
                hit = next(self.suffixed(left, need=flag, place=place), None)
                if hit is None and self.rules.get("COMPOUNDMORESUFFIXES"):
                    hit = next(self.twice_suffixed(left, need=flag), None)
                if hit is None:
                    hit = next(self.prefixed(left, flag, place), None)
        if hit and not moving and self.forbid and _side_has(hit, self.forbid):
            hit = None
        return (hit.entry if hit else None), hit, hit is not None, False

    def _split(self, word, text, left, right, at, pattern, by_rule, rule, st, number, syl, depth, moving, suggesting, two):
        """Try one split: (first part's entry or None, whether further variants of this split are pointless)."""
        r = self.rules
        first, hit, by_affix, stop = self._first_part(left, by_rule, rule, pattern, number, moving, suggesting)
        if stop:
            return None, True
        if first is None:
            if not (self.hungarian and moving):
                return None, False
            hit = next(self.affixed(left), None)
            if not hit or not hit.suffix or not ({ord("x"), ord("%")} & hit.suffix.cont):
                return None, False
            first, by_affix = hit.entry, True
        if self._bad_part(first, suggesting):
            raise _GiveUp
        if self.cpd_root and self.cpd_root in first.flags:
            number += 1
        f = first.flags
        ok = by_affix or by_rule or self.cf and self.cf in f or self.cb and number == 0 and self.cb in f or self.cm and number > 0 and self.cm in f or self.cb and self.cpd_root in f and self.cb in f
        if self.hungarian and moving:
            ok = ok or bool({ord("F"), ord("G"), ord("H")} & f)
        if not ok or pattern and pattern[1] and not (pattern[1] in f or hit and _side_has(hit, pattern[1])):
            return None, False
        if pattern is None and not by_rule and at < len(word):
            a, b = word[at - 1], word[at]
            if r.get("CHECKCOMPOUNDTRIPLE") and a == b and (at > 1 and word[at - 2] == a or word[at + 1 : at + 2] == a):
                return None, False
            if r.get("CHECKCOMPOUNDCASE") and (self.case.upper(a) == a or self.case.upper(b) == b) and a != "-" and b != "-":
                return None, False
        if self.hungarian:
            syl += self.syllables(left)
            if hit and hit.prefix and self.syllables(hit.prefix.append) > 1:
                number += 1
        rests = [right]
        if r.get("SIMPLIFIEDTRIPLE") and pattern is None and at > 2 and word[at - 1] == word[at - 2]:
            fuller = word[at - 1] + right
            rests = [fuller] if at >= len(word) - self.cpd_min + 1 else [right, fuller]
        chain = (*(rule or ()), first) if by_rule else None
        for rest in rests:
            if self._rest(word, rest, at, first, hit, pattern, chain, st, number, syl, depth, suggesting, two):
                return first, False
        return None, False

    def _rest(self, word, rest, at, first, hit, pattern, chain, st, number, syl, depth, suggesting, two) -> bool:
        """Whether what follows the first part completes the compound."""
        r = self.rules
        second = None
        for e in self.entries(rest):
            f = e.flags
            if self.needaffix and self.needaffix in f or pattern and pattern[3] and pattern[3] not in f:
                continue
            ok = self._rule_match((*chain, e), True) if chain else self.cf and self.cf in f or self.ce and self.ce in f
            if ok:
                second = e
                break
        if second and self.forceucase and self.forceucase in second.flags and not st.orig_cap:
            second = None
        if second and chain:
            return True
        if second:
            if self._bad_part(second, suggesting):
                raise _GiveUp
            more = number + (1 if self.cpd_root and self.cpd_root in second.flags else 0)
            if self._few_enough(more, syl + self.syllables(second.word)) and not (r.compound_patterns and not pattern and self._pattern_clash(word, at, first, hit, second, None)) and not (r.get("CHECKCOMPOUNDDUP") and second is first):
                self._veto(word)
                return True
        # the rest with affixes
        tail = None
        for flag in (self.cf, self.ce):
            if tail is None and flag and chain is None:
                tail = next(self.affixed(rest, flag, END), None)
        if tail is None and chain is not None:
            plain = next(self.affixed(rest, 0, END), None)
            if plain and self._rule_match((*chain, plain.entry), True):
                return True
        if tail and pattern and pattern[3] and not (pattern[3] in tail.entry.flags or _side_has(tail, pattern[3])):
            tail = None
        if tail and r.compound_patterns and not pattern and self._pattern_clash(word, at, first, hit, tail.entry, tail):
            tail = None
        if tail and self.forbid and _side_has(tail, self.forbid):
            tail = None
        if tail and self.forceucase and self.forceucase in tail.entry.flags and not st.orig_cap:
            tail = None
        if tail:
            if self._bad_part(tail.entry, suggesting):
                raise _GiveUp
            more = number + (1 if self.cpd_root and self.cpd_root in tail.entry.flags else 0)
            s = syl
            if self.hungarian:
                s += self.syllables(rest)
                if tail.suffix and not tail.suffix.cont:
                    s -= self.syllables(tail.suffix.append)
                if tail.prefix and self.syllables(tail.prefix.append) > 1:
                    more += 1
                if r.get("SYLLABLENUM", "") and tail.suffix:
                    s += {ord("c"): 2, ord("J"): 1, ord("I"): 1 if ord("J") in tail.entry.flags else 0}.get(tail.suffix.flag, 0)
            if self._few_enough(more, s) and not (r.get("CHECKCOMPOUNDDUP") and tail.entry is first):
                self._veto(word)
                return True
        # the rest as a compound
        if two:
            return False
        e = self.parts(rest, st, number + 1, syl, chain, depth + 1, False, suggesting)
        if e and r.compound_patterns and at < len(word) and self._pattern_clash(word, at, first, hit, e, None) != bool(pattern):
            e = None
        if e is None:
            return False
        if self._word_pair(word):
            raise _GiveUp
        if r.get("CHECKCOMPOUNDREP") and self._rep_fault(word):
            raise _GiveUp
        if word.startswith(e.word, at):
            head = word[: at + len(e.word)]
            if r.get("CHECKCOMPOUNDREP") and self._rep_fault(head) or self._word_pair(head):
                return False
            whole = next(iter(self.entries(word)), None) or next((h.entry for h in self.affixed(word)), None)
            if whole and self.forbidden_flag in whole.flags and whole.word[: len(head)] == head:
                raise _GiveUp
        return True

    def _few_enough(self, number: int, syl: int) -> bool:
        return self.word_max == -1 or number + 1 < self.word_max or bool(self.max_syllables) and syl <= self.max_syllables

    def _veto(self, word: str) -> None:
        if self.rules.get("CHECKCOMPOUNDREP") and self._rep_fault(word) or self._word_pair(word):
            raise _GiveUp

    def _pattern_clash(self, word, at, first, hit, second, tail) -> bool:
        """Whether a forbidden pair of endings and beginnings meets at a boundary."""
        for end, f1, begin, f2, _ in self.rules.compound_patterns:
            if not word.startswith(begin, at):
                continue
            if f1 and f1 not in first.flags and not (hit and _side_has(hit, f1)) or f2 and f2 not in second.flags and not (tail and _side_has(tail, f2)):
                continue
            if not end or end[0] == "0" and word[:at].endswith(first.word) or end[0] != "0" and word[:at].endswith(end):
                return True
        return False

    def _simple_word(self, word: str) -> bool:
        return bool(self.entries(word)) or next(self.affixed(word), None) is not None

    def _rep_fault(self, word: str) -> bool:
        """Whether a replacement turns the compound into a plain word."""
        if len(word) < 2:
            return False
        for pattern, outs in self.rules.rep:
            if not outs[0]:
                continue
            i = word.find(pattern)
            while i >= 0:
                if self._simple_word(word[:i] + outs[0] + word[i + len(pattern) :]):
                    return True
                i = word.find(pattern, i + 1)
        return False

    def _word_pair(self, word: str) -> bool:
        """Whether the lexicon has the compound as two words."""
        return self._pairs_there and len(word) > 2 and any(self._simple_word(f"{word[:i]} {word[i:]}") for i in range(1, len(word)))

    @property
    def _pairs_there(self) -> bool:
        if "_spaced" not in self.__dict__:
            self._spaced = any(" " in w for w in self.words) or any(" " in a.append + a.strip for a in self.rules.affixes)
        return self._spaced

    # whole words

    def clean(self, word: str) -> tuple[str, int]:
        """The word without blanks in front and dots behind, and the number of those dots."""
        word = self._clean(word).lstrip(" ")
        bare = word.rstrip(".")
        return bare, len(word) - len(bare)

    def too_long(self, word: str) -> bool:
        if len(word) < 75:  # at most four bytes a character
            return False
        if self.rules.charset == "utf-8":
            return len(word.encode("utf-8", "surrogatepass")) >= MAX_BYTES
        return len(word) >= MAX_BYTES_8BIT

    def writable(self, word: str) -> bool:
        """Whether the dictionary's character set has all characters of the word."""
        if word.isascii():
            return True
        try:
            word.encode(self.rules.charset)
        except UnicodeEncodeError:
            return False
        return True

    def check(self, word: str) -> Result:
        if word in self._right:
            return _LISTED
        if not self.writable(word):
            return Result(False)
        st = _State()
        ok = self._check(word, st, ())
        return Result(ok, st.compound, st.forbidden, st.warn, self.oconv(st.root) if ok and st.root else "")

    def spell(self, word: str) -> bool:
        return word in self._right or self.writable(word) and self._check(word, _State(), ())

    def _keep(self, e: Entry | None) -> bool:
        return bool(e and self.keepcase and self.keepcase in e.flags)

    def _check(self, word: str, st: _State, above: tuple) -> bool:
        if len(above) > MAX_BREAKS or word in above:
            return False
        if self.too_long(word):
            return False
        given = self.iconv(word)
        if given != word and self.too_long(given):
            return False
        w, dots = self.clean(given)
        if not w or not w[0].isalpha() and _NUMBER.fullmatch(w):
            return True
        e, w = self._by_case(w, dots, st)
        if e is not None:
            st.warn = bool(self.warn and self.warn in e.flags)
            return not (st.warn and self.rules.get("FORBIDWARN"))
        return not st.forbidden and self._broken(w, st, (*above, word))

    def _dotted(self, w: str, dots: int, st: _State) -> Entry | None:
        return self.form(w, st) or (self.form(w + ".", st) if dots else None)

    def _by_case(self, w: str, dots: int, st: _State) -> tuple[Entry | None, str]:
        """The entry for a word in any of the forms its capitals stand for, and the form that break points look at."""
        case, kind = self.case, self.case.kind(w)
        if kind in (NONE, MIXED, MIXED_INIT):
            st.orig_cap = kind != NONE
            e = self._dotted(w, dots, st)
            if e is None and kind == MIXED_INIT:
                e = self.form(case.init_small(w), st)
                if self._keep(e):
                    e = None
            return e, w
        st.orig_cap = True
        sharps = self.rules.get("CHECKSHARPS")
        dotted_i = w[0] == "İ"
        if kind == ALL:
            e = self._dotted(w, dots, st)
            if e is None and "'" in w:
                k = w.index("'")
                if k < len(w) - 1:
                    small = case.lower(w)
                    w = small[: k + 1] + case.init(small[k + 1 :])
                    e = self.form(w, st)
                    if e is None:
                        w = case.init(w)
                        e = self.form(w, st)
            if e is None and sharps and "SS" in w:
                w = case.lower(w)
                e = self._sharp(w, st)
                if e is None:
                    w = case.init(w)
                    e = self._sharp(w, st)
                if e is None and dots:
                    e = self._sharp(case.lower(w) + ".", st) or self._sharp(w + ".", st)
            if e is not None:
                return e, w
            w = case.init(case.lower(w))
            if dotted_i:
                w = "İ" + w[1:]
        st.init_query = kind == INIT
        e = self.form(w, st)
        st.init_query = False
        if st.forbidden:
            return None, w
        if self._keep(e) and kind == ALL:
            e = None
        if e is not None or dotted_i and not case.turkic:
            return e, w
        low = case.lower(w)
        w = case.init(low)
        e = self.form(low, st)
        if e is None and dots:
            low += "."
            e = self.form(low, st)
            if e is None:
                st.init_query = kind == INIT
                e = self.form(w + ".", st)
                st.init_query = False
                if self._keep(e) and kind == ALL:
                    e = None
                return e, w
        if self._keep(e) and (kind == ALL or not (sharps and "ß" in low)):
            e = None
        return e, w

    def _sharp(self, w: str, st: _State) -> Entry | None:
        """A form with some ss written as ß, at least one."""
        places = [m.start() for m in re.finditer("(?=ss)", w)]

        def go(k: int, text: str, shift: int, done: int) -> Entry | None:
            while k < len(places) and done < MAX_SHARPS:
                p = places[k] - shift
                if text[p : p + 2] == "ss":
                    e = go(k + 1, text[:p] + "ß" + text[p + 2 :], shift + 1, done + 1) or go(k + 1, text, shift, done)
                    return e
                k += 1
            return self.form(text, st) if done else None

        return go(0, w, 0, 0)

    def _broken(self, w: str, st: _State, above: tuple) -> bool:
        """Whether the word is right in pieces at its break points."""
        if not self.breaks or sum(w.count(b) for b in self.breaks) >= MAX_BREAKS:
            return False

        def right(piece: str) -> bool:
            return self._check(piece, _State(), above)

        for b in self.breaks:
            if len(b) > 1 and len(b) <= len(w):
                if b[0] == "^" and w.startswith(b[1:]) and right(w[len(b) - 1 :]) or b[-1] == "$" and w.endswith(b[:-1]) and right(w[: len(w) - len(b) + 1]):
                    st.compound = True
                    return True
        for later in (True, False):
            for b in self.breaks:
                k = w.find(b)
                if not 0 < k < len(w) - len(b):
                    continue
                if later:
                    k2 = w.find(b, k + 1)
                    k = k2 if 0 < k2 < len(w) - len(b) else k
                if right(w[k + len(b) :]) and (right(w[:k]) or self.hungarian and b == "-" and right(w[: k + 1])):
                    st.compound = True
                    return True
        return False

    # listing

    def has_word(self, word: str) -> bool:
        """Whether the lexicons list the word itself, visibly."""
        rows = self.words.get(word[::-1] if self.rtl else word, ())
        return any(ONLY_UPCASE not in e.flags and self.forbidden_flag not in e.flags for e in rows)

    def listed(self) -> list[str]:
        """All visible words, each once, in lexicon order."""
        return list(dict.fromkeys(self._shown(e.word) for e in self.order if ONLY_UPCASE not in e.flags and self.forbidden_flag not in e.flags))


def _side_has(hit: Hit, flag: int) -> bool:
    """Whether the affixes that make a part have a flag among their continuations."""
    return bool(hit.prefix and flag in hit.prefix.cont or hit.suffix and flag in hit.suffix.cont)


def _follows(rule: list[tuple[int, str]], parts: tuple, whole: bool) -> bool:
    """Whether parts match a rule's flags from its start, up to its end if whole."""

    @lru_cache(maxsize=None)
    def go(i: int, k: int) -> bool:
        if k == len(parts):
            return not whole or all(q for _, q in rule[i:])
        if i == len(rule):
            return False
        flag, q = rule[i]
        if flag in parts[k].flags and (go(i if q == "*" else i + 1, k + 1) or q == "*" and go(i + 1, k + 1)):
            return True
        return bool(q) and go(i + 1, k)

    return go(0, 0)
