"""Morphology of single words: analyses, stems, generated forms and expansion.

An analysis is a text of fields (two letters, a colon, a value). Fields are kept as the dictionary has them; where an
entry or affix has none, its stem or flag stands in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from lexloom.functions.casing import ALL, INIT, MIXED_INIT
from lexloom.sources.rules import ONLY_UPCASE, Affix, Entry

from .engine import END, Engine, Hit
from .suggester import Suggester, _field

MOST_CHARS = 4 << 20


@lru_cache(maxsize=200_000)
def signature(text: str) -> tuple[tuple[str, str], ...]:
    """Kinds and values of the derivational, inflectional and terminal suffix fields of a description's first line: the
    next ds: if there is one, else the next is:, else the next ts:."""
    fields = [(f[:2], f[3:]) for f in text.split("\n", 1)[0].split() if f[:3] in ("ds:", "is:", "ts:")]
    out, at = [], 0
    while True:
        k = next((i for kind in ("ds", "is", "ts") for i in range(at, len(fields)) if fields[i][0] == kind), None)
        if k is None:
            return tuple(out)
        out.append(fields[k])
        at = k + 1


def compare(a: str, b: str) -> int:
    """0: same suffix fields; 1: may become the same with one more suffix; -1: never."""
    x, y = signature(a), signature(b)
    for (kind, v), (_, w) in zip(x, y):
        if v != w:
            return 1 if kind == "ts" else -1
    return 0 if len(x) == len(y) and x else 1


class Analyzer(Suggester):
    # analyses

    def _flag(self, flag: int) -> str:
        return f" fl:{self.rules.spell_flag(flag)}"

    def _stem_part(self, e: Entry) -> str:
        return "" if "st:" in e.morph else f" st:{e.word}"

    def _suffix_record(self, h: Hit, prefix: Affix | None, suffix: Affix) -> str:
        head = "" if prefix is None else f"{prefix.morph} " if prefix.morph else self._flag(prefix.flag)
        data = f" {h.entry.morph}" if h.entry.morph else ""
        tail = f" {suffix.morph}" if suffix.morph else self._flag(suffix.flag)
        if self.rtl:
            return head + h.entry.morph + self._stem_part(h.entry) + tail
        return head + self._stem_part(h.entry) + data + tail

    def _record(self, h: Hit) -> str:
        if h.suffix is None:
            p = h.prefix
            head = f" {p.morph}" if p.morph else p.append
            return head + self._stem_part(h.entry) + (f" {h.entry.morph}" if h.entry.morph else self._flag(p.flag))
        if h.inner is None:
            return self._suffix_record(h, h.prefix, h.suffix)
        apart = h.prefix is not None and h.prefix.flag in h.suffix.cont
        head = f"{h.prefix.morph} " if apart and h.prefix.morph else ""
        outer = f" {h.suffix.morph}" if h.suffix.morph else self._flag(h.suffix.flag)
        return head + self._suffix_record(h, None if apart else h.prefix, h.inner) + outer

    def _form_records(self, word: str) -> list[str]:
        """Analyses of exactly this form."""
        if self.rtl:
            word = word[::-1]
        hidden = {self.forbidden_flag, self.needaffix, self.onlyincompound} - {0}
        out = [
            (f" st:{word}" if "st:" not in e.morph else "") + (f" {e.morph}" if e.morph else "") for e in self.entries(word) if not e.flags & hidden
        ]
        out += [self._record(h) for h in self.affixed(word)]
        if not out and self.has_compounds:
            out = list(self._compound_records(word, 0, (), ()))
        return list(dict.fromkeys(out))

    def _part_record(self, part: str, e: Entry, last: bool = True) -> str:
        if not last:
            return f" pa:{part}{self._stem_part(e)}" + (f" {e.morph}" if e.morph else "")
        return f" pa:{part}" + (f"{self._stem_part(e)} {e.morph}" if e.morph else "")

    def _compound_records(self, word: str, number: int, chain: tuple, rule: tuple) -> Iterator[str]:
        """Part by part analyses of a compound."""
        if number > 20:
            return
        r = self.rules
        for i in range(self.cpd_min, len(word) - self.cpd_min + 1):
            left, right = word[:i], word[i:]
            if not rule:
                yield from self._affixed_first(left, right, number, chain)
            for e in self.entries(left):
                f = e.flags
                if self.needaffix and self.needaffix in f or self._bad_part(e, False):
                    continue
                plain = not rule and (self.cf in f and self.cf or self.cb in f and self.cb and number == 0 or self.cm in f and self.cm and number)
                ruled = bool(r.compound_rules) and (not number or rule) and self._rule_match((*rule, e), False)
                if not plain and not ruled:
                    continue
                head = (*chain, self._part_record(left, e, False))
                for x in self.entries(right):
                    g = x.flags
                    if self.needaffix and self.needaffix in g or self._bad_part(x, False):
                        continue
                    if plain and (self.cf in g and self.cf or self.ce in g and self.ce) or ruled and self._rule_match((*rule, e, x), True):
                        yield "".join((*head, self._part_record(right, x)))
                for flag in {self.cf, self.ce} - {0} if plain else ():
                    for h in self.affixed(right, flag, END):
                        yield "".join(head) + f" pa:{right} " + self._record(h)
                yield from self._compound_records(right, number + 1, head, (*rule, e) if ruled and not plain else ())

    def _affixed_first(self, left: str, right: str, number: int, chain: tuple) -> Iterator[str]:
        """Analyses whose first part has affixes; only its surface is told."""
        _, hit, by_affix, stop = self._first_part(left, False, None, None, number, False, False)
        if stop or not by_affix or self._bad_part(hit.entry, False):
            return
        head = "".join(chain) + f" pa:{left}"
        for x in self.entries(right):
            if not (self.needaffix and self.needaffix in x.flags) and (self.cf and self.cf in x.flags or self.ce and self.ce in x.flags) and not self._bad_part(x, False):
                yield head + self._part_record(right, x)
        for flag in {self.cf, self.ce} - {0}:
            for h in self.affixed(right, flag, END):
                yield head + f" pa:{right} " + self._record(h)

    def analyze(self, word: str) -> list[str]:
        """All analyses of a word, those of its small form first if it begins with a capital."""
        if not self.writable(word) or self.too_long(word):
            return []
        given = self.iconv(word)
        w, dots = self.clean(given)
        if not w:
            if not dots:
                return []
            w, dots = "." * dots, 0
        out = self._analyze(w, dots)
        if self.rtl:
            out = [x[::-1] for x in out]
        if not out and "-" in w:
            out = self._dashed(w)
        out = [self.oconv(x) for x in out] if self.oconv.table else out
        total, kept = 0, []
        for x in out:
            total += len(x)
            if total > MOST_CHARS:
                break
            kept.append(x)
        return kept

    def _analyze(self, w: str, dots: int) -> list[str]:
        case, kind = self.case, self.case.kind(w)
        small = case.lower(w)
        forms = [small, case.init(small)] if kind == INIT else [w] + ([f for f in (w + ".",) if dots] + [small, case.init(small)] if kind == ALL else [])
        if dots:
            forms = forms + [f + "." for f in (forms[-2:] if kind in (INIT, ALL) else forms)]
        out: list[str] = []
        for f in forms:
            out += self._form_records(f)
        return out

    def _dashed(self, w: str) -> list[str]:
        """A word with a dash from the analyses of its two parts."""
        a, _, b = w.partition("-")
        if not a or not b:
            return []
        x, y = self._analyze(a, 0), self._analyze(b, 0)
        return [f"{x[0]}-{z}" for z in y] if x and y and self.spell(a) and self.spell(b) else []

    # stems

    @staticmethod
    def _parts_before(record: str) -> tuple[str, str]:
        """The parts of a compound but the last, joined, and what follows them."""
        k = record.rfind(" pa:")
        if k < 0:
            return "", record
        head = "".join(f[3:] for f in record[:k].split() if f.startswith("pa:"))
        return head, record[k:]

    def stem(self, word: str) -> list[str]:
        """Stems of a word: a derivational suffix stays, inflection goes."""
        return self.stems_of(self.analyze(word))

    def stems_of(self, analyses: list[str]) -> list[str]:
        out = []
        for record in analyses:
            head, rest = self._parts_before(record)
            for alt in rest.split(" | "):
                if "ds:" in alt:
                    k = alt.find("is:")
                    alt = alt if k < 0 else alt[:k]
                    out += [head + x for x in self._generate([alt], alt)]
                else:
                    out.append(head + (_field(alt, "sp:") or "") + (_field(alt, "st:") or ""))
        return list(dict.fromkeys(x for x in out if x))

    # generation

    def _with_suffix(self, word: str, flags, morph: str, target: str, level: int = 0, avoid: int = 0) -> str | None:
        """A form whose description has the target's suffix fields, with at most two suffixes."""
        if self.substandard and self.substandard in flags:
            return None
        if compare(morph, target) == 0:
            return word
        base = f"{morph} " if "is:" in morph or "ds:" in morph else ""
        for flag in sorted(flags):
            if avoid and flag == avoid:
                continue
            for a, cond in self._by_flag.get(flag, ()):
                if a.kind != "S" or not a.morph or self.substandard and self.substandard in a.cont:
                    continue
                now = compare(base + a.morph, target)
                if now == 0:
                    form = self._added(a, cond, word)
                    if form:
                        first = next(iter(self.entries(form)), None)
                        if not first or not first.flags & {self.forbidden_flag, ONLY_UPCASE}:
                            return form
                if level == 0 and now == 1 and a.cont:
                    form = self._added(a, cond, word)
                    if form:
                        more = self._with_suffix(form, a.cont, base + a.morph, target, 1, a.flag)
                        if more:
                            return more
        return None

    def _entry_forms(self, e: Entry, target: str) -> list[str]:
        """Forms of an entry and of its allomorphs."""
        if len(signature(e.morph)) > len(signature(target)) or not e.morph:
            return []
        out = [self._with_suffix(e.word, e.flags, e.morph, target)]
        for f in e.morph.split():
            if f.startswith("al:"):
                out += [self._with_suffix(x.word, x.flags, x.morph, target) for x in self.entries(f[3:]) if _field(x.morph, "st:") == e.word]
        return [x for x in out if x]

    def _generate(self, analyses: list[str], pattern: str) -> list[str]:
        while True:
            out = []
            for record in analyses:
                head, rest = self._parts_before(record)
                for alt in rest.split(" | "):
                    k = alt.find("is:")
                    own = (alt if k < 0 else alt[:k]).replace("ts:", "_s:")
                    for e in self.entries(_field(rest, "st:") or ""):
                        forms = self._entry_forms(e, own + pattern) or self._entry_forms(e, pattern)
                        out += [head + (_field(own, "sp:") or "") + f for f in forms]
            if out or "ds:" not in pattern:
                return out
            pattern = pattern.replace("ds:", "ts:")

    def generate_morph(self, word: str, descriptions: list[str]) -> list[str]:
        """Forms of a word with the suffixes of the descriptions, those that are right."""
        own = self.analyze(word)
        kind = self.case.kind(self.clean(word)[0])
        out = [x for d in descriptions for x in self._generate(own, d)]
        if kind == ALL:
            out = [self.case.upper(x) for x in out]
        elif kind in (INIT, MIXED_INIT):
            out = [self.case.init(x) for x in out]
        return [x for x in out if self.spell(x)]

    def generate(self, word: str, example: str) -> list[str]:
        """Forms of a word like an example."""
        return list(dict.fromkeys(self.generate_morph(word, self.analyze(example))))

    # forms

    def suffix_forms(self, word: str) -> list[str]:
        """The entry with each of its suffixes put behind it, where that takes off again."""
        rows = self.entries(self._clean(word))
        if not rows:
            return []
        items = sorted((x for f in rows[0].flags for x in self._by_flag.get(f, ()) if x[0].kind == "S"), key=lambda x: (x[0].append[-1:], x[0].append[::-1]))
        out = []
        for a, cond in items:
            form = word + a.append
            base = self._before(form, (a, cond))
            if base is not None and any(a.flag in e.flags for e in self.entries(base)):
                out.append(form)
        return out

    def expand(self, word: str) -> list[str]:
        """All forms of the entry that one prefix and one suffix make, the entry first, each once."""
        out: list[str] = []
        for e in self.entries(word[::-1] if self.rtl else word):
            out += [self._shown(f) for f, _ in self.forms_like(e, None)]
        return list(dict.fromkeys(out))


__all__ = ["Analyzer", "Engine", "compare", "signature"]
