"""Corrections: candidates by kinds of mistakes, then words of similar letters or sound.

Every kind of mistake is a generator of candidates; one driver checks them, keeps the order of first finds and applies the
limits. There are no time limits: the counts below bound every search, and answers depend on the word alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

from lexloom.functions.casing import ALL, INIT, MIXED, MIXED_INIT, NONE
from lexloom.functions.grams import Beginnings, GramIndex, GramTable
from lexloom.functions.near import NearWords, less_one
from lexloom.functions.phonetic import Phonetic
from lexloom.functions.similar import ANY_MISMATCH, LONGER_WORSE, common_positions, lcs_length, left_common, ngram_score
from lexloom.sources.rules import ONLY_UPCASE, Affix, Entry

from .engine import Engine, _GiveUp, _State

MOST, MOST_NGRAM, MOST_SOUND, MOST_COMPOUND, MOST_ROOTS, MOST_GUESSES, MOST_FORMS, FAR = 15, 4, 2, 3, 100, 200, 100, 4
#: At most so many candidates of related letters are tried for a word.
MOST_MAPPED = 20_000
#: A dictionary whose forms have at most so many letters together has them listed, which changes no answer.
MOST_LISTED = 2_000_000
#: Forms that are scored for many words at once, and the length from which a word is not.
MOST_IN_TABLE, MOST_AHEAD = 1_000, 60
#: Groups of affixes, and entries in each, whose forms are kept before they are dropped and made anew, which changes no
#: answer either.
MOST_GROUPS, MOST_KEPT = 50, 10_000


class _List(list):
    """Suggestions found so far, and whether a replacement or word pair ends the search."""

    best = only_compound = False


class Suggester(Engine):
    def __init__(self, rules, entries, changes=()):
        super().__init__(rules, entries, changes)
        get = rules.get
        self.most_ngram = rules.options.get("MAXNGRAMSUGS", MOST_NGRAM)
        self.most_compound = rules.options.get("MAXCPDSUGS", MOST_COMPOUND)
        self.max_diff = rules.options.get("MAXDIFF", -1)
        self.phonetic = Phonetic(rules.phone) if rules.phone else None
        self.split_words = not get("NOSPLITSUGS")
        self._ahead: dict[str, list[int]] = {}
        self._few: dict[tuple[int, bool], bool] = {}

    # validity of candidates

    def valid(self, word: str, compound: int = 0) -> bool:
        """Whether a candidate is a word: plain (0), a compound of two parts (1) or of any number (2)."""
        if compound:
            return self._valid_compound(word, compound)
        return word in self._near.words if self._near else self._derived(word)

    @cached_property
    def _near(self) -> NearWords | None:
        """All valid words; None if affixes go on affixes or the forms are too many to list."""
        if self._conts:
            return None
        tried, size = set(), 0
        for word, rows in self.words.items():
            for e in rows:
                items = [a for f in e.flags for a, _ in self._by_flag.get(f, ())]
                bases = [word, *(word[: len(word) - len(a.strip)] + a.append for a in items if a.kind == "S" and word.endswith(a.strip))]
                forms = {*bases, *(a.append + b[len(a.strip) :] for a in items if a.kind == "P" for b in bases if b.startswith(a.strip))} - tried
                size += sum(map(len, forms))
                if size > MOST_LISTED:
                    return None
                tried |= forms
        return NearWords(w for w in tried if self._derived(w))

    def _derived(self, word: str) -> bool:
        """Whether the lexicon and its affixes make a word that may be suggested."""
        rows = self.entries(word)
        refused = {self.forbidden_flag, self.nosuggest, self.substandard} - {0}
        found = None
        if rows:
            if rows[0].flags & refused:
                return False
            hidden = {self.needaffix, ONLY_UPCASE, self.onlyincompound} - {0}
            found = next((e for e in rows if not e.flags & hidden), None)
        else:
            found = next((h.entry for h in self.prefixed(word)), None)
        if found is None:
            found = next((h.entry for h in self.suffixed(word)), None)
        if found is None and self._conts:
            rest = (h.entry for h in self.affixed(word) if h.inner)
            found = next(rest, None)
        return found is not None and not found.flags & ({self.forbidden_flag, ONLY_UPCASE, self.nosuggest, self.onlyincompound} - {0})

    def _valid_compound(self, word: str, compound: int) -> bool:
        if not self.has_compounds:
            return False
        st = _State()
        try:
            e = self.parts(word, st, suggesting=True, two=compound == 1)
        except _GiveUp:
            return False
        if e is None:
            return False
        rows = self.entries(word)
        return not rows or not rows[0].flags & ({self.forbidden_flag, self.nosuggest} - {0})

    def simple_fault(self, word: str) -> bool:
        found = _List()
        return self._edits(found, word[::-1] if self.rtl else word, simple=True)

    def _take(self, found: _List, word: str, compound: int) -> bool:
        if word in found or len(found) >= MOST or not self.valid(word, compound):
            return False
        found.append(word)
        return True

    # candidates by kind of mistake

    def _replaced(self, word: str) -> Iterator[str]:
        from .engine import pick

        for pattern, outs in self.rules.rep:
            i = word.find(pattern)
            while i >= 0:
                out = pick(outs, i == 0, i + len(pattern) == len(word))
                if out:
                    yield word[:i] + out + word[i + len(pattern) :]
                i = word.find(pattern, i + 1)

    def _mapped(self, word: str) -> Iterator[str]:
        """Every combination of related letters. A later group at a place goes on from what the one before left there."""
        maps, count = self.rules.maps, [MOST_MAPPED]
        held: list[str] = []

        def go(i: int) -> Iterator[str]:
            if i == len(word):
                count[0] -= 1
                yield "".join(held)
                return
            hit = False
            for group in maps:
                for own in group:
                    if own and word.startswith(own, i):
                        hit = True
                        n = len(held)
                        for other in group:
                            del held[n:]
                            held.append(other)
                            yield from go(i + len(own))
                            if count[0] <= 0:
                                return
            if not hit:
                held.append(word[i])
                yield from go(i + 1)

        return go(0)

    @staticmethod
    def _swapped(word: str) -> Iterator[str]:
        for i in range(len(word) - 1):
            yield word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        if len(word) in (4, 5):
            mid = word[2:-2]
            yield word[1] + word[0] + mid + word[-1] + word[-2]
            if mid:
                yield word[0] + word[2] + word[1] + word[-1] + word[-2]

    @staticmethod
    def _swapped_far(word: str) -> Iterator[str]:
        for p in range(len(word)):
            for q in range(max(0, p - FAR), min(len(word), p + FAR + 1)):
                if abs(p - q) > 1 and word[p] != word[q]:
                    a, b = min(p, q), max(p, q)
                    yield word[:a] + word[b] + word[a + 1 : b] + word[a] + word[b + 1 :]

    def _wrong_key(self, word: str) -> Iterator[str]:
        for i, c in enumerate(word):
            near = [self.case.upper(c)] if self.case.upper(c) != c else []
            k = self.keyboard.find(c)
            while k >= 0:
                near += [self.keyboard[j] for j in (k - 1, k + 1) if 0 <= j < len(self.keyboard) and self.keyboard[j] != "|"]
                k = self.keyboard.find(c, k + 1)
            for other in near:
                yield word[:i] + other + word[i + 1 :]

    @staticmethod
    def _extra(word: str) -> Iterator[str]:
        for i in reversed(range(len(word))) if len(word) > 1 else ():
            yield word[:i] + word[i + 1 :]

    def _forgotten(self, word: str) -> Iterator[str]:
        for c in self.try_chars:
            for i in range(len(word), -1, -1):
                yield word[:i] + c + word[i:]

    @staticmethod
    def _moved(word: str) -> Iterator[str]:
        for p in range(len(word)):
            for q in range(p + 2, min(len(word), p + FAR + 1)):
                yield word[:p] + word[p + 1 : q + 1] + word[p] + word[q + 1 :]
        for p in range(len(word) - 1, -1, -1):
            for q in range(p - 2, max(-1, p - FAR - 1), -1):
                yield word[:q] + word[p] + word[q:p] + word[p + 1 :]

    def _wrong(self, word: str) -> Iterator[str]:
        for c in self.try_chars:
            for i in reversed(range(len(word))):
                if word[i] != c:
                    yield word[:i] + c + word[i + 1 :]

    @staticmethod
    def _doubled(word: str) -> Iterator[str]:
        run = 0
        for i in range(2, len(word)) if len(word) > 4 else ():
            run = run + 1 if word[i] == word[i - 2] else 0
            if run == 3 or run == 2 and i >= 4:
                yield word[: i - 1] + word[i + 1 :]
                run = 0

    def _split_in_two(self, found: _List, word: str, compound: int, good: bool) -> bool:
        """Pairs of words. A pair that the lexicon lists goes first and, if nothing good was there, alone."""
        if len(word) < 3:
            return False
        near = self._near
        pairs = compound == 0 and (near is None or near.spaced or near.dashed)
        for i in range(1, len(word)):
            a, b = word[:i], word[i:]
            if pairs:
                for pair in (f"{a} {b}", f"{a}-{b}")[: 1 + self.dash_language]:
                    if self.valid(pair):
                        found.best = True
                        if not good:
                            good = True
                            found.clear()
                        found.insert(0, pair)
            if len(found) < MOST and self.split_words and not good and self.valid(a, compound) and self.valid(b, compound):
                if f"{a} {b}" not in found and len(found) < MOST:
                    found.append(f"{a} {b}")
                    new = True
                else:
                    new = False
                if self.dash_language and len(a) > 1 and len(b) > 1 and f"{a}-{b}" not in found and new and len(found) < MOST:
                    found.append(f"{a}-{b}")
        return good

    def _edits(self, found: _List, word: str, simple: bool = False) -> bool:
        """Add corrections of one mistake; whether something good was found. simple: stop at the first."""
        if not word.isascii() and any(ord(c) > 0xFFFF for c in word):
            return False
        if self.rtl:
            word = word[::-1]
        before, good, found.only_compound = len(found), False, False
        plain_done = False
        every = (self._swapped, self._swapped_far, self._wrong_key, self._extra, self._forgotten, self._moved, self._wrong, self._doubled)
        # Without compounds the later rounds find nothing.
        for compound in range(3 if self.has_compounds else 1):
            kinds = self._hopeful(word) if compound == 0 and self._near else every
            start = len(found) if compound else 0

            def room() -> bool:
                return len(found) < MOST and (compound == 0 or len(found) < start + self.most_compound)

            if len(found) < MOST and self._take(found, self.case.upper(word), compound):
                good = True
            if room() and len(word) > 1:
                n = len(found)
                for c in self._replaced(word):
                    if self._take(found, c, compound):
                        found.best = True
                    if " " in c:
                        self._replaced_pair(found, c, compound)
                if len(found) > n:
                    good = True
                    if found.best:
                        return True
            if simple and found:
                return True
            if room() and len(word) > 1 and self.rules.maps:
                for c in self._mapped(word):
                    if c != word:
                        self._take(found, c, compound)
            if simple and found:
                return True
            if compound == 0 and len(found) > before:
                plain_done = True
            for kind in kinds:
                if room():
                    for c in kind(word):
                        if self._take(found, c, compound) and simple:
                            return True
            if compound == 0 or self.split_words and len(found) < start + self.most_compound:
                good = self._split_in_two(found, word, compound, good)
                if found.best:
                    return True
            if simple:
                return bool(found)
            if compound == 1 and len(found) > start:
                plain_done = True
            if plain_done:
                break
        found.only_compound = not plain_done and bool(found)
        return good

    def _hopeful(self, word: str) -> list:
        """The kinds of mistakes that may lead to a listed word, in order: one with the same letters, or one that is the
        same less a letter of either or both. Doubled syllables are always tried, as few words have any."""
        near, shorter = self._near, less_one(word)
        same = "".join(sorted(word)) in near.letters
        other = not near.short.isdisjoint(shorter)
        hopes = (
            (same, self._swapped), (same, self._swapped_far), (other, self._wrong_key), (not near.words.isdisjoint(shorter), self._extra),
            (word in near.short, self._forgotten), (same, self._moved), (other, self._wrong), (True, self._doubled),
        )
        return [kind for hope, kind in hopes if hope]

    def _replaced_pair(self, found: _List, c: str, compound: int) -> None:
        """A replacement with spaces: right if a part before a space and all that follows it are."""
        prev, k = 0, c.find(" ")
        while k >= 0:
            if self.valid(c[prev:k]) and self._take(found, c[k + 1 :], compound):
                found[-1] = c
            prev, k = k + 1, c.find(" ", k + 1)

    # similar words

    @property
    def _walk(self) -> list[Entry]:
        """Entries in the order in which equal scores are resolved: that of a hash table of the lexicon's size."""
        if "_walked" not in self.__dict__:
            codec = self.rules.charset
            by_dic: dict[int, list[Entry]] = {}
            for e in self.order:
                by_dic.setdefault(e.dic, []).append(e)
            self._walked = []
            for dic, rows in sorted(by_dic.items()):
                size = self.rules.options.get(f"_count{dic}", len(rows)) + 1005
                size += size % 2 == 0
                seen: dict[str, int] = {}
                keyed = []
                for e in rows:
                    place = seen.setdefault(e.word, len(seen))
                    keyed.append((_slot(e.word.encode(codec, "replace")) % size, place, len(keyed), e))
                self._walked += [x[-1] for x in sorted(keyed, key=lambda x: x[:3])]
        return self._walked

    def _score_low(self, n: int, word: str, other: str, penalty: str, low) -> int:
        return ngram_score(n, word, low(other), penalty) + left_common(word, other, low, self.rtl)

    @property
    def _roots(self) -> "_RootIndex":
        if "_rooted" not in self.__dict__:
            self._rooted = _RootIndex(self)
        return self._rooted

    def _scores_one_by_one(self, word: str, own, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """For words beyond the basic plane, whose bytes are compared."""
        out = np.zeros(len(self._walk), np.int64)
        for k, e in enumerate(self._walk):
            hint = _field(e.morph, "ph:")
            out[k] = max(self._score_low(3, word, own(x), LONGER_WORSE, str) for x in ([e.word, hint] if hint is not None else [e.word]))
        return out, self._roots.wanted(kind)

    def similar(self, found: _List, word: str, kind: int) -> None:
        """Add the words whose letters are most like the word's, and those that sound like it."""
        if self.rtl:
            word = word[::-1]
        ahead = self._ahead.get(word)
        if ahead is not None and not ahead:
            return
        wide = not word.isascii() and any(ord(c) > 0xFFFF for c in word)
        # Words beyond the basic plane are compared byte by byte, as they are.
        own = (lambda x: x.encode().decode("latin-1")) if wide else str
        low = str if wide else self.case.lower
        word = own(word)
        n = len(word)
        sound = self.phonetic
        walk, index = self._walk, self._roots
        heard = _Slots(MOST_ROOTS if sound else 0)
        if ahead is not None and self._few_roots(n, kind):
            wanted = index.wanted(kind)
            order, score = [k for k in reversed(ahead) if wanted[k]], None
        else:
            order, score = self._best_roots(word, own, kind, wide, heard)
            if not order and not heard.used:
                return
        plain = not wide and "*" not in word and low(word) == word
        least = _least_of_shape(tuple(map(word.index, word))) if plain else _least(word, low)
        guesses = _Slots(MOST_GUESSES)
        kept = _Forms(len(walk)) if wide else self._forms_near(word)
        first = word[:1] if plain and not self.rtl else None
        if score is not None:
            # A root's own letters are no better than its score allows: hits of order 3 are a third of it at most.
            third = np.maximum(score + 2, 0) // 3
            hopeful = (score + 2 + third * (third - 1) // 2 > least) | wide
            order = [k for k in order if hopeful[k] or kept.more[k]]
        for k in order:
            forms = kept.rows.get(k)
            if forms is None:
                forms = kept.put(k, walk[k].word, [(f, shown, low(own(f))) for f, shown in self.forms_like(walk[k], word)])
            for form, shown, small in forms:
                # Each order has fewer hits than the one before, so the letters that occur bound the score.
                hits, gap = sum(map(small.__contains__, word)), abs(len(small) - n) - 2
                most = hits * (hits + 1) // 2 + (0 if first and small[:1] != first else n) - (gap if gap > 0 else 0)
                if most > least or not small:
                    points = self._score_low(n, word, own(form), ANY_MISMATCH, low)
                    if points > least:
                        guesses.offer(points, (form, shown))
        ranked = sorted(((s, g) for s, g in guesses.rows() if g), key=lambda x: -x[0])
        factor = (10 - self.max_diff) / 5 if self.max_diff >= 0 else 1.0
        final = []
        for k, (s, (form, shown)) in enumerate(ranked):
            small = low(own(form))
            m, lcs = len(form), lcs_length(word, small)
            if n == m == lcs:
                final += [(s + 2000, (form, shown)), *ranked[k + 1 :]]
                break
            pairs = ngram_score(2, word, small, ANY_MISMATCH, True) + ngram_score(2, small, low(word), ANY_MISMATCH, True)
            same, swap = common_positions(word, small, low) if not wide else (0, False)
            poor = pairs < (m if sound else n + m) * factor
            score = 2 * lcs - abs(n - m) + left_common(word, small, low, self.rtl) + (same > 0) + 10 * swap + ngram_score(4, word, small, ANY_MISMATCH) + pairs - 1000 * poor
            final.append((score, (form, shown)))
        final.sort(key=lambda x: -x[0])
        old, closed = len(found), False
        for s, (form, shown) in final:
            if len(found) >= old + self.most_ngram or len(found) >= MOST or closed and s <= 1000:
                continue
            if s > 1000:
                closed = True
            elif s < -100:
                closed = True
                if len(found) > old or self.rules.get("ONLYMAXDIFF"):
                    continue
            if any(x in (shown or form) for x in found) or found and not self.valid(form):
                continue
            found.append(shown or form)
        if sound:
            self._add_heard(found, word, heard)

    def _few_roots(self, n: int, kind: int) -> bool:
        """Whether all roots of about this length have a slot, the last one first, whatever their scores."""
        key = n, kind == NONE
        if key not in self._few:
            self._few[key] = int((self._roots.wanted(kind) & (np.abs(n - self._roots.size) <= 4)).sum()) <= MOST_ROOTS - 2
        return self._few[key]

    def _best_roots(self, word: str, own, kind: int, wide: bool, heard: "_Slots") -> tuple[list[int], np.ndarray]:
        """Places of the roots most like a word, and the scores of all; fills heard with those that sound like it."""
        index, n = self._roots, len(word)
        roots = _Slots(MOST_ROOTS)
        score, open_ = index.scores(word, kind, wide) if not wide else self._scores_one_by_one(word, own, kind)
        near = open_ & (np.abs(n - index.size) <= 4) if not wide else open_
        roots.offer_all(score, np.flatnonzero(near))
        if self.phonetic:
            at = np.flatnonzero(near & (score > 2) & (np.abs(n - index.size) <= 3))
            if len(at):
                heard.offer_all(2 * index.sounds.scores(self.phonetic.code(self.case.upper(word))), at)
        return [k for k in roots.items if k is not None], score

    def _forms_near(self, word: str) -> "_Forms":
        """What similar() keeps of the forms of entries: the affixes that a word has decide on forms_like, so words with the
        same ones share them."""
        n = len(word)
        heads = [x for k in self._prefix_sizes if 0 < k < n and (x := word[:k]) in self._prefixes]
        tails = [x for k in self._suffix_sizes if 0 < k < n and (x := word[n - k :]) in self._suffixes]
        group = (*heads, "", *tails)
        kept = self._kept_forms.get(group)
        if kept is None or len(kept.rows) > MOST_KEPT:
            if len(self._kept_forms) >= MOST_GROUPS:
                self._kept_forms.clear()
            kept = self._kept_forms[group] = _Forms(len(self._walk))
        return kept

    @cached_property
    def _kept_forms(self) -> dict[tuple, "_Forms"]:
        return {}

    def _add_heard(self, found: _List, word: str, heard: "_Slots") -> None:
        low, n, walk = self.case.lower, len(word), self._walk
        rows = sorted(((s, walk[k].word) for s, k in heard.rows() if k is not None and walk[k].word), key=lambda x: -x[0])
        rows = [(s + 2 * lcs_length(word, low(w)) - abs(n - len(w)) + left_common(word, low(w), low, self.rtl), w) for s, w in rows]
        old = len(found)
        for _, w in sorted(rows, key=lambda x: -x[0]):
            if len(found) < old + MOST_SOUND and len(found) < MOST and not any(x in w for x in found) and (not found or self.valid(w)):
                found.append(w)

    def _added(self, a: Affix, cond, word: str) -> str | None:
        """A word with an affix put on; None if the rule doesn't fit."""
        if not (len(word) > len(a.strip) or not word and self.fullstrip) or cond is not None and not cond(word):
            return None
        if a.kind == "P":
            return a.append + word[len(a.strip) :] if word.startswith(a.strip) else None
        return word[: len(word) - len(a.strip)] + a.append if word.endswith(a.strip) else None

    def _lone(self, a: Affix) -> bool:
        """Whether a form with this affix stands without another one."""
        return not a.cont & ({self.needaffix, self.circumfix, self.onlyincompound} - {0})

    def forms_like(self, e: Entry, like: str | None) -> list[tuple[str, str | None]]:
        """Forms of an entry as (form, what to show in its place): all of them, or at most MOST_FORMS with affixes that
        `like` has. A ph: field gives further forms that are shown as the entry's own."""
        most = MOST_FORMS if like is not None else None
        out: list[tuple[str, str | None, bool]] = []

        def put(form: str, shown: str | None, cross: bool) -> None:
            if most is None or len(out) < most:
                out.append((form, shown, cross))

        hint = _field(e.morph, "ph:") if like is not None else None
        if not e.flags & ({self.needaffix, self.onlyincompound} - {0}):
            put(e.word, None, False)
            if hint is not None:
                put(hint, e.word, False)
        items = [x for f in sorted(e.flags) for x in self._by_flag.get(f, ())]

        def near(a: Affix) -> bool:
            if like is None or not a.append:
                return True
            return len(like) > len(a.append) and (like.startswith(a.append) if a.kind == "P" else like.endswith(a.append))

        for a, cond in items:
            if a.kind == "S" and near(a) and self._lone(a):
                form = self._added(a, cond, e.word)
                if form:
                    put(form, None, a.cross)
                    if hint is not None:
                        put(hint + a.append, form, False)
        for form, _, cross in list(out):
            if cross:
                for a, cond in items:
                    if a.kind == "P" and a.cross and near(a):
                        new = self._added(a, cond, form)
                        if new:
                            put(new, None, True)
        for a, cond in items:
            if a.kind == "P" and near(a) and self._lone(a):
                new = self._added(a, cond, e.word)
                if new:
                    put(new, None, a.cross)
        return [(f, s) for f, s, _ in out]

    # the whole answer

    def look_ahead(self, words: list[str]) -> None:
        """Find out at once which entries have forms that similar() may add for some words; for many words there are none.
        Answers are the same without this."""
        self._ahead = {}
        table = self._all_forms
        if table is None:
            return
        grams, root, size = table
        asked = {w for x in words if x is not None and self.writable(x) for w in [self.case.lower(self.clean(self.iconv(x))[0])] if w and "*" not in w}
        asked = [w for w in asked if len(w) < MOST_AHEAD and (w.isascii() or max(w) <= "\uffff") and self.case.lower(w) == w]
        for i in range(0, len(asked), 250):
            part = asked[i : i + 250]
            least = np.array([_least_of_shape(tuple(map(w.index, w))) for w in part])
            n = np.array([len(w) for w in part])
            hope = (grams.most(part) > least[:, None]) & (np.abs(n[:, None] - size) <= 4)
            found: dict[str, dict[int, None]] = {w: {} for w in part}
            for j, k in np.argwhere(hope).tolist():
                found[part[j]][root[k]] = None
            self._ahead |= {w: list(ks) for w, ks in found.items()}

    @cached_property
    def _all_forms(self) -> tuple[GramTable, list[int], np.ndarray] | None:
        """All forms of entries that similar() may offer, with the places and sizes of their roots; None if they are too many for a
        table, or if sounds, hints or the direction of writing count."""
        index, forms, root, size = self._roots, [], [], []
        if self.phonetic or len(index.hinted) or self.rtl:
            return None
        for k in np.flatnonzero(index.free).tolist():
            own = [f for f, _ in self.forms_like(self._walk[k], None)]
            forms, root, size = forms + own, root + [k] * len(own), size + [int(index.size[k])] * len(own)
            if len(forms) > MOST_IN_TABLE or "" in own:
                return None
        return (GramTable(forms, self.case.lower), root, np.array(size)) if forms else None

    def suggest(self, word: str) -> list[str]:
        """Corrections of a word, best first; also for a word that is right."""
        return self._suggest(word, ()) if self.writable(word) else []

    def _suggest(self, word: str, above: tuple) -> list[str]:
        if len(above) > 10 or word in above or self.too_long(word):
            return []
        given = self.iconv(word)
        if given != word and self.too_long(given):
            return []
        w, dots = self.clean(given)
        if not w:
            return []
        kind = self.case.kind(w)
        found, capital = self._collect(word, w, dots, kind, (*above, word))
        if self.rtl:
            found = [x[::-1] for x in found]
        if capital:
            found = [c if (c := self.case.init(x)) != word else x for x in found]
        if dots and self.rules.get("SUGSWITHDOTS"):
            found = [x + word[len(word) - dots :] for x in found]
        if kind != NONE and (self.keepcase or self.rules.get("FORBIDDENWORD")):
            found = [y for x in found if (y := self._mended(x)) is not None]
        found = list(dict.fromkeys(found))
        if self.oconv.table:
            found = [y for x in found if (y := self.oconv(x)) != word]
        return found

    def _mended(self, x: str) -> str | None:
        """A suggestion in a form that is right: as it is, in small letters or capitalised."""
        if self.spell(x) or " " in x and all(self.spell(p) for p in x.split(" ") if p):
            return x
        small = self.case.lower(x)
        return next((y for y in (small, self.case.init(small)) if self.spell(y)), None)

    def _collect(self, word: str, w: str, dots: int, kind: int, above: tuple) -> tuple[_List, bool]:
        case, found = self.case, _List()
        good = only = capital = False

        def edits(x: str) -> None:
            nonlocal good, only
            good = self._edits(found, x) or good
            only = only or found.only_compound

        if kind == NONE and self.forceucase:
            st = _State()
            st.orig_cap = True
            if self.form(w, st):
                found.append(case.init(w))
                return found, False
        if kind == NONE:
            edits(w)
            if dots:
                edits(w + ".")
        elif kind == INIT:
            capital = True
            edits(w)
            edits(case.lower(w))
        elif kind in (MIXED, MIXED_INIT):
            capital = kind == MIXED_INIT
            edits(w)
            head, dot, tail = w.partition(".")
            if dot and case.kind(tail) == INIT:
                found.insert(0, f"{head}. {tail}")
            if capital:
                edits(case.init_small(w))
            small = case.lower(w)
            if self.spell(small):
                found.insert(0, small)
            n = len(found)
            edits(small)
            if capital:
                small = case.init(small)
                if self.spell(small):
                    found.insert(0, small)
                edits(small)
            for j in range(n, len(found)):
                first, space, second = found[j].partition(" ")
                if space and len(second) < len(w) and w[len(w) - len(second) :] != second:
                    del found[j]
                    found.insert(0, f"{first} {case.init(second)}")
        else:
            small = case.lower(w)
            edits(small)
            if self.keepcase and self.spell(small):
                found.insert(0, small)
            edits(case.init(small))
            found[:] = [case.upper(x).replace("ß", "SS") if self.rules.get("CHECKSHARPS") else case.upper(x) for x in found]
        if self.hungarian:
            for j, x in enumerate(found):
                if "-" in x:
                    st = _State()
                    self._check(x.replace("-", "", 1), st, ())
                    if st.compound and st.forbidden:
                        found[j] = x.replace("-", " ", 1)
        if not good and (not found or only) and self.most_ngram:
            n = len(found)
            capital = capital or kind in (MIXED_INIT, INIT)
            self.similar(found, w if kind == NONE else case.lower(w), kind)
            if kind == ALL:
                found[n:] = [case.upper(x) for x in found[n:]]
        if "-" in w and not good and not any("-" in x for x in found):
            self._by_dash(found, word, w, above)
        return found, capital

    def _by_dash(self, found: _List, word: str, w: str, above: tuple) -> None:
        """The first wrong part between dashes, corrected."""
        at = 0
        for part in w.split("-"):
            if part != word and not self.spell(part):
                for x in reversed(self._suggest(part, above)):
                    whole = w[:at] + x + w[at + len(part) :]
                    st = _State()
                    if self.rules.get("FORBIDDENWORD"):
                        self.form(whole, st)
                    if not st.forbidden:
                        found.insert(0, whole)
                return
            at += len(part) + 1


class _RootIndex:
    """The lexicon in walking order, indexed: what a word's score with every entry is, and which entries count."""

    def __init__(self, e: Suggester):
        walk, low = e._walk, e.case.lower
        words, hints = [x.word for x in walk], [_field(x.morph, "ph:") for x in walk]
        self.size = np.array([len(w) for w in words], np.int64)
        self.grams, self.starts = GramIndex([low(w) for w in words]), Beginnings(words, low, e.rtl)
        self.hinted = np.array([k for k, h in enumerate(hints) if h is not None], np.int64)
        told = [h for h in hints if h is not None]
        self.hint_grams, self.hint_starts = GramIndex([low(h) for h in told]), Beginnings(told, low, e.rtl)
        if e.phonetic:
            self.sounds = GramIndex([e.phonetic.code(e.case.upper(w)) for w in words])
        refused = {e.forbidden_flag, ONLY_UPCASE, e.nosuggest, e.nongramsuggest, e.onlyincompound} - {0}
        self.free = np.array([not x.flags & refused for x in walk], bool)
        # Capitalised entries are no candidates for words in small letters, unless sounds or hints are used, or in German.
        names = e.phonetic is None and not e.lang.startswith("de")
        self.small = self.free & ~np.array([names and h is None and e.case.kind(w) == INIT for w, h in zip(words, hints)], bool)

    def wanted(self, kind: int) -> np.ndarray:
        return self.small if kind == NONE else self.free

    def scores(self, word: str, kind: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        out = self.grams.scores(word) + self.starts.common(word)
        if len(self.hinted):
            out[self.hinted] = np.maximum(out[self.hinted], self.hint_grams.scores(word) + self.hint_starts.common(word))
        return out, self.wanted(kind)


class _Forms:
    """Forms of entries, by place: rows (form, what to show, small letters), and which entries may have others than their
    own letters or a hint's, whose score is the root's; so those not looked at yet, too."""

    def __init__(self, n: int):
        self.rows, self.more = {}, np.ones(n, bool)

    def put(self, k: int, word: str, rows: list) -> list:
        self.rows[k], self.more[k] = rows, any(form != word and shown != word for form, shown, _ in rows)
        return rows


class _Slots:
    """The best items by score. A new one takes the place of the first of the lowest, if it is better than that."""

    def __init__(self, n: int):
        self.scores, self.items, self.low, self.used = list(_free(n)), [None] * n, n - 1, False

    def offer(self, score: int, item) -> None:
        if score > self.scores[self.low]:
            self.scores[self.low], self.items[self.low], self.used = score, item, True
            least = min(self.scores)
            if least < score:
                self.low = self.scores.index(least)

    def offer_all(self, score: np.ndarray, at: np.ndarray) -> None:
        """Offer places by their scores, to slots that are all free. The first ones fill them from the last slot on."""
        n, head = len(self.items), at[: len(self.items) - 2]
        if len(head) and score[head].min() > -100:
            k = n - len(head)
            self.scores[k:], self.items[k:], self.low, self.used = score[head][::-1].tolist(), head[::-1].tolist(), k - 1, True
            at = at[len(head) :]
        for k in self.better(score, at):
            self.offer(int(score[k]), k)

    def better(self, score: np.ndarray, at: np.ndarray) -> Iterator[int]:
        """Of the places `at`, those whose score beats the lowest slot's when their turn comes."""
        step = 512
        for i in range(0, len(at), step):
            part = at[i : i + step]
            for k in part[score[part] > self.scores[self.low]].tolist():
                if score[k] > self.scores[self.low]:
                    yield k

    def rows(self):
        return zip(self.scores, self.items)


def _least(word: str, low) -> int:
    """The score from which a form is a guess: that of the word itself with every fourth letter hidden, a little less."""
    total = 0
    for k in (1, 2, 3):
        masked = "".join("*" if i >= k and (i - k) % 4 == 0 else c for i, c in enumerate(word))
        total += ngram_score(len(word), word, low(masked), ANY_MISMATCH)
    return int(total / 3) - 1


@lru_cache(maxsize=100_000)
def _least_of_shape(shape: tuple) -> int:
    """_least of a word in small letters without asterisks: only where equal letters stand counts."""
    return _least("".join(chr(0x4E00 + k) for k in shape), str)


@lru_cache(maxsize=10)
def _free(n: int) -> tuple[int, ...]:
    return tuple(-100 * k for k in range(n))


@lru_cache(maxsize=100_000)
def _field(morph: str, name: str) -> str | None:
    """The first value of a morphological field."""
    k = morph.find(name)
    return morph[k + len(name) :].split(None, 1)[0] if k >= 0 and morph[k + len(name) :].strip() else None


def _slot(data: bytes) -> int:
    """The hash whose slots set the order of equal scores: four signed bytes, then rotate by five and mix, in 64 bits."""
    h, full = 0, (1 << 64) - 1
    for k, b in enumerate(data):
        signed = (b - 256 if b > 127 else b) & full
        h = (h << 8 | signed) & full if k < 4 else ((h << 5 | h >> 27 & 31) & full) ^ signed
    return h
