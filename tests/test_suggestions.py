"""The indexed search for similar words against a scan of the whole lexicon."""

import random

import numpy as np
import pytest

from lexloom.functions.grams import Beginnings, GramIndex
from lexloom.functions.similar import LONGER_WORSE, left_common, ngram_score
from lexloom.operators import suggester
from lexloom.plans import invented, mini
from lexloom.plans.dictionary import Dictionary


@pytest.mark.parametrize("from_end", [False, True])
def test_index_scores_are_the_scan_s(from_end):
    r = random.Random(1)
    words = [w.capitalize() if k % 7 == 0 else w for k, w in enumerate(invented.words(400))] + ["", "é", "Éa", "aaaa"]
    grams, starts = GramIndex([w.lower() for w in words]), Beginnings(words, str.lower, from_end)
    for w in r.sample(words, 60) + ["qx", "a", "aaa", "Éa"]:
        assert grams.scores(w).tolist() == [ngram_score(3, w, x.lower(), LONGER_WORSE) for x in words]
        assert starts.common(w).tolist() == [left_common(w, x, str.lower, from_end) for x in words]


@pytest.mark.parametrize("head", ["", "PHONE 4\nPHONE PH F\nPHONE TH 0\nPHONE K C\nPHONE S$ _\n", "MAXDIFF 4\nONLYMAXDIFF\n", "LANG de_DE\n"])
def test_suggestions_are_the_scan_s(monkeypatch, head):
    """The same answers if every score is computed word by word and offered in the lexicon's order."""
    r = random.Random(2)
    aff, dic = invented.files(700)
    n, *lines = dic.splitlines()
    lines = [w.capitalize() if r.random() < 0.1 else w + (f"\tph:{r.choice(lines).split('/')[0]}" if r.random() < 0.05 else "") for w in lines]
    e = Dictionary.parse(aff + head, "\n".join([n, *lines]) + "\n").engine
    words = ["".join(r.sample(w, len(w))) if r.random() < 0.2 else w[:-1] + "q" for w in r.sample(invented.words(2000), 60)] + ["Katoq", "KATOQ", "\U0001f600abka", "x", "zzzzqqqq"]
    fast = [e.suggest(w) for w in words]

    def scan(self, word):
        return np.array([ngram_score(3, word, x, LONGER_WORSE) for x in self.words])

    made = GramIndex.__init__

    def keep(self, words, order=3):
        made(self, words, order)
        self.words = words

    monkeypatch.setattr(GramIndex, "__init__", keep)
    monkeypatch.setattr(GramIndex, "scores", scan)
    monkeypatch.setattr(suggester._Slots, "better", lambda self, score, at: iter(at.tolist()))
    e.__dict__.pop("_rooted", None)
    assert [e.suggest(w) for w in words] == fast and any(fast)


@pytest.mark.parametrize("entries", [40, 150])
@pytest.mark.parametrize("head", ["", "LANG de_DE\nMAP 1\nMAP ae\n", "COMPOUNDFLAG C\nNOSUGGEST !\n"])
def test_listed_forms_and_looking_ahead_change_nothing(entries, head):
    """The same answers as from looking every candidate up through the affixes, word by word."""
    r = random.Random(entries)
    aff, dic = invented.files(entries)
    n, *lines = dic.splitlines()
    lines = [w.capitalize() if r.random() < 0.1 else w + (r.choice("C!") if "/" in w and r.random() < 0.3 else "") for w in lines] + ["ab cd", "ef-gh", "ka"]
    fast, slow = (Dictionary.parse(aff + head, "\n".join([n, *lines]) + "\n").engine for _ in range(2))
    slow.__dict__ |= {"_near": None, "_all_forms": None}
    base = [x for w in slow.listed() for x in slow.expand(w)]
    words = ["", ".", "*", "x", "ka*k", "É", "\U0001f600abka"]
    for _ in range(20 if "COMPOUND" in head else 100):
        w = list(r.choice(base))
        for _ in range(r.choice((1, 1, 2, 3))):
            k, i = r.randrange(5), r.randrange(len(w) + 1)
            w[i:i] = [r.choice("aeknté-. ")] if k == 0 else [r.choice(w or "a")] if k == 1 else list(r.choice(base)) if k == 2 else []
            if k > 2 and w:
                c = w.pop(r.randrange(len(w)))
                w[i:i] = [c] if k == 3 else []
        words.append(r.choice((str, str, str.upper, str.capitalize))("".join(w)))
    fast.look_ahead([*words, None])
    assert [fast.suggest(w) for w in words] == [slow.suggest(w) for w in words]


def test_candidates_are_not_looked_up_one_by_one(monkeypatch):
    """Edits of a word were hundreds of lookups through all affixes; the forms of a dictionary are now listed once."""
    e = mini.dictionary().engine
    words = ["ananreat", "shth", "enthstorha", "moev", "onse"]
    first, calls = [e.suggest(w) for w in words], []
    entries = type(e).entries
    monkeypatch.setattr(type(e), "entries", lambda self, word: calls.append(word) or entries(self, word))
    assert [e.suggest(w) for w in words] == first and not calls
