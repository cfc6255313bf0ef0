"""Cases where the original's behaviour is easy to miss."""

from lexloom.functions.phonetic import Phonetic
from lexloom.functions.tokens import tokenize
from lexloom.plans.dictionary import search_paths


def test_letters_with_longer_small_forms_move_nothing_in_latex():
    assert [t.word for t in tokenize("\u0130\u0130\u0130\u0130 \\cite{abc} word", "latex")] == ["\u0130\u0130\u0130\u0130", "word"]


def test_only_some_entities_are_letters():
    assert [t.word for t in tokenize("caf&agrave;s caf&eacute;s", "html")] == ["caf&agrave;s", "caf", "s"]


def test_a_rule_that_feeds_back_takes_the_repeated_letter():
    rules = [("A", "A"), ("B", "B"), ("XB<", "B")]
    assert Phonetic(rules).code("AXB") == "AB"
    assert Phonetic([*rules, ("C", "B")]).code("CXB") == "B"


def test_search_folders(monkeypatch, tmp_path):
    (tmp_path / "dict-b").mkdir()
    (tmp_path / "dict-a").mkdir()
    (tmp_path / "other").mkdir()
    monkeypatch.setenv("XDG_DATA_HOME", "/data/own")
    monkeypatch.setenv("XDG_DATA_DIRS", "/data/x:relative")
    monkeypatch.setenv("DICPATH", "/dics")
    got = search_paths("/mine", (str(tmp_path),))
    assert got[:6] == ["/mine", ".", "/dics", "/data/own/hunspell", "/data/x/hunspell", "/usr/share/hunspell"]
    assert got[-2:] == [str(tmp_path / "dict-a"), str(tmp_path / "dict-b")] and "relative/hunspell" not in got
    monkeypatch.setenv("XDG_DATA_HOME", "relative")
    monkeypatch.delenv("XDG_DATA_DIRS")
    assert {"/usr/local/share/hunspell", "/usr/share/hunspell"} <= set(search_paths())
