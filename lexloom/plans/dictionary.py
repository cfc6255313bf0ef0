"""The dictionary as Spark sees it: immutable, versioned by its content, small tables on one side, an engine on the other."""

from __future__ import annotations

import copy
import hashlib
import os
import pickle
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators.analyzer import Analyzer
from lexloom.sources.rules import Entry, Rules, condition_regex, number, parse_lexicon, parse_rules, read_lines

_ENGINES: OrderedDict[str, Analyzer] = OrderedDict()
KEPT_ENGINES = 16


@dataclass(frozen=True)
class Dictionary:
    """Rules, entries and later changes. Changing methods return another dictionary."""

    rules: Rules
    entries: tuple = ()
    changes: tuple = ()
    messages: tuple = ()
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    # opening

    @staticmethod
    def parse(aff: bytes | str, dic: bytes | str) -> "Dictionary":
        """From the contents of a rule file and a lexicon."""
        aff, dic = (x.encode() if isinstance(x, str) else x for x in (aff, dic))
        rules = parse_rules(aff)
        entries = parse_lexicon(dic, rules)
        rules.options["_count0"] = max(1, number(read_lines(dic, rules.charset)[0]))
        return Dictionary(rules, tuple(entries), (), tuple(rules.messages))

    @staticmethod
    def open(aff: str, dic: str) -> "Dictionary":
        """From local files; a compressed file of the same name with .hz is taken if a file is missing."""
        from lexloom.sources.compressed import read_file

        return Dictionary.parse(read_file(aff), read_file(dic))

    @staticmethod
    def load(spark: SparkSession, aff: str, dic: str) -> "Dictionary":
        """From any store that Spark reads."""
        rows = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load([aff, dic]).select("path", "content").collect()}  # two files
        by_end = {p.rsplit("/", 1)[-1]: c for p, c in rows.items()}
        return Dictionary.parse(by_end[aff.rsplit("/", 1)[-1]], by_end[dic.rsplit("/", 1)[-1]])

    def add_lexicon(self, dic: bytes | str) -> "Dictionary":
        """With a further lexicon under the same rules; earlier ones win where both have a word."""
        dic = dic.encode() if isinstance(dic, str) else dic
        n = max((e.dic for e in self.entries), default=-1) + 1
        rules = copy.deepcopy(self.rules)
        more = parse_lexicon(dic, rules, n, len(self.entries))
        rules.options[f"_count{n}"] = max(1, number(read_lines(dic, rules.charset)[0]))
        return Dictionary(rules, (*self.entries, *more), self.changes, self.messages)

    # changes

    def _with(self, *change) -> "Dictionary":
        return Dictionary(self.rules, self.entries, (*self.changes, change), self.messages)

    def add(self, word: str) -> "Dictionary":
        """With a word; a removed one comes back."""
        return self._with("add", word)

    def add_with_flags(self, word: str, flags: str, morph: str = "") -> "Dictionary":
        return self._with("add", word, self.rules.flags(flags) if flags else frozenset(), morph)

    def add_like(self, word: str, example: str) -> "Dictionary":
        """With a word that takes the affixes of an example."""
        return self._with("like", word, example)

    def remove(self, word: str) -> "Dictionary":
        """Without a word: all its homonyms are forbidden."""
        return self._with("remove", word)

    def add_personal(self, text: str) -> "Dictionary":
        """With the lines of a personal dictionary: word, word/example or *word (forbidden)."""
        out = self
        for line in text.splitlines():
            line = line.strip()
            if line.startswith("*") and len(line) > 1:
                out = out.add(line[1:]).remove(line[1:])
            elif line:
                word, slash, example = line.partition("/")
                out = out.add_like(word, example) if slash and example and word else out.add(line)
        return out

    # asking

    @cached_property
    def payload(self) -> bytes:
        return pickle.dumps((self.rules, self.entries, self.changes), protocol=5)

    @cached_property
    def version(self) -> str:
        return hashlib.sha256(self.payload).hexdigest()

    @property
    def engine(self) -> Analyzer:
        return engine_of(self.version, self.payload)

    @property
    def encoding(self) -> str:
        return self.rules.charset

    @property
    def language(self) -> str:
        return self.rules.get("LANG", "")

    @property
    def wordchars(self) -> str:
        return self.rules.get("WORDCHARS", "")

    @property
    def has_simple_rules(self) -> bool:
        """Whether one prefix and one suffix on listed words is all there is, so that joins alone decide."""
        r = self.rules
        plain = not (self.changes or r.iconv or r.oconv or r.compound_rules or r.get("COMPOUNDFLAG") or r.get("COMPOUNDBEGIN") or r.get("IGNORE"))
        marks = ("COMPLEXPREFIXES", "CHECKSHARPS", "FORBIDDENWORD", "NEEDAFFIX", "KEEPCASE", "ONLYINCOMPOUND", "CIRCUMFIX", "WARN", "FULLSTRIP")
        return plain and not any(r.get(x) for x in marks) and not any(a.cont for a in r.affixes) and not self.engine.case.turkic and {e.dic for e in self.entries} <= {0}

    def words(self) -> list[str]:
        return self.engine.listed()

    # tables

    def lexicon(self, spark: SparkSession) -> DataFrame:
        """One row per entry, hidden capitalised ones included."""
        from lexloom.sources.rules import ONLY_UPCASE

        e = self.engine
        rows, seen = [], {}
        for k, x in enumerate(e.order):
            n = seen[x.word] = seen.get(x.word, -1) + 1
            rows.append((x.dic, k, x.word, sorted(x.flags - {ONLY_UPCASE}), x.morph or None, ONLY_UPCASE in x.flags, n))
        return spark.createDataFrame(rows, LEXICON)

    def affixes(self, spark: SparkSession) -> DataFrame:
        rows = [(a.seq, a.kind, a.flag, a.strip, a.append, condition_regex(a.cond, a.kind) or None, a.cross, sorted(a.cont), a.morph or None, a.line) for a in self.rules.affixes]
        return spark.createDataFrame(rows, AFFIXES)

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, k, m) for k, m in enumerate(self.messages)], "dict_id string, seq int, message string")


LEXICON = "dic_no int, entry_no int, word string, flags array<int>, morph string, hidden boolean, homonym_no int"
AFFIXES = "seq int, kind string, flag int, strip string, append string, cond string, cross boolean, cont array<int>, morph string, line int"


def engine_of(version: str, payload: bytes) -> Analyzer:
    """The engine of a dictionary, built once for each process."""
    if version in _ENGINES:
        _ENGINES.move_to_end(version)
        return _ENGINES[version]
    rules, entries, changes = pickle.loads(payload)
    _ENGINES[version] = e = Analyzer(rules, list(entries), changes)
    while len(_ENGINES) > KEPT_ENGINES:
        _ENGINES.popitem(last=False)
    return e


class DictionaryCache:
    """Dictionaries by key and version, the least recently used going first. A loader gives (aff, dic) bytes for a key."""

    def __init__(self, loader: Callable[[str], tuple[bytes, bytes]], most: int = 16):
        self.loader, self.most, self._held = loader, most, OrderedDict()

    def get(self, key: str, version: str = "") -> Dictionary:
        if (key, version) not in self._held:
            self._held[key, version] = Dictionary.parse(*self.loader(key))
            while len(self._held) > self.most:
                self._held.popitem(last=False)
        self._held.move_to_end((key, version))
        return self._held[key, version]

    def use(self, key: str, version: str, fn: Callable[[Dictionary], object]):
        return fn(self.get(key, version))

    def check(self, key: str, version: str, word: str):
        return self.get(key, version).engine.check(word)

    def suggest(self, key: str, version: str, word: str) -> list[str]:
        return self.get(key, version).engine.suggest(word)

    def invalidate(self, key: str) -> None:
        for k in [k for k in self._held if k[0] == key]:
            del self._held[k]

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


#: The folder inside each data folder, the usual system folders, and where office extensions are installed.
DATA_SUBFOLDER = "hunspell"
SYSTEM_FOLDERS = ("/usr/share/hunspell", "/usr/share/myspell", "/usr/share/myspell/dicts", "/Library/Spelling")
HOME_FOLDERS = ("Library/Spelling",)
OFFICE_FOLDERS = ("/opt/libreoffice/share/extensions", "/usr/lib/libreoffice/share/extensions", "/usr/lib64/libreoffice/share/extensions")
DEFAULT_DATA_FOLDERS = "/usr/local/share:/usr/share"


def search_paths(extra: str = "", office: tuple[str, ...] = OFFICE_FOLDERS) -> list[str]:
    """Folders to look for dictionaries in, each once: those given and the current one, those named in DICPATH, the user's
    and the system's data folders, the usual folders, and the dict-* folders of office extensions, sorted."""
    env, home = os.environ, os.path.expanduser("~")
    own = env.get("XDG_DATA_HOME", "")
    data = [own] if os.path.isabs(own) else [os.path.join(home, ".local", "share")] if home != "~" else []
    data += [d for d in (env.get("XDG_DATA_DIRS") or DEFAULT_DATA_FOLDERS).split(os.pathsep) if os.path.isabs(d)]
    found = [*extra.split(os.pathsep), ".", *env.get("DICPATH", "").split(os.pathsep), *(os.path.join(d, DATA_SUBFOLDER) for d in data), *SYSTEM_FOLDERS]
    found += [os.path.join(home, d) for d in HOME_FOLDERS if home != "~"]
    for folder in office:
        if os.path.isdir(folder):
            found += sorted(p for d in os.listdir(folder) if d.startswith("dict-") and os.path.isdir(p := os.path.join(folder, d)))
    return list(dict.fromkeys(p for p in found if p))


def available(paths: list[str]) -> list[str]:
    """Names of dictionaries that have both files, sorted; hyphenation tables are not dictionaries."""
    names = set()
    for p in paths:
        if os.path.isdir(p):
            here = set(os.listdir(p))
            names |= {f[:-4] for f in here if f.endswith(".dic") and not f.startswith("hyph_") and (f[:-4] + ".aff") in here}
    return sorted(names)


def find(name: str, paths: list[str]) -> tuple[str, str] | None:
    """The files of a dictionary in the first folder that has both."""
    for p in paths:
        aff, dic = os.path.join(p, name + ".aff"), os.path.join(p, name + ".dic")
        if os.path.isfile(aff) and os.path.isfile(dic):
            return aff, dic
    return None


def load(name: str, paths: list[str] | None = None) -> Dictionary:
    found = find(name, paths or search_paths())
    if not found:
        raise FileNotFoundError(f"no dictionary {name}")
    return Dictionary.open(*found)


__all__ = ["AFFIXES", "Dictionary", "DictionaryCache", "Entry", "LEXICON", "available", "find", "load", "search_paths"]
