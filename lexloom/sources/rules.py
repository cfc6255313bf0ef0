"""Reader of rule files (.aff) and lexicons (.dic): bytes to plain records, with diagnostics instead of exceptions.

Everything is Unicode from here on: the file's character set is applied once, when it is read.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field

#: Flags from here on mean "unset"; the defaults of two of them; the default keyboard rows.
DEFAULT_FORBIDDEN, ONLY_UPCASE = 65510, 65511
KEYBOARD = "qwertyuiop|asdfghjkl|zxcvbnm"
DEFAULT_BREAKS = ("-", "^-", "-$")

#: Names that differ from Python's codec names.
CHARSETS = {"microsoft-cp1251": "cp1251", "cp1251": "cp1251", "tis620-2533": "tis-620", "iscii-devanagari": "latin-1", "utf-8": "utf-8"}

#: Options that hold one flag.
FLAG_OPTIONS = {
    "COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND", "COMPOUNDLAST", "COMPOUNDROOT", "COMPOUNDPERMITFLAG", "COMPOUNDFORBIDFLAG",
    "ONLYINCOMPOUND", "NEEDAFFIX", "PSEUDOROOT", "CIRCUMFIX", "KEEPCASE", "NOSUGGEST", "NONGRAMSUGGEST", "FORBIDDENWORD", "LEMMA_PRESENT",
    "FORCEUCASE", "WARN", "SUBSTANDARD", "SYLLABLENUM",
}
#: Options that are on when they are named.
SWITCHES = {
    "COMPLEXPREFIXES", "COMPOUNDMORESUFFIXES", "CHECKCOMPOUNDDUP", "CHECKCOMPOUNDREP", "CHECKCOMPOUNDCASE", "CHECKCOMPOUNDTRIPLE", "SIMPLIFIEDTRIPLE",
    "FULLSTRIP", "CHECKSHARPS", "NOSPLITSUGS", "SUGSWITHDOTS", "ONLYMAXDIFF", "FORBIDWARN", "CHECKNUM",
}
NUMBERS = {"COMPOUNDMIN", "COMPOUNDWORDMAX", "MAXNGRAMSUGS", "MAXCPDSUGS", "MAXDIFF"}
TEXTS = {"KEY", "TRY", "WORDCHARS", "LANG", "IGNORE"}


@dataclass(frozen=True)
class Affix:
    """A rule: take `strip` off an entry that matches `cond` and has `flag`, put `append` on."""

    kind: str  # P or S
    seq: int
    flag: int
    strip: str
    append: str
    cont: frozenset
    cond: str
    cross: bool
    morph: str
    line: int


@dataclass
class Rules:
    """A rule file. Tables keep the file's order."""

    charset: str = "latin-1"
    flag_mode: str = "char"
    options: dict = field(default_factory=dict)
    affixes: list = field(default_factory=list)
    rep: list = field(default_factory=list)  # (pattern, (mid, initial, final, isolated))
    maps: list = field(default_factory=list)  # lists of strings
    breaks: list | None = None
    compound_rules: list = field(default_factory=list)  # lists of (flag, "" or * or ?)
    compound_patterns: list = field(default_factory=list)  # (first, flag, second, flag, replacement)
    phone: list = field(default_factory=list)  # (pattern, replacement)
    iconv: list = field(default_factory=list)  # (pattern, replacement)
    oconv: list = field(default_factory=list)
    syllables: tuple = (0, "")  # most, vowels
    flag_alias: list = field(default_factory=list)
    morph_alias: list = field(default_factory=list)
    version: str = ""
    messages: list = field(default_factory=list)

    def get(self, name: str, default=0):
        return self.options.get(name, default)

    def flags(self, text: str) -> frozenset:
        """The flags of a flag field, in the file's syntax."""
        if self.flag_alias and text.isdigit():
            n = int(text)
            if 1 <= n <= len(self.flag_alias):
                return self.flag_alias[n - 1]
            self.messages.append(f"bad flag alias {text}")
            return frozenset()
        return self.decode_flags(text)

    def decode_flags(self, text: str) -> frozenset:
        if self.flag_mode == "long":
            if len(text) % 2:
                self.messages.append(f"odd number of flag characters: {text}")
            return frozenset((ord(a) << 8) + ord(b) for a, b in zip(text[::2], text[1::2]))
        if self.flag_mode == "num":
            out = set()
            for x in text.split(","):
                n = number(x)
                if 0 < n < 65536:
                    out.add(n)
                else:
                    self.messages.append(f"bad flag number {x}")
            return frozenset(out)
        return frozenset(map(ord, text))

    def flag(self, text: str) -> int:
        """One flag; 0 if there is none."""
        if self.flag_mode == "num":
            return number(text)
        if self.flag_mode == "long":
            return (ord(text[0]) << 8) + ord(text[1]) if len(text) > 1 else ord(text[0]) if text else 0
        return ord(text[0]) if text else 0

    def spell_flag(self, flag: int) -> str:
        """A flag as the file writes it."""
        if self.flag_mode == "num":
            return str(flag)
        return chr(flag >> 8) + chr(flag & 255) if self.flag_mode == "long" else chr(flag)


def number(text: str) -> int:
    """Leading integer of a text, 0 if there is none, held to 32 bits."""
    m = re.match(r"\s*([+-]?\d+)", text)
    return max(-(2**31), min(2**31 - 1, int(m[1]))) if m else 0


def codec_of(name: str) -> str:
    """Python's codec for a character set's name; unknown names read as Latin-1."""
    key = name.strip().lower()
    key = CHARSETS.get(key, key.replace("iso8859", "iso-8859"))
    try:
        return codecs.lookup(key).name
    except LookupError:
        return "latin-1"


def _decode(data: bytes, codec: str) -> str:
    if codec == "utf-8":
        return data.decode("utf-8", "replace")
    return data.decode(codec, "replace")


def read_lines(data: bytes, codec: str) -> list[str]:
    if data.startswith(codecs.BOM_UTF8):
        data = data[3:]
    lines = _decode(data, codec).replace("\r\n", "\n").split("\n")
    return [line.split("\0")[0].rstrip("\r") for line in lines]


def parse_rules(data: bytes) -> Rules:
    """Read a rule file. A directive that can't be read ends the reading there; what came before stays."""
    found = re.search(rb"^(?:\xef\xbb\xbf)?SET[ \t]+(\S+)", data, re.M)
    r = Rules(charset=codec_of(found[1].decode("latin-1")) if found else "latin-1")
    mode = re.search(rb"^(?:\xef\xbb\xbf)?FLAG[ \t]+(\S+)", data, re.M)
    if mode:
        r.flag_mode = {"long": "long", "num": "num"}.get(mode[1].decode("latin-1").lower(), "char")
    if re.search(rb"^(?:\xef\xbb\xbf)?LANG[ \t]+(\S+)", data, re.M) is None:
        r.options["LANG"] = ""
    lines = read_lines(data, r.charset)
    at = 0
    try:
        while at < len(lines):
            at = _directive(r, lines, at)
    except (ValueError, IndexError) as e:
        r.messages.append(f"line {at + 1}: {e or 'bad line'}")
    return r


def _table(lines: list[str], at: int, name: str) -> tuple[list[list[str]], int]:
    """The rows of a counted table whose header is line `at`, and the line after them."""
    head = lines[at].split()
    if len(head) < 2:
        raise ValueError(f"{name} has no count")
    n = number(head[1])
    if n < 1:
        raise ValueError(f"{name} has a bad count")
    rows, k = [], at + 1
    while len(rows) < n:
        if k >= len(lines):
            raise ValueError(f"{name} has too few rows")
        row = lines[k].split()
        if not row or row[0] != name:
            raise ValueError(f"{name} row expected")
        rows.append(row[1:])
        k += 1
    return rows, k


def _directive(r: Rules, lines: list[str], at: int) -> int:
    """Read the directive at a line; the number of the next line."""
    row = lines[at].split()
    if not row or row[0].startswith("#"):
        return at + 1
    name = row[0]
    value = row[1] if len(row) > 1 else ""
    if name in FLAG_OPTIONS:
        name = {"PSEUDOROOT": "NEEDAFFIX", "COMPOUNDLAST": "COMPOUNDEND"}.get(name, name)
        if name == "SYLLABLENUM":
            r.options[name] = value
        elif value and not (name in r.options and r.options[name]):
            r.options[name] = r.flag(value)
    elif name in SWITCHES:
        r.options[name] = True
    elif name in NUMBERS:
        r.options[name] = max(number(value), 1 if name == "COMPOUNDMIN" else 0)
    elif name in TEXTS:
        r.options.setdefault(name, value) if name != "LANG" else r.options.__setitem__(name, value)
    elif name == "VERSION":
        r.version = lines[at].split(None, 1)[1].strip() if value else ""
    elif name == "COMPOUNDSYLLABLE":
        r.syllables = (number(value), row[2] if len(row) > 2 else "AEIOUaeiou")
    elif name in ("AF", "AM"):
        rows, k = _table(lines, at, name)
        for i, x in enumerate(rows):
            if name == "AF":
                r.flag_alias.append(r.decode_flags(x[0]) if x else frozenset())
            else:
                r.morph_alias.append(lines[at + 1 + i].split(None, 1)[1].strip() if x else "")
        return k
    elif name == "REP":
        rows, k = _table(lines, at, name)
        for x in rows:
            if len(x) < 2:
                raise ValueError("REP row needs two fields")
            add_rep(r, x[0], x[1])
        return k
    elif name in ("ICONV", "OCONV"):
        rows, k = _table(lines, at, name)
        for x in rows:
            if len(x) < 2:
                raise ValueError(f"{name} row needs two fields")
            (r.iconv if name == "ICONV" else r.oconv).append((x[0], x[1].replace("_", " ")))
        return k
    elif name == "PHONE":
        rows, k = _table(lines, at, name)
        r.phone += [(x[0], x[1].replace("_", "") if len(x) > 1 else "") for x in rows if x]
        return k
    elif name == "MAP":
        rows, k = _table(lines, at, name)
        r.maps += [re.findall(r"\(([^)]*)\)|(.)", x[0]) for x in rows if x]
        r.maps = [[a or b for a, b in x] if x and isinstance(x[0], tuple) else x for x in r.maps]
        return k
    elif name == "BREAK":
        if number(value) == 0:
            r.breaks = []
            return at + 1
        rows, k = _table(lines, at, name)
        r.breaks = [x[0] for x in rows if x]
        return k
    elif name == "COMPOUNDRULE":
        rows, k = _table(lines, at, name)
        r.compound_rules += [_compound_rule(r, x[0]) for x in rows if x]
        return k
    elif name == "CHECKCOMPOUNDPATTERN":
        rows, k = _table(lines, at, name)
        for x in rows:
            first, _, f1 = x[0].partition("/")
            second, _, f2 = x[1].partition("/") if len(x) > 1 else ("", "", "")
            r.compound_patterns.append((first, r.flag(f1), second, r.flag(f2), x[2] if len(x) > 2 else ""))
        return k
    elif name in ("PFX", "SFX"):
        return _affix_block(r, lines, at)
    return at + 1


def add_rep(r: Rules, pattern: str, out: str) -> None:
    """Add a replacement; ^ and $ tie it to the start and end, _ is a space."""
    kind = (1 if pattern.startswith("^") else 0) + (2 if pattern.endswith("$") and len(pattern) > 1 else 0)
    pattern = pattern[1:] if kind & 1 else pattern
    pattern = (pattern[:-1] if kind & 2 else pattern).replace("_", " ")
    if not pattern:
        return
    outs = ["", "", "", ""]
    outs[kind] = out.replace("_", " ")
    r.rep.append((pattern, tuple(outs)))


def _compound_rule(r: Rules, text: str) -> list[tuple[int, str]]:
    """Flags with their quantifiers; flags of more characters stand in parentheses."""
    out = []
    if "(" in text:
        for inside, one in re.findall(r"\(([^)]*)\)|(.)", text):
            if one in ("*", "?") and out:
                out[-1] = (out[-1][0], one)
            elif inside:
                out += [(f, "") for f in sorted(r.decode_flags(inside))]
            elif one:
                out.append((r.flag(one), ""))
        return out
    units = [text[i : i + 2] if r.flag_mode == "long" and text[i] not in "*?" else text[i] for i in range(len(text))] if r.flag_mode != "long" else re.findall(r"[*?]|..", text)
    for u in units:
        if u in ("*", "?") and out:
            out[-1] = (out[-1][0], u)
        else:
            out.append((r.flag(u), ""))
    return out


def _affix_block(r: Rules, lines: list[str], at: int) -> int:
    head = lines[at].split()
    if len(head) < 4:
        raise ValueError("affix header needs four fields")
    kind, flag, cross, n = head[0][0], r.flag(head[1]), head[2] == "Y", number(head[3])
    rtl = bool(r.get("COMPLEXPREFIXES", False))
    ignore = r.get("IGNORE", "")
    k = at + 1
    for _ in range(max(0, n)):
        if k >= len(lines):
            raise ValueError("affix block is too short")
        raw = lines[k]
        row = raw.split()
        if len(row) < 4 or row[0] != head[0] or r.flag(row[1]) != flag:
            raise ValueError(f"affix row expected: {raw.strip()}")
        strip = "" if row[2] == "0" else row[2]
        append, _, cont = row[3].partition("/")
        append = "" if append == "0" else append
        cond = row[4] if len(row) > 4 else "."
        morph = raw.split(None, 5)[5].strip() if len(row) > 5 else ""
        if r.morph_alias and morph.isdigit() and 1 <= int(morph) <= len(r.morph_alias):
            morph = r.morph_alias[int(morph) - 1]
        if ignore:
            append = "".join(c for c in append if c not in ignore)
            strip = "".join(c for c in strip if c not in ignore)
        real = kind
        if rtl:  # words are kept reversed, so the sides change places
            real = "S" if kind == "P" else "P"
            strip, append, cond = strip[::-1], append[::-1], reverse_condition(cond)
            morph = morph[::-1] if morph else morph
        r.affixes.append(Affix(real, len(r.affixes), flag, strip, append, r.flags(cont) if cont else frozenset(), cond, cross, morph, k + 1))
        k += 1
    return k


def condition_parts(cond: str) -> list[str]:
    """A condition's places: a character, a dot, or a set in brackets."""
    return re.findall(r"\[[^\]]*\]|.", cond) if cond != "." else []


def reverse_condition(cond: str) -> str:
    return cond if cond == "." else "".join(reversed(condition_parts(cond)))


def condition_regex(cond: str, kind: str) -> str:
    """A condition as a regular expression anchored at its end of the word; '' if every word matches."""
    parts = condition_parts(cond)
    if not parts:
        return ""
    out = []
    for p in parts:
        if p == ".":
            out.append(".")
        elif p.startswith("["):
            inside = p[1:-1]
            no = inside.startswith("^")
            inside = re.sub(r"([\\\]\[^-])", r"\\\1", inside[1:] if no else inside)
            out.append(f"[{'^' if no else ''}{inside}]" if inside else ".")
        else:
            out.append(re.escape(p))
    return "^" + "".join(out) if kind == "P" else "".join(out) + "$"


@dataclass(frozen=True)
class Entry:
    """A lexicon row."""

    word: str
    flags: frozenset
    morph: str
    no: int  # place in the file
    dic: int = 0


_MORPH = re.compile(r"[ \t](?=..:)|\t")


def split_row(line: str) -> tuple[str, str, str]:
    """Word, flag field and morphological fields of a lexicon row. A slash is escaped by a backslash or at the start."""
    m = _MORPH.search(line)
    head, morph = (line[: m.start()], line[m.end() :].strip()) if m else (line, "")
    head = head.rstrip(" ")
    k = 0
    while (k := head.find("/", k)) >= 0:
        if k == 0:
            k += 1
        elif head[k - 1] == "\\":
            head = head[: k - 1] + head[k:]
        else:
            return head[:k], head[k + 1 :].split()[0] if head[k + 1 :].strip() else "", morph
    return head, "", morph


def parse_lexicon(data: bytes, r: Rules, dic: int = 0, first: int = 0) -> list[Entry]:
    """The rows of a lexicon, in order. The first line's count must be a number; ph: fields become replacements."""
    lines = read_lines(data, r.charset)
    n = number(lines[0]) if lines else 0
    if n < 1:
        r.messages.append("lexicon: missing or bad word count in the first line")
        if not lines or not re.match(r"\s*[0-9]", lines[0]):
            raise ValueError("the lexicon's first line is not a count")
    out = []
    ignore, rtl = r.get("IGNORE", ""), r.get("COMPLEXPREFIXES", False)
    for line in lines[1:]:
        if not line.strip():
            continue
        word, flags, morph = split_row(line.rstrip())
        if not word:
            continue
        if r.morph_alias and morph:
            morph = " ".join(r.morph_alias[int(x) - 1] if x.isdigit() and 1 <= int(x) <= len(r.morph_alias) else x for x in morph.split())
        if ignore:
            word = "".join(c for c in word if c not in ignore)
        for bad, right in phonetic_hints(word, morph, r):
            add_rep(r, bad, right)
        if rtl:
            word = word[::-1]
            morph = morph[::-1]
        out.append(Entry(word, r.flags(flags) if flags else frozenset(), morph, first + len(out), dic))
    return out


def phonetic_hints(word: str, morph: str, r: Rules) -> list[tuple[str, str]]:
    """Replacements that a row's ph: fields stand for."""
    out = []
    for f in morph.split():
        if not f.startswith("ph:") or len(f) < 4:
            continue
        hint, right = f[3:], word
        if "->" in hint:
            hint, right = hint.split("->", 1)
            if not hint or not right:
                continue
            out.append((hint, right))
            continue
        if hint.endswith("*"):
            if len(hint) < 3 or len(right) < 2:
                continue
            hint, right = hint[:-2], right[:-1]
        if right[:1].isupper() and not right[1:2].isupper():
            if r.charset == "utf-8":
                out.append((hint[:1].upper() + hint[1:], right))
                if r.get("LANG", "")[:2] in ("de", "hu"):
                    out.append((hint, right[:1].lower() + right[1:]))
        out.append((hint, right))
    return out
