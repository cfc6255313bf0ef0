"""python -m lexloom -d NAME|AFF,DIC [mode] [files]: check files or standard input word by word.

Modes: (none) answer lines, -l wrong words, -G right words, -L lines with a wrong word, -w lines whose first word is wrong,
-U corrected text, -u2 substitutions, -u3 place and correction, -s stems, -m analyses, -S suffix forms, -D list
dictionaries, --trace decisions. Formats: -t LaTeX, -n man, -H HTML, -X XML, -O office, -1 first field; else by name.
-p FILE adds a personal dictionary, --check-url looks into URLs, -i CHARSET reads in another character set.
"""

from __future__ import annotations

import sys

from lexloom.functions.tokens import format_of, replace_tokens, tokenize
from lexloom.operators.explain import explain
from lexloom.plans.dictionary import Dictionary, available, load, search_paths

FORMATS = {"-t": "latex", "-n": "man", "-H": "html", "-X": "xml", "-O": "odf", "-1": "first"}
MODES = ("-l", "-G", "-L", "-w", "-U", "-u2", "-u3", "-s", "-m", "-S", "-D", "--trace")


def run(d: Dictionary, mode: str, text: str, fmt: str, urls: bool = False, name: str = "-") -> list[str]:
    """Output lines for one text."""
    e = d.engine
    found = tokenize(text, fmt, d.wordchars, urls)
    ok = {w: e.spell(w) or e.spell(w.replace("&apos;", "'").replace("’", "'")) for w in {t.word for t in found}}
    lines = text.split("\n")
    if mode in ("-l", "-G"):
        return [t.word for t in found if ok[t.word] == (mode == "-G")]
    if mode in ("-L", "-w"):
        first = {}
        for t in found:
            first.setdefault(t.line, t)
        chosen = first.values() if mode == "-w" else found
        bad = {t.line for t in chosen if not ok[t.word]}
        return [x for k, x in enumerate(lines, 1) if k in bad]
    if mode in ("-U", "-u2", "-u3"):
        fixes = [(t, s[0]) for t in found if not ok[t.word] and (s := e.suggest(t.word))]
        if mode == "-U":
            return replace_tokens(text, fixes, fmt in ("html", "xml", "odf")).split("\n")
        return [f"{t.line}s/{t.word}/{x}/g" if mode == "-u2" else f"{name}:{t.line}: {t.word} -> {x}" for t, x in fixes]
    words = [w for line in lines for w in line.split()]
    if mode == "-s":
        return [f"{w} {x}" for w in words for x in e.stem(w) or [""]]
    if mode == "-m":
        return [f"{w} {x}" for w in words for x in e.analyze(w) or [""]]
    if mode == "-S":
        return [x for w in words for x in e.suffix_forms(w)]
    if mode == "--trace":
        return ["  " * depth + x for w in words for depth, x in explain(e, w)]
    out = []
    for t in found:
        r = e.check(t.word)
        if ok[t.word]:
            out.append("-" if r.compound else f"+ {r.root}" if r.root else "*")
        else:
            s = e.suggest(t.word)
            out.append(f"& {t.word} {len(s)} {t.column}: {', '.join(s)}" if s else f"# {t.word} {t.column}")
    return out


def main(args: list[str]) -> int:
    mode, fmt, names, personal, urls, charset, files = "", "", "en_US", [], False, "utf-8", []
    it = iter(args)
    for a in it:
        if a in MODES:
            mode = a
        elif a in FORMATS:
            fmt = FORMATS[a]
        elif a == "-d":
            names = next(it)
        elif a == "-p":
            personal.append(next(it))
        elif a == "-i":
            charset = next(it)
        elif a == "--check-url":
            urls = True
        else:
            files.append(a)
    if mode == "-D":
        print(*search_paths(), *available(search_paths()), sep="\n")
        return 0
    first, *more = names.split(",")
    d = Dictionary.open(first, more.pop(0)) if first.endswith(".aff") else load(first)
    for name in more:
        d = d.add_lexicon(open(name, "rb").read())
    for p in personal:
        with open(p, encoding="utf-8") as f:
            d = d.add_personal(f.read())
    for name in files or ["-"]:
        data = sys.stdin.buffer.read() if name == "-" else open(name, "rb").read()
        print(*run(d, mode, data.decode(charset, "replace").rstrip("\n"), fmt or format_of(name), urls, name), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
