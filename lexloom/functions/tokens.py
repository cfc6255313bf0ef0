"""Tokenizers: a format's markup is blanked out, place for place, and words are found in what is left.

So a token's offset, line and column are those of the text it came from, whatever the format. A document is one text:
tags, comments, arguments and the like may go over line ends.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.arrays import placed_matches, quoted

APOSTROPHES = ("'", "’")
#: The entities whose letters count as letters of a word. Other entities end a word.
WORD_ENTITIES = (
    "Agrave", "Atilde", "Aring", "AElig", "Egrave", "Ecirc", "Igrave", "Iuml", "ETH", "Ntilde", "Ograve", "Oslash", "Ugrave", "THORN",
    "agrave", "atilde", "aring", "aelig", "egrave", "ecirc", "igrave", "iuml", "eth", "ntilde", "ograve", "oslash", "ugrave", "thorn", "yuml",
)
LATIN_ENTITIES = "|".join(WORD_ENTITIES)

#: Elements whose text is not checked, and attributes that are.
HTML_SKIPPED = ("script", "style", "code", "samp", "kbd", "var", "listing", "address", "pre")
HTML_ATTRIBUTES = {"img": ("alt", "title"), "a": ("title",)}
ODF_SKIPPED = ("office:meta", "office:settings", "office:binary-data")

#: Stretches of LaTeX that are skipped, from the first string to the second.
LATEX_SPANS = [
    (r"\(", r"\)"), ("$$", "$$"), ("$", "$"), (r"\begin{math}", r"\end{math}"), (r"\[", r"\]"), (r"\begin{displaymath}", r"\end{displaymath}"),
    (r"\begin{equation}", r"\end{equation}"), (r"\begin{equation*}", r"\end{equation*}"), (r"\begin{align}", r"\end{align}"),
    (r"\begin{align*}", r"\end{align*}"), (r"\begin{lstlisting}", r"\end{lstlisting}"), (r"\begin{verbatim}", r"\end{verbatim}"),
    (r"\verb+", "+"), (r"\verb|", "|"), (r"\verb#", "#"), (r"\verb*", "*"), (r"\documentstyle", r"\begin{document}"),
    (r"\documentclass", r"\begin{document}"), ("\\\\[", "]"), (r"\pagebreak[", "]"), (r"\nopagebreak[", "]"),
]
#: LaTeX commands whose first arguments are skipped, by the number of arguments.
LATEX_COMMANDS = {
    1: "cite textcite autocite nocite index label ref pageref autoref parbox usepackage includeonly include input vspace hspace enlargethispage "
    "begin{tabular} gls glspl begin{thebibliography} bibliography bibliographystyle bibitem begin end pagestyle pagenumbering thispagestyle "
    "addtocounter stepcounter selectlanguage inputencoding hyphenation color textcolor pagecolor declaregraphicsextensions psfig url eqref cref "
    "vskip vglue",
    2: "setlength addtolength settowidth rule addcontentsline newtheorem newcommand renewcommand setcounter colorbox fcolorbox",
    3: "definecolor",
}


@dataclass(frozen=True)
class Token:
    """A word and its place: byte offset in the text, line from 1, column in characters from 0."""

    word: str
    offset: int
    line: int
    column: int


def word_regex(wordchars: str = "", java: bool = False) -> str:
    """Runs of letters and word characters. If either apostrophe is a word character, the other is one between others."""
    extra = "".join(c for c in wordchars if c not in APOSTROPHES)
    apos = any(c in wordchars for c in APOSTROPHES)
    letters = r"\p{L}\p{M}" if java else r"^\W\d_\U00010000-\U0010ffff"
    if java:
        unit = rf"[{letters}{_class(extra)}]"
    else:
        unit = rf"(?:[{letters}]|[\u0300-\u036f]" + (f"|[{_class(extra)}]" if extra else "") + rf"|&(?:{LATIN_ENTITIES});)"
    if not apos:
        return f"{unit}+"
    first = "".join(a for a in APOSTROPHES if a in wordchars)
    return f"{unit}+(?:['’]{unit}+)*" if not first else f"(?:{unit}|[{first}])+(?:['’](?:{unit}|[{first}])+)*"


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in chars)


_URL = re.compile(r"(?:[^\W_]|/)(?:[\w\-\\.:/~%*$\[\]?!@]|[^\W_])*")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def blank_urls(text: str) -> str:
    """URLs, mail addresses and paths blanked out."""
    if "\n" in text:  # none goes over a line end, and most lines have none
        return "\n".join(map(blank_urls, text.split("\n")))
    if "/" not in text and "@" not in text and ":\\" not in text:
        return text
    return _URL.sub(lambda m: _blank(m) if "@" in m[0] or ":\\" in m[0] or "://" in m[0] or m[0][0] == "/" else m[0], text)


def _keep_inside(m: re.Match, spans: list[tuple[int, int]]) -> str:
    """A stretch blanked out but for some spans of the text it is in."""
    out = list(_blank(m))
    for a, b in spans:
        out[a - m.start() : b - m.start()] = m.string[a:b]
    return "".join(out)


_HTML_SKIP = re.compile("|".join(rf"<{t}\b.*?(?:</{t}>|\Z)" for t in HTML_SKIPPED) + r"|<!--.*?(?:-->|\Z)|<\[cdata\[.*?(?:\]\]>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)", re.S)
_XML_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<\[cdata\[.*?(?:\]\]>|\Z)", re.S | re.I)
_ODF_SKIP = re.compile("|".join(rf"<{t}>.*?(?:</{t}>|\Z)" for t in ODF_SKIPPED) + "|" + _XML_SKIP.pattern, re.S | re.I)
_ENTITY = re.compile(rf"&(?!(?:{LATIN_ENTITIES});)(?!apos;)[^;\s<]*;")


def _tag(m: re.Match) -> str:
    name = re.match(r"<(\w+)\s", m[0])
    wanted = HTML_ATTRIBUTES.get(name[1].lower(), ()) if name else ()
    spans = [(m.start() + x.start(2), m.start() + x.end(2)) for a in wanted for x in re.finditer(rf"\b{a}=(\"|')(.*?)\1", m[0], re.S | re.I)]
    return _keep_inside(m, spans)


def blank_html(text: str) -> str:
    return _ENTITY.sub(_blank, _TAG.sub(_tag, _HTML_SKIP.sub(_blank, text)))


def blank_xml(text: str) -> str:
    return _ENTITY.sub(_blank, _TAG.sub(_blank, _XML_SKIP.sub(_blank, text)))


def blank_man(text: str) -> str:
    """troff: a request line up to its first blank, and font escapes."""
    text = re.sub(r"(?m)^\.[^ \n]*", _blank, text)
    return re.sub(r"\\f[^\n]", _blank, text)


def _latex_rules() -> tuple[list[tuple[str, str | None, int]], dict]:
    rules = [(a, b, 0) for a, b in LATEX_SPANS] + [("\\" + c, None, n) for n, names in LATEX_COMMANDS.items() for c in names.split()] + [("''", None, 1)]
    first: dict[str, list] = {}
    # A longer opening wins over one that it begins with.
    for r in sorted(rules, key=lambda r: -len(r[0])):
        first.setdefault(r[0][0], []).append(r)
    return rules, first


_LATEX = _latex_rules()[1]


def _arguments_end(text: str, i: int, n: int) -> int:
    """The place after n arguments in braces, with an optional one in brackets before each."""
    depth, done, optional = 0, 0, True
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "{" or optional and c == "[":
            depth, optional = depth + 1, False
        elif c == "}":
            depth -= 1
            if depth == 0:
                optional, done = True, done + 1
            if depth == 0 and done == n or depth < 0:
                return i + 1
        elif c == "]":
            depth -= 1
        i += 1
    return i


def blank_latex(text: str, wordchars: str = "") -> str:
    """LaTeX: comments, commands, mathematics, verbatim text and the arguments that hold no prose."""
    # Only A-Z, so that places stay: some letters have longer small forms.
    low, out, i, kept = re.sub("[A-Z]+", lambda m: m[0].lower(), text), [], 0, 0

    def skip(to: int) -> None:
        nonlocal kept, i
        out.append(text[kept:i])
        out.append(re.sub(r"[^\n]", " ", text[i:to]))
        i = kept = to

    while i < len(text):
        c = text[i]
        rule = next((r for r in _LATEX.get(c, ()) if low.startswith(r[0], i)), None)
        if rule and c == "'" and "'" in wordchars and text[i - 1 : i].isalpha():
            rule = None  # part of a word
            i += 1
            continue
        if rule:
            opening, closing, n = rule
            if closing:
                k = low.find(closing, i + len(opening))
                skip(len(text) if k < 0 else k + len(closing))
            else:
                skip(_arguments_end(text, i + len(opening), n))
        elif c == "%":
            k = text.find("\n", i)
            skip(len(text) if k < 0 else k)
        elif c == "\\":
            m = re.compile(r"\\(?:[\\$%]|[A-Za-z]*)").match(text, i)
            skip(m.end())
        else:
            i += 1
    return "".join(out) + text[kept:]


_BLANKERS = {"text": str, "html": blank_html, "xml": blank_xml, "man": blank_man, "latex": blank_latex}
FORMATS = ("text", "first", "man", "latex", "html", "xml", "odf")
#: Formats by file extension.
EXTENSIONS = {"tex": "latex", "html": "html", "htm": "html", "xhtml": "html", "xml": "xml", "odt": "odf", "ods": "odf", "odp": "odf", "fodt": "odf", "fods": "odf"}


def format_of(name: str) -> str:
    """The format that a file's name tells; text if none."""
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return "man" if len(end) == 1 and end in "12345678n" else EXTENSIONS.get(end, "text")


def tokenize(text: str, fmt: str = "text", wordchars: str = "", urls: bool = False) -> list[Token]:
    """The words of a text in a format. urls: look into URLs, mail addresses and paths as well."""
    return _placed(text, found_words(text, fmt, wordchars, urls))


def found_words(text: str, fmt: str = "text", wordchars: str = "", urls: bool = False) -> list[tuple[int, str]]:
    """The words of a text as tokenize() has them, each behind its start in characters."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt == "first":
        found = [(m.start(1), m[1]) for m in re.finditer(r"(?m)^([^\t\n]+)\t", text)]
    elif fmt == "odf":
        found = _odf_words(text, wordchars, urls)
    else:
        clean = blank_latex(text, wordchars) if fmt == "latex" else _BLANKERS[fmt](text)
        if not urls:
            clean = blank_urls(clean)
        if fmt in ("html", "xml"):
            clean = clean.replace("&apos;", "''''''") if not any(a in wordchars for a in APOSTROPHES) else clean
        if not wordchars and "&" not in clean:  # letters alone are words, and neither end in a colon nor are one
            rx = _ASCII_WORD if clean.isascii() else _PLAIN_WORD
            return [(m.start(), text[m.start() : m.end()]) for m in rx.finditer(clean)]
        found = [(m.start(), text[m.start() : m.end()]) for m in _regex(wordchars, fmt in ("html", "xml")).finditer(clean)]
    return [(at, w[:-1] if w.endswith(":") else w) for at, w in found if w not in (":", "'", "’")]


#: word_regex() where there are no entities.
_ASCII_WORD, _PLAIN_WORD = re.compile("[A-Za-z]+"), re.compile(r"(?:[^\W\d_\U00010000-\U0010ffff]+|[\u0300-\u036f]+)+")


def places(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offset, line from 1 and column from 0 of places in a text, as a Token has them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 10)
    line = np.searchsorted(ends, starts)
    octets = starts
    if not text.isascii():
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)
        octets = np.concatenate([[0], np.cumsum(width)])[starts]
    return octets, line + 1, starts - np.concatenate([[0], ends + 1])[line]


def _regex(wordchars: str, markup: bool) -> re.Pattern:
    rx = word_regex(wordchars)
    return re.compile(rx.replace("['’]", "(?:['’]|&apos;)") if markup else rx)


def _odf_words(text: str, wordchars: str, urls: bool) -> list[tuple[int, str]]:
    """Words of an ODF text; spans of one inside a word are taken out of it."""
    clean = _ODF_SKIP.sub(_blank, text)
    joined = re.compile(r"(?<=[^\W_])</?text:span[^>]*>(?=[^\W_])")
    marks = [(m.start(), m.end()) for m in joined.finditer(clean)]
    gone, parts, last = 0, [], 0
    moves = []  # (place in the joined text, how far the original is ahead)
    for a, b in marks:
        parts.append(clean[last:a])
        gone += b - a
        moves.append((a - (gone - (b - a)), gone))
        last = b
    flat = "".join(parts) + clean[last:]
    flat = _ENTITY.sub(_blank, _TAG.sub(_blank, flat))
    flat = flat if urls else blank_urls(flat)
    out = []
    for m in _regex(wordchars, True).finditer(flat):
        ahead = next((n for at, n in reversed(moves) if at <= m.start()), 0)
        out.append((m.start() + ahead, m[0]))
    return out


def _placed(text: str, words: list[tuple[int, str]]) -> list[Token]:
    out, line, start, at, octets = [], 1, 0, 0, 0
    for i, w in words:
        between = text[at:i]
        n = between.count("\n")
        if n:
            line += n
            start = at + between.rindex("\n") + 1
        octets += len(between.encode("utf-8", "surrogatepass"))
        at = i
        out.append(Token(w, octets, line, i - start))
    return out


def replace_tokens(text: str, changes: list[tuple[Token, str]], markup: bool = False) -> str:
    """The text with tokens replaced, from the last to the first; in markup the new words are escaped."""
    data = text.encode("utf-8", "surrogatepass")
    for t, new in sorted(changes, key=lambda c: -c[0].offset):
        new = html.escape(new).replace("&#x27;", "&apos;") if markup else new
        n = len(t.word.encode("utf-8", "surrogatepass"))
        data = data[: t.offset] + new.encode("utf-8", "surrogatepass") + data[t.offset + n :]
    return data.decode("utf-8", "surrogatepass")


# columns


def words_col(text: Column, wordchars: str = "") -> Column:
    """The words of plain texts as an array, by built-in functions."""
    return F.regexp_extract_all(text, F.lit(word_regex(wordchars, java=True)), F.lit(0))


def placed_words_col(text_col: str, wordchars: str = "") -> Column:
    """Words of a column of plain texts with their places: array of (word, start), start in characters from 0."""
    found = placed_matches(quoted(text_col), word_regex(wordchars, java=True))
    return F.expr(f"transform({found}, x -> named_struct('word', x.hit, 'start', x.start))")
