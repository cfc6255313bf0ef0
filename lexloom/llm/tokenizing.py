"""Token ids by the tokenizers library, asked once for each new piece of text instead of for each occurrence.

No pre-token of the two tokenizer files crosses from a character that is not white space into a space or line end, so a
text may be cut before any space or line end that follows such a character, but not at a space that a line end follows;
the pieces' ids, joined, are the text's ids.
A new piece that is a run of Latin letters goes to the tokenizer's model as it is. Pieces' ids are kept as little-endian
unsigned 32-bit bytes in two generations of tables of bounded size that live as long as the worker.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_TWO = re.compile(r"\s[ \n]")
#: A space before a line end has an id of its own, so no cut takes it away.
_CUT = re.compile(r"(?<=\S)(?: (?!\n)|(?=\n))")
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Byte-level tokenizers write each byte as a letter: printable Latin-1 characters as themselves, the others as U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)).difference(_PLAIN)))}
#: Marks that a small letter joins to one character but its capital does not: of H, J, T, W and Y; the last one holds another.
_SMALL_MARKS = "\u0331\u030c\u0308\u030a\u0344"
_OPEN: dict[tuple[str, bool], "Encoder"] = {}


def _own(text: str) -> bool:
    """Whether capitals matter: special tokens are found before letters are lowered, and letters and marks are joined before."""
    return "<|" in text or (not text.isascii() and any(m in text for m in _SMALL_MARKS))


def _ends_in_letter(text: str) -> bool:
    """Whether a text ends, in small letters too, in a Latin letter. \u0130 in small letters ends in a combining dot."""
    last = text[-1:]
    return last.isalpha() and (last.isascii() or last < "\u0250" and last.lower()[-1:].isalpha())


class _Known(dict):
    """Ids by piece; a new piece is learnt when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Encoder:
    """spaced: white space has ids, and a word's include the space before it (byte-level); else it has none."""

    def __init__(self, path: str, spaced: bool, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.most = Tokenizer.from_file(path), spaced, most
        self.known = _Known(self._learn)
        self.old: dict[str, bytes] = {}
        self.mark_bytes = self._ids("\n").tobytes()
        self.model = self.tokenizer.model
        self.marks: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def plain(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Pieces; those after the first stand for themselves with a space before, or begin with a line end."""
        if not self.spaced:
            # The normaliser lowers all letters; doing so before it only makes fewer pieces, but for those of _own.
            text = text.replace("\n", " ")
            if not _own(text):
                return text.encode().lower().decode().split(" ")
            return [p if _own(p) else p.encode().lower().decode() for p in text.split(" ")]
        return _CUT.split(text) if _TWO.search(text) else text.replace("\n", " \n").split(" ")

    def _word(self, word: str, spaced: bool) -> bytes:
        """The ids of a lone run of letters below U+0250: one pre-token, so the model sees it whole."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(f"\u0120{word}" if spaced else word)]).tobytes()

    def _learn(self, piece: str) -> bytes:
        old = self.old.get(piece)
        if old is not None:
            return old
        if piece.isalpha():
            if piece.isascii() or max(piece) < "\u0250":
                if self.spaced:
                    return self._word(piece, True)
                if piece.isascii() or (low := piece.lower()).isalpha():
                    return self._word(piece.lower() if piece.isascii() else low, False)
        elif piece:
            if piece[-1] in _MARKS:
                # A letter run and the marks after it, up to white space, are pre-tokens of their own.
                base = piece.rstrip(_MARKS)
                if _ends_in_letter(base):
                    return self.known[base] + self._mark_ids(piece[len(base) :])
            if self.spaced and piece[0] == "\n" and (body := piece[1:]).isalpha() and (body.isascii() or max(body) < "\u0250"):
                return self.mark_bytes + self._word(body, False)
        return self.plain(piece if piece[:1] == "\n" or not self.spaced else f" {piece}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, for a batch of a few MB."""
        if len(self.known) > self.most:
            self.old, self.known = dict(self.known), _Known(self._learn)
        get, out = self.known.__getitem__, []
        for text in texts:
            cut = self._cut(text)
            head = self.plain(cut.pop(0)) if self.spaced else b""
            out.append(head + b"".join(map(get, cut)))
        return out

    def _mark_ids(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[marks] = self.plain(marks)
        return self.marks[marks]


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder for each file and worker."""
    if (path, spaced) not in _OPEN:
        _OPEN[path, spaced] = Encoder(path, spaced)
    return _OPEN[path, spaced]


def runs(sizes, most: int = 1_000_000):
    """Slices of consecutive items whose sizes add up to about most."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)
