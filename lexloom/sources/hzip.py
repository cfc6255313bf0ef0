"""Compressed dictionary files: a Huffman code over pairs of bytes, and lines written as differences to the line before.

File: hz0 (or hz1, a check byte, and everything after it combined with a password by exclusive or); the number of codes;
for each its two bytes, its length in bits and its bits; then the coded text. The last code ends the text; a first byte
other than 0 in it says that its second byte is the text's last one.
"""

from __future__ import annotations

import heapq
from collections import Counter

ESCAPE, NINE = 31, 30


class FormatError(ValueError):
    """The bytes are no such file, or the password is missing or wrong."""


def _unlock(data: bytes, password: bytes) -> bytes:
    if data[:3] == b"hz0":
        return data[3:]
    if data[:3] != b"hz1":
        raise FormatError("not in hzip format")
    check = 0
    for b in password:
        check ^= b
    if not password or len(data) < 4 or check != data[3]:
        raise FormatError("missing or bad password")
    return data[4:]


class _Reader:
    """Bytes of the table, combined with the password from its first byte on."""

    def __init__(self, data: bytes, password: bytes):
        self.data, self.password, self.at = data, password, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise FormatError("not in hzip format")
        if self.password:
            part = bytes(b ^ self.password[(self.at + k) % len(self.password)] for k, b in enumerate(part))
        self.at += n
        return part


def decode(data: bytes, password: str = "") -> bytes:
    """The text of a compressed file."""
    key = password.encode() if data[:3] == b"hz1" else b""
    r = _Reader(_unlock(data, key), key)
    n = int.from_bytes(r.take(2), "big")
    symbols, last = {}, ""
    for _ in range(n):
        pair, length = r.take(2), r.take(1)[0]
        bits = "".join(f"{b:08b}" for b in r.take(length // 8 + 1))[:length]
        symbols[bits], last = pair, bits
    if not n:
        raise FormatError("not in hzip format")
    out, code = bytearray(), ""
    for b in r.data[r.at :]:
        for k in range(7, -1, -1):
            code += "1" if b >> k & 1 else "0"
            pair = symbols.get(code)
            if pair is None:
                continue
            if code == last:
                if pair[0]:
                    out.append(pair[1])
                return _lines(bytes(out))
            out += pair
            code = ""
    raise FormatError("not in hzip format")


def _lines(data: bytes) -> bytes:
    """Undo the differences: after a line's own bytes, an optional number of bytes that its end shares with the line
    before, and the number of bytes that its start shares with it."""
    lines, before, own, i = [], b"", bytearray(), 0
    while i < len(data):
        b = data[i]
        if b == ESCAPE and i + 1 < len(data):
            own.append(data[i + 1])
            i += 2
            continue
        if b in (9, 32) or b >= 47:
            own.append(b)
            i += 1
            continue
        right = 0
        if b > 32:
            right, i = b - 31, i + 1
            b = data[i] if i < len(data) else 0
        left = 9 if b == NINE else b
        end = before[len(before) - right :] if right else b""
        before = before[:left] + bytes(own) + end
        lines.append(before)
        own, i = bytearray(), i + 1
    if own:
        lines.append(bytes(own))
    return b"".join(x + b"\n" for x in lines)


def encode(text: bytes) -> bytes:
    """A compressed file with the text's lines, without a password."""
    flat, before = bytearray(), b""
    for line in text.rstrip(b"\n").split(b"\n"):
        left = 0
        while left < min(len(before), len(line), 29) and before[left] == line[left]:
            left += 1
        right = 0
        while right < min(len(before) - left, len(line) - left, 14) and before[-1 - right] == line[-1 - right]:
            right += 1
        for b in line[left : len(line) - right]:
            flat += bytes([ESCAPE, b]) if b < 47 and b not in (9, 32) else bytes([b])
        if right > 1:
            flat.append(right + 31)
        elif right:
            tail = line[-1]
            flat += bytes([ESCAPE, tail]) if tail < 47 and tail not in (9, 32) else bytes([tail])
        flat.append(NINE if left == 9 else left)
        before = line
    pairs = [bytes(flat[k : k + 2]) for k in range(0, len(flat) - len(flat) % 2, 2)]
    end = bytes([1, flat[-1]]) if len(flat) % 2 else b"\0\0"
    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(Counter(pairs).items()))] + [(0, -1, [None])]
    codes: dict = {s: "" for _, _, g in heap for s in g}
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, group in (("0", a[2]), ("1", b[2])):
            for s in group:
                codes[s] = bit + codes[s]
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    if len(codes) == 1:
        codes = {None: "0"}
    out = bytearray(b"hz0" + len(codes).to_bytes(2, "big"))
    for s, bits in sorted(codes.items(), key=lambda x: x[0] is None):
        out += (end if s is None else s) + bytes([len(bits)])
        padded = bits.ljust((len(bits) // 8 + 1) * 8, "0")
        out += bytes(int(padded[k : k + 8], 2) for k in range(0, len(padded), 8))
    stream = "".join(codes[p] for p in pairs) + codes[None]
    stream = stream.ljust(-(-len(stream) // 8) * 8, "0")
    return bytes(out + bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)))
