"""Vectorised hashing of the words of many texts at once, on the bytes that Arrow hands over."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE, _LONG = 1 << 20, 512
#: The bytes of a last lane that belong to the word, by their number.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    x = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return x[at[0] : at[-1]], at - at[0]


def _key(salt: int, which: int) -> np.uint64:
    return mix(np.array([2 * salt + which + 1], np.uint64))[0]


def _hash_words(x: np.ndarray, doc_starts: np.ndarray, keys: list[np.uint64]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the words in x, and a 64-bit hash of each for each key; no word goes over a document's start.

    A hash takes eight bytes of a word at a time, all words at once: it mixes them into what the bytes before gave. Words
    of more than _LONG bytes are hashed by BLAKE2.
    """
    word = ~_SEP[x]
    cut = np.ones(len(x) + 1, bool)
    cut[1:-1] = ~word[:-1]
    cut[doc_starts] = True
    first = np.flatnonzero(word & cut[:-1])
    cut[:-1] |= ~word
    last = np.flatnonzero(word & cut[1:]) + 1
    size = last - first
    lanes = np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), 0, (1,))
    out = [mix(size.astype(np.uint64) ^ k) for k in keys]
    active = np.flatnonzero(size <= _LONG)
    at, left = first[active], size[active]
    while len(active):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        whole = len(active) == len(first)
        for k, h in enumerate(out):
            if whole:
                out[k] = mix((h ^ lane) + keys[k])
            else:
                h[active] = mix((h[active] ^ lane) + keys[k])
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        for k, h in enumerate(out):
            h[i] = int.from_bytes(hashlib.blake2b(x[first[i] : last[i]].tobytes(), digest_size=8, key=keys[k].tobytes()).digest(), "little")
    return first, out


def word_hashes(x: np.ndarray, offsets: np.ndarray, lower: bool = True, salt: int = 0, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the documents in x, each document's offsets among them, and with
    `both` hashes under a second key. Works through pieces of about 1 MB that end between words, so memory beyond the
    result doesn't grow with a text.
    """
    keys = [_key(salt, k) for k in range(1 + both)]
    starts, hashes, at = [], [], 0
    bounds = offsets[:-1][np.diff(offsets) > 0]
    while at < len(x):
        end = min(len(x), at + _PIECE)
        while end < len(x):
            sep = np.flatnonzero(_SEP[x[at:end]])
            docs = np.searchsorted(bounds, end, "right") - 1
            best = max(at + sep[-1] + 1 if len(sep) else 0, bounds[docs])
            if best > at:
                end = best
                break
            end = min(len(x), end + _PIECE)
        piece = _LOWER[x[at:end]] if lower else x[at:end]
        s, h = _hash_words(piece, bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at, keys)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(offsets), np.int64), none if both else None
    own = [np.concatenate(x) for x in zip(*hashes)]
    return own[0], np.searchsorted(np.concatenate(starts), offsets), own[1] if both else None


def doc_runs(offsets: np.ndarray, most: int = 1 << 19):
    """Ranges of consecutive documents of about `most` bytes together; a longer one stands alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    odd = _odd(size)
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n] * odd[0]
    for k in range(1, size):
        acc += words[k : k + n] * odd[k]
    return mix(acc)


def _odd(size: int) -> np.ndarray:
    return np.array([mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(size)], np.uint64)


def _short(words: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence of fewer words than a shingle has."""
    return mix((words * _odd(len(words))).sum(keepdims=True) ^ np.uint64(len(words)))


def shingle_sets(x: np.ndarray, offsets: np.ndarray, size: int = 5, salt: int = 0) -> list[np.ndarray]:
    """Per document the sorted distinct 64-bit hashes of its word shingles; with fewer words, of the whole sequence."""
    words, at, _ = word_hashes(x, offsets, salt=salt)
    acc, out = _shingles(words, size), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            v = np.sort(acc[a : b - size + 1])
            keep = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            out.append(v[keep])
        else:
            out.append(_short(words[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def proven_sets(x: np.ndarray, offsets: np.ndarray, size: int = 5, salt: int = 0) -> list[tuple[np.ndarray, int, bool]]:
    """shingle_sets with what shows a collision: the sum of the shingles' hashes under a second key, which equal sets share
    and sets that merely look equal don't, and whether two shingles of the document share a hash."""
    words, at, again = word_hashes(x, offsets, salt=salt, both=True)
    acc, acc2, out = _shingles(words, size), _shingles(again, size), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            by = np.argsort(acc[a : b - size + 1])
            v, w = acc[a : b - size + 1][by], acc2[a : b - size + 1][by]
            keep = np.ones(len(v), bool)
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            out.append((v[keep], int(w[keep].sum()), bool((~keep[1:] & (w[1:] != w[:-1])).any())))
        elif b > a:
            out.append((_short(words[a:b]), int(_short(again[a:b])[0]), False))
        else:
            out.append((np.zeros(0, np.uint64), 0, False))
    return out
