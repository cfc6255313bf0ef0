"""Array expressions as SQL text: running totals, and places of matches, at a cost in proportion to the array.

Text, not Column objects, as a nested function of Columns takes seconds to put together on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

#: A fold that appends to an array copies it at each step, so it runs over this many elements at most; blocks of them,
#: and blocks of those blocks' totals, make up longer arrays.
BLOCK, LEVELS = 64, 2
PIECES = "array<struct<gap:string,hit:string>>"


def quoted(name: str) -> str:
    """A column name as an identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string as an SQL literal, whatever the session says about escapes: no character is left to escape."""
    return "decode(X'" + text.encode().hex() + "', 'UTF-8')"


def let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _fold(values: str, op: Callable[[str, str], str]) -> str:
    new = op("acc.top", "x")
    return f"aggregate({values}, named_struct('top', 0, 'out', CAST(array() AS array<int>)), (acc, x) -> named_struct('top', {new}, 'out', concat(acc.out, array({new}))), acc -> acc.out)"


def running(values: str, op: Callable[[str, str], str], levels: int = LEVELS) -> str:
    """Running totals of an array of ints under an associative op that 0 does not change: the k-th is of the first k."""
    if levels == 0:
        return _fold(values, op)
    v, b, e, i = (f"{x}{levels}" for x in "vbei")
    blocks = f"transform(sequence(1, greatest(size({v}), 1), {BLOCK}), {i} -> {_fold(f'slice({v}, {i}, {BLOCK})', op)})"
    before = let(e, running(f"transform({b}, y -> element_at(y, -1))", op, levels - 1), f"concat(array(0), slice({e}, 1, size({e}) - 1))")
    many = let(b, blocks, f"flatten(zip_with({b}, {before}, (y, o) -> transform(y, z -> {op('o', 'z')})))")
    return let(v, values, f"CASE WHEN size({v}) <= {BLOCK} THEN {_fold(v, op)} ELSE {many} END")


def running_sum(values: str) -> str:
    return running(values, lambda a, b: f"{a} + {b}")


def running_max(values: str) -> str:
    """Running maxima of numbers that are not below zero."""
    return running(values, lambda a, b: f"greatest({a}, {b})")


def pieces_of(text: str, pattern: str) -> str:
    """A pattern's leftmost non-overlapping matches with the pieces of text before them: array of (gap, hit)."""
    rx = literal(pattern)
    return f"CAST(filter(arrays_zip(split({text}, {rx}, -1), regexp_extract_all({text}, {rx}, 0)), x -> x.`1` IS NOT NULL) AS {PIECES})"


def ends_of(pieces: str) -> str:
    """Where each match ends, in code points: split() and regexp_extract_all() find the same matches, so that is where
    the pieces and matches up to it end."""
    return running_sum(f"transform({pieces}, x -> length(x.gap) + length(x.hit))")


def placed(pieces: str, ends: str, keep: str = "true") -> str:
    """Matches as (start, end, hit), from 0, end exclusive. keep: which of them stay, by their text x.hit."""
    return f"filter(zip_with({pieces}, {ends}, (x, e) -> named_struct('start', e - length(x.hit), 'end', e, 'hit', x.hit)), x -> {keep})"


def placed_matches(text: str, pattern: str) -> str:
    return let("p", pieces_of(text, pattern), placed("p", ends_of("p")))
