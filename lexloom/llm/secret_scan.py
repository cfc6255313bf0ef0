"""Secret scans in DataFrame functions only: patterns with spans, and entropy of sliding windows over long candidates.

A pattern's spans come from the pieces between its matches: split() and regexp_extract_all() find the same leftmost
matches, so a match ends where the running total of pieces and matches says. Candidates are runs of key-like characters.
Over each one, a window of fixed length slides; it keeps a count per character of its class, changed by the character
that enters and the one that leaves, and the running sum of c*log2(c), from which the window's Shannon entropy follows.
Runs of windows above the class's bound are spans, unless the candidate is on the allow list.

The cost of a text is in proportion to its length and its matches: running totals go block by block, a long candidate is
cut into blocks that overlap by a window less one, and texts are cut into blocks in which a place is found quickly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.arrays import PIECES, ends_of, let, literal, pieces_of, placed, quoted, running_max

from .scratch import fresh

#: Fixed patterns of the base scan, in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more; a shorter run has no longer one inside
HEX = r"[0-9a-f]{32,}"
#: Without this there is no match of ASSIGN.
ASSIGN_WORD = r"(?i)password|passwd|secret|token|api_?key"

#: Character classes of candidates: name, alphabet, shortest candidate, window, bits per character.
CLASSES = [
    ("ehex", "0123456789abcdefABCDEF", 24, 24, 2.9),
    ("ebase64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 24, 4.0),
]
#: Candidates that are never reported for their entropy: placeholders, the alphabet or digits in order, words without a digit.
ALLOW = [r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem", r"(?i)abcdefghij|0123456789|1234567890", r"^[^0-9]*$", r"^[0-9]*$"]

PART = "array<struct<start:int,end:int>>"
#: Characters of a long candidate that are slid over at a time, and of a text among which a place is looked up.
CANDIDATE_BLOCK, TEXT_BLOCK = 2048, 1024


def _windows(text: str, window: int, bound: float) -> str:
    """Merged spans (start, end) of an ASCII text's windows whose entropy in bits reaches the bound.

    A step changes the count of the character that leaves and of the one that enters, and with them the sum of
    c*log2(c); a window's entropy is log2(window) minus that sum over the window's length. The counts are the characters
    of a string, a place for each of the 95 that can be printed: a space for 0, the next one for 1 and so on.
    """
    limit = (math.log2(window) - bound) * window + 1e-9
    clog = "array(" + ", ".join(f"{c * math.log2(c) if c > 1 else 0.0!r}D" for c in range(window + 2)) + ")"
    count = lambda counts, at: f"ascii(substring({counts}, {at}, 1)) - 32"
    put = lambda counts, at, c: f"overlay({counts} PLACING char({c} + 32) FROM {at} FOR 1)"
    entry = lambda c: f"element_at({clog}, {c} + 1)"
    out = f"CASE WHEN acc.end > 0 THEN concat(acc.out, CAST(array(named_struct('start', acc.start, 'end', acc.end)) AS {PART})) ELSE acc.out END"
    gone = let("c", count("acc.counts", "chars[k - 1 - {w}]".format(w=window)), f"named_struct('counts', {put('acc.counts', f'chars[k - 1 - {window}]', 'c - 1')}, 'total', acc.total - {entry('c')} + {entry('(c - 1)')})")
    left = f"CASE WHEN k > {window} THEN {gone} ELSE named_struct('counts', acc.counts, 'total', acc.total) END"
    come = let("c", count("now.counts", "chars[k - 1]"), f"named_struct('counts', {put('now.counts', 'chars[k - 1]', 'c + 1')}, 'total', now.total - {entry('c')} + {entry('(c + 1)')})")
    high = f"(k >= {window} AND new.total <= {limit!r}D)"
    apart = f"{high} AND acc.end < k - {window}"
    step = f"""named_struct('counts', new.counts, 'total', new.total, 'start', CASE WHEN {apart} THEN k - {window} ELSE acc.start END,
        'end', CASE WHEN {high} THEN k ELSE acc.end END, 'out', CASE WHEN {apart} THEN {out} ELSE acc.out END)"""
    begin = f"named_struct('counts', repeat(' ', 95), 'total', 0.0D, 'start', 0, 'end', -1, 'out', CAST(array() AS {PART}))"
    fold = f"aggregate(sequence(1, size(chars)), {begin}, (acc, k) -> {let('now', left, let('new', come, step))}, acc -> {out})"
    return let("chars", f"transform(split({text}, ''), c -> ascii(c) - 31)", fold)


def _parts(blocks: str, window: int, bound: float) -> str:
    """Spans (start, end) of the windows of all blocks, by start."""
    return f"flatten(transform({blocks}, b -> transform({_windows('b.text', window, bound)}, x -> named_struct('start', b.start + x.start, 'end', b.start + x.end))))"


def _blocks(candidates: str, window: int) -> str:
    """Blocks (start, text) of candidates, each with the first window-1 characters of the next one."""
    cut = f"CAST(substring(encode(x.hit, 'UTF-8'), i + 1, {CANDIDATE_BLOCK + window - 1}) AS string)"
    return f"flatten(transform({candidates}, x -> transform(sequence(0, octet_length(x.hit) - 1, {CANDIDATE_BLOCK}), i -> named_struct('start', x.start + i, 'text', {cut}))))"


def _joined(parts: str, top: str) -> str:
    """Parts that come by start, those that overlap or touch made one. top: the running maximum of their ends."""
    first = f"filter(sequence(0, size({parts}) - 1), i -> i = 0 OR {parts}[i].start > {top}[greatest(i - 1, 0)])"  # where a new part begins
    many = let("a", first, f"transform(a, (i, k) -> named_struct('start', {parts}[i].start, 'end', {top}[coalesce(get(a, k + 1), size({parts})) - 1]))")
    return f"CASE WHEN size({parts}) < 2 THEN {parts} ELSE {many} END"


def _class_pattern(alphabet: str, least: int) -> str:
    return "[" + "".join("\\" + c if c in "-]^\\[" else c for c in alphabet) + f"]{{{least},}}"


def _listed_spans(found: str, kind: str, rank: int) -> str:
    return f"transform({found}, x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}'))"


def _merged(spans: list[str]) -> str:
    """All spans, by start and then kind as listed. No two of one kind have one start, so the rest breaks no ties."""
    return f"transform(array_sort(concat({', '.join(spans)})), x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'rank', x.rank))"


def _with_spans(docs: DataFrame, text_col: str, base: str, added: str) -> DataFrame:
    """docs with two more columns: the spans of the three patterns, and those that window entropy adds.

    Step by step: matches, then blocks of long candidates (each with the next one's first characters, so that every
    window lies in just one), then their windows, then the windows that touch made one.
    """
    value = f"length(regexp_extract(x.hit, {literal(ASSIGN)}, 2)) >= 8"
    unsafe = " AND ".join(f"NOT x.hit RLIKE {literal(p)}" for p in ALLOW)
    rules = [(ASSIGN, "assign", value, ASSIGN_WORD), (ACCESS, "access", "true", ACCESS), (HEX, "hex", "true", HEX)]
    rules += [(_class_pattern(c[1], c[2]), c[0], unsafe, _class_pattern(c[1], c[2])) for c in CLASSES]
    taken = docs.withColumns({base: F.lit(0), added: F.lit(0)})
    names = fresh(taken, "whole", *[kind for _, kind, _, _ in rules], *[f"{kind}_{n}" for _, kind, _, _ in rules for n in ("gaps", "ends")])
    (text, *at), gaps, tops = names[: len(rules) + 1], names[len(rules) + 1 :: 2], names[len(rules) + 2 :: 2]
    found = docs.withColumn(text, F.expr(f"coalesce({quoted(text_col)}, '')"))

    def put(values: dict[str, str]) -> None:
        nonlocal found
        found = found.withColumns({n: F.expr(x) for n, x in values.items()})

    put({g: f"CASE WHEN {quoted(text)} RLIKE {literal(needs)} THEN {pieces_of(quoted(text), rx)} ELSE CAST(array() AS {PIECES}) END" for g, (rx, _, _, needs) in zip(gaps, rules)})
    put({t: ends_of(quoted(g)) for g, t in zip(gaps, tops)})
    put({n: placed(quoted(g), quoted(t), keep) for n, g, t, (_, _, keep, _) in zip(at, gaps, tops, rules)})
    put({n: _blocks(quoted(n), c[3]) for n, c in zip(at[3:], CLASSES)})
    put({n: _parts(quoted(n), c[3], c[4]) for n, c in zip(at[3:], CLASSES)})
    put({t: running_max(f"transform({quoted(n)}, x -> x.end)") for n, t in zip(at[3:], tops[3:])})
    put({n: _joined(quoted(n), quoted(t)) for n, t in zip(at[3:], tops[3:])})
    spans = [_listed_spans(quoted(n), kind, rank) for rank, (n, (_, kind, _, _)) in enumerate(zip(at, rules))]
    put({base: _merged(spans[:3]), added: _merged(spans[3:])})
    return found.drop(*names)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with two more columns, base and added: arrays of (start, end, kind, rank) in code points, end exclusive, sorted.

    base has the matches of the three patterns (assign: only with a value of 8 characters or more), added the spans that
    window entropy finds. Null text: as empty, no spans. Every row is kept and scanned whole, repeated rows alike.
    Columns named base or added, in whatever letter case, are replaced; other columns stay as they are.
    """
    return _with_spans(docs, text_col, "base", "added")


def listed(spans: str) -> Column:
    """kind:start:end of each span of a column, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def merged(*columns: str) -> str:
    """The spans of all these columns, by start and then kind as listed."""
    return _merged([f"transform({quoted(c)}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'kind', x.kind))" for c in columns])


def _piece(blocks: str, a: str, b: str) -> str:
    """The characters a to b-1 of a text, from the blocks that hold them."""
    n, at = TEXT_BLOCK, lambda x: f"CAST({x} DIV {TEXT_BLOCK} AS int)"
    some = lambda k: f"coalesce(get({blocks}, {k}), '')"
    between = f"array_join(slice({blocks}, {at(a)} + 2, greatest({at(b)} - {at(a)} - 1, 0)), '')"
    many = f"concat(substring({some(at(a))}, {a} % {n} + 1, {n}), {between}, substring({some(at(b))}, 1, {b} % {n}))"
    return f"CASE WHEN {at(a)} = {at(b)} THEN substring({some(at(a))}, {a} % {n} + 1, {b} - {a}) ELSE {many} END"


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """docs with every span of its texts replaced by the mark, overlapping spans by one. Null texts stay null.

    What stays of a text are the pieces before spans that start at or behind the end of all before them, and the last
    piece. All other columns, whatever their names, keep their values; repeated rows stay; an empty table gives no rows.
    """
    text, names = quoted(text_col), fresh(docs, "base", "spans", "ends", "blocks")
    base, spans, ends, blocks = map(quoted, names)
    found = _with_spans(docs, text_col, *names[:2]).withColumn(names[1], F.expr(merged(*names[:2])))
    found = found.withColumn(names[2], F.expr(running_max(f"transform({spans}, x -> x.end)")))
    found = found.withColumn(names[3], F.expr(f"CASE WHEN size({spans}) > 0 THEN regexp_extract_all({text}, '(?s).{{1,{TEXT_BLOCK}}}', 0) END"))
    before = f"concat(array(0), slice({ends}, 1, size({ends}) - 1))"
    gap = f"CASE WHEN x.start >= top THEN concat({_piece(blocks, 'top', 'x.start')}, {literal(mark)}) END"
    whole = f"concat(array_join(zip_with({before}, {spans}, (top, x) -> {gap}), ''), {_piece(blocks, f'element_at({ends}, -1)', f'(size({blocks}) * {TEXT_BLOCK})')})"
    out = found.withColumn(text_col, F.expr(f"CASE WHEN size({spans}) > 0 THEN {whole} ELSE {text} END"))
    return out.drop(*names)
