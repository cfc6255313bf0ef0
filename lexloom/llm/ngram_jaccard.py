"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence matrix with its transpose.

Documents with equal n-gram sets are one row of the matrix (a class). Columns are ordered from rare to common. Two rows
of sizes a <= b reach similarity t only if a >= t*b and their overlap is at least t*a, so they share a column among the
first n - ceil(t*n) + 1 of each: only those entries are multiplied, in blocks of columns, and the rest of a row is read
only for pairs that some block leaves possible. Any order of columns gives whole results; the common ones that are put
last come from bounded counts of every task.

A column's rows come with the first columns that each shares with any other row. A block multiplies those small matrices,
keeps a pair only at the first column that both share, and drops it if its overlap there and all that can follow (the
rest of the row that ends earlier in the order) stays below the bound. Rows with many shared columns are sent with some
of them at first and with all for the pairs that remain. What is left of a column is compared over whole rows, again as a product in blocks of columns that accumulates overlap counts, and only a spanning forest of its links
comes out. So pairs never become rows of a table, however large a group of copies, and no possible pair is left out.
Columns with many rows are cut into chunks, whose pairs go to different tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.arrays import quoted

from .components import components
from .scratch import Scratch, small_batches
from .textkernel import doc_runs, mix, proven_sets, shingle_sets, utf8

SIZE, PERCENT = 5, 80
COMMON, COMMON_PER_TASK, COUNTED, ENTRIES_PER_BLOCK = 1 << 18, 1 << 15, 1 << 20, 1 << 19
CHUNK_ROWS, CHUNK_GRAMS, SENT, VOCABULARY, STRIPE = 1024, 1 << 21, 32, 4096, 256
#: A column with more rows than HOT_ROWS is cut before its block is gathered; groups of up to SMALL rows are multiplied together.
HOT_ROWS, SMALL, BATCH_ENTRIES = 1 << 18, 64, 1 << 17
BROADCAST_ROWS, SEEN, MOST_SALTS = 200_000, 500_000, 20


def _sets(column: pa.Array, size: int, salt: int, make=shingle_sets):
    x, at = utf8(column)
    for a, b in doc_runs(at):
        yield a, make(x[at[a] : at[b]], at[a : b + 1] - at[a], size, salt)


def _counted(grams: np.ndarray, counts: np.ndarray, new: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts with those of new sets added; if there are more than `most`, those met once go."""
    flat = np.concatenate([grams, *new])
    weight = np.concatenate([counts, np.ones(len(flat) - len(grams), np.int64)])
    by = np.argsort(flat, kind="stable")
    flat, weight = flat[by], weight[by]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    grams, counts = flat[start], np.add.reduceat(weight, start) if len(start) else weight
    if len(grams) > most:
        keep = counts > 1
        grams, counts = grams[keep], counts[keep]
    return grams, counts


def _common(size: int, salt: int):
    """Per task the n-grams met in most of its documents, at most COMMON_PER_TASK of them, by lossy counting."""

    def run(batches):
        grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, waiting = [], 0
        for batch in batches:
            for _, sets in _sets(batch.column(0), size, salt):
                held += sets
                waiting += sum(map(len, sets))
                if waiting > COUNTED // 2:
                    grams, counts = _counted(grams, counts, held, COUNTED)
                    held, waiting = [], 0
        if held:
            grams, counts = _counted(grams, counts, held, COUNTED)
        often = counts > 1
        grams, counts = grams[often], counts[often]
        if len(grams) > COMMON_PER_TASK:
            top = np.argpartition(-counts, COMMON_PER_TASK)[:COMMON_PER_TASK]
            grams, counts = grams[top], counts[top]
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    return run


class Order:
    """Numbers n-grams so that common ones come after all others, the most common last. Fixed by at most COMMON numbers."""

    def __init__(self, common: np.ndarray):
        by = np.argsort(common)
        self.common, self.rank = common[by], by.astype(np.uint64)
        self.hit = np.zeros(1 << 20, bool)
        self.hit[(common >> np.uint64(44)).astype(np.int64)] = True

    def place(self, grams: np.ndarray) -> np.ndarray:
        """The sorted numbers of a sorted set: half the hash, or 2**63 and the rank of a common n-gram."""
        out = grams >> np.uint64(1)
        maybe = np.flatnonzero(self.hit[(grams >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return out
        at = np.minimum(np.searchsorted(self.common, grams[maybe]), len(self.common) - 1)
        real = self.common[at] == grams[maybe]
        maybe, at = maybe[real], at[real]
        if not len(maybe):
            return out
        return np.concatenate([np.delete(out, maybe), np.sort(self.rank[at]) | np.uint64(1 << 63)])


def _name(grams: np.ndarray, salt: int) -> int:
    """A class's number."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8, salt=salt.to_bytes(4, "little")).digest(), "little", signed=True)


def _rows(size: int, percent: int, common: np.ndarray, salt: int):
    """Per document: its own key, the class, what proves it (see proven_sets), the set's size and the first columns of its row."""

    def run(batches):
        order = Order(common)
        for batch in batches:
            for a, found in _sets(batch.column(0), size, salt, proven_sets):
                n = [len(v) for v, _, _ in found]
                first = [order.place(v)[: k - -(-percent * k // 100) + 1].tobytes() if k else b"" for (v, _, _), k in zip(found, n)]
                part, proof = batch.slice(a, len(found)), np.array([x for _, x, _ in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array([_name(v, salt) for v, _, _ in found]), pa.array(proof), pa.array([x for *_, x in found]), pa.array(n, pa.int64()), pa.array(first, pa.binary())],
                    names=["doc_id", "tkey", "id", "proof", "clash", "n", "first"],
                )

    return run


def _scatter(blocks: int, hot: np.ndarray, chunks: np.ndarray):
    """Entries of the matrix by block of columns, as bytes of columns and of rows. A hot column's rows are dealt to chunks."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            g, r = (np.concatenate(x) for x in zip(*held))
            held.clear()
            block = (mix(g) % np.uint64(blocks)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                own = np.flatnonzero(hot[at] == g)
                chunk = mix(r[own].view(np.uint64)) % chunks[at[own]]
                block[own] = (mix(g[own] + (chunk << np.uint64(32))) % np.uint64(blocks)).astype(np.int64)
            by = np.argsort(block, kind="stable")
            g, r, block = g[by], r[by], block[by]
            start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            ends = [*start[1:], len(block)]
            data = [pa.array([x[i:j].tobytes() for i, j in zip(start, ends)], pa.binary()) for x in (g, r)]
            yield pa.RecordBatch.from_arrays([pa.array(block[start].astype(np.int32)), *data], names=["block", "grams", "rows"])

        waiting, seen = 0, set()
        for batch in batches:
            for i, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i in seen:  # a copy; those in other tasks meet in the block
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(i)
                g = np.frombuffer(first, np.uint64)
                held.append((g, np.full(len(g), i, np.int64)))
                waiting += len(g)
                if waiting >= ENTRIES_PER_BLOCK:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _columns(hot: np.ndarray):
    """Entries of columns with two rows or more; lead is set for the first of the columns that have the same rows. Of a hot
    column, a task has some rows; all its entries come, with lead unknown."""

    def run(batches):
        got = [(g, r) for batch in batches for g, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if not got:
            return
        g = np.frombuffer(b"".join(x for x, _ in got), np.uint64)
        r = np.frombuffer(b"".join(x for _, x in got), np.int64)
        by = np.lexsort((r, g))
        g, r = g[by], r[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
        g, r = g[new], r[new]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(start, len(g)))
        marks = [np.add.reduceat(mix(r.view(np.uint64) + np.uint64(k)), start) for k in (1, 0x51ED2701)]
        part = np.isin(g[start], hot)
        many = np.flatnonzero((size > 1) & ~part)
        _, one = np.unique(np.stack([m[many] for m in marks], 1), axis=0, return_index=True) if len(many) else (0, many)
        lead = np.zeros(len(start), bool)
        lead[many[one]] = True
        lead, part = np.repeat(lead, size), np.repeat(part, size)
        rows = np.flatnonzero(np.repeat(size > 1, size) | part)
        for i in range(0, len(rows), 100_000):
            at = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(g[at])), pa.array(r[at]), pa.array(lead[at], mask=part[at])], names=["col", "id", "lead"])

    return run


def _groups(batches, keys: int):
    """Rows that come sorted by their first `keys` columns, as one list of rows for each group."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _entries(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the entries whose column two rows or more have, by column, and these columns' values."""
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    useful = count > 1
    keep = useful[place]
    own, place = own[keep], (np.cumsum(useful) - 1)[place[keep]]
    by = np.argsort(place, kind="stable")
    return own[by], place[by], values[useful]


def _blocks(own: np.ndarray, place: np.ndarray, rows: int, edges: list[int]):
    """The matrix, a block of columns at a time."""
    for a, b in zip(edges, edges[1:]):
        i, j = np.searchsorted(place, (a, b))
        m = np.zeros((rows, b - a), np.float32)
        m[own[i:j], place[i:j] - a] = 1
        yield b, m


def _product(lists: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlap counts of all pairs of sets, and those over numbers below `before`, accumulated block by block of columns."""
    k = len(lists)
    own, place, values = _entries(lists)
    total, early = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    split = int(np.searchsorted(values, before))
    for end, m in _blocks(own, place, k, sorted({*range(0, len(values), VOCABULARY), split, len(values)})):
        part = m @ m.T
        total += part
        if end <= split:
            early += part
    return total, early


def _masked_product(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Overlap counts of the pairs (i, j) of sets, accumulated block by block of columns: the whole product of a block if
    the pairs are many, else the products of their rows alone."""
    own, place, values = _entries(lists)
    out, many = np.zeros(len(i), np.float64), len(i) > 4 * len(lists)
    for _, m in _blocks(own, place, len(lists), [*range(0, len(values), VOCABULARY), len(values)]):
        if many:
            out += (m @ m.T)[i, j]
        else:
            for a in range(0, len(i), STRIPE):
                at = slice(a, a + STRIPE)
                out[at] += np.einsum("pc,pc->p", m[i[at]], m[j[at]])
    return out.astype(np.int64)


def _sparse_product(lists: list[np.ndarray], group: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same product for many small groups of rows at once: pairs of rows (i < j) of one group that share a column, their
    overlap counts, and those over columns below the group's `before`. Each column adds the outer product of its entries."""
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value, of = np.concatenate(lists), group[own]
    by = np.lexsort((own, value, of))
    own, value, of = own[by], value[by], of[by]
    start = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])]))
    size = np.diff(np.append(start, len(own)))
    codes, low = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for k in np.unique(size[size > 1]).tolist():
        s = start[size == k]
        x, y = np.triu_indices(k, 1)
        rows = own[s[:, None] + np.arange(k)]
        codes.append((rows[:, x] * len(lists) + rows[:, y]).ravel())
        low.append(np.repeat(value[s] < before[of[s]], len(x)))
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    early = np.bincount(place, np.concatenate(low), len(code))
    return code // len(lists), code % len(lists), np.bincount(place, minlength=len(code)), early


def _candidates(percent: int):
    """Per column (or pair of chunks of one): the pairs that this column owns and that the bounds leave."""

    def possible(n, rest, i, j, both, early):
        x, y = n[i], n[j]
        ok = (early == 0) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        return ok & ((both + np.maximum(rest[i], rest[j])) * (100 + percent) >= (x + y) * percent)

    def numbers(rows):
        n = np.array([r[4] for r in rows], np.int64)
        return np.array([r[3] for r in rows], np.int64), n, -(-percent * n // 100) - 1 + np.array([r[6] for r in rows], np.int64), np.array([r[2] for r in rows])

    def sets_of(rows):
        # Rows of a column share it, though a row with many shared columns may have been sent without it.
        return [np.unique(np.array([*r[5], r[1]], np.int64)) for r in rows]

    def large(rows):
        ids, n, rest, side = numbers(rows)
        both, early = _product(sets_of(rows), rows[0][1])
        out = []
        for a in range(0, len(rows), STRIPE):  # a stripe of the pairs' matrix at a time
            i, j = np.arange(a, min(a + STRIPE, len(rows)))[:, None], np.arange(len(rows))[None, :]
            ok = (j < i) & possible(n, rest, i, j, both[a : a + STRIPE], early[a : a + STRIPE])
            if rows[0][7]:
                ok &= side[i] != side[j]
            x, y = np.nonzero(ok)
            out.append((x + a, y))
        a, b = (np.concatenate(x) for x in zip(*out))
        return [(rows[0][0], ids[a], ids[b])] if len(a) else []

    def small(groups):
        rows = [r for g in groups for r in g]
        of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        ids, n, rest, side = numbers(rows)
        apart = np.array([g[0][7] for g in groups])
        i, j, both, early = _sparse_product(sets_of(rows), of, np.array([g[0][1] for g in groups], np.int64))
        ok = possible(n, rest, i, j, both, early) & ~(apart[of[i]] & (side[i] == side[j]))
        i, j = i[ok], j[ok]
        start = np.flatnonzero(np.concatenate([[True], of[i][1:] != of[i][:-1]])) if len(i) else []
        return [(groups[of[i[a]]][0][0], ids[i[a:b]], ids[j[a:b]]) for a, b in zip(start, [*start[1:], len(i)])]

    def told(found):
        for a in range(0, len(found), 500):
            part = found[a : a + 500]
            ids = [np.unique(np.concatenate([x, y])).tolist() for _, x, y in part]
            columns = [pa.array([k for k, _, _ in part], pa.int64()), pa.array(ids, pa.list_(pa.int64())), *(pa.array([p[c].tobytes() for p in part], pa.binary()) for c in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "a", "b"])

    def run(batches):
        held, waiting = [], 0
        for rows in _groups(batches, 2):
            if len(rows) > SMALL:
                yield from told(large(rows))
                continue
            if len(rows) > 1:
                held.append(rows)
                waiting += sum(len(r[5]) + 1 for r in rows)
            if waiting > BATCH_ENTRIES:
                yield from told(small(held))
                held, waiting = [], 0
        if held:
            yield from told(small(held))

    return run


def _families(a: np.ndarray, b: np.ndarray):
    """One row for each family that pairs join: its least id, all its ids and its pairs."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:  # the least label of a neighbour, then that one's label
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    for k in np.unique(label):
        own = label[i] == k
        yield int(ids[k]), ids[label == k].tolist(), a[own].tobytes(), b[own].tobytes()


def _rows_of(rows) -> pa.RecordBatch:
    kinds = {"rep": pa.int64(), "ids": pa.list_(pa.int64()), "a": pa.binary(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))


def _chunk(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(max(1, chunks))).astype(np.int64)


def _key(family: int, x: int, y: int) -> int:
    """A number for a pair of chunks of a family."""
    h = (family * 0x9E3779B97F4A7C15 + x * 0xBF58476D1CE4E5B9 + y * 0x94D049BB133111EB) & ((1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def _routed(batches):
    """Pairs of families, by pairs of chunks: (family, chunks, a, b) to (key, a, b)."""
    for batch in batches:
        for family, chunks, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            x, y = _chunk(a, chunks), _chunk(b, chunks)
            x, y = np.minimum(x, y), np.maximum(x, y)
            for code in np.unique(x * chunks + y).tolist():
                own = x * chunks + y == code
                yield pa.RecordBatch.from_arrays([pa.array([_key(family, *divmod(code, chunks))]), pa.array([a[own].tobytes()], pa.binary()), pa.array([b[own].tobytes()], pa.binary())], names=["key", "a", "b"])


def _overlaps(lists: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap counts of pairs of ids."""
    ids = np.array(sorted(lists), np.int64)
    return _masked_product([lists[i] for i in ids.tolist()], np.searchsorted(ids, a), np.searchsorted(ids, b))


def _pairs_of(rows, at: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(r[k] for r in rows if r[1] == 0), np.int64) for k in (at, at + 1))


def _narrowed(percent: int):
    """Per column: the pairs that the bound leaves over all shared columns. Rows: key, kind, id, cols, a, b, n."""

    def run(batches):
        for rows in _groups(batches, 1):
            a, b = _pairs_of(rows, 4)
            lists = {r[2]: np.array(r[3], np.int64) for r in rows if r[1] == 1}
            sizes = {r[2]: r[6] for r in rows if r[1] == 1}
            x, y = (np.array([sizes[i] for i in ids.tolist()], np.int64) for ids in (a, b))
            reach = _overlaps(lists, a, b) + -(-percent * np.maximum(x, y) // 100) - 1
            ok = reach * (100 + percent) >= (x + y) * percent
            if ok.any():
                yield _rows_of(list(_families(a[ok], b[ok])))

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what others don't."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = top(x), top(y)
        if i != j:
            up[i] = j
            out.append((x, y))
    return out


def _linked(percent: int):
    """Per column: the candidate pairs whose whole rows overlap enough, as a spanning forest."""

    def run(batches):
        for rows in _groups(batches, 1):
            a, b = _pairs_of(rows, 3)
            if not len(a):
                continue
            sets = {r[2]: np.frombuffer(r[3], np.uint64) for r in rows if r[1] == 1}
            x, y = (np.array([len(sets[i]) for i in ids.tolist()], np.int64) for ids in (a, b))
            both = _overlaps(sets, a, b)
            ok = 100 * both >= percent * (x + y - both)
            found = _forest(a[ok], b[ok])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


def _take_sets(size: int, salt: int):
    """A class's whole set, once for each pair of chunks of its family that it is in."""

    def run(batches):
        for batch in batches:
            want, family, chunks = (batch.column(k).to_pylist() for k in (1, 2, 3))
            for a, sets in _sets(batch.column(0), size, salt):
                for k, v in enumerate(sets, a):
                    if not len(v) or _name(v, salt) != want[k]:
                        continue
                    own = int(_chunk(np.array([want[k]], np.int64), chunks[k])[0])
                    keys = [_key(family[k], min(own, z), max(own, z)) for z in range(chunks[k])]
                    for i in range(0, len(keys), 16):
                        part = keys[i : i + 16]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([want[k]] * len(part), pa.int64()), pa.array([v.tobytes()] * len(part), pa.binary())], names=["key", "id", "grams"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, tkey (the text's 64-bit hash) and first_key.

    Texts are lower-cased (A-Z) and cut into words [^\\x20\\x09-\\x0D]+; a set has the distinct `size`-word shingles, or
    the whole sequence if there are fewer words. Null, empty and blank texts have empty sets, link with nothing and are
    components of their own. Documents with 100*overlap >= percent*union are linked; component_id is the least id
    reachable, first_key the (id, tkey) that sorts first in the component. Null ids sort first and stay null. Repeated
    rows are repeated in the result. Extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "ngram-jaccard")
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"))
    schema = "doc_id long, tkey long, id long, proof long, clash boolean, n long, first binary"
    for salt in range(MOST_SALTS):
        top = d.select("text").mapInArrow(_common(size, salt), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(COMMON)
        often = top.filter("n > 2").toArrow()  # at most COMMON, most common first
        common, count = often.column(0).to_numpy().view(np.uint64)[::-1].copy(), often.column(1).to_numpy()[::-1]
        found = s.cut(d.mapInArrow(_rows(size, percent, common, salt), schema), f"documents{salt}")
        odd = found.filter("n > 0").groupBy("id").agg(F.min("proof").alias("x"), F.max("proof").alias("y"), F.max("clash").alias("z")).filter("x <> y OR z")
        if odd.isEmpty():
            break
        s.drop(f"documents{salt}")
    else:
        raise RuntimeError(f"hashes collide under {MOST_SALTS} keys")
    light = s.cut(found.select("doc_id", "tkey", "id", "n"), "light")
    classes = s.cut(light.filter("n > 0").groupBy("id").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "tkey")).alias("one")), "classes")
    entries = classes.agg(F.sum(F.expr(f"n - ({percent} * n + 99) DIV 100 + 1"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / ENTRIES_PER_BLOCK))
    at = np.flatnonzero(count > HOT_ROWS)
    hot, chunks = at.astype(np.uint64) | np.uint64(1 << 63), -(-count[at] // HOT_ROWS).astype(np.uint64) if len(at) else at.astype(np.uint64)
    spread = found.filter("n > 0").select("id", "first").mapInArrow(_scatter(blocks, hot, chunks), "block int, grams binary, rows binary")
    cols = s.cut(spread.repartition(blocks, "block").select("grams", "rows").mapInArrow(_columns(hot), "col long, id long, lead boolean"), "columns")
    if len(hot):
        cols = _hot_leads(s, cols)
    s.drop(f"documents{salt}")
    links = _links(s, d, cols, classes, size, percent, salt, blocks)
    label = components(links, s)
    docs_in = s.cut(light.filter("n > 0").join(label, "id", "left").select("doc_id", "tkey", "n", F.coalesce("comp", "id").alias("comp")), "labelled")
    best = s.cut(docs_in.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "tkey")).alias("first_key")), "components")
    out = docs_in.join(best, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "tkey", "first_key")
    alone = light.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "tkey", F.struct("doc_id", "tkey").alias("first_key"))
    return out.unionByName(alone)


def _hot_leads(s: Scratch, cols: DataFrame) -> DataFrame:
    """cols with lead filled in for hot columns: the first of those that have the same rows, told by sums over these."""
    hot = cols.filter("lead IS NULL")
    marks = hot.groupBy("col").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("k > 1")
    marks = s.cut(marks, "hot")
    lead = marks.groupBy("k", "x", "y").agg(F.min("col").alias("col")).select("col", F.lit(True).alias("first"))
    named = marks.select("col").join(lead, "col", "left").select("col", F.coalesce("first", F.lit(False)).alias("first"))
    filled = hot.join(F.broadcast(named), "col").select("col", "id", F.col("first").alias("lead"))  # at most COMMON rows
    return cols.filter("lead IS NOT NULL").unionByName(filled)


def _links(s: Scratch, d: DataFrame, cols: DataFrame, classes: DataFrame, size: int, percent: int, salt: int, blocks: int) -> DataFrame:
    """Links (a, b) between classes, a spanning forest for each column."""
    shared = cols.groupBy("id").agg(F.sort_array(F.collect_list("col")).alias("cols"))  # no more than a row's first columns
    shared = s.cut(shared, "shared")
    sent = shared.select("id", F.slice("cols", 1, SENT).alias("cols"), F.greatest(F.lit(0), F.size("cols") - SENT).alias("more"))
    at = cols.filter("lead").select("col", "id").join(classes.select("id", "n"), "id")
    large = at.groupBy("col").agg(F.count("*").alias("k"), F.sum("n").alias("w")).select("col", F.ceil(F.greatest(F.col("k") / CHUNK_ROWS, F.col("w") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    large = s.cut(large.filter("chunks > 1"), "large")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    whole = at.join(large.select("col"), "col", "left_anti").select("col", F.lit(0).alias("side"), "id", "n", F.lit(0).alias("x"), F.lit(0).alias("y"))
    cut = at.join(large, "col").withColumn("side", mine).withColumn("z", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("col", "side", "id", "n", F.least("side", "z").alias("x"), F.greatest("side", "z").alias("y"))
    rows = whole.unionByName(cut).join(sent, "id").withColumn("key", F.xxhash64("col", "x", "y"))
    rows = rows.select("key", F.col("col"), "side", "id", "n", "cols", "more", (F.col("x") != F.col("y")).alias("apart"), "x", "y")
    rows = rows.repartition(blocks, "key").sortWithinPartitions("key", "col", "x", "y").drop("x", "y")
    blob = "key long, ids array<long>, a binary, b binary"
    some = s.cut(rows.mapInArrow(_candidates(percent), blob), "some")
    need = some.select("key", F.explode("ids").alias("id")).join(shared, "id").join(classes.select("id", "n"), "id")
    need = need.select("key", F.lit(1).alias("kind"), "id", "cols", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"), "n")
    both = need.unionByName(some.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("cols"), "a", "b", F.lit(0).cast("long").alias("n")))
    both = both.repartition(blocks, "key").sortWithinPartitions("key", "kind")
    pairs = s.cut(both.mapInArrow(_narrowed(percent), "rep long, ids array<long>, a binary, b binary"), "pairs")
    s.drop("some", "shared", "large")
    star = pairs.select(F.col("rep").alias("a"), F.explode("ids").alias("b"))
    family = components(star, s, "families").withColumnRenamed("comp", "family")
    member = s.cut(classes.join(family, "id"), "members")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n") / CHUNK_GRAMS)).cast("int")
    member = s.cut(member.join(s.cut(member.groupBy("family").agg(chunks.alias("chunks")), "chunks"), "family"), "used")
    mine = member.select("id", "family", "chunks", F.col("one.doc_id").alias("w_doc"), F.col("one.tkey").alias("w_key"))
    if mine.count() <= BROADCAST_ROWS:
        mine = F.broadcast(mine)  # at most BROADCAST_ROWS rows of some 50 bytes; beyond that a sorted join
    mine = d.join(mine, (d.tkey == F.col("w_key")) & d.doc_id.eqNullSafe(F.col("w_doc")))
    sets = mine.select("text", "id", "family", "chunks").mapInArrow(_take_sets(size, salt), "key long, id long, grams binary")
    need = sets.select("key", F.lit(1).alias("kind"), "id", F.col("grams").alias("a"), F.lit(None).cast("binary").alias("b"))
    routed = pairs.join(member.select(F.col("id").alias("rep"), "family", "chunks"), "rep").select("family", "chunks", "a", "b").mapInArrow(_routed, "key long, a binary, b binary")
    both = need.unionByName(routed.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "a", "b"))
    both = both.repartition(blocks, "key").sortWithinPartitions("key", "kind")
    return s.cut(both.mapInArrow(_linked(percent), "a long, b long"), "links")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that come first in their component, with all their columns, whatever their names: one row of each."""
    s = Scratch(docs.sparkSession, "keep-first")
    found = near_groups(docs, id_col, text_col)
    stay = s.cut(found.filter("struct(doc_id, tkey) <=> first_key").select("doc_id", "tkey", "n_shingles"), "stay")
    twice = s.cut(stay.filter("n_shingles > 0").groupBy("doc_id", "tkey").count().filter("count > 1").select("doc_id", "tkey"), "twice")
    row = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    same = F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("tkey"))
    held = row.join(stay, same, "left_semi")
    if not twice.isEmpty():
        held = held.join(twice, same, "left_anti").unionByName(held.join(twice, same, "left_semi").dropDuplicates(["own", "key"]))
    return held.select("row.*")
