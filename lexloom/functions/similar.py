"""Word similarity: the measures that rank suggestions, for single words and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGER_WORSE, ANY_MISMATCH, PLAIN = "longer", "any", ""


def ngram_score(n: int, a: str, b: str, penalty: str = PLAIN, weighted: bool = False) -> int:
    """Grams of a, of orders 1 to n, that occur in b; an order with less than two ends it. Then less for the lengths:
    b longer by more than 2 (LONGER_WORSE) or the lengths apart by more than 2 (ANY_MISMATCH). Weighted: a missing gram
    costs 1, and 1 more at either end of a, and no order ends it."""
    if not b:
        return 0
    total = 0
    for order in range(1, n + 1):
        hits = 0
        last = len(a) - order
        for i in range(last + 1):
            if a[i : i + order] in b:
                hits += 1
            elif weighted:
                hits -= 1 + (i in (0, last))
        total += hits
        if hits < 2 and not weighted:
            break
    extra = len(b) - len(a) - 2 if penalty == LONGER_WORSE else abs(len(b) - len(a)) - 2 if penalty == ANY_MISMATCH else 0
    return total - max(0, extra)


def left_common(a: str, b: str, lower, from_end: bool = False) -> int:
    """Length of the common start; b's first letter may be a capital. from_end: 1 if the last letters are equal."""
    if from_end:
        return int(bool(a and b and a[-1] == b[-1]))
    x, y = a[:1], b[:1]
    if x != y and x != lower(y):
        return 0
    n = 1
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for k, y in enumerate(b, 1):
            corner, row[k] = row[k], corner + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def common_positions(a: str, b: str, lower) -> tuple[int, bool]:
    """Places with equal letters (b's first one lowered), and whether the words differ by one exchange of two letters."""
    b = lower(b[:1]) + b[1:]
    same = sum(x == y for x, y in zip(a, b))
    apart = [k for k, (x, y) in enumerate(zip(a, b)) if x != y]
    swap = len(a) == len(b) and len(apart) == 2 and a[apart[0]] == b[apart[1]] and a[apart[1]] == b[apart[0]]
    return same, swap


def osa_distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace or exchange neighbours, each place touched once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def ngram_score_col(n: int, a: Column, b: Column, penalty: str = PLAIN) -> Column:
    """ngram_score for columns, unweighted."""

    def order(k: int) -> Column:
        starts = F.when(F.length(a) >= k, F.sequence(F.lit(1), F.greatest(F.length(a) - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.instr(b, F.substring(a, i, F.lit(k))) > 0))

    step = F.aggregate(
        F.array(*[order(k) for k in range(1, n + 1)]),
        F.struct(F.lit(0).alias("total"), F.lit(True).alias("on")),
        lambda acc, hits: F.struct((acc["total"] + F.when(acc["on"], hits).otherwise(0)).alias("total"), (acc["on"] & (hits >= 2)).alias("on")),
        lambda acc: acc["total"],
    )
    gap = F.length(b) - F.length(a) - 2 if penalty == LONGER_WORSE else F.abs(F.length(b) - F.length(a)) - 2 if penalty == ANY_MISMATCH else F.lit(0)
    return F.when(F.length(b) == 0, 0).otherwise(step - F.greatest(gap, F.lit(0)))


def osa_col(a: Column, b: Column) -> Column:
    """osa_distance for columns: rows of the table are folded over a's letters."""
    width = F.length(b)
    letter = lambda c, i: F.substring(c, i, F.lit(1))
    first = F.sequence(F.lit(0), width)

    def row(acc: Column, i: Column) -> Column:
        prev, older = acc["prev"], acc["older"]

        def cell(done: Column, j: Column) -> Column:
            best = F.least(
                F.element_at(prev, j + 1) + 1, F.element_at(done, -1) + 1,
                F.element_at(prev, j) + (letter(a, i) != letter(b, j)).cast("int"),
            )
            swap = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            return F.concat(done, F.array(F.when(swap, F.least(best, F.element_at(older, F.greatest(j - 1, F.lit(1))) + 1)).otherwise(best)))

        new = F.when(width == 0, F.array(i)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), F.array(i), cell))
        return F.struct(new.alias("prev"), prev.alias("older"))

    folded = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.struct(first.alias("prev"), first.alias("older")), row, lambda acc: F.element_at(acc["prev"], -1)
    )
    return F.when(F.length(a) == 0, width).otherwise(folded)
