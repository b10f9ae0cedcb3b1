"""Scalar kernels that SQL expressions can't state: plain Python over str or list, wrapped for Arrow batches in ``vectorised``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

#: Beyond this length quadratic kernels fall back, or refuse.
LONG = 10_000


def jaro(a: Sequence, b: Sequence, halve: bool = True) -> float:
    """``halve``: half of an odd number of transposed characters is rounded down."""
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, unused in zip(b, free) if not unused]
    swapped = sum(x != y for x, y in zip(left, right))
    m, t = len(left), swapped // 2 if halve else swapped / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: Sequence, b: Sequence, weight: float = 0.1, longest: int = 4, halve: bool = True) -> float:
    j = jaro(a, b, halve)
    same = 0
    for x, y in zip(a[:longest], b[:longest]):
        if x != y:
            break
        same += 1
    return min(1.0, j + same * weight * (1 - j)) if j > 0 else 0.0


def osa(a: Sequence, b: Sequence) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice."""
    if a == b:
        return 0
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            best = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, older[j - 2] + 1)
            row[j] = best
        older, old = old, row
    return old[-1]


def damerau(a: Sequence, b: Sequence) -> int:
    """Unrestricted Damerau-Levenshtein in linear space; optimal string alignment where a side is very long.

    A swap with edits in between pays only if one of its two letters is the last of its kind right before the cell,
    in its row or its column. So of the cells where such swaps begin, one for each column and one for the row are kept.
    """
    if a == b:
        return 0
    if max(len(a), len(b)) > LONG:
        return osa(a, b)
    far = len(a) + len(b) + 2
    seen: dict = {}
    before, old, new = [far] * (len(b) + 2), [far] * (len(b) + 2), [far, *range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        old, new = new, old
        column, corner, new[1], swap_base = -1, new[1], i, far
        for j, y in enumerate(b, 1):
            best = min(old[j] + (x != y), new[j] + 1, old[j + 1] + 1)
            if x == y:
                column, before[j + 1], swap_base = j, old[j - 1], corner
            else:
                row = seen.get(y, -1)
                if j - column == 1:
                    best = min(best, before[j + 1] + i - row)
                elif i - row == 1:
                    best = min(best, swap_base + j - column)
            corner, new[j + 1] = new[j + 1], best
        seen[x] = i
    return new[len(b) + 1]


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence, a machine word of columns at a time."""
    if len(a) < len(b):
        a, b = b, a
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def lcs_string(a: str, b: str) -> str:
    """The subsequence itself; of equally good ways back, the one that drops a character of ``b``."""
    if max(len(a), len(b)) > LONG:
        raise ValueError(f"lcs_string takes up to {LONG} characters")
    best = [[0] * (len(b) + 1)]
    for x in a:
        old, row = best[-1], [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        best.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def common_substring(a: str, b: str) -> str:
    """The longest string inside both; of several, the one that ends first in ``a``."""
    if max(len(a), len(b)) > LONG:
        raise ValueError(f"longest_common_substring takes up to {LONG} characters")
    size, end, old = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                row[j] = old[j - 1] + 1
                if row[j] > size:
                    size, end = row[j], i
        old = row
    return a[end - size : end]


@lru_cache(maxsize=1 << 16)
def graphemes(s: str) -> tuple[str, ...]:
    import regex

    return tuple(regex.findall(r"\X", s))
