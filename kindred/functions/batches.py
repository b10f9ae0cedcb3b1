"""The quadratic kernels over many pairs at once, in numpy: loops run over positions, not over pairs.

Sequences become rows of numbers, padded by 0. Results equal those of the scalar kernels, which take over for very
long sequences and for few pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from kindred.functions import kernels

#: Longest sequences that are padded, cells (pairs by both lengths) that are handled at a time, and fewest pairs worth it.
LONGEST, CELLS, FEW = 256, 1 << 21, 16


def padded(items: Sequence[Sequence], numbers: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each sequence, of code points or of ``numbers`` (beginning with 1) of its items, and the lengths."""
    size = np.array([len(s) for s in items], np.int64)
    if numbers is None:
        flat = np.frombuffer("".join(items).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    else:
        flat = np.array([numbers.setdefault(x, len(numbers) + 1) for s in items for x in s], np.int32)
    out = np.zeros((len(items), max(1, size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def jaro(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, halve: bool = True) -> np.ndarray:
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    at, far, wide = np.arange(y.shape[1]), int(reach.max(initial=0)), y.shape[1]
    free, met = at < m[:, None], np.zeros(x.shape, bool)
    near = np.abs(at) <= 0
    for i in range(x.shape[1]):
        low, high = max(0, i - far), min(wide, i + far + 1)
        if low >= high:
            break
        near = np.abs(at[low:high] - i) <= reach[:, None]
        hit = free[:, low:high] & near & (y[:, low:high] == x[:, i, None]) & (i < n)[:, None]
        some = np.flatnonzero(hit.any(1))
        met[some, i] = True
        free[some, low + hit[some].argmax(1)] = False
    used = ~free & (at < m[:, None])
    count = met.sum(1)
    row = np.repeat(np.arange(len(x)), count)
    swapped = np.bincount(row[x[met] != y[used]], minlength=len(x))
    t = swapped // 2 if halve else swapped / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (count / n + count / m + (count - t) / count) / 3
    score = np.where(count == 0, 0.0, score)
    same = (n == m) & (x[:, : min(x.shape[1], wide)] == y[:, : min(x.shape[1], wide)]).all(1)
    return np.where(same, 1.0, np.where((n == 0) | (m == 0), 0.0, score))


def jaro_winkler(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, weight: float = 0.1, longest: int = 4, halve: bool = True) -> np.ndarray:
    j = jaro(x, n, y, m, halve)
    k = min(longest, x.shape[1], y.shape[1])
    equal = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None])
    same = np.logical_and.accumulate(equal, 1).sum(1) if k else np.zeros(len(x), np.int64)
    return np.where(j > 0, np.minimum(1.0, j + same * weight * (1 - j)), 0.0)


def osa(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By diagonals: cell (i, k - i) of diagonal k needs the four diagonals before."""
    p, la, lb = len(x), x.shape[1], y.shape[1]
    back, far = y[:, ::-1], la + lb + 2
    lines = [np.full((p, la + 1), far, np.int32) for _ in range(5)]
    out = np.zeros(p, np.int64)
    for k in range(la + lb + 1):
        now = lines[k % 5]
        now[:] = far
        one, two, four = lines[(k - 1) % 5], lines[(k - 2) % 5], lines[(k - 4) % 5]
        if k <= lb:
            now[:, 0] = k
        if k <= la:
            now[:, k] = k
        low, high = max(1, k - lb), min(la, k - 1) + 1
        if low < high:
            i = slice(low, high)
            a, b = x[:, low - 1 : high - 1], back[:, lb - k + low : lb - k + high]
            best = np.minimum(np.minimum(one[:, low - 1 : high - 1], one[:, i]) + 1, two[:, low - 1 : high - 1] + (a != b))
            # i and j are 2 at least: not the first row, nor the cell whose column is 1
            first, last = max(low, 2), min(high, k - 1)
            if first < last:
                # x[i - 1] is y[j - 2], x[i - 2] is y[j - 1]
                swap = (x[:, first - 1 : last - 1] == back[:, lb - k + first + 1 : lb - k + last + 1]) & (x[:, first - 2 : last - 2] == back[:, lb - k + first : lb - k + last])
                part = best[:, first - low : last - low]
                part[:] = np.where(swap, np.minimum(part, four[:, first - 2 : last - 2] + 1), part)
            now[:, i] = best
        done = n + m == k
        out[done] = now[done, n[done]]
    return out


def damerau(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Row by row in linear space, as in ``kernels.damerau``; each cell is a step over all pairs."""
    p, la, lb = len(x), x.shape[1], y.shape[1]
    _, code = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = code[: x.size].reshape(x.shape), code[x.size :].reshape(y.shape)
    rows, far = np.arange(p), la + lb + 2
    seen = np.full((p, int(code.max(initial=0)) + 1), -1, np.int32)
    before = np.full((lb + 2, p), far, np.int32)
    old, new = np.full((lb + 2, p), far, np.int32), np.concatenate([np.full((1, p), far), np.broadcast_to(np.arange(lb + 1)[:, None], (lb + 1, p))]).astype(np.int32)
    out = np.where(n == 0, m, 0).astype(np.int64)
    for i in range(1, la + 1):
        old, new = new, old
        column = np.full(p, -1, np.int32)
        corner, new[1] = new[1].copy(), i
        swap_base = np.full(p, far, np.int32)
        for j in range(1, lb + 1):
            same = x[:, i - 1] == y[:, j - 1]
            best = np.minimum(np.minimum(old[j] + ~same, new[j] + 1), old[j + 1] + 1)
            row = seen[rows, y[:, j - 1]]
            cross = np.where(j - column == 1, before[j + 1] + (i - row), np.where(i - row == 1, swap_base + (j - column), far))
            best = np.where(same, best, np.minimum(best, cross))
            before[j + 1] = np.where(same, old[j - 1], before[j + 1])
            swap_base = np.where(same, corner, swap_base)
            column = np.where(same, j, column)
            corner = new[j + 1].copy()
            new[j + 1] = best
        seen[rows, x[:, i - 1]] = i
        done = np.flatnonzero(n == i)
        out[done] = new[m[done] + 1, done]
    return out


def common_substring(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the longest common substring ends in ``x``, first of several, and its length."""
    size, end = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    row = np.zeros((len(x), y.shape[1] + 1), np.int32)
    inside = np.arange(y.shape[1]) < m[:, None]
    for i in range(x.shape[1]):
        row[:, 1:] = np.where((y == x[:, i, None]) & inside & (i < n)[:, None], row[:, :-1] + 1, 0)
        best = row.max(1)
        longer = best > size
        size, end = np.where(longer, best, size), np.where(longer, i + 1, end)
    return end, size


def over(batch: Callable, scalar: Callable, clusters: bool = False) -> Callable[[list, list], list]:
    """A function of two lists: ``batch`` where that is worth it, else ``scalar``. ``clusters``: over grapheme clusters."""

    def run(a: list, b: list) -> list:
        x, y = ([kernels.graphemes(s) for s in t] if clusters else t for t in (a, b))
        longest = [max(len(p), len(q)) for p, q in zip(x, y)]
        out: list = [None] * len(a)
        order = sorted((k for k in range(len(a)) if longest[k] <= LONGEST), key=longest.__getitem__)
        if len(order) < FEW:
            order = []
        for k in set(range(len(a))) - set(order):
            out[k] = scalar(x[k], y[k])
        low = 0
        while low < len(order):
            # pairs of like length, none more than twice as long as the shortest of its group
            top = max(8, 2 * longest[order[low]])
            high = low
            while high < len(order) and longest[order[high]] <= top and (high - low) * longest[order[high]] ** 2 <= CELLS:
                high += 1
            some, low = order[low : max(high, low + 1)], max(high, low + 1)
            numbers: dict | None = {} if clusters else None
            p, n = padded([x[k] for k in some], numbers)
            q, m = padded([y[k] for k in some], numbers)
            for k, value in zip(some, batch(p, n, q, m).tolist()):
                out[k] = value
        return out

    return run


def substrings(a: list, b: list) -> list:
    found = over(lambda *x: np.stack(common_substring(*x), 1), lambda s, t: (len(w := kernels.common_substring(s, t)), w))(a, b)
    return [f[1] if isinstance(f[1], str) else s[f[0] - f[1] : f[0]] for f, s in zip(found, a)]
