"""Levenshtein distances of many strings to many others: bit-parallel columns, shared along a trie of the others."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Queries that are walked together, pairs of a query and a node at most, levels between two prunings.
TOGETHER, ALIVE, EACH = 256, 1 << 17, 2

ONE, ONES = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _deltas() -> tuple[np.ndarray, np.ndarray]:
    """For eight rows' steps up and down: their sum, and the least sum of the first few."""
    up, down = np.arange(256)[:, None, None] >> np.arange(8) & 1, np.arange(256)[None, :, None] >> np.arange(8) & 1
    sums = np.cumsum(up - down, axis=2)
    return sums[..., -1].astype(np.int8).ravel(), sums.min(axis=2).astype(np.int8).ravel()


SUM, LOW = _deltas()


def code_points(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the strings' lengths."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, strings), np.int64, len(strings))


class Trie:
    """``strings`` are distinct and sorted by code points. Nodes are numbered by level; a node's children lie together."""

    def __init__(self, strings: Sequence[str]):
        codes, n = code_points(strings)
        self.lengths, rows, width = n, len(strings), int(n.max(initial=0))
        self.alphabet, flat = np.unique(codes, return_inverse=True)
        inside = np.arange(width) < n[:, None]
        grid = np.full((rows, width), -1, np.int32)
        grid[inside] = flat
        # a string has nodes of its own from where it departs from the one before
        fresh = inside.copy()
        if rows > 1 and width:
            differs = grid[1:] != grid[:-1]
            fresh[1:] &= np.arange(width) >= np.where(differs.any(axis=1), differs.argmax(axis=1), width)[:, None]
        by_level = fresh.T
        number = np.cumsum(by_level.ravel()).reshape(by_level.shape)
        level, row = np.nonzero(by_level)
        self.char = np.concatenate([[0], grid[row, level]]).astype(np.int32)
        parent = np.where(level > 0, number[np.maximum(level - 1, 0), row], 0)
        self.count = np.bincount(parent, minlength=len(self.char)).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count + 1).astype(np.int32)
        self.parent, self.level = parent, level
        self.ends = np.full(len(self.char), -1, np.int32)
        self.ends[np.where(n > 0, number[np.maximum(n - 1, 0), np.arange(rows)] if width else 0, 0)] = np.arange(rows)
        # how long the strings below a node are: the middle of the least and the greatest length, and how far off these are
        lo, hi = self.extremes(n)
        self.longest, self.middle = hi.astype(np.int32), ((lo + hi) // 2).astype(np.int32)
        self.off = self.longest - self.middle

    def extremes(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the least and the greatest value that strings below it have in ``of``."""
        big = np.iinfo(np.int64).max
        lo, hi = np.full(len(self.char), big), np.full(len(self.char), -1)
        at = np.flatnonzero(self.ends >= 0)
        lo[at] = hi[at] = of[self.ends[at]]
        bounds = np.searchsorted(self.level, np.arange(int(self.level.max(initial=-1)) + 2)) + 1
        for k in range(len(bounds) - 2, -1, -1):
            p = self.parent[bounds[k] - 1 : bounds[k + 1] - 1]
            np.minimum.at(lo, p, lo[bounds[k] : bounds[k + 1]])
            np.maximum.at(hi, p, hi[bounds[k] : bounds[k + 1]])
        return lo, hi

    def spread(self, of: np.ndarray) -> np.ndarray:
        """For each node the value that all strings below it have in ``of``, else -1."""
        lo, hi = self.extremes(of)
        return np.where(lo == hi, lo, -1)

    def within(self, queries: Sequence[str], radius: np.ndarray, own: np.ndarray | None = None, groups: np.ndarray | None = None, by_length: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``query, string, distance`` of all pairs within the query's radius, in batches.

        With ``own`` and ``groups`` strings of the query's own group are passed over: whole branches of it at once.
        ``by_length``, which doesn't fall, bounds the distance by the length of the longer of the two as well.
        """
        order = np.argsort(np.fromiter(map(len, queries), np.int64, len(queries)), kind="stable")
        label = None if groups is None else self.spread(groups)
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            yield from self._walk([queries[i] for i in some], some, radius[some].astype(np.int32), None if own is None else own[some], label, groups, by_length)

    def _walk(self, queries, names, radius, own, label, groups, by_length):
        codes, m = code_points(queries)
        m = m.astype(np.int32)
        words = max(1, -(-int(m.max(initial=0)) // 64))
        which = np.repeat(np.arange(len(queries)), m)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(m) - m, m)
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        known = self.alphabet[at] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        letters = max(1, len(self.alphabet))
        equal = np.zeros((words, len(queries) * letters), np.uint64)
        np.bitwise_or.at(equal, (place[known] // 64, which[known] * letters + at[known]), ONE << (place[known] % 64).astype(np.uint64))
        # where a query ends: the word of its last row and the place in it
        last, high = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        up, down, score = np.full((words, len(q)), ONES), np.zeros((words, len(q)), np.uint64), m.astype(np.int32)
        stack = [(0, q, node, up, down, score, False)]
        while stack:
            depth, q, node, up, down, score, seen = stack.pop()
            while len(q):
                end = self.ends[node]
                # what was halved has been looked at
                hit = np.flatnonzero((end >= 0) & (score <= radius[q]) & (not seen))
                seen = False
                if groups is not None and len(hit):
                    hit = hit[groups[end[hit]] != own[q[hit]]]
                if len(hit):
                    yield names[q[hit]], end[hit].astype(np.int64), score[hit]
                if depth:
                    far = radius[q] if by_length is None else np.minimum(radius[q], by_length[np.maximum(m[q], self.longest[node])])
                    # distances don't fall along a diagonal, so what stands on the one that ends where a string does is its bound
                    row = m[q] - self.middle[node] + depth
                    keep = np.flatnonzero(depth + self._sum(up, down, row) - np.minimum(row, 0) - self.off[node] <= far)
                    if depth % EACH == 0 and self.off[node[keep]].any():
                        keep = keep[depth + self._least(up[:, keep], down[:, keep]) <= far[keep]]
                    if len(keep) < len(q):
                        q, node, up, down, score = q[keep], node[keep], up[:, keep], down[:, keep], score[keep]
                count = self.count[node]
                total = int(count.sum())
                if total > ALIVE and len(q) > 1:
                    half = len(q) // 2
                    stack.append((depth, q[half:], node[half:], up[:, half:], down[:, half:], score[half:], True))
                    q, node, up, down, score, count = q[:half], node[:half], up[:, :half], down[:, :half], score[:half], count[:half]
                    stack.append((depth, q, node, up, down, score, True))
                    break
                if not total:
                    break
                was = np.repeat(np.arange(len(q)), count)
                node = np.arange(total) + (self.first[node] - (np.cumsum(count) - count))[was]
                if label is not None:
                    keep = np.flatnonzero(label[node] != own[q[was]])
                    was, node = was[keep], node[keep]
                q = q[was]
                if not len(q):
                    break
                up, down, score = self._step(up[:, was], down[:, was], score[was], equal, q * letters + self.char[node], last[q], high[q], m[q], words)
                depth += 1

    @staticmethod
    def _step(up, down, score, equal, at, last, high, m, words):
        enter = None
        for w in range(words):
            eq, p, n = equal[w][at], up[w], down[w]
            xv = eq | n
            if enter is not None:
                eq = eq | (enter < 0).astype(np.uint64)
            xh = (((eq & p) + p) ^ p) | eq
            hp, hn = n | ~(xh | p), p & xh
            # a query without characters has no row to follow: its distance is the depth
            change = (hp >> high & ONE).astype(np.int32) - (hn >> high & ONE).astype(np.int32)
            score = score + np.where(last == w, np.where(m == 0, 1, change), 0)
            leave = None if w == words - 1 else (hp >> np.uint64(63)).astype(np.int8) - (hn >> np.uint64(63)).astype(np.int8)
            if enter is None:
                hp, hn = hp << ONE | ONE, hn << ONE
            else:
                hp, hn = hp << ONE | (enter > 0).astype(np.uint64), hn << ONE | (enter < 0).astype(np.uint64)
            up[w], down[w] = hn | ~(xv | hp), hp & xv
            enter = leave
        return up, down, score

    @staticmethod
    def _sum(up: np.ndarray, down: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The entry of each column in its ``row``, less its first; none before the first."""
        total = np.zeros(len(row), np.int32)
        for w in range(len(up)):
            mask = (ONE << np.clip(row - 64 * w, 0, 64).astype(np.uint64)) - ONE
            total += np.bitwise_count(up[w] & mask)
            total -= np.bitwise_count(down[w] & mask)
        return total

    @staticmethod
    def _least(up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The least entry of each column, less its first."""
        low = np.zeros(up.shape[1], np.int16)
        base = np.zeros(up.shape[1], np.int16)
        for w in range(len(up)):
            a = np.ascontiguousarray(up[w]).view(np.uint8).reshape(-1, 8).astype(np.uint16) << 8 | np.ascontiguousarray(down[w]).view(np.uint8).reshape(-1, 8)
            sums, lows = SUM[a], LOW[a]
            for k in range(8):
                np.minimum(low, base + lows[:, k], out=low)
                base += sums[:, k]
        return low
