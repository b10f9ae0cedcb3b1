"""Pairs of strings within an edit distance: blocks of both sides meet, and a trie of one block is walked for the other.

Only rows travel, each to the blocks it meets; pairs arise where they are asked for. All distances are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.trie import Trie
from kindred.plans.scratch import numbered

#: Strings of up to so many characters are met in blocks; rows of a block, groups of blocks at least, pairs that are written together.
LONGEST, BLOCK, GROUPS, TOGETHER = 512, 16384, 48, 1 << 16

ROWS = "pair long, asks boolean, id long, t string, s string, data long, far int"


def short(*columns: tuple[DataFrame, str]) -> bool:
    """Whether no string of these columns is longer than LONGEST."""
    return all((df.agg(F.max(F.length(c))).first()[0] or 0) <= LONGEST for df, c in columns)


def met(rows: DataFrame, run: Callable, schema: str, groups: int, apart: bool = False) -> DataFrame:
    """``run`` over the items and queries of each pair of blocks, as Arrow tables. ``apart``: each pair, from 0 on, is a task of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, now = [], None
        for b in batches:
            at = b.column("pair").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if at[i] != now and got:
                        yield from run_one(got)
                        got = []
                    now = at[i]
                    got.append(b.slice(i, j - i))
        if got:
            yield from run_one(got)

    def run_one(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got).combine_chunks()
        asks = table.column("asks")
        items, queries = table.filter(pc.invert(asks)), table.filter(asks)
        if len(items) and len(queries):
            yield from run(items, queries)

    # a number of partitions that is given isn't coalesced: few bytes are much work here
    dealt = rows.repartitionById(groups, F.col("pair").cast("int")) if apart else rows.repartition(groups, "pair")
    return dealt.sortWithinPartitions("pair").mapInArrow(each, schema)


def crossed(items: DataFrame, queries: DataFrame, n_items: int, n_queries: int) -> tuple[DataFrame, int]:
    """All items meet all queries. ``id, t, s, data`` and ``id, t, s, far``: the compared string, and what it is given back as."""
    across = max(1, -(-n_items // (2 * BLOCK)))
    down = max(1, -(-n_queries // BLOCK), min(-(-n_queries // 8), -(-GROUPS // across)))
    a = items.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("k"), F.pmod(F.xxhash64("id"), F.lit(across)).alias("own"), "id", "t", "s", "data")
    b = queries.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("k"), F.pmod(F.xxhash64("id"), F.lit(down)).alias("own"), "id", "t", "s", "far")
    left = a.select((F.col("k") * across + F.col("own")).cast("long").alias("pair"), F.lit(False).alias("asks"), "id", "t", "s", "data", F.lit(None).cast("int").alias("far"))
    right = b.select((F.col("own") * across + F.col("k")).cast("long").alias("pair"), F.lit(True).alias("asks"), "id", "t", "s", F.lit(None).cast("long").alias("data"), F.col("far").cast("int").alias("far"))
    return left.unionByName(right), across * down


def itself(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """All rows ``id, t, far`` meet each other: each two blocks once, and each block itself."""
    many = max(8, -(-n // BLOCK)) if n > 512 else 1
    own = rows.select("id", "t", "far", F.pmod(F.xxhash64("id"), F.lit(many)).alias("own"))
    none = [F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("data")]
    asks = own.withColumn("k", F.explode(F.sequence(F.col("own"), F.lit(many - 1).cast("long")))).select((F.col("own") * many + F.col("k")).cast("long").alias("pair"), F.lit(True).alias("asks"), "id", "t", *none, F.col("far").cast("int").alias("far"))
    items = own.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own")))).select((F.col("k") * many + F.col("own")).cast("long").alias("pair"), F.lit(False).alias("asks"), "id", "t", *none, F.lit(None).cast("int").alias("far"))
    return asks.unionByName(items), many * (many + 1) // 2


class Distinct:
    """The distinct strings of a block, sorted, and the rows of each."""

    def __init__(self, rows: pa.Table):
        coded = rows.column("t").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        of = at[coded.indices.to_numpy()]
        self.rows = np.argsort(of, kind="stable")
        self.count = np.bincount(of, minlength=len(order))
        self.start = np.cumsum(self.count) - self.count
        self.texts = coded.dictionary.take(pa.array(order))
        self.strings = self.texts.to_pylist()
        self.length = np.fromiter(map(len, self.strings), np.int64, len(self.strings))

    def lists(self, values: pa.Array, k: np.ndarray) -> pa.ListArray:
        """For each string of ``k`` what its rows have in ``values``."""
        ends = np.concatenate([[0], np.cumsum(self.count[k])])
        at = np.arange(ends[-1]) + np.repeat(self.start[k] - ends[:-1], self.count[k])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values.take(pa.array(self.rows[at])))


class Found(Distinct):
    """The items of a block as a trie of their distinct strings, and the rows of each of these."""

    def __init__(self, items: pa.Table):
        super().__init__(items)
        self.trie = Trie(self.strings)
        self.ids = items.column("id").to_numpy()

    def expand(self, q: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings to rows."""
        n = self.count[s]
        if (n == 1).all():
            return q, self.rows[self.start[s]], d
        k = np.repeat(np.arange(len(q)), n)
        within = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        return q[k], self.rows[self.start[s][k] + within], d[k]

    def within(self, queries: list[str], far: np.ndarray, *groups) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for x in self.trie.within(queries, far, *groups):
            yield self.expand(*x)


def gathered(hits: Iterator[tuple]) -> Iterator[tuple]:
    """The same in fewer, larger pieces."""
    some, n = [], 0
    for x in hits:
        some.append(x)
        n += len(x[0])
        if n >= TOGETHER:
            yield tuple(map(np.concatenate, zip(*some)))
            some, n = [], 0
    if some:
        yield tuple(map(np.concatenate, zip(*some)))


def likeness(d: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    longest = np.maximum(m, n)
    return np.where(longest == 0, 1.0, 1.0 - d / np.maximum(longest, 1))


def hits_within(items: DataFrame, queries: DataFrame, n_items: int, n_queries: int, limit: int | None = None, least: float | None = None, nearest: bool = False) -> DataFrame:
    """``query_id, query, id, text, distance, score, data``: items within each query's ``far``, which a ``least`` score may narrow.

    With a ``limit`` a block gives its best only, by score if there is a ``least`` and else by distance, then id.
    ``nearest``: as far as it takes to find so many.
    """

    def ranked(q, s, d, score, ids):
        order = np.lexsort((ids[s], d if least is None else -score, q))
        q = q[order]
        first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(q) else q
        return order[place < limit]

    def run(items: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        found, asked = Found(items), queries.column("t").to_pylist()
        m, n = np.fromiter(map(len, asked), np.int64, len(asked)), np.fromiter(map(len, items.column("t").to_pylist()), np.int64, len(items))
        texts, said, data = items.column("s").combine_chunks(), queries.column("s").combine_chunks(), items.column("data").combine_chunks()
        asks = queries.column("id").combine_chunks()

        def batch(q, s, d, score):
            for k in range(0, len(q), TOGETHER):
                a, b = pa.array(q[k : k + TOGETHER]), pa.array(s[k : k + TOGETHER])
                yield pa.RecordBatch.from_arrays([asks.take(a), said.take(a), pa.array(found.ids[s[k : k + TOGETHER]]), texts.take(b), pa.array(d[k : k + TOGETHER].astype(np.int32)), pa.array(score[k : k + TOGETHER]), data.take(b)], ["query_id", "query", "id", "text", "distance", "score", "data"])

        def scored(hits):
            for q, s, d in gathered(hits):
                score = likeness(d, m[q], n[s])
                if least is not None:
                    keep = np.flatnonzero(score >= least)
                    q, s, d, score = q[keep], s[keep], d[keep], score[keep]
                yield q, s, d, score

        if nearest:
            left, far, most = np.arange(len(asked)), 4, int(max(m.max(), n.max()))
            while len(left):
                got = list(scored(found.within([asked[k] for k in left], np.full(len(left), far))))
                q, s, d, score = map(np.concatenate, zip(*got)) if got else (np.zeros(0, np.int64),) * 4
                enough = (np.bincount(q, minlength=len(left)) >= limit) | (far >= most)
                names, left = left, left[~enough]
                keep = np.flatnonzero(enough[q])
                q, s, d, score = names[q[keep]], s[keep], d[keep], score[keep]
                best = ranked(q, s, d, score, found.ids)
                yield from batch(q[best], s[best], d[best], score[best])
                far *= 2
            return
        far = queries.column("far").to_numpy()
        if least is not None and least > 0:
            # a partner has m / least characters at most
            far = np.minimum(far, np.floor((1 - least) * np.floor(m / least + 1e-9) + 1e-9)).astype(np.int64)
        if limit is None:
            for x in scored(found.within(asked, far)):
                yield from batch(*x)
            return
        for k in range(0, len(asked), 256):
            got = list(scored(found.within(asked[k : k + 256], far[k : k + 256])))
            if got:
                q, s, d, score = map(np.concatenate, zip(*got))
                best = ranked(q, s, d, score, found.ids)
                yield from batch(q[best] + k, s[best], d[best], score[best])

    rows, groups = crossed(items, queries, n_items, n_queries)
    return met(rows, run, "query_id long, query string, id long, text string, distance int, score double, data long", groups)


def in_runs(rows: DataFrame, many: int, n: int) -> DataFrame:
    """``id, t, own``: ``rows`` in ``many`` runs of equal size, sorted by ``t``. Equal strings lie together, however many there are."""
    return numbered(rows, ["t", "id"]).select("id", "t", F.floor(F.col("nth") * many / max(n, 1)).alias("own"))


def matches(items: DataFrame, queries: DataFrame, n_items: int, n_queries: int, least: float) -> DataFrame:
    """``query_id, query, id, text, score``: rows ``id, t`` of both sides with a Levenshtein similarity of ``least``, above 0.

    Runs of sorted strings meet: a trie of neighbours has few nodes, and most runs are left soon. Distinct strings are
    compared once where runs meet, and go out with lists of their rows, so copies are expanded where the result is made.
    """
    across = max(1, -(-n_items // BLOCK))
    down = max(1, -(-n_queries // (BLOCK // 2)), min(-(-n_queries // 8), -(-GROUPS // across)))
    by_length = np.floor((1 - least) * np.arange(LONGEST + 1) + 1e-9).astype(np.int64)

    def run(items: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        found, asked = Found(items), Distinct(queries)
        ids, asks = items.column("id").combine_chunks(), queries.column("id").combine_chunks()
        # a partner has length / least characters at most
        far = np.floor((1 - least) * np.floor(asked.length / least + 1e-9) + 1e-9).astype(np.int64)
        for q, s, d in gathered(found.trie.within(asked.strings, far, by_length=by_length)):
            score = likeness(d, asked.length[q], found.length[s])
            keep = np.flatnonzero(score >= least)
            q, s, score = q[keep], s[keep], score[keep]
            rows = np.cumsum(asked.count[q] + found.count[s])
            cuts = np.unique([0, *np.searchsorted(rows, np.arange(2 * TOGETHER, rows[-1] if len(q) else 0, 2 * TOGETHER)).tolist(), len(q)])
            for i, j in zip(cuts, cuts[1:]):
                a, b = q[i:j], s[i:j]
                yield pa.RecordBatch.from_arrays([asked.lists(asks, a), asked.texts.take(pa.array(a)), found.lists(ids, b), found.texts.take(pa.array(b)), pa.array(score[i:j])], ["query_ids", "query", "ids", "text", "score"])

    a = in_runs(items, across, n_items).select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("k"), "own", "id", "t")
    b = in_runs(queries, down, n_queries).select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("k"), "own", "id", "t")
    left = a.select((F.col("k") * across + F.col("own")).cast("long").alias("pair"), F.lit(False).alias("asks"), "id", "t")
    right = b.select((F.col("own") * across + F.col("k")).cast("long").alias("pair"), F.lit(True).alias("asks"), "id", "t")
    found = met(left.unionByName(right), run, "query_ids array<long>, query string, ids array<long>, text string, score double", across * down, apart=True)
    return found.select(F.explode("query_ids").alias("query_id"), "query", "ids", "text", "score").select("query_id", "query", F.explode("ids").alias("id"), "text", "score")


def shared(a: str, b: str, gate: int) -> bool:
    return not {a[k : k + gate] for k in range(len(a) - gate + 1)}.isdisjoint(b[k : k + gate] for k in range(len(b) - gate + 1))


def radius(v: str, least: float):
    """How far a partner of a similarity of ``least`` can be; ``v`` names a column."""
    return F.floor((1 - least) * F.floor(F.length(v) / least + 1e-9) + 1e-9).cast("int")


def similar_to_itself(rows: DataFrame, n: int, least: float, gate: int, forest: bool = False) -> DataFrame:
    """``id_a, id_b, a, b, score``: rows ``id, t`` with id_a < id_b, a Levenshtein similarity of ``least`` and a common gram, each pair once.

    ``gate`` is the length of the grams, 0 for none. ``forest``: ``u, v`` only, which tie together what all of these
    pairs do; of each two blocks these are fewer than rows.
    """

    def run(items: pa.Table, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        found, asked, texts = Found(items), queries.column("t").to_pylist(), items.column("t").to_pylist()
        a, b = queries.column("t").combine_chunks(), items.column("t").combine_chunks()
        m, n = np.fromiter(map(len, asked), np.int64, len(asked)), np.fromiter(map(len, texts), np.int64, len(texts))
        ids, far = queries.column("id").to_numpy(), queries.column("far").to_numpy()
        # blocks are dealt by id: they are one and the same, or have no row in common
        same = bool(np.isin(ids, found.ids).any())

        def checked(hits):
            for q, s, d in gathered(hits):
                score = likeness(d, m[q], n[s])
                keep = np.flatnonzero((score >= least) & (ids[q] < found.ids[s]) if same else score >= least)
                q, s, d, score = q[keep], s[keep], d[keep], score[keep]
                if gate:
                    # an edit changes as many grams as these are long
                    doubtful = np.flatnonzero(np.maximum(m[q], n[s]) - gate + 1 <= gate * d)
                    if len(doubtful):
                        bad = [k for k in doubtful if not shared(asked[q[k]], texts[s[k]], gate)]
                        q, s, score = np.delete(q, bad), np.delete(s, bad), np.delete(score, bad)
                yield q, s, score

        if forest:
            yield from tied(found, asked, ids, far, checked)
            return
        for q, s, score in checked(found.within(asked, far)):
            for k in range(0, len(q), TOGETHER):
                i, j = q[k : k + TOGETHER], s[k : k + TOGETHER]
                less = ids[i] < found.ids[j]
                x, y = a.take(pa.array(i)), b.take(pa.array(j))
                cond = pa.array(less)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(less, ids[i], found.ids[j])), pa.array(np.where(less, found.ids[j], ids[i])), pc.if_else(cond, x, y), pc.if_else(cond, y, x), pa.array(score[k : k + TOGETHER])], ["id_a", "id_b", "a", "b", "score"])

    pairs, groups = itself(rows.withColumn("far", radius("t", least)), n)
    return met(pairs, run, "u long, v long" if forest else "id_a long, id_b long, a string, b string, score double", groups)


def tied(found: Found, asked: list[str], ids: np.ndarray, far: np.ndarray, checked: Callable) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a block's pairs: strings that are tied already aren't compared again."""
    from kindred.operators.cluster import least_of

    nodes = np.unique(np.concatenate([ids, found.ids]))
    top = np.arange(len(nodes))
    query, item = np.searchsorted(nodes, ids), np.searchsorted(nodes, found.ids)
    single, first = bool((found.count == 1).all()), found.rows[found.start]
    for k in range(0, len(asked), 512):
        part = slice(k, k + 512)
        own = top[query[part]]
        # equal strings in several rows may belong to different groups, so they are looked at
        groups = top[item[first]] if single else np.full(len(first), -2)
        hits = ((q + k, s, d) for q, s, d in found.within(asked[part], far[part], own, groups))
        for q, s, _ in checked(hits):
            u, v = query[q], item[s]
            node, low = least_of(top[u], top[v])
            keep = np.flatnonzero(node != low)
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[low[keep]]), pa.array(nodes[node[keep]])], ["u", "v"])
            to = np.arange(len(nodes))
            to[node] = low
            top = to[top]

