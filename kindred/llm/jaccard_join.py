"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashed word 5-grams; TOKENS minima under random hash functions stand for a set's tokens, and
two sets share one of them with a chance that is their similarity. A run splits all sets by sampled tokens: in a
bucket ``1 / threshold`` tokens are chosen on average, by a hash of the path so far, and sets that share a chosen token
go on together in a bucket of it. A small bucket is compared outright. One that hardly shrank when it was split
is a family of similar sets, and is tied together as a whole. All others are split again, however often that takes,
as each time they halve. Runs are repeated until a pair at the threshold has been met with the target recall, which is
computed, and then measured with sample sets that are compared with all others; more runs follow while any is missed.

Buckets only nominate: sets whose sketches allow a similarity at the threshold, or that are tied, become a candidate
component. Inside these, tiles of bounded size compare sketches again, and sets with a partner there are
verified by their grams. No pair is written anywhere: tiles give counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import KEYS_BITS, hot_bound, join_counted, mark, mark_of_row, spool, table, trim, with_rows
from kindred.operators.cluster import connected_components as components

BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

TOKENS = 48  # tokens that paths choose from
SKETCH = 64  # bytes of a sketch
LEVELS = 4  # splits of a path that the number of runs allows for
SMALL = 32  # a bucket that is compared outright
BLOCK = 256  # sets of a component that one task verifies against as many
MISSED = 1e-6  # chance that the sketches of two sets at the threshold agree in fewer bytes than ``bound`` asks for
SLICE = 1 << 19  # bytes of text that are turned into sets at a time
PROBES = 64  # sample sets that recall is measured with
MORE = 8  # times that runs are added at most, as long as a probe misses a partner


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)


def gram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed word n-grams of all texts, text by text and sorted inside, and how many each has.

    Words are split at ASCII white space. A text of fewer words has one gram of all its words; without words it has none.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    word = ~SPACE[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        power = np.full(len(buf) + 1, BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=prefix[1:])
        inverse = np.full(len(buf) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        words = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
        text = np.searchsorted(ends, start, side="right")
        count = np.bincount(text, minlength=len(texts))
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        grams, live = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
        last = (np.cumsum(count))[text] if len(words) else np.zeros(0, int)
        at = np.arange(len(words))
        for j in range(n):
            inside = at + j < last
            grams = grams * BASE + np.where(inside, padded[at + j], np.uint64(0))
        grams = mix(grams)
        # a gram begins at every word but a text's last n - 1; a short text has one at its first word
        live = (at + n <= last) | (at == last - np.minimum(count[text], n)) & (count[text] < n)
    grams, text = grams[live], text[live]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[first], np.bincount(text[first], minlength=len(texts))


def by_size(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def seeds(count: int) -> np.ndarray:
    return np.random.default_rng(5).integers(1, 1 << 63, count, dtype=np.uint64)


def minima(grams: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """For each non-empty set and each of ``count`` hash functions, the least hash."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), count), np.uint64)
    with np.errstate(over="ignore"):
        for k, s in enumerate(seeds(2 * count).reshape(count, 2)):
            out[:, k] = np.minimum.reduceat((grams ^ s[0]) * (s[1] | np.uint64(1)), starts) if len(starts) else 0
    return out


def set_keys(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set: two sums of mixed grams."""
    starts = np.minimum(np.cumsum(sizes) - sizes, max(0, len(grams) - 1))
    with np.errstate(over="ignore"):
        sums = [np.add.reduceat(mix(grams * np.uint64(k)), starts) if len(grams) else np.zeros(len(sizes), np.uint64) for k in (1, 3)]
    return tuple(np.where(sizes > 0, s, np.uint64(0)).astype(np.int64) for s in sums)


def sketch(docs: DataFrame, n: int, marked: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, most=SLICE):
                grams, sizes = gram_sets(b.column("text").to_pylist(), n)
                k1, k2 = set_keys(grams, sizes)
                least = np.zeros((len(sizes), TOKENS + SKETCH), np.uint64)
                least[sizes > 0] = minima(grams, sizes, TOKENS + SKETCH)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * TOKENS, pa.int32()), pa.array(np.ascontiguousarray(least[:, :TOKENS]).ravel().astype(np.int64)))
                bytes_ = (mix(least[:, TOKENS:]) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("mark"), pa.array(sizes, pa.int64()), pa.array(k1), pa.array(k2), tokens, pa.array([r.tobytes() for r in bytes_], pa.binary())],
                    ["doc_id", "mark", "n", "k1", "k2", "tokens", "sketch"],
                )
        trim()

    return docs.select("doc_id", "text", marked.alias("mark")).mapInArrow(run, "doc_id long, mark long, n long, k1 long, k2 long, tokens array<long>, sketch binary")


def bound(threshold: float) -> int:
    """Equal bytes of two sketches at least, for a pair at ``threshold``, but for a chance of MISSED."""
    below = 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if below > MISSED:
            return k
    return SKETCH


def runs_for(threshold: float, recall: float) -> int:
    """Runs in which a pair at ``threshold`` stays together along some path of LEVELS splits, in one of them at least, with the chance ``recall``.

    Of the ``1 / threshold`` tokens that are chosen on average the last is chosen with a chance; each is shared with
    the chance ``threshold``.
    """
    sure, extra = int(1 / threshold), 1 / threshold - int(1 / threshold)
    met = 1.0
    for _ in range(LEVELS):
        lost = 1 - threshold * met
        met = 1 - lost**sure * (1 - extra + extra * lost)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 1


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """``sid, bucket, parent, sketch``: rows (``sid, bucket, size, tokens, sketch``) in the buckets of the tokens that their bucket chooses."""
    sure, extra = int(1 / threshold), 1 / threshold - int(1 / threshold)
    draw = lambda j: F.xxhash64("bucket", j)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(sure)), lambda j: (j < sure) | (F.pmod(draw(j + 1000), F.lit(1 << 20)) < int(extra * (1 << 20))))
    at = F.explode(F.array_distinct(F.transform(chosen, lambda j: F.pmod(draw(j), F.lit(TOKENS)).cast("int"))))
    each = rows.select("sid", "bucket", F.col("size").alias("parent"), "tokens", "sketch", at.alias("at"))
    return each.select("sid", F.xxhash64("bucket", "at", F.get("tokens", F.col("at"))).alias("bucket"), "parent", "sketch")


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def equal_bytes(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)


MET = "u long, v long, bucket long, size long"


def meet(rows: DataFrame, least: int) -> DataFrame:
    """Compares the rows (``sid, bucket, size, leader, family, sketch``, by bucket) of small buckets, whose ``size`` is null.

    ``u, v`` are pairs whose sketches agree in ``least`` bytes, and the rows of families with their leaders; rows of
    other large buckets are passed on as ``u, bucket, size``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            size, family = b.column("size"), pc.fill_null(b.column("family"), False)
            for some, names in ((family, ("sid", "leader", None, None)), (pc.and_not(size.is_valid(), family), ("sid", None, "bucket", "size"))):
                rest = b.filter(some)
                if rest.num_rows:
                    yield pa.RecordBatch.from_arrays([rest.column(c) if c else pa.nulls(rest.num_rows, pa.int64()) for c in names], ["u", "v", "bucket", "size"])
            here = b.filter(size.is_null())
            bucket, sid = here.column("bucket").to_numpy(), here.column("sid").to_numpy()
            sk = equal_bytes(here.column("sketch").to_pylist())
            if held is not None:
                bucket, sid, sk = np.concatenate([held[0], bucket]), np.concatenate([held[1], sid]), np.concatenate([held[2], sk])
            for k in range(1, SMALL):
                i = np.flatnonzero(bucket[k:] == bucket[:-k])
                if not len(i):
                    break
                i = i[(sk[i] == sk[i + k]).sum(1) >= least]
                i = i[sid[i] != sid[i + k]]
                if len(i):
                    none = pa.nulls(len(i), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(sid[i]), pa.array(sid[i + k]), none, none], ["u", "v", "bucket", "size"])
            # the last bucket may go on in the next batch; what is compared twice is tied twice
            tail = bucket == bucket[-1] if len(bucket) else np.zeros(0, bool)
            held = bucket[tail], sid[tail], sk[tail]

    return rows.select("sid", "bucket", "size", "leader", "family", "sketch").mapInArrow(run, MET)


def candidate_edges(content: DataFrame, threshold: float, runs: range) -> DataFrame:
    """Edges that tie together the sets (``sid, tokens, sketch``) that some bucket of the ``runs`` finds alike."""
    least, found = bound(threshold), []
    known = content.select("sid", "tokens", "sketch")
    each = known.withColumn("bucket", F.explode(F.sequence(F.lit(runs.start).cast("long"), F.lit(runs.stop - 1).cast("long")))).withColumn("size", F.lit(None).cast("long"))
    rows, count, level = split(each, threshold), 2 * known.count() * len(runs), 0
    # rows of large buckets that aren't compared: those of a family are tied to its leader, others are split again
    passed = [F.col("sid").alias("u"), F.when(F.col("family"), F.col("leader")).alias("v"), F.when(~F.col("family"), F.col("bucket")).alias("bucket"), F.when(~F.col("family"), F.col("size")).alias("size")]
    while count:
        large = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("leader"), F.max("parent").alias("parent")).where(F.col("size") > SMALL)
        # a family: half of the parent's rows or more share a token that was chosen blindly
        large = spool(large.select("bucket", "size", "leader", F.coalesce(2 * F.col("size") >= F.col("parent"), F.lit(False)).alias("family")), f"large{level}")
        # all large buckets if they are few, else those that have many of all rows, which are few: their rows stay where they are
        few = large.count() <= 1 << KEYS_BITS
        top = F.broadcast(large if few else large.where(F.col("size") > hot_bound(count)))
        stay = rows.join(top, "bucket").select(*passed)
        cold = rows.join(top.select("bucket"), "bucket", "left_anti").repartition("bucket")
        if few:
            cold = cold.withColumns({c: F.lit(None).cast(t) for c, t in large.dtypes if c != "bucket"})
        else:
            cold = cold.join(large.where(F.col("size") <= hot_bound(count)), "bucket", "left")
        met = spool(meet(cold.sortWithinPartitions("bucket"), least).unionByName(stay), f"met{level}")
        found.append(met.where("v is not null").select("u", "v"))
        if large.where("not family").isEmpty():
            break
        left = met.where("v is null").select(F.col("u").alias("sid"), "bucket", "size")
        rows, level = spool(split(left.join(known, "sid"), threshold), f"split{level}"), level + 1
        count = rows.count()
    edges = content.select(F.col("sid").alias("u"), F.col("sid").alias("v")).limit(0)
    for f in found:
        edges = edges.unionByName(f)
    return edges.where("u <> v")


def missed(content: DataFrame, comps: DataFrame, threshold: float) -> int:
    """How many of the pairs of a probe and a set that are surely similar, by their sketches, are in different components.

    Probes are the PROBES sets with the least hash of their number; each is compared with all sets.
    """
    probes = content.select("sid", "sketch").orderBy(F.xxhash64("sid"), "sid").limit(PROBES).collect()
    if not probes:
        return 0
    ids, sk = np.array([r.sid for r in probes]), equal_bytes([bytes(r.sketch) for r in probes])
    sure = math.ceil(SKETCH * (threshold + 1) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, own = b.column("sid").to_numpy(), equal_bytes(b.column("sketch").to_pylist())
            for k, p in enumerate(ids):
                i = np.flatnonzero((own == sk[k]).sum(1) >= sure)
                i = i[sid[i] != p]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(sid[i])], ["probe", "sid"])

    near = content.select("sid", "sketch").mapInArrow(run, "probe long, sid long")
    of = comps.where(F.col("node").isin(ids.tolist())).select(F.col("node").alias("probe"), F.col("component").alias("own"))
    placed = near.join(F.broadcast(of), "probe", "left").join(comps, F.col("sid") == F.col("node"), "left")
    return placed.where("own is null or component is null or own <> component").count()


def nominate(tasks: DataFrame, least: int) -> DataFrame:
    """``component, a, b, side, sid`` of the rows (``..., sketch``) of each tile that have a partner in it by their sketches."""

    def solve(at: tuple, rows: list[tuple], out: list[tuple]) -> None:
        sk = equal_bytes([r[2] for r in rows])
        side = np.array([r[1] for r in rows])
        across = (side == 1).any()
        has = np.zeros(len(rows), bool)
        for low in range(0, len(rows), 64):
            like = (sk[low : low + 64, None] == sk[None]).sum(2) >= least
            like[np.arange(len(like)), low + np.arange(len(like))] = False
            if across:
                like &= side[low : low + 64, None] != side[None]
            has |= like.any(0)
        out.extend((*at, r[1], r[0]) for r, h in zip(rows, has) if h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["component", "a", "b", "side", "sid"])

        for b in batches:
            for comp, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("component", "a", "b", "sid", "side", "sketch"))):
                if (comp, i, j) != at:
                    if len(rows) > 1:
                        solve(at, rows, out)
                    at, rows = (comp, i, j), []
                rows.append(row)
            if len(out) > 10_000:
                yield flush()
                out = []
        if len(rows) > 1:
            solve(at, rows, out)
        yield flush()

    dealt = tasks.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "sid")
    return dealt.select("component", "a", "b", "sid", "side", "sketch").mapInArrow(run, "component long, a long, b long, side int, sid long")


def verify(tasks: DataFrame, threshold: float) -> DataFrame:
    """``sid, links, to``: for each task (component, a, b) of ``..., side, sid, copies, grams`` the documents that each set is similar to, and a forest of the similar sets."""

    def solve(rows: list[tuple], out: list[tuple]) -> None:
        sids, sides = [r[0] for r in rows], np.array([r[1] for r in rows])
        copies, sets = np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [low, low + 8192])
            cells = np.zeros((len(sets), 8192), np.float32)
            cells[owner[a:b], column[a:b] - low] = 1
            both += cells @ cells.T
        linked = both >= threshold * (sizes[:, None] + sizes[None] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if (sides == 1).any():  # two blocks: only across
            linked &= sides[:, None] != sides[None]
        parent = list(range(len(sets)))
        for i, j in zip(*np.nonzero(np.triu(linked))):
            x, y = find(parent, int(i)), find(parent, int(j))
            parent[max(x, y)] = min(x, y)
        links = linked @ copies
        out.extend((sids[k], int(links[k]), sids[find(parent, k)]) for k in range(len(sets)) if links[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["sid", "links", "to"])

        for b in batches:
            for comp, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("component", "a", "b", "sid", "side", "copies", "grams"))):
                if (comp, i, j) != at:
                    if len(rows) > 1:
                        solve(rows, out)
                    at, rows = (comp, i, j), []
                rows.append(row)
            if len(out) > 10_000:
                yield flush()
                out = []
        if len(rows) > 1:
            solve(rows, out)
        yield flush()

    dealt = tasks.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "sid")
    return dealt.select("component", "a", "b", "sid", "side", "copies", "grams").mapInArrow(run, "sid long, links long, to long")


def with_grams(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, most=SLICE):
                grams, sizes = gram_sets(b.column("text").to_pylist(), n)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sid", "copies")), pa.array([grams[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())], ["sid", "copies", "grams"])
        trim()

    return rows.select("sid", "copies", "text").mapInArrow(run, "sid long, copies long, grams binary")


def candidate_components(content: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``node, component`` of the sets that have candidates: runs of chosen paths until the recall is reached, as computed and as measured."""
    runs, edges = runs_for(threshold, recall), None
    for k in range(MORE + 1):
        got = candidate_edges(content, threshold, range(k * runs, (k + 1) * runs))
        edges = got if edges is None else edges.unionByName(got)
        comps = spool(components(edges, "candidates"), "components")
        if not missed(content, comps, threshold):
            break
    return comps


def similarity_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, marked: Column | None = None) -> DataFrame:
    """``doc_id, class_id, n_links, stays`` and ``mark`` (``marked``, by default a hash of id and text) for each input row.

    ``n_links`` counts the other rows whose Jaccard similarity of word n-gram sets is at least ``threshold``, equal
    sets included; ``class_id`` is the smallest doc_id among the documents that chains of links reach. A text
    without words, or null, has no grams and no links: its class is itself (null ids stay null).
    ``stays`` holds for one row of each class, that with the smallest doc_id, of several with that id the one with the
    smallest mark. Repeated rows are copies of each other. An empty table gives an empty result. Extra columns are ignored.
    """
    marked = mark() if marked is None else marked
    rows = spool(sketch(docs, n, marked).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    keyed = rows.where("n > 0")
    sets = spool(
        keyed.groupBy("k1", "k2").agg(F.min("uid").alias("sid"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "mark", "uid")).alias("least")),
        "sets",
    )
    content = spool(sets.select("sid", "copies").join(keyed, F.col("sid") == F.col("uid")).select("sid", "copies", "mark", "tokens", "sketch"), "content")
    comps = candidate_components(content, threshold, recall)
    members = comps.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    # a block of its component for each set, by hash, so a large component isn't numbered in one task
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK))
    placed = join_counted(comps, members, "component", "members").withColumn("blocks", blocks).withColumn("nth", F.pmod(F.xxhash64("node"), "blocks"))
    placed = placed.join(content.select("sid", "sketch"), F.col("node") == F.col("sid"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = placed.select("component", "nth", "sid", "sketch", others).select(
        "component", F.least("nth", "other").alias("a"), F.greatest("nth", "other").alias("b"), "sid", (F.col("nth") > F.col("other")).cast("int").alias("side"), "sketch"
    )
    nominated = spool(nominate(tiles, bound(threshold)), "nominated")
    wanted = nominated.select("sid").distinct().join(content.select("sid", "copies", "mark"), "sid")
    texts = docs.select("text", marked.alias("mark"))
    # rows that are repeated have the same mark and text: one is enough
    grams = spool(with_grams(texts.join(wanted, "mark").dropDuplicates(["sid"]), n), "grams")
    links = spool(verify(nominated.join(grams, "sid"), threshold), "links")
    classes = components(links.select(F.col("sid").alias("u"), F.col("to").alias("v")), "classes")
    counted = links.groupBy("sid").agg(F.sum("links").alias("links"))
    known = sets.join(classes, F.col("sid") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "sid")).join(counted, "sid", "left")
    known = spool(known, "known")
    class_ids = spool(known.groupBy("component").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("members")), "classes")
    known = join_counted(known, class_ids, "component", "members").select("k1", "k2", "best", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    worded = join_counted(keyed.select("doc_id", "mark", "uid", "k1", "k2"), spool(known, "linked"), ["k1", "k2"], "copies")
    worded = worded.select("doc_id", F.col("best.doc_id").alias("class_id"), "n_links", (F.col("uid") == F.col("best.uid")).alias("stays"), "mark")
    return worded.unionByName(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"), "mark"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each class."""
    row = mark_of_row(docs)
    return with_rows(docs, similarity_classes(docs, n, threshold, recall, row).where("stays").select("doc_id", "mark", F.lit(1).alias("times")), row)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).drop("mark")
