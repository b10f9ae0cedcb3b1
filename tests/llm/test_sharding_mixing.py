import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm import mixing, sharding


def least_capacity(weights, shards):
    """The smallest largest sum of ``shards`` contiguous parts, by trying all capacities."""
    for c in itertools.count(max([0, *weights])):
        parts, at = 1, 0
        for w in weights:
            if at + w > c:
                parts, at = parts + 1, 0
            at += w
        if parts <= shards:
            return c


def test_minimax_cuts_are_the_best_ones():
    rng = random.Random(1)
    for _ in range(40):
        keys = sorted(rng.sample(range(1 << 60), rng.randint(1, 300)))
        weights = [rng.choice([1, 5, 9, 300]) for _ in keys]

        def sums(ranges, parts):
            out = []
            for lo, hi in ranges:
                step = max(1, -(-(hi - lo) // 4))
                cells = defaultdict(list)
                for k, w in zip(keys, weights):
                    if lo <= k < hi:
                        cells[(k - lo) // step].append(w)
                out += [sharding.Block(lo + p * step, min(hi, lo + (p + 1) * step), sum(ws), len(ws)) for p, ws in cells.items()]
            return sorted(out, key=lambda b: b.low)

        cuts, capacity = sharding.minimax_cuts(sums, 8, 4)
        assert capacity == least_capacity(weights, 8)
        sizes = Counter()
        for k, w in zip(keys, weights):
            sizes[sum(k >= c for c in cuts)] += w
        assert max(sizes.values()) == capacity and len(sizes) <= 8


def test_shards(docs, awkward):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(awkward)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in awkward)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    slots, crcs = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        crcs[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in crcs.values()) and set(slots) <= set(range(8))


def test_shards_of_nothing(no_docs):
    assert sharding.shard(no_docs).collect() == []


def poured(sizes, most=3):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(docs, awkward):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for _, t, _, s, _ in awkward:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    target = poured(sizes)
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, size(t)) for i, t, *_ in awkward)
    by_target = defaultdict(list)
    for r in rows:
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 3 * r["size"]
        by_target[r.source_size].append(r)
    for s, n in sizes.items():
        same = by_target[n]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9) for r in same)
        if len([m for m in sizes.values() if m == n]) == 1:
            assert abs(sum(r.taken for r in same) - target[s]) <= largest[s]
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mixed_rows_are_those_of_the_mix(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r["size"]] += r.copies
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = Counter((r.doc_id, size(r.text)) for r in out.collect())
    assert got == Counter({k: n for k, n in taken.items() if n})


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []


def test_rounding_hits_the_target_within_one_document(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([1, 3, 10, 50])), "x", ["a", "b", None][k % 3], 0) for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source_size, r.target].append(r.taken)
    assert all(abs(sum(v) - target) <= 50 for (_, target), v in by.items())


def test_large_documents_leave_small_errors(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * (rng.randint(1, 60) if k % 40 else rng.randint(1500, 2500))), "x", ["a", "b", None][k % 3], 0) for k in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source_size, r.target].append(r.taken)
    assert all(abs(sum(v) - target) <= 60 for (_, target), v in by.items())


def test_repeated_rows_are_dealt_to_blocks(spark):
    # rows that agree in everything have ties of their own, and the same ones in any order
    rows = [(1, "one two three", "x", "a", 0)] * 700 + [(None, "four five", "x", "b", 0)] * 700 + [(k, "six", "x", None, 0) for k in range(100)]
    of = lambda n: spark.createDataFrame(random.Random(n).sample(rows, len(rows)), "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
    copies = mixing.among_equals(of(3).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("same"))).groupBy("doc_id", "same").agg(F.countDistinct("copy").alias("n"), F.max("copy").alias("most"), F.count("*").alias("rows")).collect()
    assert all(r.n == r.rows == r.most + 1 for r in copies)
    got = [Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix(of(n)).collect()) for n in (1, 4)]
    assert got[0] == got[1]


@pytest.mark.parametrize("seed", range(3))
def test_rounding_is_unbiased_enough(spark, seed):
    rows = [(k, "a b", "x", ["a", "b"][k % 2], 0) for k in range(800)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), seed=seed).collect()
    first = sum(r.taken for r in out if r.doc_id < 400 and r.doc_id % 2 == 0)
    every = sum(r.taken for r in out if r.doc_id % 2 == 0)
    assert 0.4 < first / every < 0.6


def test_rows_that_share_id_and_text_keep_their_source(spark):
    rows = [(k % 40, "one two three " * (1 + k % 40), "en", f"src{k // 40}", {"k": k // 40}) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra map<string,int>").repartition(4)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[round(r.target, 6)] += r.taken
    got = Counter()
    for r in mixing.mixed(docs).collect():
        assert r.source == f"src{r.extra['k']}"
        got[r.source] += len(r.text.split())
    assert sorted(got.values()) == sorted(x for x in taken.values() if x)
