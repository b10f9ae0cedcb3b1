"""Pairs within an edit distance, by blocks and tries."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.trie import Trie
from kindred.operators.batch import duplicate_edges, series_match
from kindred.operators.dedupe import ROW, key_edges, match_pairs
from kindred.operators.index import EditIndex, NgramIndex
from kindred.plans import near
from kindred.plans.similarity_join import Field


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def alike():
    return [f"https://www.example.org/en/{k:05d}" for k in range(0, 6000, 10)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trie_against_all_distances():
    rnd = random.Random(1)
    for _ in range(60):
        most, letters = rnd.choice([4, 12, 70, 150]), rnd.choice(["ab", "abcdé😀"])
        word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))  # noqa: E731, B023
        items = sorted({word() for _ in range(rnd.randint(1, 20))})
        asked = [word() for _ in range(6)] + [x[:-1] + "a" for x in items[:3]]
        far, own, groups = (np.array([rnd.randint(0, n) for _ in x]) for n, x in ((most, asked), (2, asked), (2, items)))
        for skip in (False, True):
            got = [x for a, b, d in Trie(items).within(asked, far, *((own, groups) if skip else ())) for x in zip(a.tolist(), b.tolist(), d.tolist())]
            want = [(i, j, lev(q, t)) for i, q in enumerate(asked) for j, t in enumerate(items) if lev(q, t) <= far[i] and not (skip and own[i] == groups[j])]
            assert sorted(got) == want


def test_trie_leaves_branches_by_their_lengths(monkeypatch):
    items, asked, seen = [f"Customer#{k:05d}" for k in range(20000)], [f"Supplier#{k:05d}" for k in range(0, 20000, 400)], []
    step = Trie._step
    monkeypatch.setattr(Trie, "_step", staticmethod(lambda up, *rest: seen.append(up.shape[1]) or step(up, *rest)))
    by_length = np.array([2 * k // 5 for k in range(30)])
    hits = [x for a, b, d in Trie(items).within(asked, np.full(50, 8), by_length=by_length) for x in zip(a.tolist(), b.tolist(), d.tolist()) if x[2] <= 5]
    assert sorted(hits) == [(i, j, 5) for i, q in enumerate(asked) for j, t in enumerate(items) if q[9:] == t[9:]]
    assert sum(seen) < 50 * 100


@pytest.mark.parametrize("block", [4, 1 << 14])
def test_matches_in_blocks_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "TOGETHER", 4 * block)
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abé😀") for _ in range(rnd.randint(0, 7)))
    q, r = [*(word() for _ in range(12)), None, "", "aab", "aab", "aab"], [*(word() for _ in range(40)), None, "", *["aab"] * 20]
    table = lambda x: spark.createDataFrame([*enumerate(x), (None, "aab")], "id long, text string").repartition(3)
    for least in (0.05, 0.5, 0.6, 1.0):
        got = series_match(table(q), table(r), "levenshtein", least, query_id="id", target_id="id")
        assert got.columns == ["query_idx", "query", "target_idx", "target", "score"] and "NestedLoop" not in plan(got) and "SortMerge" not in plan(got)
        pairs = [(i, a, j, b, 1.0 - lev(a, b) / max(len(a), len(b), 1)) for i, a in [*enumerate(q), (None, "aab")] for j, b in [*enumerate(r), (None, "aab")] if a is not None and b is not None]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(x) for x in pairs if x[4] >= least)
    assert series_match(table(q).limit(0), table(r), "levenshtein", 0.5, query_id="id", target_id="id").count() == 0


def test_edges_of_a_large_group_are_fewer_than_its_rows(spark, alike):
    rows = spark.createDataFrame(list(enumerate(alike)), f"{ROW} long, url string")
    edges = key_edges(rows, ["url"], [Field("url", "url", "levenshtein")], 0.8)
    assert edges.count() < 60 * len(alike)
    keyed = rows.select(F.col(ROW).alias("id"), F.col("url").alias("key"))
    assert duplicate_edges(keyed, "levenshtein", 0.8, "brute_force", 50).count() < 60 * len(alike)


def test_pairs_need_no_join(spark, alike):
    rows = spark.createDataFrame(list(enumerate([*alike[:40], alike[0], "", None, "x", "x"])), "id long, url string")
    got = match_pairs(rows, ["url"], "levenshtein", 0.9, id_col="id")
    assert "Join" not in plan(got)
    texts = [*alike[:40], alike[0], "", "", "x", "x"]
    like = lambda a, b: 1.0 - lev(a, b) / max(len(a), len(b))
    want = {(i, j, like(a, b), a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and len(a) > 1 and len(b) > 1 and like(a, b) >= 0.9}
    assert {tuple(r) for r in got.collect()} == want


def test_search_of_an_edit_index_needs_no_join(spark, alike):
    items = spark.createDataFrame(list(enumerate(alike)), "id long, text string")
    hits = EditIndex(items, id_col="id").search(items.where("id % 50 = 0"), max_distance=3, query_id="id")
    assert "Join" not in plan(hits)
    assert {(r.query_id, r.id, r.distance) for r in hits.collect()} == {(i, j, lev(alike[i], b)) for i in range(0, len(alike), 50) for j, b in enumerate(alike) if lev(alike[i], b) <= 3}


@pytest.mark.parametrize("damerau", [False, True])
def test_nearest_items_however_far(spark, damerau):
    words = ["a" * 30, "b" * 40, "c" * 45, "a" * 5 + "d" * 50]
    index = EditIndex(spark.createDataFrame(list(enumerate(words)), "id long, text string"), damerau, id_col="id")
    asked = spark.createDataFrame([(9, "a" * 40), (8, "")], "id long, text string")
    got = {(r.query_id, r.id, r.distance) for r in index.find_nearest(asked, 3, query_id="id").collect()}
    want = {(q, k, d) for q, text in ((9, "a" * 40), (8, "")) for d, k in sorted((lev(text, w), k) for k, w in enumerate(words))[:3]}
    assert got == want


def test_candidates_of_an_ngram_index_need_no_join(spark, alike):
    texts = [*alike[:60], "", "ab", "abc", "x" * 70, "é😀abc"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = NgramIndex(items, id_col="id").get_candidates(items.where("id % 5 = 0"), query_id="id")
    assert "Join" not in plan(got)
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} for t in texts]
    want = {(i, j, len(a & b)) for i, a in enumerate(grams) if i % 5 == 0 for j, b in enumerate(grams) if len(a & b) >= max(1, -(-len(a) // 5))}
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("algorithm", ["levenshtein", "jaro", "jaro_winkler"])
def test_best_of_an_ngram_index_are_those_of_all_candidates(spark, algorithm):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))) for _ in range(200)]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index, asked = NgramIndex(items, id_col="id"), items.where("id % 20 = 0")
    every = {}
    for r in index.search(asked, algorithm, 0.0, None, query_id="id").collect():
        every.setdefault(r.query_id, []).append((-r.score, r.id))
    got = {(r.query_id, r.id) for r in index.search(asked, algorithm, 0.4, 3, query_id="id").collect()}
    assert got == {(q, i) for q, hits in every.items() for s, i in sorted(hits)[:3] if -s >= 0.4}


def test_equal_records_of_a_schema_are_scored_once(spark, monkeypatch):
    from kindred.operators import schema

    met, real = [], schema.pair_scores
    monkeypatch.setattr(schema, "pair_scores", lambda a, b, *more: met.append((a.count(), b.count())) or real(a, b, *more))
    rows = spark.createDataFrame([(k, ["red ring", "old bolt"][k % 2], "big") for k in range(60)], "id long, name string, kind string")
    index = schema.SchemaIndex(schema.MatchSchema.builder().add_field("name").add_field("kind").build(), rows, id_col="id")
    asked = rows.where("id < 12").withColumnRenamed("id", "query_id")
    got = index.search(asked, 0.9, 4, query_id="query_id", digits=9).collect()
    assert met == [(2, 2)]
    assert {(r.query_id, r.id) for r in got} == {(q, i) for q in range(12) for i in range(q % 2, 8, 2)}
    assert index.search(asked, 0.9, query_id="query_id").count() == 12 * 30
