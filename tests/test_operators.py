"""Joins, deduplication, batches, indexes, schema search, metrics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kindred.errors import AlgorithmError, SchemaError, ValidationError
from kindred.functions import kernels
from kindred.operators import batch, metrics
from kindred.operators.cluster import connected_components
from kindred.operators.dedupe import dedupe, dedupe_snm, find_pairs, match_pairs
from kindred.operators.index import EditIndex, FuzzyIndex, HybridIndex, NgramIndex, ShardedEditIndex, ShardedNgramIndex, ThreadSafeNgramIndex
from kindred.operators.join import fuzzy_join, match_records
from kindred.operators.schema import MatchSchema, SchemaIndex
from kindred.plans import neighbours, similarity_join
from kindred.plans.scratch import hot_bound, join_counted, numbered, with_row_ids

rng = random.Random(8)


def strings(spark, values, start=0):
    return spark.createDataFrame([(k + start, v) for k, v in enumerate(values)], "id long, text string")


def bigrams(s):
    return {s[k : k + 2] for k in range(len(s) - 1)}


def lev(a, b):
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        old = row
    return old[-1]


def lev_sim(a, b):
    return 1 - lev(a, b) / max(len(a), len(b)) if a or b else 1.0


# --- joins


def test_join_demo(spark):
    left = strings(spark, ["Appel", "Microsft Corp", "Googel", "Amzon Inc", None, "Zzz"])
    right = strings(spark, ["Apple Inc.", "Microsoft Corporation", "Google LLC", "Amazon.com Inc.", None])
    inner = fuzzy_join(left, right, on="text", min_similarity=0.5, left_id="id", right_id="id")
    assert inner.columns == ["id", "text", "id_right", "text_right", "fuzzy_score"]
    got = {r.text: (r.text_right, round(r.fuzzy_score, 2)) for r in inner.collect()}
    assert got == {"Appel": ("Apple Inc.", 0.84), "Microsft Corp": ("Microsoft Corporation", 0.89), "Googel": ("Google LLC", 0.89), "Amzon Inc": ("Amazon.com Inc.", 0.83)}
    outer = {r.id: (r.id_right, r.fuzzy_score) for r in fuzzy_join(left, right, on="text", min_similarity=0.5, how="left", left_id="id", right_id="id").collect()}
    assert outer[4] == outer[5] == (None, 0.0) and len(outer) == 6
    assert {r.id for r in fuzzy_join(left, right, on="text", min_similarity=0.5, how="semi").collect()} == {0, 1, 2, 3}
    assert {r.id for r in fuzzy_join(left, right, on="text", min_similarity=0.5, how="anti").collect()} == {4, 5}
    assert fuzzy_join(left, right, on="text", min_similarity=0.999).count() == 0


@pytest.mark.parametrize("few", [0, 5000])
@pytest.mark.parametrize("t", [0.5, 0.7, 0.8, 0.9])
def test_levenshtein_join_is_the_nested_loop(spark, monkeypatch, t, few):
    """The prefix filter loses no pair and adds none."""
    monkeypatch.setattr(similarity_join, "FEW", few)
    word = lambda: "".join(rng.choice("aabbcd") for _ in range(rng.randint(0, 11)))
    a, b = [word() for _ in range(120)], [word() for _ in range(120)]
    got = {(r.lid, r.rid) for r in similarity_join.pair_scores(strings(spark, a).withColumnRenamed("id", "lid"), strings(spark, b).withColumnRenamed("id", "rid"), [similarity_join.Field("text", "text", "levenshtein")], t).collect()}
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if bigrams(x) & bigrams(y) and lev_sim(x, y) >= t}
    assert got == want and want


def test_join_on_several_columns(spark):
    left = spark.createDataFrame([(1, "acme corp", "berlin"), (2, "acme corp", None), (3, "foo bar", "x")], "id long, name string, city string")
    right = spark.createDataFrame([(7, "acme corp", "bern"), (8, "acme korp", "berlin"), (9, "acme korp", "berlin")], "rid long, company string, town string")
    on = [("name", "company", {"algorithm": "levenshtein", "weight": 1.0}), ("city", "town", {"weight": 3.0})]
    rows = fuzzy_join(left, right, on=on, min_similarity=0.5, left_id="id", right_id="rid").collect()
    assert [(r.id, r.rid) for r in rows] == [(1, 8)] and abs(rows[0].fuzzy_score - (8 / 9 + 3) / 4) < 1e-9
    # x is in no bigram, so only the name counts
    two = fuzzy_join(left, right, on=on, min_similarity=0.5, left_id="id", right_id="rid", top_k=3).collect()
    assert [r.rid for r in sorted(two, key=lambda r: (-r.fuzzy_score, r.rid)) if r.id == 1] == [8, 9, 7]


def test_join_arguments(spark):
    df = strings(spark, ["a"])
    for bad in ({"how": "right"}, {"min_similarity": 2}, {"algorithm": "nope"}, {"on": [("text", "text", {"speed": 1})]}, {"on": "missing"}, {"top_k": 0}, {"on": [("text", "text", {"weight": -1})]}):
        with pytest.raises((ValidationError, AlgorithmError)):
            fuzzy_join(df, df, **{"on": "text"} | bad)
    with pytest.raises(ValidationError):
        fuzzy_join(df, df, left_on="text")


def test_scorer_of_ones_own(spark):
    same_first = lambda a, b: (F.substring(a, 1, 1) == F.substring(b, 1, 1)).cast("double")
    got = fuzzy_join(strings(spark, ["abcd"]), strings(spark, ["zbcd", "axcd"]), on="text", algorithm=same_first, min_similarity=1.0, left_id="id", right_id="id").collect()
    assert [r.text_right for r in got] == ["axcd"]


def test_match_records(spark):
    q = spark.createDataFrame([(1, "jon smith", "ny"), (2, "qqqq", "zz")], "id long, name string, city string")
    t = spark.createDataFrame([(1, "john smith", "ny"), (2, "jon smyth", "la"), (3, None, None)], "id long, name string, city string")
    rows = match_records(q, t, ["name", "city"], limit=2, query_id="id", target_id="id").collect()
    assert [(r.query_idx, r.target_idx) for r in sorted(rows, key=lambda r: -r.score)] == [(1, 1), (1, 2)]
    assert rows[0].asDict().keys() == {"query_idx", "target_idx", "score", "name_query", "city_query", "name_target", "city_target"}


# --- deduplication

PEOPLE = [(0, "John Smith", "js@x.com", None), (1, "Jon Smith", "js@x.com", "1"), (2, "Mary Jones", "mj@x.com", None), (3, "John Smith", None, None), (4, "", None, None), (5, "", None, None), (6, None, "a", "b"), (7, "Mary Jones", "mj@x.com", "2")]


@pytest.mark.parametrize("keep, kept", [("first", {0, 2}), ("last", {3, 7}), ("most_complete", {1, 7})])
def test_dedupe(spark, keep, kept):
    df = spark.createDataFrame(PEOPLE, "id long, name string, email string, phone string")
    rows = {r.id: r for r in dedupe(df, ["name"], min_similarity=0.9, keep=keep, id_col="id").collect()}
    assert {k: r._group_id for k, r in rows.items()} == {0: 0, 1: 0, 3: 0, 2: 1, 7: 1, 4: None, 5: None, 6: None}
    assert {k for k, r in rows.items() if r._is_canonical} == kept | {4, 5, 6}


def test_weighted_dedupe_and_pairs(spark):
    df = spark.createDataFrame(PEOPLE, "id long, name string, email string, phone string")
    pairs = {(r.idx_a, r.idx_b): r.score for r in match_pairs(df, ["name", "email"], min_similarity=0.0, weights={"name": 2.0}, algorithms={"email": "exact_match"}, id_col="id").collect()}
    jw = kernels.jaro_winkler("John Smith", "Jon Smith")
    assert abs(pairs[0, 1] - (2 * jw + 1) / 3) < 1e-12 and abs(pairs[0, 3] - 1) < 1e-12 and pairs[2, 7] == 1
    # names without a common bigram are left out of the mean
    assert all(a < b for a, b in pairs) and (4, 5) not in pairs
    with pytest.raises(ValidationError):
        match_pairs(df, ["name"], weights={"email": 1.0})


def neighbours_brute(keys, window, blocks=None):
    out = set()
    for block in {None} if blocks is None else {b for b in blocks if b is not None}:
        rows = sorted((k, i) for i, k in enumerate(keys) if blocks is None or blocks[i] == block)
        out |= {(min(i, j), max(i, j)) for p, (_, i) in enumerate(rows) for _, j in rows[p + 1 : p + 1 + window]}
    return out


@pytest.mark.parametrize("window, run", [(1, 4096), (3, 7), (9, 4), (20, 4096)])
def test_neighbours(spark, monkeypatch, window, run):
    monkeypatch.setattr(neighbours, "RUN", run)
    keys = ["".join(rng.choice("abc") for _ in range(3)) for _ in range(90)]
    blocks = [rng.choice(["x", "y", None]) for _ in keys]
    df = spark.createDataFrame([(i, k, b) for i, (k, b) in enumerate(zip(keys, blocks))], "i long, k string, b string").repartition(5)
    pair = lambda r: (min(r.a.i, r.b.i), max(r.a.i, r.b.i))
    got = [pair(r) for r in neighbours.neighbour_pairs(df, ["k", "i"], window, ["i"]).collect()]
    assert len(got) == len(set(got)) and set(got) == neighbours_brute(keys, window)
    blocked = [pair(r) for r in neighbours.neighbour_pairs(df, ["k", "i"], window, ["i"], "b").collect()]
    assert len(blocked) == len(set(blocked)) and set(blocked) == neighbours_brute(keys, window, blocks)


def test_snm(spark):
    names = [f"Company {k // 2:03d}{'x' if k % 2 else ''}" for k in range(40)]
    df = spark.createDataFrame([(k, n, "ab"[k % 2]) for k, n in enumerate(names)], "id long, name string, block string")
    got = dedupe_snm(df, ["name"], "levenshtein", 0.9, window_size=2, id_col="id").where("_group_id is not null")
    assert got.count() == 40 and got.select("_group_id").distinct().count() == 20
    assert dedupe_snm(df, ["name"], "levenshtein", 0.9, window_size=1, id_col="id").where("_group_id is not null").count() == 0
    weighted = dedupe_snm(df, ["name"], "levenshtein", 0.9, window_size=1, weights={"name": 1.0}, id_col="id")
    assert weighted.where("_group_id is not null").count() == 40
    for key in ("block", F.col("block"), lambda d: F.upper(d["block"])):
        assert dedupe_snm(df, ["name"], "levenshtein", 0.95, blocking_key=key, id_col="id").where("_group_id is not null").count() == 0
    assert find_pairs(df, ["name"], "levenshtein", 0.9, window_size=2, id_col="id").count() == 20
    full = find_pairs(df, ["name"], "levenshtein", 0.9, method="full", id_col="id").count()
    assert full == sum(lev_sim(a, b) >= 0.9 for k, a in enumerate(names) for b in names[:k])
    with pytest.raises(ValidationError):
        dedupe_snm(df, ["name"], window_size=0)


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components(spark, one_task):
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 160)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()}
    assert got == {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), one_task=one_task).count() == 0


@pytest.mark.parametrize("total", [None, 10_000_000])
def test_hot_keys_are_joined_where_they_are(spark, total):
    rows = spark.createDataFrame([(0 if k % 3 else k, k) for k in range(1500)], "key long, x long").repartition(6)
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    got = join_counted(rows, found, "key", "n", total)
    assert sorted(map(tuple, got.select("key", "x", "top").collect())) == sorted(map(tuple, rows.join(found, "key").select("key", "x", "top").collect()))
    assert hot_bound(1 << 30) == 1 << 14


def test_spooled_tables_are_deleted_on_request(spark):
    from kindred.plans import scratch

    df = scratch.spool(spark.range(10), "ten")
    assert df.count() == 10
    files = df.inputFiles()
    scratch.clear(spark)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from kindred.plans import scratch

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValidationError):
        scratch.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_schema_normalises_both_sides(spark):
    rows = spark.createDataFrame([(1, "ACME CORP", "x"), (2, "Other", None)], "id long, name string, note string")
    asked = spark.createDataFrame([(7, "acme-corp")], "query_id long, name string")
    for mode, want in ((None, []), ("strict", [(7, 1, 1.0)])):
        schema = MatchSchema.builder().add_field("name", algorithm="levenshtein", normalize=mode, max_length=50).add_field("note", "long_text", chunk_size=10).build()
        index = SchemaIndex(schema, rows, id_col="id")
        assert [tuple(r)[:3] for r in index.search(asked, 0.9, query_id="query_id").collect()] == want
        assert index.get(1).first().name == "ACME CORP"
    for bad in ({"normalize": "loud"}, {"max_length": 0}, {"chunk_size": -1}, {"colour": "red"}):
        with pytest.raises(SchemaError):
            MatchSchema.builder().add_field("name", **bad)


def test_least_similarity_of_an_index(spark, tmp_path):
    items = spark.createDataFrame([(1, "abcdef"), (2, "abcxyz")], "id long, text string")
    asked = spark.createDataFrame([(1, "abcdeg")], "id long, text string")
    index = ThreadSafeNgramIndex(items, min_similarity=0.9, id_col="id")
    index.save(f"file://{tmp_path}/index")
    for i in (index, index.add_all(items.where("id > 5"), id_col="id"), ThreadSafeNgramIndex.load(spark, f"file://{tmp_path}/index")):
        assert [r.id for r in i.search(asked, "levenshtein", query_id="id").collect()] == []
        assert [r.id for r in i.search(asked, query_id="id").collect()] == [1]
        assert [r.id for r in i.find_nearest(asked, 5, query_id="id").collect()] == [1]


@pytest.mark.parametrize("damerau", [False, True])
def test_edit_index_by_grams_loses_nothing(spark, monkeypatch, damerau):
    r = random.Random(9)
    values = ["".join(r.choice("abcd") for _ in range(r.randint(0, 14))) for _ in range(120)]
    items, asked = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, text string"), spark.createDataFrame([(k, v) for k, v in enumerate(values[::3])], "qid long, q string")
    index = EditIndex(items, use_damerau=damerau, id_col="id")
    found = lambda k: sorted(map(tuple, index.search(asked, max_distance=k, text="q", query_id="qid").select("query_id", "id", "distance").collect()))
    want = {k: found(k) for k in (0, 1, 3)}
    monkeypatch.setattr(similarity_join, "FEW", 0)
    assert {k: found(k) for k in (0, 1, 3)} == want and len(want[3]) > len(want[1]) > 0


def test_rare_tokens_lose_no_pair(spark):
    from kindred.plans import similarity_join as J

    r = random.Random(3)
    values = [",".join(r.sample("abcdefghij", r.randint(1, 6))) for _ in range(80)]
    left, right = (spark.createDataFrame([(v,) for v in set(values)], f"{c} string") for c in ("lv", "rv"))
    field = J.Field("x", "y", "jaccard", gate=0)
    for t in (0.3, 0.5, 0.75, 1.0):
        got = {(r.lv, r.rv) for r in J.by_rare_tokens(left, right, field, t).collect()}
        assert all((x, y) in got for x in set(values) for y in set(values) if len({*x.split(",")} & {*y.split(",")}) >= t * len({*x.split(",")} | {*y.split(",")}))


def test_numbering(spark):
    df = spark.range(0, 500).select(((F.col("id") * 7919) % 500).alias("x")).repartition(7)
    assert [r.n for r in numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(500))
    ids = with_row_ids(df, "n").collect()
    assert sorted(r.n for r in ids) == list(range(500))


# --- batches


def test_batches(spark):
    df = strings(spark, ["hello", "hallo", "help", "world", "hello", None])
    assert [r.id for r in batch.best_matches(df, "hello", limit=3, id_col="id").collect()] == [0, 4, 1]
    assert {r.id: r.score is None for r in batch.similarity(df, "hello", id_col="id").collect()} == {**dict.fromkeys(range(5), False), 5: True}
    assert batch.best_matches(df, "hello", min_similarity=0.99, id_col="id").count() == 2
    assert [r.id for r in batch.extract_one("hello", df, id_col="id").collect()] == [4]
    assert batch.extract_one("hello", df, min_similarity=1.0, id_col="id").count() == 1 and batch.extract_one("zzzz", df, min_similarity=0.9).count() == 0
    assert batch.similarity_matrix(df.limit(2), df.limit(3)).count() == 6
    assert {r.query_idx for r in batch.series_match(df, df, "levenshtein", 0.8, query_id="id", target_id="id").collect()} == {0, 1, 2, 3, 4}
    best = {r.query_idx: r.match for r in batch.series_best_match(df, strings(spark, ["help!", "word", None]), query_id="id", target_id="id").collect()}
    assert best == {0: "help!", 4: "help!", 2: "help!", 3: "word", 1: None, 5: None}
    means = batch.compare_algorithms(df.where("text is not null"), "hello", ["levenshtein", "jaro"], 2, id_col="id").collect()
    assert [r.algorithm for r in means] == ["jaro"] * 2 + ["levenshtein"] * 2 and [r["rank"] for r in means] == [1, 2, 1, 2]
    with pytest.raises(AlgorithmError):
        batch.similarity(df, "x", "nope")


def test_find_duplicates(spark):
    df = strings(spark, ["Hello", "hello", "hallo", "zebra", "zebras", "apple", "HELLO"])
    for method in ("auto", "brute_force", "snm"):
        got = batch.find_duplicates(df, "levenshtein", 0.8, method=method, id_col="id")
        rows = {r.id: (r.group_id, r.group_size) for r in got.collect()}
        assert rows == {0: (0, 4), 1: (0, 4), 2: (0, 4), 6: (0, 4), 3: (1, 2), 4: (1, 2), 5: (None, None)}
        assert batch.total_duplicates(got) == 4
    one = {r.id: (r.group_id, r.is_canonical) for r in batch.series_dedupe(df, "levenshtein", 0.8, id_col="id").collect()}
    assert one == {0: (0, True), 1: (0, False), 2: (0, False), 6: (0, False), 3: (1, True), 4: (1, False), 5: (2, True)}
    pairs = {(r.id_a, r.id_b) for r in batch.find_duplicate_pairs(df, "levenshtein", 0.8, window_size=2, id_col="id").collect()}
    assert pairs == {(0, 1), (1, 6), (0, 2), (3, 4)} or (1, 6) in pairs


# --- indexes


def test_edit_index(spark, tmp_path):
    words = ["book", "books", "cake", "boo", "cape", "cart", "book"]
    index = EditIndex(strings(spark, words), id_col="id")
    assert len(index) == 6
    q = strings(spark, ["book", "caqe", None], 100)
    got = {(r.query_id, r.text): r.distance for r in index.search(q, max_distance=1, query_id="id").collect()}
    assert got == {(100, "book"): 0, (100, "books"): 1, (100, "boo"): 1, (101, "cake"): 1, (101, "cape"): 1}
    assert {r.text for r in index.search(q.limit(1), min_similarity=0.5, query_id="id").collect()} == {w for w in set(words) if lev("book", w) <= 2}
    assert [r.text for r in index.find_nearest(q.where("id = 101"), 1, query_id="id").collect()] == ["cake"]
    assert {r.text for r in index.remove([0]).search(q.limit(1), max_distance=0, query_id="id").collect()} == set()
    assert sorted(r.id for r in index.remove([0, 1]).compact().items.collect()) == [0, 1, 2, 3]
    more = index.add_all(strings(spark, ["zzz", "book"]).select("text"))
    assert len(more) == 7 and more.get_text(6).first().text == "zzz"
    assert [r.text for r in index.contains(strings(spark, ["cake", "pie"])).collect()] == ["cake"]
    index.save(f"file://{tmp_path}/i")
    assert len(EditIndex.load(spark, f"file://{tmp_path}/i")) == 6
    swapped = EditIndex(strings(spark, ["abdc"]), use_damerau=True, id_col="id").search(strings(spark, ["abcd"]), max_distance=1, query_id="id")
    assert swapped.count() == 1
    with pytest.raises(ValidationError):
        index.search(q)


def test_ngram_index(spark, tmp_path):
    words = ["hello world", "hello there", "goodbye world", "Hello World", "xy", None]
    df = strings(spark, words)
    index = NgramIndex(df.where("text is not null"), id_col="id")
    got = {r.id: r.shared for r in index.get_candidates(strings(spark, ["hello word"], 9), query_id="id").collect()}
    grams = lambda s: {s.lower()[k : k + 3] for k in range(len(s) - 2)}
    q = grams("hello word")
    assert got == {k: len(q & grams(w)) for k, w in enumerate(words) if w and len(q & grams(w)) >= max(1, -(-len(q) // 5))}
    hits = index.search(strings(spark, ["hello world"], 9), min_similarity=0.9, query_id="id").collect()
    assert {r.id: r.score for r in hits} == {0: 1.0, 3: 1.0}
    assert {r.id for r in index.search(strings(spark, ["hello world"], 9), min_similarity=0.95, normalize=None, query_id="id").collect()} == {0}
    assert index.find_nearest(strings(spark, ["hello"], 9), 2, query_id="id").count() == 2
    assert HybridIndex(df.where("text is not null"), id_col="id").search(strings(spark, ["hello world"], 9), limit=1, query_id="id").first().id == 0
    sharded = ShardedNgramIndex(df.where("text is not null"), num_shards=3, id_col="id")
    assert sharded.shard_distribution().agg(F.sum("items")).first()[0] == 5
    assert {r.id for r in sharded.search(strings(spark, ["hello world"], 9), min_similarity=0.9, query_id="id").collect()} == {0, 3}
    assert ShardedEditIndex(df, num_shards=2, id_col="id").search(strings(spark, ["xz"]), max_distance=1, query_id="id").count() == 1
    assert {r.id for r in ThreadSafeNgramIndex(df.where("text is not null"), id_col="id").get_candidates(strings(spark, ["HELLO"]), query_id="id").collect()} == set()
    assert index.compression_stats().first().grams == len(set().union(*(grams(w) for w in words if w)))
    index.save(f"file://{tmp_path}/n")
    assert NgramIndex.load(spark, f"file://{tmp_path}/n").options == index.options
    with pytest.raises(ValidationError):
        NgramIndex(df, ngram_size=1)


@pytest.mark.parametrize("kind", ["ngram", "edit", "hybrid", "bktree"])
def test_fuzzy_index(spark, tmp_path, kind):
    index = FuzzyIndex(strings(spark, ["apple", "maple", "banana"]), kind, id_col="id")
    hits = index.search(strings(spark, ["applе".replace("е", "e"), "bananna"], 5), min_similarity=0.8, limit=1, query_id="id").collect()
    assert {(r.query_id, r.text) for r in hits} == {(5, "apple"), (6, "banana")}
    index.save(f"file://{tmp_path}/f")
    assert FuzzyIndex.load(spark, f"file://{tmp_path}/f").get_items().count() == 3


# --- schema


def records(spark):
    rows = [(0, "red apple pie", "a long text about apples and pies", "food, Sweet"), (1, "green apple", "another text", "food"), (2, "blue car", None, "car,fast"), (3, None, "text", None)]
    return spark.createDataFrame(rows, "id long, title string, body string, tags string")


def test_schema_search(spark):
    schema = MatchSchema.builder().add_field("title", algorithm="levenshtein", weight=2.0).add_field("body", "long_text").add_field("tags", "token_set").build()
    assert schema.field_names() == ["title", "body", "tags"] and schema.field_count() == 3
    index = SchemaIndex(schema, records(spark), id_col="id")
    q = spark.createDataFrame([(9, "red aple pie", "sweet , FOOD")], "query_id long, title string, tags string")
    got = {r.id: r.score for r in index.search(q, query_id="query_id").collect()}
    assert abs(got[0] - (2 * lev_sim("red aple pie", "red apple pie") + 1) / 3) < 1e-12
    assert abs(got[1] - (2 * lev_sim("red aple pie", "green apple") + 0.5) / 3) < 1e-12 and 3 not in got
    assert [r.id for r in index.search(q, limit=1, query_id="query_id").collect()] == [0]
    only = {r.id: r.score for r in index.search(q, min_field_similarity=0.6, query_id="query_id").collect()}
    assert set(only) == {0}
    boosted = {r.id: r.score for r in index.search(q, field_boosts={"tags": 10.0, "title": 0.0}, query_id="query_id").collect()}
    assert abs(boosted[1] - 0.5) < 1e-12
    assert len(index.add(records(spark).drop("id"))) == 8 and index.get(2).first().title == "blue car"


def test_minmax(spark):
    schema = MatchSchema.builder().add_field("title", algorithm="levenshtein").add_field("tags", "token_set", weight=3.0).with_scoring("minmax_scaling").build()
    q = spark.createDataFrame([(9, "green apples", "food,x")], "query_id long, title string, tags string")
    got = {r.id: r.score for r in SchemaIndex(schema, records(spark).drop("body"), id_col="id").search(q, query_id="query_id").collect()}
    # the title is the better field of record 1: it scales to 1, the tags to 0
    assert abs(got[1] - 0.25) < 1e-9


def test_schema_errors(spark):
    b = MatchSchema.builder
    for bad in (lambda: b().build(), lambda: b().add_field("a").add_field("a").build(), lambda: b().add_field("a", "blob"), lambda: b().add_field("a", weight=11.0), lambda: b().add_field("a").with_scoring("max").build(), lambda: b().add_field("")):
        with pytest.raises(SchemaError):
            bad()
    index = SchemaIndex(b().add_field("title").build(), records(spark).select("id", "title"), id_col="id")
    with pytest.raises(SchemaError):
        index.search(records(spark).select("body"))
    with pytest.raises(SchemaError):
        SchemaIndex(b().add_field("title").build(), records(spark), id_col="id")
    with pytest.raises(SchemaError):
        SchemaIndex(b().add_field("name", required=True).build(), records(spark).select("id"), id_col="id")


# --- metrics


def test_metrics(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    true, found = pairs((1, 2), (2, 1), (3, 4), (5, 6)), pairs((2, 1), (4, 3), (7, 8))
    row = metrics.confusion_matrix(true, found, total_pairs=10).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 1, 6) and abs(row.f_score - 2 / 3) < 1e-12
    assert metrics.precision(pairs(), pairs()) == metrics.recall(pairs(), pairs()) == 1.0
    assert metrics.precision(true, pairs()) == 0.0 and metrics.recall(pairs(), found) == 0.0
    assert metrics.confusion_matrix(true, found, total_pairs=1).first().tn == 0
    assert abs(metrics.f_score(true, found, 2.0) - 2 / 3) < 1e-12
    with pytest.raises(ValidationError):
        metrics.f_score(true, found, -1)


def test_best_match_score_chooses_among_all_regions(spark, tmp_path):
    from kindred.plans.queries import best_match_score

    spark.createDataFrame([(k, f"REGION{k}") for k in range(5)] + [(5, "ALGERIA"), (6, "BRAZIL")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(0, "ALGERIA"), (1, "BRAZIL")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    assert {(r.n_nationkey, r.best, r.score) for r in best_match_score(spark, str(tmp_path)).collect()} == {(0, "ALGERIA", 1.0), (1, "BRAZIL", 1.0)}
