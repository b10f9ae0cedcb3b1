import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import exact_dedup, jaccard_join, suffix_dedup

UPPER = {c: c + 32 for c in range(65, 91)}


def test_exact_dedup(docs, awkward):
    norm = lambda t: (t or "").translate(UPPER)
    groups = defaultdict(list)
    for i, t, *_ in awkward:
        groups[norm(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    rows = exact_dedup.exact_dedup(docs).collect()
    want = Counter((i, best[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in awkward)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_keeps_whole_rows(docs, awkward):
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns
    norm = Counter((r.text or "").translate(UPPER) for r in out.collect())
    assert set(norm.values()) == {1} and set(norm) == {(t or "").translate(UPPER) for _, t, *_ in awkward}


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == [] and exact_dedup.without_copies(no_docs).collect() == []


@pytest.mark.parametrize("hash_of", [lambda c: F.lit(7), lambda c: F.pmod(F.crc32(c), F.lit(3))])
def test_exact_dedup_verifies_chunks(docs, awkward, hash_of):
    key = lambda rows: Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows)
    assert key(exact_dedup.exact_dedup(docs, hash_of).collect()) == key(exact_dedup.exact_dedup(docs).collect())


def test_exact_dedup_groups_by_recipe(docs, monkeypatch):
    # the recipe decides: one that forgets all but the last chunk makes texts with equal ends equal
    rows = [(1, "a" * 600 + "\n" + "same end\n", "en", "s", 1), (2, "b" * 600 + "\n" + "same end\n", "en", "s", 1)]
    df = docs.sparkSession.createDataFrame(rows, docs.sparkSession.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").schema)
    assert [r.group_size for r in exact_dedup.exact_dedup(df).collect()] == [1, 1]
    whole = exact_dedup.recipes
    monkeypatch.setattr(exact_dedup, "recipes", lambda *a, **k: whole(*a, **k).withColumn("recipe", F.slice("recipe", -1, 1)))
    assert [r.group_size for r in exact_dedup.exact_dedup(df).collect()] == [2, 2]


def test_exact_dedup_of_a_large_group(spark):
    rows = [(k, "copy" if k % 3 else f"text {k}", "en", "s", 1) for k in range(1200)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)).collect()
    assert len(got) == 1200 and {(r.group_size, r.keep_id) for r in got if r.doc_id % 3} == {(800, 1199)} and sum(r.kept for r in got) == 401


def test_exact_dedup_stays_the_same_among_rows_that_share_id_and_text(spark):
    rows = [(1, "t", lang, src, 1) for lang in ("a", "b", "c") for src in ("x", "y", None)]
    got = {tuple(map(tuple, exact_dedup.without_copies(spark.createDataFrame(random.Random(n).sample(rows, 9), "doc_id long, text string, lang string, source string, n_chars long").repartition(n)).collect())) for n in (1, 2, 5)}
    assert len(got) == 1


def test_chunks_lose_nothing():
    rng = random.Random(3)
    pattern = exact_dedup.chunk_pattern(16, 64).replace("\\z", "\\Z")
    for n in (0, 1, 10, 100, 5000):
        text = "".join(rng.choice("abcdefgio \né") for _ in range(n))
        chunks = re.findall(pattern, text)
        assert "".join(chunks) == text and all(len(c) <= 64 for c in chunks)


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets, parent = [grams(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[find(a)] = find(b)
    roots = [find(k) for k in range(len(rows))]
    return sets, roots, links


def test_jaccard_classes(docs, awkward):
    _, roots, links = brute_classes(awkward)
    ids = defaultdict(list)
    for r, (i, *_) in zip(roots, awkward):
        ids[r].append(i)
    # among equals a null id is the smallest
    least = {r: None if None in i else min(i) for r, i in ids.items()}
    rows = jaccard_join.similarity_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in rows) == Counter((i, least[r], n) for r, n, (i, *_) in zip(roots, links, awkward))
    assert sum(r.stays for r in rows) == len(set(roots))


def test_jaccard_join_keeps_one_row_of_each_class(docs, awkward):
    sets, roots, _ = brute_classes(awkward)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter(grams(r.text) for r in out.collect() if grams(r.text))
    assert set(got.values()) == {1} and sum(got.values()) == len({r for r, s in zip(roots, sets) if s})


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join.similarity_classes(no_docs).collect() == [] and jaccard_join.one_of_each(no_docs).collect() == []


def test_large_groups_are_split_and_still_whole(spark, monkeypatch):
    """Buckets and components far beyond the sizes that one task handles."""
    for name, value in (("SMALL", 4), ("BLOCK", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        if k:
            w[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(f"y{rng.randrange(9999)}" for _ in range(80))) for k in range(20)]
    _, roots, links = brute_classes(rows)
    least = {r: min(i for q, (i, _) in zip(roots, rows) if q == r) for r in set(roots)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (least[r], n) for r, n, (i, _) in zip(roots, links, rows)}


@pytest.mark.parametrize("bits", [16, 0])
def test_buckets_are_split_until_they_are_small(spark, monkeypatch, bits):
    """Sets that share boilerplate, and families inside, so that buckets must be split several times; with few large buckets, and with many."""
    monkeypatch.setattr(jaccard_join, "KEYS_BITS", bits)
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    levels, spool = [], jaccard_join.spool
    monkeypatch.setattr(jaccard_join, "spool", lambda df, name: levels.append(name) or spool(df, name))
    rng = random.Random(11)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for f in range(80):
        own = common + [f"f{f}w{k}" for k in range(90)]
        for k in range(3):
            w = list(own)
            if k:
                w[rng.randrange(60, 150)] = f"x{f}{k}"
            rows.append((len(rows), " ".join(w)))
    _, roots, links = brute_classes(rows)
    least = {r: min(i for q, (i, _) in zip(roots, rows) if q == r) for r in set(roots)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (least[r], n) for r, n, (i, _) in zip(roots, links, rows)}
    assert "large2" in levels


def test_recall_is_measured(spark):
    rng = random.Random(12)
    sk = [bytes(rng.randrange(256) for _ in range(64)) for _ in range(20)]
    content = spark.createDataFrame([(k, bytearray(sk[k // 2])) for k in range(40)], "sid long, sketch binary")
    comps = spark.createDataFrame([(k, k // 2 * 2) for k in range(40)], "node long, component long")
    assert jaccard_join.missed(content, comps, 0.8) == 0
    assert jaccard_join.missed(content, comps.where("node not in (4, 9)"), 0.8) == 4
    assert jaccard_join.missed(content.limit(0), comps, 0.8) == 0


def test_bounds_of_sketches_and_runs():
    assert 30 < jaccard_join.bound(0.8) < 45 and jaccard_join.bound(1.0) == 64 and jaccard_join.bound(0.5) < jaccard_join.bound(0.8)
    assert jaccard_join.runs_for(0.8, 0.9) < jaccard_join.runs_for(0.8, 0.9999) < 20 and jaccard_join.runs_for(0.5, 0.99) > 3


def test_gram_sets_match_a_plain_count():
    texts = [None, "", " \n", "a", "a b c d", "a b c d e", "a b c d e f a b c d e", "  x\ty z q  w v u\n"]
    _, sizes = jaccard_join.gram_sets(texts, 5)
    assert sizes.tolist() == [len(grams(t)) for t in texts]


def brute_cover(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + length, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(t)]
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def removed(df, **options):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(df, **options)).collect())


def test_repeats(docs, awkward):
    want = brute_cover([(t or "").encode() for _, t, *_ in awkward], 200)
    assert removed(docs) == Counter((i, *w) for (i, *_), w in zip(awkward, want))


def test_spans_and_what_stays(docs, awkward):
    texts = defaultdict(set)
    for i, t, *_ in awkward:
        texts[i].add((t or "").encode())
    for r in suffix_dedup.remove_repeats(docs).collect():
        for t in texts[r.doc_id]:
            rest = bytearray(t)
            for x in reversed(r.spans):
                del rest[x.start : x.start + x.bytes]
            if bytes(rest) == bytes(r.kept):
                break
        else:
            raise AssertionError(r.doc_id)


def test_repeats_of_nothing(no_docs):
    assert removed(no_docs) == Counter()


@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats_of_many_lengths(spark, monkeypatch, crowd):
    """Random texts over few letters, with runs of one letter, in which repeats overlap and end everywhere."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)
    rng = random.Random(crowd)
    pool = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(6)] + ["z" * 45]
    rows = []
    for k in range(60):
        parts = [rng.choice(pool)[rng.randrange(20) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        rows.append((k, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for length, gram in ((20, 8), (24, 20), (17, 5)):
        want = brute_cover([t.encode() for _, t in rows], length)
        assert removed(df, length=length, gram=gram, crowd=crowd) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_frequent_leads_have_several_buckets(spark, monkeypatch):
    lead = np.array([b"b" * 16] * 50 + [b"a" * 16, b"c" * 16], "S16")
    splitters = np.array([b"a" * 16] + [b"b" * 16] * 4 + [b"bz"], "S16")
    bucket = suffix_dedup.bucket_of(splitters, lead, np.arange(52, dtype=np.uint64))
    assert set(bucket[:50].tolist()) == {2, 3, 4, 5} and bucket[50:].tolist() == [1, 6]
    # every 60 bytes of these texts begin with the same 16: they share leads and yet not all their repeats
    monkeypatch.setattr(suffix_dedup, "BUCKET", 300)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1000)
    rng = random.Random(3)
    pool = ["same leading text" + "".join(rng.choice("abcd") for _ in range(43)) for _ in range(30)]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randrange(8)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (4096, 1):
        want = brute_cover([t.encode() for _, t in rows], 40)
        assert removed(df, length=40, gram=20, crowd=crowd) == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_long_texts_go_in_pieces():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 30, 999, 5, 60, 61)]
    windows = Counter()
    for raw, owner, skip in suffix_dedup.pieces(texts, 20, 50):
        assert sum(map(len, raw)) < 50 + 50 + 19 + 1
        for r, k, at in zip(raw, owner, skip):
            windows.update((int(k), int(at) + i, r[i : i + 20]) for i in range(max(0, len(r) - 19)))
    assert windows == Counter((k, i, t[i : i + 20].encode()) for k, t in enumerate(texts) for i in range(max(0, len(t) - 19)))


def test_multikey_quicksort_orders_suffixes():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 400, dtype=np.uint8)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)
    at = np.arange(0, 376)
    order, run = suffix_dedup.multikey_quicksort(words, at, 3)
    keys = [bytes(buf[p : p + 24]) for p in at[order]]
    assert keys == sorted(keys)
    assert [run[k] == run[k - 1] for k in range(1, len(run))] == [keys[k] == keys[k - 1] for k in range(1, len(keys))]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 9, 1, 30, 2)] + [None]})
    got = [t for b in jaccard_join.by_size(batch, most=10) for t in b.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()


def test_sampled_leads_are_from_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE_LEADS", 400)
    rng = random.Random(9)
    rows = [(k, "".join(rng.choices("abcd" if k < 100 else "wxyz", k=2000))) for k in range(200)]
    docs = spark.createDataFrame(rows, "id long, t string").repartitionByRange(8, "id")
    leads = suffix_dedup.sample_leads(docs, 200, 400_000, suffix_dedup.LENGTH, suffix_dedup.GRAM)
    assert 200 < len(leads) < 800 and 0.3 < np.mean([x[:1] >= b"w" for x in leads.tolist()]) < 0.7
