import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import byte_bpe, mixing, toxicity
from tests.llm.conftest import DOCS, words
from tests.llm.test_dedup import UPPER, brute_classes

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grotmund", "vilskap", "snarzel"]


def corpus(n, seed=1):
    """Texts of which some hold bad words, also with endings that training may not have met."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        w, bad = words(rng, rng.randint(5, 120)).split(), rng.random() < 0.15
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(BAD) + rng.choice(["", "", "en", "erst", "ung"]))
        rows.append((k, " ".join(w), int(bad)))
    return rows


def remainder(i):
    return zlib.crc32(str(i).encode()) % 3


def test_network_learns_words_and_their_endings():
    rows = corpus(3000)
    train, held = [r for r in rows if remainder(r[0]) != 1], [r for r in rows if remainder(r[0]) == 1]
    net = toxicity.train([t for _, t, _ in train], np.array([y for *_, y in train]))
    score, y = net.score([t for _, t, _ in held]), np.array([y for *_, y in held])
    assert ((score >= 0.7) == (y == 1)).mean() > 0.98
    again = toxicity.train([t for _, t, _ in train], np.array([y for *_, y in train]))
    assert np.array_equal(again.score([t for _, t, _ in held[:20]]), score[:20])


def test_scores_depend_on_the_text_alone():
    rows = corpus(500)
    net = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    rng = random.Random(8)
    texts = [t for _, t, _ in rows[:120]] + ["", " \n", "word", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 50, words(rng, 3000), "x" * 500]
    alone = np.concatenate([net.score([t]) for t in texts])
    for size in (2, 7, 64, len(texts)):
        assert np.array_equal(alone, np.concatenate([net.score(texts[k : k + size]) for k in range(0, len(texts), size)]))
    order = rng.sample(range(len(texts)), len(texts))
    assert np.array_equal(alone[order], net.score([texts[k] for k in order]))


def test_training_sample_is_bounded_and_repeatable(spark):
    docs = [(k, f"text {k} " + "x" * 100, "en", "s", 1) for k in range(60)] + [(k, f"other text of {k}", "fr", "t", 1) for k in range(0, 60, 2)] * 3
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(80)] * 2, LABELS)
    of = lambda df, *bounds: sorted(map(tuple, toxicity.sample_of(df, labels, *bounds)[0].collect()))
    seen = {tuple(of(spark.createDataFrame(random.Random(n).sample(docs, len(docs)), DOCS).repartition(n), 30, 1 << 20)) for n in (1, 3, 7)}
    assert len(seen) == 1 and 20 <= len(*seen) <= 30
    assert 0 < sum(len(t) for _, t in of(spark.createDataFrame(docs, DOCS), 30, 1000)) <= 1000
    assert of(spark.createDataFrame([], DOCS), 30, 1000) == []


def test_gradients_of_the_network():
    texts = ["a bad word here", "clean words only in this one", "x", ""]
    words_ = toxicity.Words(texts)
    rows, _ = words_.windows(len(texts))
    net = toxicity.Network(3)
    r = np.random.default_rng(0)
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    net.p["word"] += 0.5 * r.standard_normal(net.p["word"].shape)
    net.p["gram"] += 0.5 * r.standard_normal(net.p["gram"].shape)
    y, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        p = net.forward(net.projected(net.inputs(words_)), rows)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())

    grads, _ = net.gradients(words_, rows, y, weight)
    for name in ("wf", "uf", "cf", "wb", "ub", "cb", "v", "vs", "out", "bias"):
        flat, g = net.p[name].ravel(), np.asarray(grads[name]).ravel()
        k = int(np.abs(g).argmax())
        flat[k] += 1e-3
        up = loss()
        flat[k] -= 2e-3
        down = loss()
        flat[k] += 1e-3
        assert abs((up - down) / 2e-3 - g[k]) < 5e-3 * max(1, abs(g[k])) + 3e-4, name


def test_windows_cover_all_words():
    texts = ["", "one", " ".join(f"w{k}" for k in range(32)), " ".join(f"v{k}" for k in range(33)), " ".join(f"u{k}" for k in range(100))]
    words_ = toxicity.Words(texts)
    rows, text = words_.windows(len(texts))
    assert [int((text == k).sum()) for k in range(5)] == [1, 1, 1, 2, 6]
    for k, t in enumerate(texts):
        assert {int(x) for x in rows[text == k].ravel()} - {-1} == {int(x) for x in words_.of[words_.text == k]}
        assert len({int(x) for x in words_.of[words_.text == k]}) == len(set(t.split()))


def test_toxicity_table(spark, docs, awkward):
    rows = corpus(600)
    known = spark.createDataFrame([(k + 1000, t, "en", "s", 1) for k, t, _ in rows], DOCS)
    both = docs.select(*known.columns).unionByName(known).withColumn("held_out", F.lit("clash")).withColumn("score", F.lit("clash"))
    # a label of a held-out row that is wrong must not matter, nor one without a document
    labels = spark.createDataFrame([(k + 1000, 1, y if remainder(k + 1000) != 1 else 1 - y) for k, _, y in rows] + [(None, 1, 1), (99_999, 0, 1), (1001, 1, None)], LABELS)
    got = toxicity.toxicity(both, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter([*(i for i, *_ in awkward), *(k + 1000 for k, *_ in rows)])
    assert all(r.held_out == (r.doc_id is not None and remainder(r.doc_id) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {k + 1000: y for k, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("kinds", [[], [0], [1]])
def test_labels_of_one_kind(spark, docs, kinds):
    labels = spark.createDataFrame([(k, 1, kinds[0]) for k in range(10)] if kinds else [], LABELS)
    scores = {r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert len(scores) == 1 and (max(scores) > 0.5) == (kinds == [1])


def test_no_documents(spark, no_docs):
    assert toxicity.toxicity(no_docs, spark.createDataFrame([(1, 1, 1)], LABELS)).collect() == []


def brute_pipeline(spark, rows, labels):
    """All stages over a list of rows, each by the plainest way there is."""
    known = [(i, y) for i, _, y in labels if remainder(i) != 1]
    text = {i: t for i, t, *_ in rows}
    pick = [(i, y) for i, y in sorted(known) if i in text]
    net = toxicity.train([text[i] or "" for i, _ in pick], np.array([y for _, y in pick], int))
    rows = [r for r, s in zip(rows, net.score([r[1] or "" for r in rows])) if s < 0.7]
    best = {}
    for r in rows:
        key = (r[1] or "").translate(UPPER)
        best[key] = max(best.get(key, r), r, key=lambda x: x[0])
    rows = list(best.values())
    _, roots, _ = brute_classes(rows)
    least = {}
    for q, r in zip(roots, rows):
        least[q] = min(least.get(q, r), r, key=lambda x: x[0])
    rows = list(least.values())
    taken = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()}
    bpe = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())
    return Counter({(i, len(bpe.encode(t or ""))): taken[i] for i, t, *_ in rows if taken[i]})


def test_pipeline(spark, tmp_path, awkward):
    rows = [(k + 1000, t, "en", f"src{k % 4}", 1) for k, t, _ in corpus(500)]
    rows += list({i: r for r in awkward if (i := r[0]) is not None}.values())
    labels = [(k + 1000, 1, y) for k, _, y in corpus(500)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(spark, rows, labels)


def test_stages_keep_the_columns(spark, tmp_path, docs):
    spark.createDataFrame([(k, 1, k % 2) for k in range(30)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_stages_on_nothing(spark, tmp_path, no_docs):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).collect() == []


def test_long_runs_are_read_whole():
    head = "anbacedoerfigohaanba"
    for end in ("x", "y", "xy" * 40):
        words_ = toxicity.Words([head + "q" + end, head + "r" + end])
        assert set(words_.of[words_.text == 0]) != set(words_.of[words_.text == 1])
    letters = "".join(chr(0x4E00 + k) for k in range(400))
    for n in range(1, 400, 7):
        # pieces overlap and leave no byte out: each 4-gram of bytes within the run is in one of them
        words_ = toxicity.Words([letters[:n], *(letters[k : k + 2] for k in range(n - 1))])
        grams = [set(g) for g in np.split(words_.grams, words_.begins()[1:])]
        mine = set().union(*(grams[w] for w in words_.of[words_.text == 0]))
        for k in range(1, n):
            inner = toxicity.Words([letters[k - 1 : k + 1]])
            assert set(inner.grams[1:-1]) <= mine


def test_words_end_at_breaks_of_any_script():
    for gap in "\u0085\u00a0\u2003\u200b\u2028\u3000\ufeff\u2014\u2013\u2026\u201c\u201d\u00ab\u3001\u3002\u300c\uff01\uff1f\u060c\u0964":
        words_ = toxicity.Words([f"one{gap}two{gap}", "one two"])
        assert np.array_equal(words_.of[words_.text == 0], words_.of[words_.text == 1]), hex(ord(gap))
    # letters with marks, and signs that may mean something, stay
    assert len(toxicity.Words(["naïve हिन्दी ภาษา 日本語 😀 café"]).text) == len("naïve हिन्दी ภาษา 日本語 😀 café".split()) + 2


def test_toxic_words_beyond_the_head_of_a_run_are_found():
    rng, rows = random.Random(5), corpus(1500)
    han = [chr(0x4E00 + 37 * k) for k in range(200)]
    head = lambda: words(rng, 12).replace(" ", "")[: rng.choice((17, 18, 20, 22, 24, 30, 40, 60))]
    for k in range(1500):
        bad = rng.random() < 0.2
        rows.append((k, "".join(rng.choices(han, k=rng.randint(6, 60)) + ["虐虑虒"] * bad + rng.choices(han, k=rng.randint(6, 60))), int(bad)))
    for k in range(600):
        bad = rng.random() < 0.3
        rows.append((k, f"{words(rng, rng.randint(3, 30))} {head()}{rng.choice(BAD) * bad} {words(rng, rng.randint(3, 30))}", int(bad)))
    net = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    clean = [words(rng, 30) for _ in range(40)]
    texts = {
        "dashes": [f"extraordinary\u2014{b}" for b in BAD],
        "spaces": [f"{c} {b}".replace(" ", "\u00a0") for c in clean for b in BAD],
        "compounds": [f"{c} {head()}{b} {c}" for c in clean for b in BAD],
        "han": ["".join(rng.choices(han, k=40) + ["虐虑虒"] + rng.choices(han, k=k)) for k in range(40)],
    }
    for name, toxic in texts.items():
        assert (net.score(toxic) >= 0.7).mean() > 0.85, name
    for t in (clean, [c.replace(" ", "\u00a0") for c in clean], [f"{c} {head()} {c}" for c in clean], ["".join(rng.choices(han, k=60)) for _ in range(40)]):
        assert (net.score(t) < 0.7).mean() > 0.85


def test_bounds_of_training_are_parameters(spark, monkeypatch):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], LABELS)
    known = [(k, t, y) for k, t, y in rows if remainder(k) != 1]
    texts, y = [t for _, t, _ in known], np.array([y for *_, y in known])
    same = lambda p, q: all(np.array_equal(p[k], q[k]) for k in q)
    # training runs in a task, with these bounds, and gives what it gives here
    got = toxicity.unpacked(toxicity.learnt(docs, labels, 4000, 1 << 20, negatives=40, worst=1)).p
    assert same(got, toxicity.train(texts, y, negatives=40, worst=1).p) and not same(got, toxicity.train(texts, y, negatives=60, worst=2).p)
    seen = []
    monkeypatch.setattr(toxicity, "learnt", lambda *a, **bounds: seen.append((*a[2:], bounds)) or toxicity.packed(toxicity.Network().p))
    toxicity.toxicity(docs, labels, negatives=5, worst=2, training_rows=7)
    toxicity.without_toxic(docs, labels, negatives=6, worst=1, training_bytes=8)
    toxicity.toxicity(docs, labels)
    assert seen == [(7, 16 << 20, {"negatives": 5, "worst": 2}), (4000, 8, {"negatives": 6, "worst": 1}), (4000, 16 << 20, {"negatives": 24_000, "worst": 3})]
