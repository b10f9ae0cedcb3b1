import base64
import gzip
import hashlib
import random
import re
import string
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kindred.llm import archives, byte_bpe, fingerprints, html_text
from tests.llm.conftest import DOCS, words


def edited(rows):
    """Each text, its edited text and the next text, by the contract."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + n[:half], n


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(text):
    """Sections of paragraphs of clauses' digests, by plain loops."""
    sections = [x for x in re.split(r"(?<=\n\n)", text)]
    # a run of three line ends ends a section after the second and after the third
    return [[[sha(c) for c in re.findall(fingerprints.CLAUSE.replace("\\z", "\\Z"), p)] for p in re.split(r"(?<=\n)", s)] for s in sections]


def brute_root(text):
    return sha("r" + "".join(sha("s" + "".join(sha("p" + "".join(p)) for p in s)) for s in brute_tree(text)))


def brute_likeness(a, b):
    a, b = (Counter(c for s in brute_tree(t) for p in s for c in p) for t in (a, b))
    return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0


def test_fingerprints_are_those_of_the_tree(docs, awkward, spark):
    rng = random.Random(6)
    line = lambda: rng.choice(["one line.\n", "two, lines\n", "\n", "a longer line of words; with a clause\n", words(rng, 5) + ". "])
    extra = [(1000 + k, "".join(line() for _ in range(rng.randint(0, 40))), "en", "s", 1) for k in range(60)]
    rows = [r for r in awkward if len(r[1] or "") < 5000] + extra
    want = Counter((i, brute_root(t), brute_root(e), round(brute_likeness(t, e), 9), round(brute_likeness(t, n), 9)) for i, t, e, n in edited(rows))
    got = fingerprints.compare_edits(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_least_and_null_ids_are_told_apart(spark):
    rows = [(-(1 << 63), "least id", None, None, 1), (None, "no id", None, None, 1), (5, "five", None, None, 1)]
    got = {r.doc_id: r.next_t for r in fingerprints.with_next(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {None: "least id", -(1 << 63): "five", 5: "no id"}


def test_blocks_have_partitions_of_their_own(spark):
    keys = fingerprints.keys_of(spark, 37)
    df = spark.createDataFrame([(k,) for k in keys], "key int").repartition(37, "key").select(F.spark_partition_id().alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(37))


@pytest.mark.parametrize("block_bytes", [32 << 20, 500])
def test_fingerprints(docs, awkward, monkeypatch, block_bytes):
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (block_bytes,))
    rows = fingerprints.compare_edits(docs).collect()
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited(awkward))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    prints = {}
    for i, t, e, _ in edited(awkward):
        r = next(r for r in rows if r.doc_id == i and r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint and prints.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (t == e) and (r.edit_section == 0) == (t == e)
        if len(t) > 200 and t != e:
            assert 0.3 < r.near_edited
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_of_nothing_and_of_one(spark, no_docs):
    assert fingerprints.compare_edits(no_docs).collect() == []
    one = fingerprints.compare_edits(spark.createDataFrame([(7, "abcdef", None, None, 6)], DOCS)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1


def test_nodes_tell_blank_lines_apart_and_locate_edits(spark):
    texts = ["a\n\nb", "a\n\n\nb", "a\n \nb", "p one.\np two.\n\ns two.\nlast.", "p one.\np two.\n\ns two.\nlest."]
    df = fingerprints.fingerprint(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    rows = df.orderBy("doc_id").collect()
    assert len({r.fingerprint for r in rows}) == len(texts)
    a, b = rows[3].tree, rows[4].tree
    assert [x.node == y.node for x, y in zip(a, b)] == [True, False]
    assert [x == y for x, y in zip(a[1].paragraphs, b[1].paragraphs)] == [True, False]


def test_binary_search_for_blocks(spark):
    splits = [3, 5, 5, 9, 100]
    rows = spark.range(0, 120).select("id", fingerprints.block_of(F.col("id"), sorted(set(splits))).alias("b")).collect()
    assert all(r.b == sum(r.id >= s for s in sorted(set(splits))) for r in rows)


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_reference_encoder(encoding):
    bpe, rng = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary()), random.Random(1)
    texts = ["", " ", "\n\n x", "a" * 3000, "日本語テキスト😀", "\x00\x1c\x1f\x85 x", "it's 're we'LL", "<|endoftext|>", " " * 500]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += [words(rng, 50).title() for _ in range(50)]
    for t in texts:
        ids = bpe.encode(t)
        assert ids.tolist() == encoding.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_bpe_digests(docs, awkward, encoding):
    want = Counter()
    for i, t, *_ in awkward:
        ids = encoding.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    path, pattern = byte_bpe.public_vocabulary()
    assert Counter(tuple(r) for r in byte_bpe.encode_digest(docs, path, pattern).collect()) == want


def test_ids_and_bytes_as_tables(docs, awkward, encoding):
    path, pattern = byte_bpe.public_vocabulary()
    tokens = byte_bpe.encode(docs, path, pattern)
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == Counter((i, tuple(encoding.encode_ordinary(t or ""))) for i, t, *_ in awkward)
    nothing = tokens.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))
    assert byte_bpe.decode(nothing, path, pattern).first().decoded == b""
    assert Counter(bytes(r.decoded) for r in byte_bpe.decode(tokens, path, pattern).collect()) == Counter((t or "").encode() for _, t, *_ in awkward)


def test_bpe_of_nothing(no_docs):
    assert byte_bpe.encode_digest(no_docs, *byte_bpe.public_vocabulary()).collect() == []


def test_small_cache_changes_nothing(monkeypatch, encoding):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    bpe = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())
    for t in ("one two three four five six", "six seven", "one two zzqx"):
        assert bpe.encode(t).tolist() == encoding.encode_ordinary(t)


# --- archives

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    rows = [(k, f"http://h{k}.example/{k}", f"<p>{words(rng, 20)}</p>") for k in range(20)]
    rows += [(30 + k, f"http://copy.example/{k} x\ny", rows[k % 3][2]) for k in range(8)]
    rows += [(-5, "http://neg.example/", rows[4][2]), (50, None, None), (51, "http://e.example/", ""), (52, "", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\x00\x1f"), (53, "http://big.example/", "x" * 300_000)]
    rows += [(None, "http://null.example/", rows[5][2]), (None, None, "<i>alone</i>"), (60, "http://twice.example/", "<b>twice</b>"), (60, "http://twice.example/", "<b>twice</b>")]
    return rows


def test_archives(spark, pages, tmp_path):
    df = spark.createDataFrame(pages, PAGES).repartition(4).withColumn("first", F.lit("clash")).withColumn("sha", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("copy", F.lit(0))
    rows = archives.archive(df, f"file://{tmp_path}/warc").collect()
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h in pages)
    by = {}
    for i, _, h in pages:
        by.setdefault(sha(h), []).append(i)
    for d, ids in by.items():
        same = [r for r in rows if r.payload_digest == d]
        least = min((i for i in ids if i is not None), default=None)
        responses = [r for r in same if r.record_type == "response"]
        assert [r.page_id for r in responses] == [least]
        assert all(r.refers_to == least for r in same if r.record_type == "revisit") and responses[0].refers_to is None
    files = list(tmp_path.glob("warc/part-*"))
    records = [x for f in files for x in archives.read_warc(gzip.decompress(f.read_bytes()))]
    # each record is a gzip member of its own
    assert all(len(list(archives.read_warc(m))) == 1 for f in files for m in archives.members(f.read_bytes()))
    assert len(records) == len(pages) and Counter(b.decode() for h, b in records if h["warc-type"] == "response") == Counter({(h or "") for _, _, h in pages})
    assert len({h["warc-record-id"] for h, _ in records}) == len(records)


def test_members_of_any_length():
    rng = random.Random(3)
    parts = [b"", b"a", rng.randbytes(100_000), b"x" * (1 << 24), b"y" * 70_000, b"z" * ((1 << 24) + 5)]
    files = b"".join(archives.member(p) for p in parts)
    assert gzip.decompress(files) == b"".join(parts) and all(archives.member(p)[-1] == 0 for p in parts)
    assert [m for m in archives.members(files) if m] == [p for p in parts if p]
    with pytest.raises(ValueError):
        list(archives.members(files[:-9]))


def test_only_long_payloads_are_revisited(spark, pages, tmp_path):
    rows = archives.archive(spark.createDataFrame(pages, PAGES), f"file://{tmp_path}/warc", 1 << 20).collect()
    assert {r.record_type for r in rows} == {"response"} and len(rows) == len(pages)


def test_no_pages(spark, tmp_path):
    assert archives.archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/warc").collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    date = datetime(2001, 2, 3, 4, 5, 6, tzinfo=timezone.utc)
    records = [archives.Record("http://a.example/", "1.2.3.4", date, "text/html", p) for p in (b"", b"\n\n", b"http://x 1 2 3 4\nyy", bytes(range(256)))]
    assert list(archives.read_arc(archives.write_arc(records, version))) == records
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.write_arc(records, version)[:-40]))


def test_damaged_archives_are_errors():
    date = datetime(2001, 1, 1, tzinfo=timezone.utc)
    arc = archives.write_arc([archives.Record("http://a/", "0.0.0.0", date, "text/html", b"payload")], 2)
    with pytest.raises(ValueError, match="checksum"):
        list(archives.read_arc(arc.replace(b"payload", b"payluad")))
    with pytest.raises(ValueError, match="unknown ARC"):
        list(archives.read_arc(arc.replace(b"2 0 kindred", b"3 0 kindred")))
    warc = b"".join(archives.convert(arc, lambda k, r: (archives.record_id(5, 1), None)))
    assert [h["warc-date"] for h, _ in archives.read_warc(warc)] == ["2001-01-01T00:00:00Z"]
    with pytest.raises(ValueError):
        list(archives.read_warc(warc[:-3]))


@pytest.mark.parametrize("page", [None, 0, 7, -7, (1 << 63) - 1, -(1 << 63)])
def test_record_ids_carry_the_page(page):
    assert archives.page_of(archives.record_id(page, 3)) == page


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><ul><li><a href="/">home</a></li><li><a href="/about">about us</a></li></ul></header><nav><a href="/x">menu item</a></nav>
<div class="cookie-notice"><p>We use cookies. Accept them.</p></div><!-- note --><div class="ad">Buy this thing now.</div>
<article><h1>{h}</h1><p><b>{a}<br><p>{b} &lt;x&gt; &eacute;</p><div class="ad">Sponsored words here.</div><ul><li>{c}<li>{d}</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">related story</a></li></ul></aside>
<section class="comments"><h3>comments</h3><div class="comment"><b>bob</b> <p>I think this is a long comment about the story that goes on.</p></div></section>
<form action="/s"><label>subscribe</label><input name="q"><button>sign up</button></form><footer>&copy; site &middot; all rights reserved.</footer></body></html>"""


def page(rng):
    parts = {k: words(rng, rng.randint(4, 40)).capitalize() + "." for k in "habcd"}
    return PAGE.format(**parts), "\n".join([parts["h"], parts["a"], parts["b"] + " <x> é", parts["c"], parts["d"]])


def test_main_text(spark):
    rng = random.Random(6)
    made = [page(rng) for _ in range(30)]
    rows = [(k, "http://a/", h) for k, (h, _) in enumerate(made)] + [(100, None, None), (101, "u", ""), (102, "u", "<nav><a href='/'>home</a></nav>"), (None, "n", made[0][0]), (5, "again", made[5][0])]
    rows.append((103, "long", "<article>" + "".join(f"<p>{words(rng, 12).capitalize()}.</p>" for _ in range(3000)) + "</article>"))
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash")).withColumn("label", F.lit(0)).repartition(3)
    got = {(r.page_id, r.url): r for r in html_text.main_text(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    right = sum(got[k, "http://a/"].text == want for k, (_, want) in enumerate(made))
    assert right >= 28, right
    assert got[100, None].text == got[101, "u"].text == got[102, "u"].text == ""
    assert got[None, "n"].text == got[0, "http://a/"].text and len(got[103, "long"].text.split("\n")) == 3000


def test_no_main_text_of_nothing(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_labeller_on_pages_it_has_not_seen():
    net, layouts = html_text.train(), html_text.Layouts(77)
    right = total = 0
    for _ in range(200):
        got = html_text.blocks(layouts.page())
        if got:
            plain = [(" ".join(t.replace(html_text.MAIN, "").split()) or "x", *rest) for t, *rest in got]
            y = net.label([plain])[0]
            right += sum(a == (html_text.MAIN in b[0]) for a, b in zip(y, got))
            total += len(got)
    assert right / total > 0.99


def test_gradients_of_the_labeller():
    net, layouts = html_text.Labeller(1), html_text.Layouts(1)
    pages_ = [html_text.blocks(layouts.page())[:4] for _ in range(3)]
    net.p = {k: v.astype("float64") for k, v in net.p.items()}
    x, rng = html_text.Pages(pages_), random.Random(0)
    y = [float(rng.random() < 0.5) for _ in range(sum(map(len, pages_)))]
    import numpy as np

    y = np.array(y)
    loss = lambda: float(-np.mean(y * np.log(net.forward(x)) + (1 - y) * np.log(1 - net.forward(x))))
    g = net.gradients(x, y)
    for name in ("wf", "uf", "wb", "ub", "out", "bias"):
        flat = net.p[name].ravel()
        k = int(np.abs(g[name]).argmax())
        h = 1e-3
        flat[k] += h
        up = loss()
        flat[k] -= 2 * h
        down = loss()
        flat[k] += h
        assert abs((up - down) / (2 * h) - g[name].ravel()[k]) < 2e-3 * max(1, abs(g[name].ravel()[k])) + 2e-4, name


def test_parser_survives_broken_markup():
    rng = random.Random(9)
    for _ in range(300):
        html_text.blocks("".join(rng.choice(["<p>", "</p", "<a href='", "<!--", "-->", "&amp", "&#x41;", "<script>", "</script>", "<", ">", "x y", "<li>", "</ul>", '"', "<td>", string.whitespace]) for _ in range(40)))


def test_bpe_cache_may_be_emptied_by_a_text_of_many_new_words(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    bpe = byte_bpe.ByteBpe(*byte_bpe.public_vocabulary())
    for text in ("one two three four five six", "one two " + " ".join(f"nineq{chr(97 + k)}z" for k in range(20))):
        assert bpe.encode(text).tolist() == encoding.encode_ordinary(text)


def test_labels_depend_on_the_page_alone():
    net, layouts = html_text.train(), html_text.Layouts(5)
    pages_ = [html_text.blocks(layouts.page()) for _ in range(150)]
    together = net.label(pages_)
    assert all((a == net.label([p])[0]).all() for a, p in zip(together, pages_))


def test_very_long_pages_are_labelled_in_parts(monkeypatch):
    net, layouts = html_text.train(), html_text.Layouts(6)
    pages_ = [html_text.blocks("".join(layouts.page() for _ in range(20)))] + [html_text.blocks(layouts.page()) for _ in range(30)]
    want = net.label(pages_)
    monkeypatch.setattr(html_text, "STEPS", 7)
    monkeypatch.setattr(html_text, "CELLS", 50)
    assert all((a == b).all() for a, b in zip(want, net.label(pages_)))


def test_all_pieces_of_an_attribute_and_inline_ones_are_features():
    many = " ".join(f"name{k} {'abcdefghijkl'[k]}x" for k in range(12))
    assert {"class:lx", "class:name"} <= set(html_text.element("div", f' class="{many}"')[1])
    (text, path, leaf, _), (_, other, _, _) = html_text.blocks('<div><span class="ad box"> all <b>of it</b></span> </div><div>some <span class="ad">of it</span></div>')
    assert (text, leaf) == ("all of it", "div") and "class:ad" in {w for _, found in path for w in found}
    assert "class:ad" not in {w for _, found in other for w in found}
