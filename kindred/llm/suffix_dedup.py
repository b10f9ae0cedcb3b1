"""Removal of repeated byte strings by a distributed, sparse suffix array.

Every byte covered by a string of ``length`` bytes that also starts elsewhere goes. Sorting the suffixes of all
positions would move each text hundreds of times, so positions are thinned out without losing any:

* Each window of ``length`` bytes has an anchor, the position inside it whose ``gram`` bytes hash lowest. Equal
  windows have equal anchors, so only suffixes that begin with equal grams at their anchors can repeat.
  Neighbouring windows with one anchor form a stretch.
* Stretches are range-partitioned by the leading bytes of their anchored suffixes, with splitters from a sample,
  and sorted in each bucket by two hashes of 64 bits, of different kinds: of the gram and of the whole stretch. A
  gram that is alone ends there. Stretches that agree in both are repeated as a whole; inside a batch their
  bytes are compared, too. What is left are the edges of repeats: stretches that share a gram but not the whole string.
* The suffixes at all windows of these edges are range-partitioned in the same way, sorted in each bucket by
  multikey quicksort over 8-byte words, and neighbours that agree in ``length`` bytes are repeats.

Splitters cut between distinct leading strings. A string that is several splitters at once, being so frequent,
has as many buckets, among which its suffixes are dealt by what equal windows have in common. So equal windows always
meet in one bucket and the comparison across a bucket's boundary has nothing left to find. What would be large
there is made small before: equal stretches or windows of one batch travel as one, and the windows of a gram that
very many edges share are dealt by themselves instead of by the gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import blocks_for, pick, spool, table, text_of
from kindred.llm.jaccard_join import by_size, mix
from kindred.llm.toxicity import spread

LENGTH, GRAM, LEAD = 200, 100, 16
SLICE, BATCH, BUCKET = 1 << 20, 16 << 20, 16 << 20
SAMPLE_DOCS, SAMPLE_LEADS = 2000, 50_000
#: Edges that share a gram, beyond which their windows are dealt by themselves.
CROWD = 4096
COVERED, EDGE, WITNESS, CROWDED = 0, 1, 2, 4
BASE = np.uint64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


class Stretches:
    """The stretches of some texts laid end to end: first window ``start``, number of windows ``count``, anchor, hashes of gram and whole."""

    def __init__(self, raw: list[bytes], length: int, gram: int):
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        span, n = length - gram + 1, len(self.buf)
        windows = n - length + 1
        if windows <= 0:
            self.start = self.count = self.anchor = self.doc = np.zeros(0, np.int64)
            self.gram = self.whole = np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            power = np.full(n + 1, BASE, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(TABLE[self.buf] * power[:n], out=prefix[1:])
            del power
            inverse = np.full(n + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
            inverse[0] = 1
            inverse = np.cumprod(inverse, dtype=np.uint64)
            hashes = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
        # least hash of each span by blocks of that length: the least to the left and to the right of each block's end.
        # Low bits are the place in the block, so of equal hashes the first is least, and so is the block that comes first
        bits = np.uint64(span.bit_length())
        low = (np.uint64(1) << bits) - np.uint64(1)
        place = np.arange(len(hashes), dtype=np.uint64) % np.uint64(span)
        key = hashes & ~low | place
        key = np.concatenate([key, np.full(-len(key) % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
        left = np.minimum.accumulate(key, 1).ravel()[span - 1 : span - 1 + windows]
        right = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()[:windows]
        at = np.arange(windows)
        first = right >> bits <= left >> bits
        anchor = (np.where(first, right, left) & low).astype(np.int64) + np.where(first, at, at + span - 1) // span * span
        del key, left, right, first, place
        doc = np.searchsorted(self.ends, at, side="right")
        inside = at + length <= self.ends[doc]
        at, anchor, doc = at[inside], anchor[inside], doc[inside]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.start, self.anchor, self.doc = at[first], anchor[first], doc[first]
        self.count = np.diff(np.append(first, len(at)))
        self.gram = hashes[self.anchor]
        with np.errstate(over="ignore"):
            text, end = self.buf.tobytes(), (self.start + self.count - 1 + length).tolist()
            self.whole = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(self.start.tolist(), end)), np.uint64, len(end))

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The LEAD bytes at each place, as byte strings."""
        padded = np.concatenate([self.buf, np.zeros(LEAD, np.uint8)])
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LEAD)[at]).view(f"S{LEAD}").ravel()


def bucket_of(splitters: np.ndarray, lead: np.ndarray, what: np.ndarray) -> np.ndarray:
    """The bucket of each lead; leads that are several splitters at once are dealt by ``what`` among as many buckets."""
    low, high = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
    return np.where(high - low > 1, low + 1 + (what % np.maximum(1, high - low).astype(np.uint64)).astype(np.int64), high)


def pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


BLOB = (np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint8, np.uint32, np.uint32, np.uint32)


def repeats(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts pairs; their order, and where runs of equal ``first`` and of equal pairs begin in it."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    one = np.ones(len(a), bool)
    one[1:] = a[1:] != a[:-1]
    two = one.copy()
    two[1:] |= b[1:] != b[:-1]
    return order, one, two


def joined(start: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring stretches of a document as one."""
    if not len(start):
        return start, count, doc
    order = np.lexsort((start, doc))
    s, c, d = start[order], count[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + c[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], s[last] + c[last] - s[first], d[first]


def pieces(texts: list[str], length: int, most: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """The texts in bytes, those of over ``most`` windows in pieces that overlap by a window less a byte; which text each piece is of, and from where on."""
    raw, owner, skip, size = [], [], [], 0
    for k, t in enumerate(texts):
        whole = t.encode("utf-8", "replace")
        for at in range(0, max(1, len(whole) - length + 1), most):
            if size >= most:
                yield raw, np.array(owner), np.array(skip)
                raw, owner, skip, size = [], [], [], 0
            raw.append(whole[at : at + most + length - 1])
            owner.append(k)
            skip.append(at)
            size += len(raw[-1])
    if raw:
        yield raw, np.array(owner), np.array(skip)


def check(text: np.ndarray, place: np.ndarray, count: np.ndarray, order: np.ndarray, first: np.ndarray, length: int) -> None:
    """Compares the bytes of each stretch with those of the first that has the same hashes."""
    a, b = order, order[first]
    other = np.flatnonzero(a != b)
    a, b = a[other], b[other]
    size = count[a] + length - 1
    if (size != count[b] + length - 1).any():
        raise ValueError("two stretches of different lengths have the same hashes")
    for low in range(0, len(a), 4096):
        some = slice(low, low + 4096)
        if (text[spread(place[a[some]], size[some])] != text[spread(place[b[some]], size[some])]).any():
            raise ValueError("two stretches have the same hashes")


def find_anchors(docs: DataFrame, splitters: np.ndarray, length: int, gram: int) -> DataFrame:
    """``bucket, blob``: the stretches of all texts, dealt by the leading bytes at their anchors."""

    def dealt(parts: list[tuple], turn: int) -> pa.RecordBatch:
        ids, marks, gram, whole, start, anchor, count, lead = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 3, 5, 6, 7, 8))
        text, before = np.concatenate([p[9] for p in parts]), np.cumsum([0, *(len(p[9]) for p in parts)])
        place = np.concatenate([p[10] + n for p, n in zip(parts, before)])
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        doc = np.concatenate([p[4] + n for p, n in zip(parts, base)])
        order, _, new = repeats(gram, whole)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        keep = order[first]  # one of each; the others, and itself, are covered if there are others
        many = np.zeros(len(order), bool)
        many[order] = np.repeat(times > 1, times)
        check(text, place, count, order, np.repeat(first, times), length)
        done = joined(start[many], count[many], doc[many])
        bucket = bucket_of(splitters, lead[keep], gram[keep])
        sorted_ = np.argsort(bucket, kind="stable")
        own = turn % (len(splitters) + 1)  # the bucket that carries what is known already
        names, blobs = [], []
        there, cuts = np.unique(bucket[sorted_], return_index=True)
        cuts = dict(zip(there.tolist(), zip(cuts.tolist(), [*cuts.tolist()[1:], len(sorted_)])))
        for k in {**cuts, **({own: None} if len(done[0]) else {})}:
            low, high = cuts.get(k, (0, 0))
            p = keep[sorted_[low:high]]
            extra = done if k == own else tuple(y[:0] for y in done)
            used, local = np.unique(np.concatenate([doc[p], extra[2]]), return_inverse=True)
            names.append(k)
            blobs.append(pack(ids[used], marks[used], gram[p], whole[p], local[: len(p)].astype(np.uint32), start[p].astype(np.uint32), anchor[p].astype(np.uint32), count[p].astype(np.uint16), many[p].astype(np.uint8), *(y.astype(np.uint32) for y in (extra[0], extra[1], local[len(p) :]))))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, turn = [], 0, 0
        for batch in batches:
            for b in by_size(batch, "t", SLICE):
                ids, marks = b.column("id").to_numpy(), b.column("mark").to_numpy()
                for raw, owner, skip in pieces(b.column("t").to_pylist(), length, SLICE):
                    x = Stretches(raw, length, gram)
                    off = skip[x.doc] - x.begins[x.doc]
                    parts.append((ids, marks, x.gram, x.whole, owner[x.doc], x.start + off, x.anchor + off, x.count, x.leads(x.anchor), x.buf, x.start))
                    size += len(x.buf)
                    if size >= BATCH:
                        yield dealt(parts, turn)
                        parts, size, turn = [], 0, turn + 1
        if parts:
            yield dealt(parts, turn)

    return docs.mapInArrow(run, "bucket int, blob binary")


FOUND = "id long, mark long, start long, count long, anchor long, kind int"


def sort_stretches(rows: pa.Table, crowd: int) -> pa.Table:
    """Finds in a bucket the stretches that are repeated as a whole and the edges."""
    parts, base = [unpack(b.as_py(), *BLOB) for b in rows.column("blob")], 0
    local, extra_doc = [], []
    for p in parts:
        local.append(p[4].astype(np.int64) + base)
        extra_doc.append(p[11].astype(np.int64) + base)
        base += len(p[0])
    ids, marks, gram, whole = (np.concatenate([p[k] for p in parts]) for k in range(4))
    doc, extra_doc = np.concatenate(local), np.concatenate(extra_doc)
    start, anchor, count, known = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (5, 6, 7, 8))
    extra_start, extra_count = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (9, 10))
    order, one, two = repeats(gram, whole)
    group, pair = np.cumsum(one) - 1, np.cumsum(two) - 1
    known = known[order] > 0
    times = np.bincount(pair, minlength=1)[pair]
    shared = np.bincount(pair, known, minlength=1)[pair] > 0
    covered = (times > 1) | shared
    edge = ~covered & (np.bincount(group, minlength=1)[group] > 1)
    # one of each covered string stands for it where an edge shares its gram
    edges = np.bincount(group, edge, minlength=1)
    witness = covered & two & (edges[group] > 0)
    crowded = np.bincount(group, edge | witness, minlength=1)[group] > crowd
    kind = np.where(edge, EDGE, COVERED) + WITNESS * witness + CROWDED * (crowded & (edge | witness))
    own = covered & ~known | edge | witness
    pick_ = order[own]
    out_doc = np.concatenate([doc[pick_], extra_doc])
    zero = np.zeros(len(extra_doc), np.int64)
    return pa.table(
        {
            "id": ids[out_doc],
            "mark": marks[out_doc],
            "start": np.concatenate([start[pick_], extra_start]),
            "count": np.concatenate([count[pick_], extra_count]),
            "anchor": np.concatenate([anchor[pick_], zero]),
            "kind": np.concatenate([kind[own], zero]).astype(np.int32),
        }
    )


def cut_edges(rows: DataFrame, splitters: np.ndarray, length: int, gram: int) -> DataFrame:
    """``bucket, segment, id, mark, start, known``: the strings of edges and witnesses, or the single windows of crowded ones."""

    def dealt(out: list[tuple], crowded: dict[bytes, list]) -> pa.RecordBatch:
        for window, where in crowded.items():
            # one stands for all of this batch; the others are known repeats and follow without their string
            out.append((window[:LEAD], xxhash.xxh3_64_intdigest(window), window, *where[0], len(where) > 1))
            out += [(b"", 0, b"", *w, True) for w in where[1:]]
        cols = list(zip(*out)) or [()] * 7
        bucket = bucket_of(splitters, np.array(cols[0], f"S{LEAD}"), np.array(cols[1], np.uint64)).astype(np.int32)
        # what needs no neighbours is spread evenly
        bare = np.array([not x for x in cols[2]], bool)
        bucket[bare] = np.arange(int(bare.sum())) % (len(splitters) + 1)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(cols[2], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[3:6]), pa.array(cols[6], pa.bool_())], ["bucket", "segment", "id", "mark", "start", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        out, crowded, held = [], {}, 0
        for b in (x for whole in batches for x in by_size(whole, "z", SLICE)):
            for id_, mark, z, found in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "z", "found"))):
                text = unzip(z)
                for f in found:
                    s, n, a = f["start"], f["count"], f["anchor"]
                    if f["kind"] & CROWDED:
                        for w in range(s, s + n):
                            window = text[w : w + length]
                            where = crowded.setdefault(window, [])
                            held += 100 + (0 if where else 2 * length)
                            where.append((id_, mark, w))
                    else:
                        out.append((text[a : a + LEAD], xxhash.xxh3_64_intdigest(text[a : a + gram]), text[s : s + n - 1 + length], id_, mark, s, False))
                        held += n + 2 * length
                    if held > BATCH:
                        yield dealt(out, crowded)
                        out, crowded, held = [], {}, 0
        yield dealt(out, crowded)

    return rows.mapInArrow(run, "bucket int, segment binary, id long, mark long, start long, known boolean")


def multikey_quicksort(words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes at ``at`` by ``depth`` words; the order, and which run of equal suffixes each is in.

    ``words[p]`` is the word at byte p. Each part is split in three by a pivot of its words at its depth: less and
    greater ones are split again at that depth, equal ones at the next word. All parts take their step at once.
    """
    order, begins = np.arange(len(at)), np.zeros(len(at) + 1, bool)
    begins[0] = True
    low, high, level = np.array([0]), np.array([len(at)]), np.array([0])
    while True:
        open_ = (high - low > 1) & (level < depth)
        low, high, level = low[open_], high[open_], level[open_]
        if not len(low):
            return order, np.cumsum(begins[:-1]) - 1
        size = high - low
        first = np.cumsum(size) - size
        here, part = spread(low, size), np.repeat(np.arange(len(low)), size)
        was = order[here]
        key = words[at[was] + 8 * level[part]]
        three = np.sort(np.stack([key[first], key[first + size // 2], key[first + size - 1]]), 0)
        pivot = three[1][part]
        side = [key < pivot, key == pivot, key > pivot]
        count = [np.add.reduceat(x, first, dtype=np.int64) for x in side]
        begin = [low, low + count[0], low + count[0] + count[1]]
        for x, c, b in zip(side, count, begin):
            order[spread(b, c)] = was[x]
        for b, e in zip(begin[1:], (high, high)):
            begins[b[b < e]] = True
        low, high, level = np.concatenate(begin), np.concatenate([begin[1], begin[2], high]), np.concatenate([level, level + 1, level])


def sort_suffixes(length: int):
    def solve(rows: pa.Table) -> pa.Table:
        segments = [s.as_py() for s in rows.column("segment")]
        ids, marks, start, known = (rows.column(c).to_numpy() for c in ("id", "mark", "start", "known"))
        size = np.array([len(s) for s in segments])
        buf = np.frombuffer(b"".join(segments) + b"\0" * 8, np.uint8)
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)).view(">u8").ravel().astype(np.uint64)
        count = np.maximum(0, size - length + 1)
        owner = np.repeat(np.arange(len(segments)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(size) - size)[owner] + nth
        order, run = multikey_quicksort(words, at, length // 8)
        if length % 8:  # the last bytes, as a word that overlaps the one before
            last = words[at[order] + length - 8]
            inner = np.lexsort((last, run))
            order, last = order[inner], last[inner]
            run = np.cumsum(np.concatenate([[False], (run[1:] != run[:-1]) | (last[1:] != last[:-1])])) if len(run) else run
        sure = np.bincount(run, known[owner[order]], minlength=1) > 0
        hit = order[(np.bincount(run, minlength=1)[run] > 1) | sure[run]] if len(run) else order
        alone = np.flatnonzero(size == 0)  # known repeats that came without their string
        o, s = np.concatenate([owner[hit], alone]), np.concatenate([start[owner[hit]] + nth[hit], start[alone]])
        s, c, o = joined(s, np.ones(len(s), np.int64), o)
        return pa.table({"id": ids[o], "mark": marks[o], "start": s.astype(np.int64), "count": c.astype(np.int64)})

    return solve


def cover(rows: DataFrame, length: int) -> DataFrame:
    """Cuts the covered bytes out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            sizes, kept, spans = [], [], []
            for z, start, count in zip(b.column("z"), b.column("starts"), b.column("counts")):
                text = unzip(z.as_py())
                rest, runs = text, []
                if start.is_valid and len(start.values):
                    s, c = start.values.to_numpy(), count.values.to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate((s + c - 1 + length)[order])
                    first = np.flatnonzero(np.concatenate([[True], s[1:] > reach[:-1]]))
                    begin, end = s[first].tolist(), reach[np.append(first[1:], len(s)) - 1].tolist()
                    runs = [{"start": x, "bytes": y - x} for x, y in zip(begin, end)]
                    rest = b"".join(text[x:y] for x, y in zip([0, *end], [*begin, len(text)]))
                sizes.append(len(text))
                kept.append(rest)
                spans.append(runs)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,bytes:long>>")


def zipped(docs: DataFrame) -> DataFrame:
    """Texts travel zipped: they take a third of the space, in a shuffle too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(3).compress
        for b in batches:
            z = [zip_(t.encode("utf-8", "replace")) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("id"), b.column("mark"), pa.array(z, pa.binary())], ["doc_id", "id", "mark", "z"])

    return docs.mapInArrow(run, "doc_id long, id long, mark long, z binary")


def sample_leads(docs: DataFrame, rows: int, size: int, length: int, gram: int) -> np.ndarray:
    """The leading bytes at about SAMPLE_LEADS anchors of about SAMPLE_DOCS texts, sorted; each anchor has the same chance.

    ``size`` is the bytes of all ``rows`` texts. Least-hashed grams of windows lie half a window apart on average.
    """
    docs_share = min(1.0, SAMPLE_DOCS / max(1, rows))
    share = min(1.0, SAMPLE_LEADS * (length - gram + 2) / 2 / max(1.0, size * docs_share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(3)
        for batch in batches:
            for b in by_size(batch, "t", SLICE):
                for raw, _, _ in pieces(b.column("t").to_pylist(), length, SLICE):
                    x = Stretches(raw, length, gram)
                    lead = x.leads(x.anchor[r.random(len(x.anchor)) < share])
                    yield pa.RecordBatch.from_arrays([pa.array(lead.tolist(), pa.binary())], ["lead"])

    got = docs.sample(docs_share, seed=3).mapInArrow(run, "lead binary").collect()
    return np.sort(np.array([r.lead for r in got], f"S{LEAD}"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` for each input row: the bytes that stay, and the runs that go.

    A null text is an empty text; texts shorter than ``length`` bytes lose nothing. Repeated rows are documents of
    their own and so cover each other. Rows with null ids are handled like others. An empty table gives an empty
    result. Extra columns are ignored. ``gram`` only sets how many anchors there are and
    ``crowd`` which of them are dealt by window, not the result.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("mark"), text_of().alias("t"))
    many, total = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first()
    buckets = blocks_for(total or 0, BUCKET)
    leads = sample_leads(rows, many, total or 0, length, gram)
    splitters = leads[[k * len(leads) // buckets for k in range(1, buckets)]] if len(leads) else np.zeros(0, f"S{LEAD}")
    found = spool(find_anchors(rows, splitters, length, gram).groupBy("bucket").applyInArrow(lambda rows: sort_stretches(rows, crowd), FOUND), "stretches")
    text = zipped(rows)
    marked = found.where("kind > 0").groupBy("id", "mark").agg(F.collect_list(F.struct("start", "count", "anchor", "kind")).alias("found"))
    edges = cut_edges(text.join(marked, ["id", "mark"]).select("id", "mark", "z", "found"), splitters, length, gram)
    late = edges.groupBy("bucket").applyInArrow(sort_suffixes(length), "id long, mark long, start long, count long")
    covered = found.where(f"kind % {CROWDED} <> {EDGE}").select("id", "mark", "start", "count").unionByName(late)
    spans = covered.groupBy("id", "mark").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    return cover(text.join(spans, ["id", "mark"], "left").select("doc_id", "z", "starts", "counts"), length)


def digests(cleaned: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["bytes"])
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(table(spark, sf_dir, "documents")))
