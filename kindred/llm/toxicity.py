"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters as a hashed word vector next to the mean of its hashed character 4-gram vectors. Words end at
white space and punctuation of any script; long ones are read in pieces that overlap, too. Windows of
32 words that overlap by half are scored one by one; a document's score is that of its worst window, so length
doesn't dilute it. Only document labels are known, so training picks the windows of toxic documents that look
worst so far (first by log-odds, then by the network) and learns from those.

A score is a function of the text alone, whatever batch it comes in: scoring keeps weights and states on a
binary grid, on which all sums are exact in double precision, so the order in which a product of matrices adds
up, which depends on the number of rows, can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import pick, table, text_of, trim

WINDOW, STRIDE = 32, 16
HIDDEN, WIDTH = 8, 8
TABLE_BITS = 18
#: A run of over PART bytes without a break is read in pieces of PART bytes that begin every STEP bytes, and
#: before them as a whole if it has at most LONG bytes.
LONG, PART, STEP = 64, 16, 8
WORDS = GRAMS = 1 << TABLE_BITS
#: Texts in which a feature must occur for training to use it.
RARE = 4
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Words of text that are turned into numbers at a time, and windows that go through the network at a time.
PIECE, BATCH = 1 << 15, 1024

#: What ends words besides the ASCII characters that aren't letters or digits.
BREAK = regex.compile(r"(?V1)[[\p{P}\p{White_Space}\u200B\uFEFF]--[\x00-\x7F]]")
IS_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` successive places from each of ``begin``, in its type."""
    out = np.repeat((begin - (np.cumsum(count) - count)).astype(begin.dtype), count)
    out += np.arange(len(out), dtype=begin.dtype)
    return out


class Words:
    """The words of some texts: ``of`` (which distinct word each is), ``text`` (whose word it is), and the distinct words' features.

    ``grams`` has the 4-grams of one distinct word after another, ``count`` how many each has.
    """

    def __init__(self, texts: list[str]):
        raw = [(t if t.isascii() else BREAK.sub(" ", t)).lower().encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        ends_of = np.cumsum([len(r) + 1 for r in raw])
        letter = IS_LETTER[buf]
        # half the space, where that is enough
        kind = np.int32 if len(buf) < 1 << 31 else np.int64
        edge = (np.flatnonzero(letter[1:] != letter[:-1]) + 1).astype(kind)
        del letter
        start, size = edge[0::2].copy(), edge[1::2] - edge[0::2]
        del edge
        whole = size <= LONG
        many = np.where(size > PART, -(-(size - PART) // STEP) + 1, 0).astype(kind) + whole.astype(kind)
        if (many != 1).any():
            run = np.repeat(np.arange(len(start), dtype=kind), many)
            nth = spread(np.zeros(len(many), kind), many) - whole[run]
            skip = np.maximum(nth, 0) * kind(STEP)
            start, size = start[run] + skip, np.where(nth < 0, size[run], np.minimum(kind(PART), size[run] - skip))
            del run, nth, skip
        self.text = np.searchsorted(ends_of, start, side="right").astype(np.int32)
        key = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            k, live = 0, np.arange(len(start))
            while len(live):
                key[live] = key[live] * BASE + buf[start[live] + k] + np.uint64(1)
                k += 1
                live = live[size[live] > k]
            key ^= key >> np.uint64(29)
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            self.of = of.astype(np.int32)
            self.word = (key[first] * BASE >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
            # all letters, framed by 1 and 2, in fours
            n = size[first]
            wide = np.maximum(n + 2, 4)
            frame = np.cumsum(wide) - wide
            framed = np.zeros(wide.sum(), np.uint8)
            framed[frame] = 1
            framed[spread(frame + 1, n)] = buf[spread(start[first], n)]
            framed[frame + n + 1] = 2
            self.count = np.maximum(n - 1, 1)
            at = spread(frame, self.count)
            mixed = sum(framed[at + j].astype(np.uint64) * np.uint64(pow(0x2545F4914F6CDD1D, j + 1, 1 << 64)) for j in range(4))
            self.grams = (((mixed ^ mixed >> np.uint64(31)) * BASE) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)

    def begins(self) -> np.ndarray:
        """Where each distinct word's 4-grams begin."""
        return np.cumsum(self.count) - self.count

    def owners(self) -> np.ndarray:
        """The distinct word that each 4-gram belongs to."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """A row of word numbers (-1: none) for each window, and the text of each."""
        n = np.bincount(self.text, minlength=count)
        begin = np.cumsum(n) - n
        many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(count), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        rows = np.full((len(text), WINDOW), -1, np.int32)
        for low in range(0, len(text) if len(self.of) else 0, 1 << 13):
            some = slice(low, low + (1 << 13))
            at = nth[some, None] * STRIDE + np.arange(WINDOW)
            inside = at < n[text[some]][:, None]
            rows[some] = np.where(inside, self.of[np.where(inside, begin[text[some]][:, None] + at, 0)], -1)
        return rows, text


def texts_by_words(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of about PIECE words (by their length)."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) // (6 if t.isascii() else 2)
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: Steps of the grids of weights and states, and of attention, in powers of two.
GRID, FINE = 4096.0, float(1 << 20)


def to_grid(x: np.ndarray, steps: float = GRID) -> np.ndarray:
    """The nearest multiples of 1 / ``steps``. Products and sums of such numbers that stay small are exact doubles."""
    return np.rint(x * steps) * (1 / steps)


class Network:
    """Two GRUs over word vectors, attention over their states, and a logistic output."""

    #: Whether all weights are on the grid.
    exact = False

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        mat = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        # what training hasn't met says nothing
        self.p = {"word": np.zeros((WORDS, WIDTH), np.float32), "gram": np.zeros((GRAMS, WIDTH), np.float32), "v": mat(2 * HIDDEN), "out": mat(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": mat(2 * WIDTH, 3 * HIDDEN), f"u{d}": mat(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["vs"] = np.ones(1, np.float32)

    def inputs(self, words: Words) -> np.ndarray:
        total = np.zeros((len(words.word), WIDTH), np.float32)
        begin, j, rows = words.begins(), 0, np.arange(len(words.word))
        while len(rows):
            total[rows] += self.p["gram"][words.grams[begin[rows] + j]]
            j += 1
            rows = rows[words.count[rows] > j]
        return np.concatenate([self.p["word"][words.word], total / words.count[:, None].astype(np.float32)], 1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates; a last row of zeros stands for no word."""
        return {d: np.concatenate([x @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), x.dtype)]) for d in "fb"}

    def on_grid(self) -> "Network":
        """A copy for scoring, in double precision, with all weights on the grid; the tables stay single, which holds their grid."""
        net = object.__new__(Network)
        net.exact = True
        net.p = {k: to_grid(x).astype(np.float32 if k in ("word", "gram") else np.float64) for k, x in self.p.items()}
        return net

    def run(self, d: str, gates: np.ndarray, rows: np.ndarray, mask: np.ndarray, keep: list | None = None, exact: bool = False) -> np.ndarray:
        u, kind, snap = self.p[f"u{d}"], gates.dtype, to_grid if exact else lambda x: x
        h, out = np.zeros((len(rows), HIDDEN), kind), np.empty((len(rows), WINDOW, HIDDEN), kind)
        for t in range(WINDOW) if d == "f" else reversed(range(WINDOW)):
            x = gates[rows[:, t]]
            zr = sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + snap(r * h) @ u[:, 2 * HIDDEN :])
            new = snap(h + z * (c - h)) * mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = new
            out[:, t] = h
        return out

    def forward(self, gates: dict, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        mask = (rows >= 0).astype(np.float32)
        states = np.concatenate([self.run(d, gates[d], rows, mask, None if keep is None else keep.setdefault(d, [])) for d in "fb"], 2)
        a = np.exp(np.clip(states @ self.p["v"] * self.p["vs"], -30, 30)) * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", a, states)
        if keep is not None:
            keep |= {"mask": mask, "states": states, "a": a, "pooled": pooled}
        return sigmoid(pooled @ self.p["out"] + self.p["bias"])

    def exactly(self, gates: dict, rows: np.ndarray) -> np.ndarray:
        """``forward`` on the grid: each window's score, in millionths, doesn't depend on the other windows."""
        here = rows >= 0
        states = np.concatenate([self.run(d, gates[d], rows, here.astype(np.float64), exact=True) for d in "fb"], 2)
        e = np.where(here, states @ self.p["v"] * self.p["vs"], -1e9)
        a = to_grid(np.exp(e - e.max(1, keepdims=True)), FINE) * here
        pooled = np.einsum("nt,nth->nh", a, states) / np.maximum(a.sum(1, keepdims=True), 1.0)
        return np.round(sigmoid(to_grid(pooled, FINE) @ self.p["out"] + self.p["bias"]), 6)

    def score(self, texts: list[str]) -> np.ndarray:
        """The worst window's score of each text."""
        net, out = self if self.exact else self.on_grid(), []
        for run in texts_by_words(texts):
            words = Words(run)
            rows, text = words.windows(len(run))
            gates, got = net.projected(to_grid(net.inputs(words).astype(np.float64))), np.empty(len(rows))
            for k in range(0, len(rows), BATCH):
                got[k : k + BATCH] = net.exactly(gates, rows[k : k + BATCH])
            out.append(np.maximum.reduceat(got, np.searchsorted(text, np.arange(len(run)))))
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, words: Words, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        used, local = np.unique(rows, return_inverse=True)
        local = local.reshape(rows.shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        sub = words_at(words, used)
        x = self.inputs(sub)
        keep: dict = {}
        p = self.forward(self.projected(x), local, keep)
        g = {}
        dlogit = ((p - y) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = keep["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dpool = dlogit[:, None] * self.p["out"]
        a, s = keep["a"], keep["states"]
        da = np.einsum("nh,nth->nt", dpool, s)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["v"], g["vs"] = np.einsum("nt,nth->h", de, s) * self.p["vs"], np.array([(de * (s @ self.p["v"])).sum()], np.float32)
        dstates = a[:, :, None] * dpool[:, None] + de[:, :, None] * (self.p["v"] * self.p["vs"])
        dx = np.zeros_like(x)
        # all places of a word next to each other, to add up what they hand down
        order = np.argsort(local, axis=None, kind="stable")
        placed = local.ravel()[order]
        first = np.searchsorted(placed, np.arange(len(x)))
        for k, d in enumerate("fb"):
            u, ds = self.p[f"u{d}"], dstates[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            gu, steps = np.zeros_like(u), np.empty((*rows.shape, 3 * HIDDEN), x.dtype)
            dh = np.zeros((len(rows), HIDDEN), np.float32)
            for t, h, z, r, c in reversed(keep[d]):
                dn = (dh + ds[:, t]) * keep["mask"][:, t, None]
                dc = dn * z * (1 - c * c)
                dz = dn * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                gu[:, : 2 * HIDDEN] += h.T @ dzr
                gu[:, 2 * HIDDEN :] += (r * h).T @ dc
                dh = dn * (1 - z) + drh * r + dzr @ u[:, : 2 * HIDDEN].T
                steps[:, t, : 2 * HIDDEN], steps[:, t, 2 * HIDDEN :] = dzr, dc
            dg = np.add.reduceat(steps.reshape(-1, 3 * HIDDEN)[order], first, 0) if len(x) else np.zeros((0, 3 * HIDDEN), x.dtype)
            g |= {f"u{d}": gu, f"w{d}": x.T @ dg, f"c{d}": dg.sum(0)}
            dx += dg @ self.p[f"w{d}"].T
        g["word"] = (sub.word, dx[:, :WIDTH])
        at = sub.owners()
        g["gram"] = (sub.grams, dx[at, WIDTH:] / sub.count[at][:, None])
        eps = 1e-7
        return g, float(-(weight * (y * np.log(p + eps) + (1 - y) * np.log(1 - p + eps))).sum() / weight.sum())


def words_at(words: Words, at: np.ndarray) -> Words:
    sub = object.__new__(Words)
    sub.word, sub.count = words.word[at], words.count[at]
    sub.grams = words.grams[spread(words.begins()[at], sub.count)]
    return sub


class Adam:
    def __init__(self, params: dict, rate: float):
        self.p, self.rate, self.n = params, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in params.items()}
        self.s = {k: np.zeros_like(x) for k, x in params.items()}

    def step(self, grads: dict) -> None:
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in grads.items():
            at: object = slice(None)
            if isinstance(g, tuple):  # rows of a table
                at, inverse = np.unique(g[0], return_inverse=True)
                g = np.stack([np.bincount(inverse, g[1][:, j], len(at)) for j in range(g[1].shape[1])], 1).astype(np.float32)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.s[k][at] = 0.999 * self.s[k][at] + 0.001 * g * g
            self.p[k][at] -= (self.rate * fix * self.m[k][at] / (np.sqrt(self.s[k][at]) + 1e-8)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, seed: int = 1, epochs: int = 6, batch: int = 512, negatives: int = 24_000, worst: int = 3) -> Network:
    """Learns from whole texts with labels 0 and 1: in each epoch from the ``worst`` windows of each toxic text that look
    worst so far and from at most ``negatives`` windows of clean texts, a third of them the worst. Without both labels the network scores as it began: near its bias."""
    net, r = Network(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, bool)
    if not labels.any() or labels.all():
        net.p["out"][:] = 0
        net.p["bias"][:] = 4.0 if len(labels) and labels.all() else -4.0
        return net
    words = Words(texts)
    rows, text = words.windows(len(texts))
    positive = labels[text]
    # log-odds of the features over words of texts, to find the telling windows of toxic texts at first
    pair = np.unique(words.text.astype(np.int64) * len(words.word) + words.of)
    toxic, pair = labels[pair // len(words.word)], pair % len(words.word)
    tally = [np.bincount(pair[toxic == y], minlength=len(words.word)) for y in (False, True)]
    owner = words.owners()

    def odds(feature: np.ndarray, of: np.ndarray | slice, size: int) -> np.ndarray:
        clean, bad = (np.bincount(feature, t[of], minlength=size) for t in tally)
        return np.log((bad + 0.1) / (labels.sum() + 1)) - np.log((clean + 1.0) / ((~labels).sum() + 1))

    # a feature of few texts would only be learnt by heart
    both = tally[0] + tally[1]
    common = {"word": np.bincount(words.word, both, minlength=WORDS) >= RARE, "gram": np.bincount(words.grams, both[owner], minlength=GRAMS) >= RARE}
    by_word = odds(words.word, slice(None), WORDS)[words.word]
    of_gram = odds(words.grams, owner, GRAMS)
    by_gram = np.maximum(np.maximum.reduceat(of_gram[words.grams], words.begins()), -9.0) if len(owner) else np.zeros(0)
    of_word = np.append(np.maximum(by_word, by_gram), -9.0)
    suspect = np.concatenate([of_word[rows[k : k + BATCH]].max(1) for k in range(0, len(rows), BATCH)])
    opt = Adam(net.p, 0.01)
    neg_at = np.flatnonzero(~positive)
    for epoch in range(epochs):
        if epoch:
            look = np.flatnonzero(positive) if epoch < 3 else np.arange(len(rows))
            for k in range(0, len(look), 4 * BATCH):
                part = look[k : k + 4 * BATCH]
                # only the words of these windows, so that memory doesn't grow with the corpus's vocabulary
                used, local = np.unique(rows[part], return_inverse=True)
                local = local.reshape(-1, WINDOW) - int(used[0] < 0)
                gates = net.projected(net.inputs(words_at(words, used[used >= 0])))
                suspect[part] = np.concatenate([net.forward(gates, local[j : j + BATCH]) for j in range(0, len(part), BATCH)])
        order = np.lexsort((-suspect, text))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows)) - np.searchsorted(text, text[order])
        pos = np.flatnonzero(positive & (rank < worst))
        # the worst windows of clean texts, and others at random
        hard = neg_at[np.argsort(-suspect[neg_at], kind="stable")[: negatives // 3]]
        neg = np.unique(np.concatenate([hard, r.choice(neg_at, min(len(neg_at), negatives - len(hard)), replace=False)]))
        both = r.permutation(np.concatenate([pos, neg]))
        share = np.where(positive[both], 2.0, 1.0)
        # small corpora need small steps to have enough of them
        size = max(16, min(batch, len(both) // 40))
        for k in range(0, len(both), size):
            b = both[k : k + size]
            opt.rate = 0.01 * (0.5 if epoch >= epochs - 2 else 1.0)
            grads, _ = net.gradients(words, rows[b], positive[b].astype(np.float32), share[k : k + size].astype(np.float32))
            for name, keep in common.items():
                at, g = grads[name]
                grads[name] = at[keep[at]], g[keep[at]]
            opt.step(grads)
    return net


def sample_of(docs: DataFrame, labels: DataFrame, limit: int, most_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``limit`` labelled texts (``doc_id, text``) that aren't held out, and all labels of such a number of ids.

    They are taken in the order of a hash of doc_id, as long as they have at most ``most_bytes`` together. Of rows
    that share a doc_id the text with the least digest counts, so that the sample is the same each time.
    """
    known = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = {r.doc_id: r.toxic for r in known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()}
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isin(list(chosen)))
    sized = {r.doc_id: r.least for r in rows.groupBy("doc_id").agg(F.min(F.struct(F.sha2(text_of(), 256).alias("sha"), F.octet_length(text_of()).alias("size"))).alias("least")).collect()}
    taken, total = set(), 0
    for i in (i for i in chosen if i in sized):
        total += sized[i].size
        if taken and total > most_bytes:
            break
        taken.add(i)
    named = F.concat_ws(" ", "doc_id", F.sha2(text_of(), 256))
    return rows.where(named.isin([f"{i} {sized[i].sha}" for i in sorted(taken)])).dropDuplicates(["doc_id"]), chosen


def learnt(docs: DataFrame, labels: DataFrame, limit: int, most_bytes: int, **bounds: int) -> Packed:
    """What ``train`` learns from the sample, in one task, so that the driver only gets the weights."""
    rows, toxic = sample_of(docs, labels, limit, most_bytes)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((i, t or "") for b in batches for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        net = train([t for _, t in known], np.array([toxic[i] for i, _ in known], int), **bounds)
        trim()
        for name, (shape, at, rows) in packed(net.p).items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(shape)], pa.list_(pa.int64())), pa.array([at.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["name", "shape", "at", "rows"])

    got = rows.coalesce(1).mapInArrow(fit, "name string, shape array<long>, at binary, rows binary").collect()
    if not got:
        return packed(train([], np.zeros(0, int)).p)
    return {r.name: (tuple(r["shape"]), np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r.rows), np.float32).reshape(-1, *r["shape"][1:])) for r in got}


Packed = dict[str, tuple[tuple[int, ...], np.ndarray, np.ndarray]]


def packed(params: dict[str, np.ndarray]) -> Packed:
    """Shape, numbers of the rows that aren't zero, and those rows: training touches few rows of the tables."""
    out = {}
    for name, x in params.items():
        at = np.flatnonzero(x.reshape(len(x), -1).any(1)).astype(np.int32)
        out[name] = (x.shape, at, x[at])
    return out


def unpacked(params: Packed) -> Network:
    net = object.__new__(Network)
    net.p = {}
    for name, (shape, at, rows) in params.items():
        net.p[name] = np.zeros(shape, np.float32)
        net.p[name][at] = rows
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, training_rows: int = 4000, training_bytes: int = 16 << 20, negatives: int = 24_000, worst: int = 3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each input row.

    Bounds hold for training alone: it is on at most ``training_rows`` labelled texts of ``training_bytes`` together
    (the last ones by a hash of doc_id are left out; a single text may be longer), and an epoch takes at most ``negatives`` windows of the clean ones and the ``worst`` windows of each toxic one that look worst so far.
    Scoring reads every window of every text in a narrow pass. Null and empty texts get the score of a window without words. A null doc_id isn't held out.
    Repeated rows are scored alike. An empty table gives an empty result; without labels of both kinds the
    scores are constant. Extra columns are ignored.
    """
    params = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, training_rows, training_bytes, negatives=negatives, worst=worst))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unpacked(params.value).on_grid()
        for b in batches:
            score = net.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        trim()

    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, training_rows: int = 4000, training_bytes: int = 16 << 20, negatives: int = 24_000, worst: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; a narrow pass. Training is bounded as in ``toxicity``."""
    params = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, training_rows, training_bytes, negatives=negatives, worst=worst))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unpacked(params.value).on_grid()
        for b in batches:
            yield b.filter(pa.array(net.score([t or "" for t in b.column("text").to_pylist()]) < threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
