"""Byte-level BPE encoding and decoding through a sentencepiece model written from a rank file.

No training: every vocabulary entry becomes a piece whose bytes are mapped to printable characters and
whose score is its negative rank, so the merges happen in rank order. The normaliser is the identity.
Each match of the split pattern is encoded by itself; decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from array import array
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import pick, table
from kindred.llm.jaccard_join import by_size

#: Pre-tokens whose ids a worker keeps; beyond that it starts afresh.
CACHE = 1 << 19


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else more))
        more += b not in own
    return out


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: a varint, a 32-bit float or bytes."""
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_proto(pieces: list[str]) -> bytes:
    """A sentencepiece BPE model whose n-th piece has score -n; the unknown piece comes after them."""
    normal, unknown, bpe = 1, 2, 2
    body = [field(1, field(1, p.encode()) + field(2, -float(n)) + field(3, normal)) for n, p in enumerate(pieces)]
    body.append(field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, unknown)))
    trainer = field(3, bpe) + field(4, len(pieces) + 1) + field(40, len(pieces))
    identity = field(1, b"identity") + field(2, b"") + field(3, 0) + field(4, 0) + field(5, 0)
    return b"".join(body) + field(2, trainer) + field(3, identity)


def ascii_form(pattern: str) -> str:
    """What ``pattern`` means on ASCII texts, for the faster built-in ``re``."""
    plain = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t-\r"}
    token = re.compile(r"\[[^\]]*\]|" + "|".join(map(re.escape, plain)))

    def spelt(m: re.Match) -> str:
        if m[0][0] != "[":
            return f"[{plain[m[0]]}]"
        out = m[0]
        for k, v in plain.items():
            out = out.replace(k, v)
        return out

    return token.sub(spelt, pattern.replace(r"\S", r"[^\s]"))


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        with open(path, "rb") as f:
            ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f))))
        # the same white space as in the tables that other implementations use: U+001C to U+001F are none
        self.split = regex.compile(pattern.replace(r"\S", r"[^\s]").replace(r"\s", r"\p{White_Space}"))
        self.split_ascii = re.compile(ascii_form(pattern))
        self.letters = dict(enumerate(byte_characters()))
        self.ids = [rank for rank, _ in ranks]
        self.whole = {token: rank for rank, token in ranks}
        self.bytes_of = dict(ranks)
        self.names = {rank: str(rank) for rank, _ in ranks}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto([self.mapped(token) for _, token in ranks]))
        self.known: dict[str, tuple[int, ...]] = {}

    def mapped(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.letters)

    def learn(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens not met before. One that is a vocabulary entry is that entry, whether merges lead to it or not."""
        hard, out = [], {}
        for t in tokens:
            rank = self.whole.get(t.encode())
            if rank is None:
                hard.append(t)
            else:
                out[t] = (rank,)
        for t, pieces in zip(hard, self.model.encode([self.mapped(t.encode()) for t in hard], num_threads=1)):
            out[t] = tuple([self.ids[p] for p in pieces])
        return out

    def encode(self, text: str) -> array:
        tokens = (self.split_ascii if text.isascii() else self.split).findall(text)
        try:
            return array("i", chain.from_iterable(map(self.known.__getitem__, tokens)))
        except KeyError:
            # the text's own ids, so that it needs nothing of the cache once that is emptied
            own = {t: self.known.get(t) for t in tokens}
            learnt = self.learn([t for t, ids in own.items() if ids is None])
            own |= learnt
            if len(self.known) > CACHE:
                self.known.clear()
            self.known |= learnt
            return array("i", chain.from_iterable(map(own.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids`` of batches of ``doc_id, text``."""
    bpe = codec(path, pattern)
    for whole in batches:
        for batch in by_size(whole):
            ids, ends = array("i"), [0]
            for text in batch.column("text"):
                ids += bpe.encode(text.as_py() or "")
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])


def lists_of(ids: pa.Array) -> Iterator[list[int]]:
    """Each row's ids as a list; none for null."""
    for x in ids:
        yield x.values.to_numpy().tolist() if x.is_valid else []


def decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids, decoded`` of batches of ``doc_id, ids``."""
    bpe = codec(path, pattern)
    for batch in batches:
        texts = pa.array([bpe.decode(ids) for ids in lists_of(batch.column("ids"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "decoded"])


def digested(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of batches of ``doc_id, ids, decoded``."""
    names = codec(path, pattern).names
    for batch in batches:
        n, ids_sha = [], []
        for ids in lists_of(batch.column("ids")):
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
        text_sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of each row's text; a narrow pass without shuffles.

    A null text is an empty text: no ids. Repeated rows and null ids are rows like others, an empty table
    gives an empty result, extra columns are ignored.
    """
    return pick(docs, "doc_id", "text").mapInArrow(lambda b: encoded(b, path, pattern), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the bytes that the ids stand for; null ids give no bytes."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda b: decoded(b, path, pattern), "doc_id long, ids array<int>, decoded binary")


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encode`` and then ``decode`` give, digested in the same pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return pick(docs, "doc_id", "text").mapInArrow(lambda b: digested(decoded(encoded(b, path, pattern), path, pattern), path, pattern), schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), *public_vocabulary())
