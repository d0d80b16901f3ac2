"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from the vocabulary.

Each byte is written as one printable character, so every vocabulary entry is a string, and the entries become the pieces
of a BPE model scored by negative rank, with an identity normaliser. Sentencepiece then merges the pair of the lowest rank
first, leftmost on ties, which is what the rank file asks for. Texts are cut into pre-tokens by the vocabulary's pattern
and each distinct pre-token of a worker is encoded once. Decoding maps pieces back to bytes.

A pre-token that is an entry itself takes that entry's rank, also where merging alone would not reach it; the few such
entries are found when the model is built.

Nulls: a null text is an empty one: no ids. Very long texts and runs are one pre-token like any other. Repeated rows give
repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Distinct pre-tokens that a worker remembers; beyond it starts anew.
REMEMBERED = 200_000
_CODECS: dict = {}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """One field of a protocol-buffer message: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: piece i is the entry of rank i; one more piece stands for the unknown, which no text needs."""
    chars = byte_characters()
    pieces = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = [_field(1, _field(1, "".join(chars[b] for b in p).encode()) + _field(2, float(-k)) + _field(3, 1)) for k, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    out.append(_field(2, _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes and decodes texts; built once in each Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.table = dict(enumerate(byte_characters()))
        back = {ord(c): b for b, c in self.table.items()}
        self.bytes_of = [bytes(back[ord(c)] for c in self.model.id_to_piece(k)) for k in range(len(ranks))]
        mapped = ["".join(map(self.table.__getitem__, p)) for p in self.bytes_of]
        self.direct = {p: k for k, (p, ids) in enumerate(zip(mapped, self.model.encode(mapped, num_threads=1), strict=True)) if ids != [k]}
        self.seen: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}

    def _learn(self, words: set[str]) -> None:
        """Encodes what is new. Old entries live on while they are in use: a full memory becomes the second, and is asked first."""
        if len(self.seen) > REMEMBERED:
            self.before, self.seen = self.seen, {}
        fresh = []
        for w in words.difference(self.seen):
            known = self.before.get(w)
            if known:
                self.seen[w] = known
            else:
                fresh.append(w)
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in fresh]
        for w, m, ids in zip(fresh, mapped, self.model.encode(mapped, num_threads=1), strict=True):
            ids = [self.direct[m]] if m in self.direct else ids
            self.seen[w] = (np.array(ids, dtype=np.int32).tobytes(), " ".join(map(str, ids)))  # nothing the garbage collector follows

    def parts(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """For each text the ids of its pre-tokens, as bytes and as decimal text."""
        for s in range(0, len(texts), 32):
            cut = [self.pattern.findall(t) for t in texts[s : s + 32]]
            self._learn(set(chain.from_iterable(cut)))
            for words in cut:
                yield [self.seen[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join([p[0] for p in parts]), dtype=np.int32) for parts in self.parts(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(ranks_path: str, pattern: str) -> Codec:
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Returns doc_id and ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Returns doc_id and bytes; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            out = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return arrow_map(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (decimal ids, one space between), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for parts in own.parts([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.frombuffer(b"".join([p[0] for p in parts]), dtype=np.int32).tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
