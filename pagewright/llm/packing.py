"""Best-fit packing of tokenised documents into sequences of fixed length.

Lengths are integers from 1 to ``capacity``, so both sorted sides of the matching, pieces by length and open sequences by
gap, are at most ``capacity`` runs of equal values however many rows there are. A bulk-synchronous superstep takes the
longest unplaced run, sweeps its successors (the smallest gaps that hold it) and gives the k-th piece of the run, by rank,
the k-th sequence of the gap run: equal wishes are thus settled by rank. Gaps shrink and the next superstep follows.
Ranks come from one distributed range sort of lengths and ids of rows; the token ids move once, when they meet their
places, in as few bytes as they need. Only the run lengths (at most ``capacity`` numbers) reach the driver.

Nulls: a null text is an empty one. An empty text is the end token alone. Ties (equal lengths) go by document and piece.
Rows that repeat a document id are packed as documents of their own, in any order among equal lengths.
Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import Scratch, arrow_map, ranked

PIECES = "doc_id long, piece int, start long, length long, narrow binary"
_ENCODERS: dict = {}


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, which that library takes out of a text before it looks for words."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that are met literally are built")
    return {t["content"]: t["id"] for t in tokens}


def token_ids(ranks_path: str, pattern: str, added: dict[str, int] | None = None):
    """A function from text to uint32 ids, built once in each Python worker.

    The ids are those of the tokenizers library with the same vocabulary (the tests hold one against the other);
    its own encoder takes three times the CPU. The literals of ``added`` get their own ids, and the text between them is
    encoded part by part; without it they are plain text.
    """
    key = (ranks_path, pattern, tuple(sorted((added or {}).items())))
    if key not in _ENCODERS:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        literals = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def plain(text: str) -> list[int]:
            try:
                return encoding.encode_ordinary(text)
            except BaseException as e:  # the library's own matcher overflows on very long runs of white space
                if type(e).__name__ != "PanicException":
                    raise
                return [i for w in words.findall(text) for i in encoding._encode_single_piece(w.encode())]

        def encode(text: str) -> np.ndarray:
            if literals is None or not literals.search(text):
                return np.asarray(plain(text), dtype="<u4")
            parts = literals.split(text)  # every second one is a literal
            return np.asarray([i for k, part in enumerate(parts) for i in ([added[part]] if k % 2 else plain(part))], dtype="<u4")

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces of ``capacity``, of which the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def narrow(ids: np.ndarray) -> bytes:
    """The ids in two bytes each if all fit, else in four: what moves, instead of an array<int>."""
    return (ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()


@F.arrow_udf(ArrayType(IntegerType()))
def widened(narrow: pa.Array, length: pa.Array) -> pa.Array:
    parts = [np.frombuffer(b.as_buffer(), dtype="<u2" if len(b.as_buffer()) == 2 * n else "<u4").astype(np.int32) for b, n in zip(narrow, length.to_pylist(), strict=True)]
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int32)])))


@F.arrow_udf(LongType())
def crc32_of_ids(ids: pa.Array) -> pa.Array:
    """crc32 of the ids as little-endian integers of four bytes."""
    edges, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.int64())


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, end_id: int, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenises each document, adds the end token and cuts what is longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = token_ids(ranks_path, pattern, added), np.array([end_id], dtype="<u4")
        types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "narrow": pa.binary()}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                rows += [(doc_id, k, s, n, narrow(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, PIECES)


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit, longest first, over runs: (length, pieces, first sequence, offset) in the order of placing.

    A run's pieces go to consecutive sequences, one to each, all at the same offset.
    """
    gaps: list[int] = []  # sorted gap values that have open sequences
    open_runs: dict[int, list[list[int]]] = {}  # gap -> runs [first sequence, count]
    plan, made = [], 0

    def give(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in open_runs:
                insort(gaps, gap)
                open_runs[gap] = []
            open_runs[gap].append([first, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)  # the sweep to the successor
            if at == len(gaps):  # none: the rest opens sequences, each holding as many as fit
                per = capacity // length
                full, rest = divmod(left, per)
                for k in range(per):
                    if full:
                        plan.append((length, full, made, k * length))
                    if k < rest:
                        plan.append((length, 1, made + full, k * length))
                give(capacity - per * length, made, full) if full else None
                give(capacity - rest * length, made + full, 1) if rest else None
                made, left = made + full + (rest > 0), 0
                continue
            gap = gaps[at]
            run = open_runs[gap][-1]
            n = min(left, run[1])
            run[1] -= n  # the last n of the run, so that the rest keeps its first sequence
            first = run[0] + run[1]
            if not run[1]:
                open_runs[gap].pop()
                if not open_runs[gap]:
                    del open_runs[gap]
                    gaps.pop(at)
            plan.append((length, n, first, capacity - gap))
            give(gap - length, first, n)
            left -= n
    return plan


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, scratch: Scratch | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Returns per piece doc_id, piece, start, length, ids array<int>, ids_crc32, sequence_id, offset: its ids and where they stand.

    The pieces of one sequence_id in the order of offset are that sequence. ids_crc32 is derived from ids. ``added``: see token_ids.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    cut_up = scratch.save(pieces(docs, ranks_path, pattern, capacity, end_id, added).withColumn("row", F.monotonically_increasing_id()), "pieces")  # else texts would be encoded again
    placed, _ = ranked(cut_up.select("length", "doc_id", "piece", "row"), ["length", "doc_id", "piece", "row"], scratch, "by_length")
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = match_runs(counts, capacity)
    runs.sort(key=lambda r: r[0])  # stable: within a length, ranks go in the order of placing
    size = np.array([r[1] for r in runs], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(runs) else size
    first, offset = (np.array([r[k] for r in runs], dtype=np.int64) for k in (2, 3))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(begin, rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + rank.to_numpy() - begin[at], "offset": offset[at]})

    places = placed.withColumn("at", place("rank")).select("row", "at.sequence_id", "at.offset")
    met = cut_up.join(places.hint("shuffle_hash"), "row").withColumn("ids", widened("narrow", "length"))
    return met.select("doc_id", "piece", "start", "length", "ids", crc32_of_ids("ids").alias("ids_crc32"), "sequence_id", "offset")
