"""Removal of repeated passages by prefix doubling over position names.

A byte goes if it lies in a string of ``length`` bytes that also starts at another place, in the same document or another.

Ranking every byte position at growing offsets would move 16 bytes or more for each byte of text in every round. Here the
doubling runs on a content-defined sample of positions that no repeat can miss. Names of 8 bytes are paired into names
of 16, 32, ... bytes at every position inside the scan (equal names, equal strings), up to the longest that is at most
a sixth of ``length``. Each window of ``length`` bytes takes as its anchor the leftmost position with the least name
among those it holds; equal windows have equal anchors at equal places. Then, as in prefix doubling, only what is not
yet unique is compared further:

1. anchors whose name occurs once leave: their windows are unique;
2. the rest are told apart by a digest of the whole run of windows they serve: runs that repeat are repeats as a whole;
3. where runs of one anchor name differ (edges of passages), one run of each kind is cut into parts, and steps 1 and 2
   follow with the bytes that all windows of a part share (185 of 200) as the name;
4. and once more with single windows: the full length.

Names, of 64 bits, only decide what is compared further: a clash costs work. What counts as repeated is decided by a
digest (BLAKE2b, 128 bits) of all bytes of a run, part or window. Copies are counted map-side and never paired with each
other, so the work grows with the text and not with the square of a group. Texts move only for documents that may hold
a repeat, tested by a bitmap of fixed size.

Nulls: a null text is an empty one. Texts below ``length`` bytes hold no repeat. Very long texts are scanned in blocks.
Rows that repeat an id, and rows with a null one, are documents of their own, so rows repeated as a whole are repeats of each
other. Other columns are ignored by suffix_dedup and come back from drop_repeats, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, fresh, identified, marked, maybe_in

POSITIONS = 20  # bits for a position in a block
BLOCK = 1 << 19
PART = 16  # places of an anchor in a window that are first compared together
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M1
    x ^= (b ^ (b >> np.uint64(31))) * _M2
    x ^= x >> np.uint64(29)
    x *= _M3
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2^64 to the powers 0..n-1, kept for the next block."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK * 2)
        _POWERS[:] = [np.append(np.uint64(1), np.full(size - 1, b, dtype=np.uint64)).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each position, as numbers."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64)


def doubled(data: np.ndarray, size: int) -> np.ndarray:
    """Names at every position of strings of 8, 16, 32, ... bytes, by pairing names at growing offsets."""
    name, width = eight_bytes(data), 8
    while width < size:
        name = _mix(name[:-width], name[width:])
        width *= 2
    return name if size > 8 else _mix(name, name)


class Names:
    """Names of the substrings of a buffer: equal bytes, equal names, wherever they stand."""

    def __init__(self, data: np.ndarray):
        eight = eight_bytes(data)
        power, self.inverse = _powers(len(eight) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(eight, eight) * power[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Names of the strings of `size` (8 at least) bytes at `start`."""
        x = (self.sums[start + size - 7] - self.sums[start]) * self.inverse[start]
        return x ^ (x >> np.uint64(32))


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of the digest of each data[start:stop]."""
    view = memoryview(np.ascontiguousarray(data))
    found = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(found, dtype="<i8").reshape(-1, 2)


def seed_size(length: int) -> int:
    size = 8
    while size * 2 <= length // 6:
        size *= 2
    return size


def anchors_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts data[begin:end]: text number, first window, windows, anchor place in it, the anchor's name, and the digest of the run."""
    k = seed_size(length)
    seeds = doubled(data, k)
    low = np.uint64((1 << POSITIONS) - 1)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    width, reach = 1, length - k + 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    anchor = (least & low).astype(np.int64)
    first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, begin[begin < len(anchor)])
    text = np.searchsorted(begin, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(anchor)), end[text] - length + 1)
    ok = last > first
    first, last, text = first[ok], last[ok], text[ok]
    at = anchor[first]
    place, n = at - first, last - first
    return text, first, n, place, seeds[at], digests(data, first, last + length - 1)


def _blocks(ids: list[int], texts: pa.Array, length: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into blocks: (id, offset) of each, the bytes, begins and ends. A long text comes in overlapping parts."""
    held, parts, size = [], [], 0

    def flush():
        ends = np.cumsum([len(p) for p in parts])
        return list(held), np.concatenate(parts), ends - [len(p) for p in parts], ends

    for key, text in zip(ids, texts, strict=True):
        data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid else b""
        step = BLOCK - length + 1
        for s in range(0, max(len(data) - length + 1, 0), step):
            part = data[s : s + BLOCK]
            if size + len(part) > BLOCK and parts:
                yield flush()
                held, parts, size = [], [], 0
            held.append((key, s))
            parts.append(part)
            size += len(part)
    if parts:
        yield flush()


ANCHORS = "id long, first int, n int, place int, seed long, span1 long, span2 long"
_FIELDS = [x.split()[0] for x in ANCHORS.split(", ")]


def _anchor_rows(ids: np.ndarray, ints: tuple[np.ndarray, ...], seed: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(ids), *(pa.array(x.astype(np.int32)) for x in ints), pa.array(seed.view(np.int64)), pa.array(span[:, 0]), pa.array(span[:, 1])]
    return pa.RecordBatch.from_arrays(columns, _FIELDS)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, data, begin, end in _blocks(batch.column(0).to_pylist(), batch.column(1), length):
                text, first, n, place, seed, span = anchors_of(data, begin, end, length)
                ids, offset = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
                yield _anchor_rows(ids[text], (first - begin[text] + offset[text], n, place), seed, span)

    return arrow_map(docs, run, ANCHORS)


def ranges_of(data: np.ndarray, base: np.ndarray, n: np.ndarray, place: np.ndarray, seed: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Cuts runs of windows, whose bytes start at `base`, where the anchor's place in the window divides by `width`.

    Gives for each part its run, first window, windows, anchor place, a name of the bytes that all windows of such a part hold
    (with the run's anchor name), and a digest of all its bytes.
    """
    names = Names(data)
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    part = (place[run] - step) // width
    start = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (part[1:] != part[:-1])))
    count = np.diff(np.append(start, len(run)))
    run, step, part = run[start], step[start], part[start]
    at = place[run] - step
    core = names.of(base[run] + place[run] - part * width, length - width + 1)
    core = _mix(core, seed[run] + (part * width).astype(np.uint64) * _M1)
    begin = base[run] + step
    return run, step, count, at, core, digests(data, begin, begin + length + count - 1)


def _refined(runs_with_text: DataFrame, length: int, width: int) -> DataFrame:
    """The listed runs of each document cut into parts of `width` places, in the form of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, dict, np.ndarray]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                parts = [p for _, _, p in held]
                base = np.cumsum([len(p) for p in parts]) - [len(p) for p in parts]
                first, n, place, seed = (np.array([r[k] for _, r, _ in held], dtype=np.int64) for k in ("first", "n", "place", "seed"))
                number, step, count, at, core, full = ranges_of(np.concatenate(parts), base, n, place, seed.view(np.uint64), length, width)
                doc = np.array([d for d, _, _ in held], dtype=np.int64)
                return _anchor_rows(doc[number], (first[number] + step, count, at), core, full)

            for key, text, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                for r in listed.as_py():
                    part = data[r["first"] : r["first"] + r["n"] + length - 1]
                    held.append((key, r, part))
                    size += len(part)
                    if size > BLOCK:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return arrow_map(runs_with_text, run, ANCHORS)


def repeated_spans(texts: DataFrame, length: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """texts: id (unique), text binary. Gives id and spans array<struct<begin, stop>> (unmerged) of the bytes of each text that holds repeats."""
    scratch = scratch or Scratch(texts.sparkSession, "suffix")
    rows, found, kind = scratch.save(_anchors(texts, length), "rows0"), [], ["seed", "span1", "span2"]
    span = [F.col("first").alias("begin"), (F.col("first") + F.col("n") + length - 1).alias("stop")]
    for level, width in enumerate((PART, 1, 0)):
        shared = scratch.save(rows.groupBy("seed").agg(F.count("*").alias("copies")).where("copies > 1").select("seed"), f"shared{level}")
        left = scratch.save(maybe_in(rows, shared, "seed"), f"left{level}")  # what is surely unique is gone; what stays may still be
        scratch.drop(f"rows{level}")
        kinds = left.groupBy(*kind).agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("id", "first", "n", "place")))
        kinds = scratch.save(kinds, f"kinds{level}")
        whole = kinds.where("copies > 1").select(*kind)
        found.append(scratch.save(maybe_in(left, whole, *kind).join(whole, kind, "left_semi").select("id", *span), f"whole{level}"))
        scratch.drop(f"left{level}", f"shared{level}")
        if not width:  # single windows were compared as a whole
            break
        mixed = kinds.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed")
        edges = kinds.join(mixed, "seed", "left_semi").groupBy("id").agg(F.collect_list(F.struct("first", "n", "place", "seed")).alias("runs"))
        edges = scratch.save(edges, f"edges{level}")
        with_text = maybe_in(texts, edges, "id").join(edges.hint("shuffle_hash"), "id").select("id", "text", "runs")
        rows = scratch.save(_refined(with_text, length, width), f"rows{level + 1}")
        scratch.drop(f"kinds{level}", f"edges{level}")
    spans = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop("kinds2", *(f"whole{k}" for k in range(3)))
    return spans


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[list[int]] = []
    for b, e in sorted((s["begin"], s["stop"]) for s in spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def strip(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """id, kept (the bytes outside the spans), kept_text, n_removed, n_spans of the texts that have spans.

    kept_text is what is left as a string: a character that is cut through goes as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, as_text, removed, n = [], [], [], []
            for text, listed in zip(batch.column(1), batch.column(2), strict=True):
                data, runs = text.as_py(), [(b, min(e, len(text.as_buffer()))) for b, e in merge(listed.as_py())]
                edges = [0, *(x for r in runs for x in r), len(data)]
                parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(b"".join(parts))
                as_text.append("".join([p.decode("utf-8", "ignore") for p in parts]))
                removed.append(len(data) - len(kept[-1]))
                n.append(len(runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(as_text, pa.string()), pa.array(removed, pa.int64()), pa.array(n, pa.int64())], ["id", "kept", "kept_text", "n_removed", "n_spans"])

    met = maybe_in(texts, spans, "id").join(spans.hint("shuffle_hash"), "id").select("id", "text", "spans")
    return arrow_map(met, run, "id long, kept binary, kept_text string, n_removed long, n_spans long")


def _texts(docs: DataFrame, row: str) -> DataFrame:
    return docs.select(F.col(row).alias("id"), F.col("text").cast("binary").alias("text"))


def suffix_dedup(docs: DataFrame, length: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """Per document doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    held, row = identified(docs.select(F.col("doc_id").cast("long"), "text"), scratch, "texts")
    texts = _texts(held, row)
    cut = scratch.save(strip(texts, repeated_spans(texts, length, scratch)).select("id", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256")), "cut")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = held.select("doc_id", F.col(row).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    zero = F.lit(0).cast("long")
    return facts.join(cut, "id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"))


def drop_repeats(docs: DataFrame, length: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut out of their texts and n_chars, if there is one, set anew.

    A character that is cut through goes as a whole. Only documents that may hold a repeat are shuffled.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    held, row = identified(docs, scratch, "texts")
    texts = _texts(held, row)
    spans = repeated_spans(texts, length, scratch)
    new = fresh("kept", held)
    cut = strip(texts, spans).select(F.col("id").alias(row), F.col("kept_text").alias(new))
    found, flag = marked(held, spans.select(F.col("id").alias(row)), row)
    met = found.where(flag).drop(flag).join(cut, row, "left")
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType)
    return found.where(~F.col(flag)).drop(flag, row).unionByName(met.withColumns(changed).drop(new, row))
