"""Alignment of two tokenizers' tokens over the same bytes, and how often their entries meet.

Tokens of both sides are rows (posexplode) with windowed cumulative lengths; ends that both sides share are an equi-join, running
counts of such cuts number the groups, and a join by group gives the linked pairs.

Both tokenizers must end a token at certain places whatever stands around them, so texts are first cut there, and each
distinct stretch of the corpus is tokenised and aligned once, in the place of a document. A cut goes before a space or
line feed between characters that are no white space, and between a Latin letter and ASCII punctuation: the first tokenizer's
pattern never matches across these, and the second's pieces are searched for any that would (a kind of cut for
which there is one is not used). Documents are lists of stretches, numbered within blocks of about ``BLOCK`` bytes of text, or
of one longer document. What stretches give comes to each block once, beside its documents' packed numbers, so a document's
figures are sums and joined strings of table entries, and nothing of a token's size is shuffled for each occurrence.

Nulls: a null text is an empty one. It, and a text whose tokens' bytes differ from space + text on either side, has no tokens:
zeros and an empty groups_sha256. Very long texts without cuts are one stretch. Documents count one by one for the pairs,
also rows that repeat an id or have none. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _field, byte_characters
from .common import Scratch, arrow_map, shuffle_partitions

BLOCK = 32 << 20
#: A token is its id and, in the low bits, its length in bytes.
LENGTH_BITS = 12
SPACE = "▁"
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: Pieces that would stand across each kind of cut: before white space, and between letter and mark.
ACROSS = (rf"[^{SPACE}]{SPACE}|.\n|\n.", r"[A-Za-zÀ-ɏ][!-/:-@\[-`{-~]")
WHITE, BREAK, LETTER, MARK = 1, 2, 4, 8
#: Characters up to which the faster encoder is given a stretch.
SHORT = 200


class Cutter:
    """Cuts texts before a space or line feed between characters that are no white space, and between Latin letters and marks."""

    def __init__(self, breaks: bool, marks: bool):
        self.breaks, self.marks = breaks, marks
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.kinds[[c for c in range(0x10000) if chr(c).isspace() or chr(c) == SPACE]] |= WHITE  # none are beyond
        self.kinds[[ord(" "), ord("\n")]] |= BREAK
        for bit, spans in ((LETTER, ("AZ", "az", "Àɏ")), (MARK, ("!/", ":@", "[`", "{~"))):
            for low, high in spans:
                self.kinds[ord(low) : ord(high) + 1] |= bit

    def split(self, text: str) -> list[str]:
        kinds = self.kinds[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
        cut = np.zeros(max(0, len(kinds) - 1), dtype=bool)  # before each character but the first
        if self.marks:
            cut |= (kinds[:-1] & LETTER != 0) & (kinds[1:] & MARK != 0)
        if self.breaks:
            black = kinds & WHITE == 0
            cut[:-1] |= black[:-2] & (kinds[1:-1] & BREAK != 0) & black[2:]
        at = (np.flatnonzero(cut) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


class Second:
    """The sentencepiece side, given texts that have their leading space already."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        # a later value of the normaliser's add_dummy_prefix takes the place of the earlier one
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto + _field(3, _field(3, 0)))
        self.pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in self.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class First:
    """The byte-level side; special tokens' strings are plain text."""

    def __init__(self, path: str, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        added = self.model.get_added_tokens_decoder()
        self.bytes_of = [b""] * self.model.get_vocab_size()
        for piece, k in self.model.get_vocab().items():
            self.bytes_of[k] = piece.encode() if k in added else bytes(back[c] for c in piece)
        self.quick = None
        if pattern:
            import tiktoken

            self.quick = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks={p: k for k, p in enumerate(self.bytes_of) if k not in added}, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.quick:
            return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        # runs of white space may be too long for the faster encoder
        long = iter(self.model.encode_batch_fast([t for t in texts if len(t) > SHORT], add_special_tokens=False))
        return [self.quick(t) if len(t) <= SHORT else next(long).ids for t in texts]


@functools.lru_cache(maxsize=2)
def _sides(first: str, second: str, pattern: str | None = None) -> tuple[First, Second]:
    sides = First(first, pattern), Second(second)
    for side in sides:
        if len(side.bytes_of) >> 31 - LENGTH_BITS or max(map(len, side.bytes_of)) >> LENGTH_BITS:
            raise ValueError("entries do not fit the packed form")
    return sides


@functools.lru_cache(maxsize=2)
def _cutter(second: str) -> Cutter | None:
    side = Second(second)
    # pieces that stand for one byte each are never part of a longer one
    kinds = [not any(re.search(across, p) for p in side.pieces if not re.fullmatch("<.*>", p)) for across in ACROSS]
    return Cutter(*kinds) if any(kinds) else None


def _cut(docs: DataFrame, second: str, size: int) -> DataFrame:
    """Rows of two sorts: (block, ids, lengths, seq) of some documents and (block, unit, text) of a block's stretches, which seq's numbers name."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("seq", pa.binary()), ("unit", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(second)
        block, held, units = TaskContext.get().partitionId() << 24, 0, _Numbers()
        ids, lengths, seq = [], [], array("i")

        def stretches() -> pa.RecordBatch:
            n = len(units)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), *(pa.nulls(n, schema.field(k).type) for k in (1, 2, 3)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(units), pa.string())], schema=schema)

        def documents() -> pa.RecordBatch:
            columns = [[block], [ids], [lengths], [_packed(np.frombuffer(seq, dtype=np.int32))], [None], [None]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                before = len(seq)
                if text:
                    seq.extend(map(units.__getitem__, cutter.split(" " + text) if cutter else [" " + text]))
                    held += len(text)
                lengths.append(len(seq) - before)
                if held >= size:
                    yield documents()
                    yield stretches()
                    block, held, units = block + 1, 0, _Numbers()
                    ids, lengths, seq = [], [], array("i")
            if ids:
                yield documents()
                ids, lengths, seq = [], [], array("i")
        if units:
            yield stretches()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "block long, ids array<long>, lengths array<int>, seq binary, unit int, text string")


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers with their low bytes first, then their second bytes, and so on, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<i4")


def _each(chunks: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a block, with the numbers of their stretches."""
    for ids, lengths, seq in zip(*(chunks.column(x) for x in ("ids", "lengths", "seq")), strict=True):
        ends = np.cumsum(np.array(lengths.as_py(), dtype=np.int64))
        numbers = _unpacked(seq.as_py(), int(ends[-1]))
        for doc_id, i, j in zip(ids.as_py(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield doc_id, numbers[i:j]


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def tokens(texts: DataFrame, first: str, second: str, pattern: str | None = None) -> DataFrame:
    """texts (id, text, with its leading space) with the packed tokens a and b of both sides; null if their bytes are not the text's."""

    @F.arrow_udf("struct<a:array<int>,b:array<int>>")
    def encode(batch: pa.Array) -> pa.Array:
        given = batch.to_pylist()
        raw = [t.encode() for t in given]
        made = []
        for side in _sides(first, second, pattern):
            table = np.array([k << LENGTH_BITS | len(p) for k, p in enumerate(side.bytes_of)], dtype=np.int32)
            ids = side.encode(given)
            fits = [b"".join(map(side.bytes_of.__getitem__, x)) == t for x, t in zip(ids, raw, strict=True)]
            made.append((ids, fits, table))
        both = np.array([x and y for x, y in zip(made[0][1], made[1][1], strict=True)], dtype=bool)
        columns = []
        for ids, _, table in made:
            flat = np.fromiter((k for x in ids for k in x), dtype=np.int64)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[flat])))
        return pa.StructArray.from_arrays(columns, ["a", "b"], mask=pa.array(~both))

    return texts.withColumn("both", encode("text")).select("id", "text", "both.a", "both.b")


def groups(tokenised: DataFrame) -> DataFrame:
    """tokenised: id, a, b (packed tokens). Per group of an id: id, g (from 0 in order), as and bs (token ids in order)."""

    # one shuffle of whole stretches: windows and join find their rows together
    dealt = tokenised.repartition(shuffle_partitions(tokenised.sparkSession), "id")

    def ends(side: str) -> DataFrame:
        rows = dealt.select("id", F.posexplode(side).alias("pos", "token"))
        end = F.sum(F.col("token").bitwiseAND((1 << LENGTH_BITS) - 1)).over(Window.partitionBy("id").orderBy("pos"))
        return rows.select("id", end.alias("end"), F.shiftright("token", LENGTH_BITS).alias(side))

    met = ends("a").join(ends("b"), ["id", "end"], "full")
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    numbered = met.withColumn("g", F.coalesce(F.sum(cut).over(before), F.lit(0)))
    ordered = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side])
    return numbered.groupBy("id", "g").agg(ordered("a").alias("as"), ordered("b").alias("bs"))


def links(grouped: DataFrame) -> DataFrame:
    """Per id and linked pair: id, pair (a and, in the low half, b), links (pairs of occurrences whose ranges share a group)."""
    pair = lambda a, b: (F.shiftleft(a.cast("long"), 32) + b).alias("pair")
    one = (F.size("as") == 1) & (F.size("bs") == 1)
    single = grouped.where(one).select("id", pair(F.col("as")[0], F.col("bs")[0]), F.lit(1).cast("long").alias("links"))
    many = grouped.where(~one)
    count = lambda side, name: many.select("id", "g", F.explode(side).alias(name)).groupBy("id", "g", name).agg(F.count("*").alias(f"n_{name}"))
    met = count("as", "a").join(count("bs", "b"), ["id", "g"]).select("id", pair(F.col("a"), F.col("b")), (F.col("n_a") * F.col("n_b")).alias("links"))
    return single.unionByName(met).groupBy("id", "pair").agg(F.sum("links").alias("links"))


def align(docs: DataFrame, first: str, second: str, block: int = BLOCK, scratch: Scratch | None = None, pattern: str | None = None) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; first and second are paths of tokenizers.

    ``pattern``: what the first cuts texts by, where its ids are ranks of merging; short stretches are then encoded faster.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    cut = scratch.save(_cut(docs, second, block), "cut")
    units = cut.where("unit IS NOT NULL").select("block", "unit", "text")
    chunks = cut.where("unit IS NULL").select(F.col("block").alias("own"), "ids", "lengths", "seq")
    stretches = tokens(units.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), first, second, pattern)
    stretches = scratch.save(stretches.where("a IS NOT NULL"), "stretches")
    grouped = scratch.save(groups(stretches), "groups")
    linked = scratch.save(links(grouped), "links")

    # how many documents hold each pair: every block's documents look their stretches' pairs up, and a block tells its counts
    met = scratch.save(linked.groupBy("id").agg(F.collect_list("pair").alias("pairs")).join(stretches.select("id", "text"), "id").select("text", "pairs"), "pairs")
    held = _by_block(chunks, units.join(met, "text").select("block", "unit", "pairs")).applyInArrow(_holders, "pair long, count long")
    counts = held.groupBy("pair").agg(F.sum("count").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # no more rows than the second tokenizer has entries
    counts = scratch.save(counts.select("pair", "count", (F.col("count") == highest).alias("best")), "counts")
    scratch.drop("pairs")

    # stretches' figures, then documents'
    sums = linked.join(counts, "pair").groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    shown = F.concat(F.array_join("as", ","), F.lit("|"), F.array_join("bs", ","))
    n_a, n_b = F.size("as").cast("long"), F.size("bs").cast("long")
    facts = grouped.groupBy("id").agg(F.sum(n_a).alias("n_a"), F.sum(n_b).alias("n_b"), F.count("*").alias("n_groups"), F.sum(n_a * n_b).alias("n_links"), F.array_sort(F.collect_list(F.struct("g", shown.alias("shown")))).alias("list"))
    facts = facts.join(sums, "id").withColumn("shown", F.array_join(F.transform("list", lambda x: x["shown"]), ";"))
    facts = scratch.save(facts.join(stretches.select("id", "text"), "id").select("text", *FIGURES, "shown"), "facts")
    scratch.drop("stretches", "groups", "links", "counts")
    schema = ", ".join(["doc_id long", *(f"{x} long" for x in FIGURES), "groups_sha256 string"])
    return _by_block(chunks, units.join(facts, "text").select("block", "unit", *FIGURES, "shown")).applyInArrow(_figures, schema)


def _by_block(chunks: DataFrame, entries: DataFrame):
    """Each block's documents beside what is known of its stretches; stretches without tokens are not among these."""
    return chunks.groupBy("own").cogroup(entries.groupBy("block"))


def _holders(chunks: pa.Table, entries: pa.Table) -> pa.Table:
    """How many of a block's documents hold each pair."""
    unit = entries.column("unit").to_numpy()
    lists = entries.column("pairs").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    pairs, numbers = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    size = int(unit.max()) + 1 if len(unit) else 0
    start, n = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    n[unit] = lists.value_lengths().to_numpy(zero_copy_only=False)
    start[unit] = np.cumsum(n[unit]) - n[unit]
    once, mark, counts = np.zeros(size, dtype=np.int64), np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)

    def distinct(x: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.arange(len(x))
        place[x] = at
        return x[place[x] == at]

    for _, seq in _each(chunks):
        if not len(seq) or seq.max() >= size or not n[seq].all():
            continue  # not all of its stretches have tokens
        u = distinct(seq, once)
        many = n[u]
        counts[distinct(numbers[np.repeat(start[u] - np.cumsum(many) + many, many) + np.arange(many.sum())], mark)] += 1
    some = counts > 0
    return pa.table({"pair": pa.array(pairs[some], pa.int64()), "count": pa.array(counts[some], pa.int64())})


def _figures(chunks: pa.Table, entries: pa.Table) -> pa.Table:
    """The figures of a block's documents: sums of those of their stretches, and the digest of all groups."""
    unit = entries.column("unit").to_numpy()
    size = int(unit.max()) + 1 if len(unit) else 0
    table = np.zeros((size, len(FIGURES)), dtype=np.int64)
    for k, x in enumerate(FIGURES):
        table[unit, k] = entries.column(x).to_numpy()
    shown: list[str | None] = [None] * size
    for u, x in zip(unit.tolist(), entries.column("shown").to_pylist(), strict=True):
        shown[u] = x
    ids, sums, digests = [], [], []
    none = np.zeros(len(FIGURES), dtype=np.int64)
    for doc_id, seq in _each(chunks):
        there = len(seq) and seq.max() < size and table[seq, FIGURES.index("n_groups")].all()
        ids.append(doc_id)
        sums.append(table[seq].sum(axis=0) if there else none)
        digests.append(hashlib.sha256(";".join(map(shown.__getitem__, seq.tolist())).encode()).hexdigest() if there else "")
    of = np.array(sums, dtype=np.int64).reshape(-1, len(FIGURES))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), **{x: pa.array(of[:, k]) for k, x in enumerate(FIGURES)}, "groups_sha256": pa.array(digests, pa.string())})
