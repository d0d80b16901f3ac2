"""Join of documents whose word n-grams have a Jaccard similarity of at least a threshold.

Documents with equal sets of n-grams form one class and are compared once. Classes meet in the buckets of a banded
MinHash, wide enough that a pair at the threshold is missed with a chance below one in a million. In a bucket, MinHash
values are compared step by step; with m of the first n equal, and any similarity as likely as another beforehand, the
chance that the pair reaches the threshold is P(Bin(n + 1, threshold) <= m), and the pair is dropped when that falls below
`tolerance`. What is left is verified on the whole n-gram sets.

Pairs are never rows. A bucket's survivors leave as a spanning forest, so pairs that others connect already are not
compared there; the forests' components are cut into blocks, and each pair of blocks is verified in one task that gives
back, for each document, its number of links and a forest of them. So a group of near copies costs rows in proportion to
its size (times its blocks), no task holds more than two blocks, and every link between different texts is counted. Links
to copies count through the class's size.

n-grams go by names of 64 bits, whole sets by 128 bits from two independent hashes.
A word is a run of bytes without ASCII white space, taken as it stands. A text of fewer than n words has one n-gram, all its
words. Nulls: a null text is an empty one; texts without words link to nothing and are classes of their own. Rows that repeat
an id, and rows with a null one, are documents of their own; a null id is below all others. Other columns are ignored by
jaccard_join and come back from drop_near_copies, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, identified, maybe_in, shuffle_partitions, without
from .components import connected_components

N = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 28  # 0.5904 ^ 28 = 4e-7 pairs missed at the threshold
TOLERANCE = 1e-6
STEPS = (8, 16, 32, 64, ROWS * BANDS)
BLOCK_DOCS, BLOCK_GRAMS = 512, 1_000_000
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (rows) and the begin of each word of the bytes.

    Eight bytes at a time are mixed with their place in the word before they are summed, so no arithmetic relation between
    words carries over to their hashes. Work goes in parts, whatever the length of texts and words.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, end = edge[::2], edge[1::2]
    first = np.concatenate([[0], np.cumsum((end - begin + 7) // 8)])
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data),), dtype=np.dtype("<u8"), buffer=padded, strides=(1,))
    sums = np.zeros((2, len(begin)), dtype=np.uint64)
    for lo in range(0, int(first[-1]), part):
        place = np.arange(lo, min(lo + part, int(first[-1])))
        word = np.searchsorted(first, place, side="right") - 1
        k = place - first[word]
        at = begin[word] + 8 * k
        short = np.maximum(0, 8 - (end[word] - at)).astype(np.uint64) * np.uint64(8)
        value = eight[at] << short
        own = np.flatnonzero(np.diff(word, prepend=-1))
        for lane, seed in enumerate((_C1, _C3)):
            sums[lane, word[own]] += np.add.reduceat(_mix(value ^ _mix((k.astype(np.uint64) + np.uint64(1)) * seed)), own)
    size = (end - begin).astype(np.uint64)
    return np.stack([_mix(x + size * seed) for x, seed in zip(sums, (_C1, _C3), strict=True)]), begin


def gram_hashes(words: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Distinct hashes of the n-grams of consecutive words, sorted, and a digest of the set by the words' other hashes."""
    m = words.shape[1]
    if not m:
        return words[0], 0
    n = min(n, m)
    x = np.zeros((2, m - n + 1), dtype=np.uint64)
    for k in range(n):
        x = _mix(x * _C1 + words[:, k : k + x.shape[1]])
    grams, at = np.unique(x[0], return_index=True)
    return grams, int(_mix(x[1, at]).sum(dtype=np.uint64).view(np.int64))


def grams_of(texts: pa.Array, n: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, int]]:
    """The n-gram set of each text, hashed, and its digest; short texts share the work of one block."""
    held: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, int]]:
        gap = np.array([32], dtype=np.uint8)
        words, begin = word_hashes(np.concatenate([x for h in held for x in (h, gap)]))
        bounds = np.searchsorted(begin, np.cumsum([0, *(len(h) + 1 for h in held)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield gram_hashes(words[:, a:b], n)

    for text in texts:
        held.append(np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, dtype=np.uint8))
        size += len(held[-1])
        if size > block:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def minhashes(grams: list[np.ndarray]) -> np.ndarray:
    """ROWS * BANDS minima for each non-empty set."""
    x = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
    start = np.cumsum([0, *map(len, grams)])[:-1]
    out = np.empty((len(grams), len(_A)), dtype=np.uint32)
    for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, k] = np.minimum.reduceat(x * a + b, start)
    return out


SIGNATURES = "id long, doc_id long, n long, set1 long, set2 long, bands array<long>, values binary"


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """texts: id, doc_id, text. Per text the size and 128 bits of its n-gram set (two sums, of names that come from independent hashes), its band keys and the low halves of its MinHash values."""

    def pack(ids: list[tuple], grams: list[np.ndarray], set2: list[int]) -> pa.RecordBatch:
        full = [k for k, g in enumerate(grams) if len(g)]
        bands: list = [[] for _ in grams]
        values: list = [b""] * len(grams)
        if full:
            m = minhashes([grams[k] for k in full])
            wide = m.reshape(len(full), BANDS, ROWS).astype(np.uint64)
            key = np.zeros((len(full), BANDS), dtype=np.uint64)
            for r in range(ROWS):
                key = _mix(key * _C1 + wide[:, :, r])
            key = key.view(np.int64)
            low = m.astype(np.uint16)
            for at, k in enumerate(full):
                bands[k], values[k] = key[at], low[at].tobytes()
        set1 = [int(_mix(g).sum(dtype=np.uint64).view(np.int64)) if len(g) else 0 for g in grams]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*ids, strict=True)), pa.array([len(g) for g in grams], pa.int64()), pa.array(set1, pa.int64()), pa.array(set2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(values, pa.binary())], ["id", "doc_id", "n", "set1", "set2", "bands", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams, digests, size = [], [], [], 0
            both = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for key, (g, digest) in zip(both, grams_of(batch.column(2), n), strict=True):
                ids.append(key)
                grams.append(g)
                digests.append(digest)
                size += len(g)
                if size > 1 << 16:
                    yield pack(ids, grams, digests)
                    ids, grams, digests, size = [], [], [], 0
            if ids:
                yield pack(ids, grams, digests)

    return arrow_map(texts, run, SIGNATURES)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values among n with which a pair may go on."""
    total = 0.0
    for m in range(n + 2):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least place that each of n places is linked to, by the pairs (a, b) and those that made ``root``."""
    root = np.arange(n) if root is None else root
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root
    return root


def _dealt(rows: DataFrame, key: list[str], blocks: str) -> DataFrame:
    """Each row once for each pair of blocks that holds its own: key, i <= j, own. Sorted by id, so that groups in common have links in common."""
    own = F.pmod(F.xxhash64("id"), F.col(blocks).cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.drop("other", blocks)
    return rows.repartition(shuffle_partitions(rows.sparkSession), *key, "i", "j").sortWithinPartitions(*key, "i", "j", "id")


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal values in the first `key` columns, with the bounds of the groups."""
    rest: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, new]) if rest is not None and len(rest) else new
        values = np.stack([rest.column(k).to_numpy() for k in range(key)], axis=1)
        bound = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        if len(bound):
            yield rest.slice(0, bound[-1]), np.append(0, bound)
            rest = rest.slice(bound[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def candidate_forest(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """members: band, key, i, j, id, values, own, sorted. Gives (a, b): ids linked to a lesser one by pairs not dropped."""
    least = [least_matches(s, threshold, tolerance) for s in STEPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bound in _groups(batches, 4):
            ids = rows.column("id").to_numpy()
            values = np.frombuffer(b"".join(rows.column("values").to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
            stop = np.repeat(bound[1:], np.diff(bound))
            cross = (rows.column("i").to_numpy() != rows.column("j").to_numpy())
            own = rows.column("own").to_numpy()
            here, root = np.arange(len(ids)), np.arange(len(ids))
            for apart in range(1, int(np.diff(bound).max())):
                here = here[here + apart < stop[here]]
                # only a forest leaves, so pairs that others connect already need no comparison
                a = here[(root[here] != root[here + apart]) & (~cross[here] | (own[here] != own[here + apart]))]
                if not len(a):
                    continue
                equal = np.zeros(len(a), dtype=np.int64)
                done = 0
                for to, low in zip(STEPS, least, strict=True):
                    equal = equal + (values[a, done:to] == values[a + apart, done:to]).sum(1)
                    go = equal >= low
                    a, equal, done = a[go], equal[go], to
                root = _forest(len(ids), a, a + apart, root)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    return arrow_map(members, run, "a long, b long")


def _gram_table(texts: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for key, (g, _) in zip(batch.column(0).to_pylist(), grams_of(batch.column(1), n), strict=True):
                ids.append(key)
                sets.append(g.tobytes())
                size += len(g)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "grams"])
                    ids, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "grams"])

    return arrow_map(texts, run, "id long, grams binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix."""
    g = len(sets)
    if g <= 6:
        out = np.zeros((g, g), dtype=np.int64)
        for a in range(g):
            for b in range(a + 1, g):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    owner, column = owner[keep], (np.cumsum(count > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((g, g), dtype=np.float32)
    width = max(256, (1 << 22) // g)
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [s, s + width])
        dense = np.zeros((g, min(width, int(column[-1]) + 1 - s)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - s] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """members: component, i, j, id, copies, grams, own, sorted. Per id of a pair of blocks its links and a lesser linked id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bound in _groups(batches, 3):
            all_ids, copies, own = (rows.column(c).to_numpy() for c in ("id", "copies", "own"))
            cross = rows.column("i").to_numpy() != rows.column("j").to_numpy()
            grams = rows.column("grams")
            ids, links, low = [], [], []
            for s, e in zip(bound[:-1], bound[1:], strict=True):
                sets = [np.frombuffer(grams[int(k)].as_py(), dtype=np.uint64) for k in range(s, e)]
                size = np.array([len(x) for x in sets])
                shared = shared_counts(sets)
                link = shared >= threshold * (size[:, None] + size - shared) - 1e-9
                np.fill_diagonal(link, False)
                if cross[s]:
                    link &= own[s:e, None] != own[s:e]
                root = _forest(e - s, *np.nonzero(link))
                ids.append(all_ids[s:e])
                links.append(link @ copies[s:e])
                low.append(all_ids[s:e][root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, links, low)], ["id", "links", "low"])

    return arrow_map(members, run, "id long, links long, low long")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """Per document doc_id, class_id (least id of the documents that links connect it with), n_links, copy_id (least id with an equal n-gram set)."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    held, row = identified(docs.select(F.col("doc_id").cast("long"), "text"), scratch, "texts")
    texts = held.select(F.col(row).alias("id"), "doc_id", F.col("text").cast("binary").alias("text"))
    sets = ["n", "set1", "set2"]
    signed = scratch.save(signatures(texts, n), "signed")
    classes = scratch.save(signed.where("n > 0").groupBy(*sets).agg(F.min("id").alias("id"), F.min("doc_id").alias("copy_id"), F.count("*").alias("copies")), "classes")
    linked = _linked(texts, signed, classes, n, threshold, tolerance, scratch)
    # classes go by the ids of rows; the least document id of each component takes the place of its name
    first = linked.join(classes.select("id", "copy_id"), "id").groupBy("component").agg(F.min("copy_id").alias("class_id"))
    met = classes.join(linked.join(first, "component"), "id", "left")
    named = scratch.save(met.select(*sets, "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = signed.select("doc_id", *sets).join(named, sets, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"))


def _linked(texts: DataFrame, signed: DataFrame, classes: DataFrame, n: int, threshold: float, tolerance: float, scratch: Scratch) -> DataFrame:
    """(id, component, links) of the classes that are linked to others. A class is called by its least id, and so is a component."""
    one = signed.where("n > 0").join(classes.select("id", "copies"), "id")
    one = scratch.save(one.select("id", "n", "copies", "bands", "values"), "one")
    banded = one.select("id", "values", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = scratch.save(buckets.select("band", "key", F.ceil(F.col("m") / BLOCK_DOCS).cast("int").alias("blocks")), "buckets")
    members = maybe_in(banded, buckets, "band", "key").join(buckets, ["band", "key"])
    members = _dealt(members.select("band", "key", "blocks", "id", "values"), ["band", "key"], "blocks").select("band", "key", "i", "j", "own", "id", "values")
    edges = scratch.save(candidate_forest(members, threshold, tolerance).distinct(), "candidates")
    groups = connected_components(edges, scratch, "candidate_groups")

    facts = scratch.save(groups.join(one.select("id", "n", "copies"), "id"), "facts")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    facts = facts.join(facts.groupBy("component").agg(blocks), "component")
    grams = _gram_table(maybe_in(texts.select("id", "text"), groups.select("id"), "id"), n)
    met = facts.join(grams, "id").select("component", "blocks", "id", "copies", "grams")
    met = _dealt(met, ["component"], "blocks").select("component", "i", "j", "own", "id", "copies", "grams")
    counted = scratch.save(verified(met, threshold), "verified")
    links = counted.groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(counted.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")), scratch, "groups")
    return scratch.save(found.join(links, "id").select("id", "component", "links"), "linked")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, with one row, of the least id, for each class of linked documents."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    held, row = identified(docs, scratch, "rows")
    joined = jaccard_join(held.select(F.col(row).alias("doc_id"), "text"), n, threshold, tolerance, scratch).where("n_links > 0")
    ids = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"))
    linked = scratch.save(joined.select(F.col("doc_id").alias("row"), "class_id").join(ids, "row"), "members")
    kept = linked.groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("kept"))
    gone = scratch.save(linked.join(kept, "class_id").where("row <> kept.row").select(F.col("row").alias(row)), "gone")
    return without(held, gone, row).drop(row)
