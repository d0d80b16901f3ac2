"""Exact rolling medians and median absolute deviations over a time window, for every click of a series.

Time is cut into blocks as long as the window, so each window is a suffix of one block and a prefix of the next. Both get a
persistent counted tree over the ranks of their values: the prefix's inserts clicks forwards in time, the suffix's backwards,
every insertion leaves a version, and one walk down both trees at once selects a rank of the window. Trees of many series
and blocks are built and searched side by side as arrays: a node is named by its level and the insertion that made it.

A median is two selections. Around it the window is two runs of rising deviations, one to either side, and a search over
how many come from the right one selects the deviations' middle.

A block of more clicks than a task should hold is cut into slices of time (by counts in 4096 cells of the block, which are
rows of a shuffle like any others). A slice's windows share all that lies between its own clicks and those it drops; that
comes as a histogram, value by value, counted before it is shuffled, and is added to both trees' counts. Two clicks in one cell
are never cut apart.

A click's series is its kind, null being one; its cents are floor(100 * value + 0.5), and null, NaN, infinite and values
beyond 10^15 have none. A click without cents gets its window's figures like others. Clicks without ts are dropped; of rows with
one id, a null one too, the least (ts, kind, value) counts, nulls first. Ties in ts see each other; equal cents all count. Other
columns are ignored. No text is read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from .common import Scratch, arrow_map, shuffle_partitions

MINUTE = 60_000_000
CELLS = 4096
#: Clicks of a block and the one before it that one task takes at most, but for a single cell.
SLICE = 200_000
#: Rows of whole groups that a task builds trees for at a time.
TOGETHER = 1 << 16
OWN, TAIL, CORE = 0, 1, 2
OUT = "click_id long, kind string, n long, median2 long, mad4 long, far boolean"


def micros(ts: Column, zoned: bool) -> Column:
    """Microseconds since 1970, with no zone where the column has none."""
    if zoned:
        return F.unix_micros(ts)
    hours = F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 24 + F.hour(ts)
    return (hours * 60 + F.minute(ts)) * MINUTE + (F.expr("1000000") * F.extract(F.lit("SECOND"), ts)).cast("long")


def _clicks(clicks: DataFrame, value: Column) -> DataFrame:
    at = micros(F.col("ts"), isinstance(clicks.schema["ts"].dataType, TimestampType))
    rows = clicks.where("ts IS NOT NULL").select(F.col("click_id").cast("long").alias("click_id"), at.alias("t"), F.col("kind").cast("string").alias("kind"), value.cast("double").alias("value"))
    one = rows.groupBy("click_id").agg(F.min(F.struct("t", "kind", "value")).alias("r")).select("click_id", "r.*")
    usable = ~F.isnan("value") & (F.abs("value") <= 1e15)
    return one.select("click_id", "kind", "t", F.when(usable, F.floor(F.col("value") * 100 + 0.5)).cast("long").alias("c"))


def _sliced(rows: DataFrame, window: int, limit: int, scratch: Scratch) -> DataFrame:
    """Rows for the trees: kind, block, slice, role, t, c, n, click_id. Each click is its own slice's, and in the tail of a slice of the next block."""
    block = F.floor(F.col("t") / F.lit(window)).cast("long") if window & (window - 1) == 0 else F.expr(f"t div {window} - CASE WHEN t < 0 AND t % {window} <> 0 THEN 1 ELSE 0 END")
    placed = rows.withColumn("block", block)
    counted = placed.groupBy("kind", "block").agg(F.count("*").alias("m"))
    largest = counted.agg(F.max("m")).first()[0] or 0
    plain = lambda d: d.withColumns({"slice": F.lit(0), "slices": F.lit(1)})
    own, tail = plain(placed), plain(placed.withColumn("block", F.col("block") + 1))
    if 2 * largest > limit:
        cell = F.expr(f"CAST((t - block * {window}) * {CELLS} div {window} AS INT)")
        placed = scratch.save(placed.withColumn("cell", cell), "celled")
        cuts = scratch.save(_cuts(placed, limit), "cuts")
        # nulls are a kind, so the joins are null-safe in it
        own, tail = _cut(placed, cuts), _cut(placed.withColumn("block", F.col("block") + 1), cuts)
    full = own.select("kind", "block", "slice", F.lit(OWN).alias("role"), "t", "c", F.lit(1).cast("long").alias("n"), "click_id")
    full = full.unionByName(tail.where("c IS NOT NULL").select("kind", "block", "slice", F.lit(TAIL).alias("role"), "t", "c", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("click_id")))
    if 2 * largest > limit:
        first = own.where("c IS NOT NULL AND slice + 1 < slices").select("kind", "block", "c", (F.col("slice") + 1).alias("a"), (F.col("slices") - 1).alias("b"))
        rest = tail.where("c IS NOT NULL AND slice > 0").select("kind", "block", "c", F.lit(0).alias("a"), (F.col("slice") - 1).alias("b"))
        core = first.unionByName(rest).groupBy("kind", "block", "c", "a", "b").agg(F.count("*").alias("n"))
        core = core.select("kind", "block", F.explode(F.sequence("a", "b")).alias("slice"), "c", "n").groupBy("kind", "block", "slice", "c").agg(F.sum("n").alias("n"))
        full = full.unionByName(core.select("kind", "block", "slice", F.lit(CORE).alias("role"), F.lit(0).cast("long").alias("t"), "c", "n", F.lit(None).cast("long").alias("click_id")))
    return full


def _cuts(placed: DataFrame, limit: int) -> DataFrame:
    """kind, block, cell, slice, slices of the blocks that one task should not take whole, with the tails of the blocks before them."""
    cells = placed.groupBy("kind", "block", "cell").agg(F.count("*").alias("m"), F.count("*").alias("own"))
    before = cells.select("kind", (F.col("block") + 1).alias("block"), "cell", "m", F.lit(0).cast("long").alias("own"))
    both = cells.unionByName(before).groupBy("kind", "block", "cell").agg(F.sum("m").alias("m"), F.sum("own").alias("own"))
    whole = Window.partitionBy("kind", "block")  # at most CELLS rows
    run = F.sum("m").over(whole.orderBy("cell")) - F.col("m")
    found = both.select("kind", "block", "cell", F.floor(run / limit).cast("int").alias("slice"), F.sum("m").over(whole).alias("all"), F.sum("own").over(whole).alias("own"))
    return found.where(f"all > {limit} AND own > 0").select("kind", "block", "cell", "slice", (F.max("slice").over(whole) + 1).alias("slices"))


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    x, y = rows.alias("x"), cuts.alias("y")
    met = x.join(y, F.col("x.kind").eqNullSafe(F.col("y.kind")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.cell") == F.col("y.cell")), "left")
    return met.select("x.*", F.coalesce("y.slice", F.lit(0)).alias("slice"), F.coalesce("y.slices", F.lit(1)).alias("slices"))


class Trees:
    """Persistent counted trees of several groups, one version for each insertion, in the order given.

    ``key`` holds group << levels | rank. Node (level, i) was made by insertion i on the way to its own key; ``count`` has how many
    insertions up to i lie below it, ``child`` the insertions that made its two children. The last index is the empty tree.
    """

    def __init__(self, key: np.ndarray, levels: int):
        n = len(key)
        self.levels, self.count, self.child = levels, [], []
        place = np.arange(n)
        for level in range(levels + 1):
            prefix = key >> (levels - level)
            order = np.argsort(prefix, kind="stable")
            ordered = prefix[order]
            first = np.searchsorted(ordered, ordered, side="left")
            count = np.zeros(n + 1, dtype=np.int64)
            count[order] = place - first + 1
            self.count.append(count)
            if level:
                # the newest insertion before i below the sibling of i's node
                names = ordered * (n + 1) + order
                at = np.searchsorted(names, (prefix ^ 1) * (n + 1) + place) - 1
                there = (at >= 0) & (ordered[at] == prefix ^ 1) if n else np.zeros(0, dtype=bool)
                other = np.where(there, order[at], n) if n else place
                right = (prefix & 1).astype(bool)
                self.child.append(np.stack([np.append(np.where(right, other, place), n), np.append(np.where(right, place, other), n)]))


def select(k: np.ndarray, group: np.ndarray, trees: tuple[Trees, Trees], roots: tuple[np.ndarray, np.ndarray], core: np.ndarray | None) -> np.ndarray:
    """The rank of the k-th value (from 0) of each window: both trees and the core's running counts are descended at once."""
    (a, b), levels, k = roots, trees[0].levels, k.copy()
    node = group.copy()
    for level in range(levels):
        la, lb = trees[0].child[level][0][a], trees[1].child[level][0][b]
        left = trees[0].count[level + 1][la] + trees[1].count[level + 1][lb]
        if core is not None:
            width = levels - level - 1
            left += core[(2 * node + 1) << width] - core[(2 * node) << width]
        go = k >= left
        k -= np.where(go, left, 0)
        a = np.where(go, trees[0].child[level][1][a], la)
        b = np.where(go, trees[1].child[level][1][b], lb)
        node = 2 * node + go
    return node


def figures(group: np.ndarray, role: np.ndarray, t: np.ndarray, c: np.ndarray, has: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """n, median2, mad4 for the OWN rows, in their order. Rows are sorted by group."""
    asks = np.flatnonzero(role == OWN)
    new = np.flatnonzero(has & (role == OWN))
    new = new[np.lexsort((t[new], group[new]))]
    old = np.flatnonzero(role == TAIL)
    old = old[np.lexsort((-t[old], group[old]))]
    held = np.flatnonzero(role == CORE)
    # ranks of the distinct values of each group
    used = np.flatnonzero(has)
    order = used[np.lexsort((c[used], group[used]))]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (group[order][1:] != group[order][:-1]) | (c[order][1:] != c[order][:-1])
    values = np.append(c[order][fresh], 0)
    at = np.cumsum(fresh) - 1
    begin = np.searchsorted(group[order][fresh], np.arange(group[-1] + 2))
    rank = np.zeros(len(c), dtype=np.int64)
    rank[order] = at - begin[group[order]]
    levels = max(1, int(np.diff(begin).max(initial=1) - 1).bit_length())
    key = (group << levels) | rank
    trees = Trees(key[new], levels), Trees(key[old], levels)
    core = None
    if len(held):
        core = np.zeros((int(group[-1]) + 1 << levels) + 1, dtype=np.int64)
        np.add.at(core, key[held] + 1, n[held])
        core = np.cumsum(core)
    # versions: clicks of the own block up to t, clicks of the block before from t - window on
    g = group[asks]
    a, n_a = _versions(group[new], t[new], g, t[asks])
    b, n_b = _versions(group[old], -t[old], g, window - t[asks])
    roots = np.where(n_a > 0, a, len(new)), np.where(n_b > 0, b, len(old))
    size = n_a + n_b + (0 if core is None else core[g + 1 << levels] - core[g << levels])

    def kth(k: np.ndarray) -> np.ndarray:
        """The k-th value of each window; any number for windows that have none."""
        ranks = select(np.clip(k, 0, np.maximum(size - 1, 0)), g, trees, roots, core) & (1 << levels) - 1
        return values[np.minimum(begin[g] + ranks, len(values) - 1)]

    half, need = size // 2, (size - 1) // 2 + 1
    median2 = kth(need - 1) + kth(half)
    # deviations rise to the right from half on, and to the left from half - 1 down
    low, high = np.maximum(0, need - half), np.minimum(need, size - half)
    while (low < high).any():
        mid = (low + high) // 2
        more = (low < high) & (2 * kth(half + mid) - median2 < median2 - 2 * kth(half - need + mid))
        low, high = np.where(more, mid + 1, low), np.where(more | (low >= high), high, mid)
    left, none = need - low, np.iinfo(np.int64).max
    last = np.maximum(np.where(low > 0, 2 * kth(half + low - 1) - median2, -1), np.where(left > 0, median2 - 2 * kth(half - left), -1))
    after = np.minimum(np.where(low < size - half, 2 * kth(half + low) - median2, none), np.where(left < half, median2 - 2 * kth(half - 1 - left), none))
    return size, median2, last + np.where(size % 2 == 0, after, last)


def _versions(group: np.ndarray, t: np.ndarray, ask_group: np.ndarray, ask_t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last insertion of the asked group with a time up to the asked one, and how many there are."""
    both_g, both_t = np.concatenate([group, ask_group]), np.concatenate([t, ask_t])
    order = np.lexsort((np.arange(len(both_g)) >= len(group), both_t, both_g))
    seen = np.empty(len(both_g), dtype=np.int64)
    seen[order] = np.cumsum(order < len(group))
    upto = seen[len(group) :]
    return upto - 1, upto - np.searchsorted(group, ask_group)


def _solved(rows: DataFrame, window: int) -> DataFrame:
    """rows: kind, block, slice, role, t, c, n, click_id, with groups of equal kind, block and slice side by side."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        kind = rows.column("kind").combine_chunks()
        group = _numbers(rows)
        c = rows.column("c").combine_chunks()
        has = np.asarray(c.is_valid())
        cents = c.fill_null(0).to_numpy(zero_copy_only=False)
        role, t, n = (rows.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("role", "t", "n"))
        own = np.flatnonzero(role == OWN)
        if not len(own):
            return pa.RecordBatch.from_pylist([], schema=schema)
        size, median2, mad4 = figures(group, role, t, cents, has, n, window)
        few = size < 2
        far = 2 * np.abs(2 * cents[own] - median2) > 3 * mad4
        at = pa.array(own)
        return pa.RecordBatch.from_arrays([rows.column("click_id").combine_chunks().take(at), kind.take(at), pa.array(size, pa.int64()), pa.array(median2, pa.int64(), mask=few), pa.array(mad4, pa.int64(), mask=few), pa.array(far, mask=few | ~has[own])], schema=schema)

    schema = pa.schema([("click_id", pa.int64()), ("kind", pa.string()), ("n", pa.int64()), ("median2", pa.int64()), ("mad4", pa.int64()), ("far", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                rows = pa.Table.from_batches(held)
                group = _numbers(rows)
                whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if whole:
                    yield solve(rows.slice(0, whole))
                    held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield solve(rows)

    return arrow_map(rows, run, OUT)


def _numbers(rows: pa.Table) -> np.ndarray:
    """Groups of neighbours with equal kind, block and slice, numbered from 0."""
    kind = np.asarray(pc.dictionary_encode(rows.column("kind").combine_chunks(), null_encoding="encode").indices)
    block, part = (rows.column(x).to_numpy() for x in ("block", "slice"))
    new = (kind[1:] != kind[:-1]) | (block[1:] != block[:-1]) | (part[1:] != part[:-1])
    return np.concatenate([[0], np.cumsum(new)]).astype(np.int64)


def rolling_median(clicks: DataFrame, minutes: int = 60, limit: int = SLICE, value: str = "value", scratch: Scratch | None = None) -> DataFrame:
    """Per click: click_id, kind, n (cents in its window), median2 (doubled median), mad4 (doubled median of |2 * cents - median2|), far."""
    scratch = scratch or Scratch(clicks.sparkSession, "rolling")
    window = minutes * MINUTE
    rows = scratch.save(_clicks(clicks, F.col(value)), "clicks")
    keys = ["kind", "block", "slice"]
    dealt = _sliced(rows, window, limit, scratch).repartition(shuffle_partitions(clicks.sparkSession), *keys).sortWithinPartitions(*keys)
    return _solved(dealt.select("kind", "block", "slice", "role", "t", "c", "n", "click_id"), window)
