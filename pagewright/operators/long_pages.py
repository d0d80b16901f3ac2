"""Right-to-left reading order of pages that no task should hold whole: the same rows as `layout`, by sorts in ranges and counts.

A band begins at its first line's centre and ends where a centre is ``tolerance`` or more below. Lines are sorted once, in
ranges. What goes on in a range depends on what comes before only by the height from which the next band may begin, and only
the centres within one tolerance of the range's first can be that band's first. So each range tells, for these, where its last
band ends and how many bands it opens; a walk over the ranges gives each its beginning, and a second look at the ranges
numbers the bands. No column of lines, band or page is in one task; what is broadcast is a few figures of each long page.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..config import Settings
from .detections import PAGE
from .layout import _split, reading_order_rtl
from .scans import checkpointed, in_ranges, radix_median, ranked

#: Lines from which a page counts as long.
LONG_PAGE = 1_000_000
#: Long pages up to which their figures are broadcast.
FEW = 100_000


def page_medians(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings(), small: bool = False) -> DataFrame:
    """Like `detections.median_box_height`, by counts of digits: key, median_height."""
    heights = detections.withColumn("_h", F.when(F.col("y2") > F.col("y1"), F.col("y2") - F.col("y1")).cast("int"))
    n = heights.groupBy(*key).agg(F.count("*").alias("_lines"))
    found = n.join(radix_median(heights, key, "_h", small), key, "left")
    height = F.when(F.col("_lines") < 3, F.lit(float(s.band_tolerance))).otherwise(F.coalesce("median", F.lit(float(s.band_tolerance))))
    return found.select(*key, height.alias("median_height"))


def widest_gaps(detections: DataFrame, key: list[str]) -> DataFrame:
    """Per page n_lines, page_width, w (the first of the largest gaps of neighbouring centres, with its middle)."""
    centres = detections.groupBy(*key, (F.col("x1") + (F.col("x2") - F.col("x1")) / 2).alias("cx")).agg(F.count("*").alias("n"), F.max("x2").alias("x2"))
    placed = checkpointed(ranked(centres, [*key, "cx"], "at"))
    before = placed.select(*key, (F.col("at") + 1).alias("at"), F.col("cx").alias("before"))
    # lines of the same centre have no gap, which is the largest only where all have the same
    gap = F.coalesce(F.col("cx") - F.col("before"), F.when(F.col("n") > 1, 0.0))
    met = placed.join(before, [*key, "at"], "left")
    widest = F.max(F.struct(gap.alias("gap"), (-F.col("at")).alias("first"), ((F.col("cx") + F.coalesce("before", "cx")) / 2).alias("middle")))
    return met.groupBy(*key).agg(F.sum("n").alias("n_lines"), F.max("x2").alias("page_width"), widest.alias("w"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range (range, group, cy, tol), for what may come before: where its last band ends, and the bands it opens.

    One row for each run of centres that can be the first group's first band here and lead to the same, named by its last, and
    one for the last group, if that is another.
    """
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    part, (group, cy, tol) = int(parts[0][0][0]), (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    found = []
    for g in sorted({int(group[0]), int(group[-1])}):
        at = slice(*np.searchsorted(group, [g, g + 1]))
        u, reach = np.unique(cy[at]), int(tol[at.start])
        follows, last, opened = np.append(np.searchsorted(u, u + reach), len(u)), np.arange(len(u) + 1), np.append(np.ones(len(u), dtype=np.int64), 0)
        while (on := follows < len(u)).any():  # each round takes twice as many bands at a time
            last, opened, follows = np.where(on, last[follows], last), opened + opened[follows], follows[follows]
        entries = np.arange(min(len(u), int(np.searchsorted(u, u[0] + reach)) + 1)) if g == group[0] else np.zeros(1, dtype=np.int64)
        ends = np.append((np.diff(last[entries]) != 0) | (np.diff(opened[entries]) != 0), True)
        found += [(part, g, float(u[e]), float(u[last[e]]) + reach, int(opened[e])) for e in entries[ends]]
    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["range", "group", "entry", "leaves", "opened"])


def _beginnings(steps: list) -> dict[int, tuple[int, float, int]]:
    """Per range the group that comes into it, the height from which its next band may begin, and its bands so far."""
    of: dict[int, list] = {}
    for r in sorted(steps):
        of.setdefault(r["range"], []).append(r)
    state, out = (-1, -math.inf, 0), {}
    for part, rows in of.items():
        first, last = rows[0]["group"], rows[-1]
        out[part] = state
        _, height, bands = state if state[0] == first else (first, -math.inf, 0)
        if last["group"] != first:
            state = (last["group"], last["leaves"], last["opened"])
        else:
            step = next((r for r in rows if r["entry"] >= height), None)  # none: all of the range is in the band that comes in
            state = (first, step["leaves"], bands + step["opened"]) if step else (first, height, bands)
    return out


def banded(lines: DataFrame) -> DataFrame:
    """lines: _group (a number), cy, tol (one for a group), det_ord and others. Adds band, from 0 in each group."""
    placed = in_ranges(lines, ["_group", "cy", "det_ord"], "_range")
    steps = placed.select("_range", "_group", "cy", "tol").mapInArrow(_steps, "range int, group long, entry double, leaves double, opened long")
    beginnings = _beginnings(steps.collect())  # a few rows for each range
    names = placed.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            part, group, cy, tol = (batch.column(names.index(x)).to_numpy(zero_copy_only=False) for x in ("_range", "_group", "cy", "tol"))
            opens = np.zeros(len(cy), dtype=np.int32)
            bands = np.zeros(len(cy), dtype=np.int32)
            starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(cy)], strict=True):
                state = beginnings[int(part[i])] if state is None else state
                g, height, so_far = state if state[0] == group[i] else (int(group[i]), -math.inf, 0)
                here, reach = cy[i:j].tolist(), int(tol[i])
                at = bisect.bisect_left(here, height)
                while at < len(here):
                    opens[i + at] = 1
                    height = here[at] + reach
                    at = bisect.bisect_left(here, height, at + 1)
                bands[i:j] = so_far - 1 + np.cumsum(opens[i:j])
                state = (g, height, int(bands[j - 1]) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bands)], [*batch.schema.names, "band"])

    return placed.mapInArrow(number, StructType([*placed.schema.fields]).add("band", IntegerType())).drop("_range")


def _placed(detections: DataFrame, key: list[str], s: Settings, small: bool) -> DataFrame:
    """Adds col, band and cy, _page (a number) and _group (in the order of page and column)."""
    c = F.col
    split = _split(c("n_lines"), c("page_width"), c("w"), s)
    tol = F.greatest(F.lit(s.band_tolerance), (c("median_height") * 0.4).cast("int"))
    facts = widest_gaps(detections, key).join(page_medians(detections, key, s, small), key)
    facts = checkpointed(facts.select(*key, split.alias("split_x"), tol.alias("tol"), F.monotonically_increasing_id().alias("_page")))
    placed = detections.join(F.broadcast(facts) if small else facts, key).withColumn("cy", (c("y1") + c("y2")) / 2)
    placed = placed.withColumn("col", F.when(c("split_x").isNull() | ((c("x1") + c("x2")) / 2 >= c("split_x")), 0).otherwise(1))
    return banded(placed.withColumn("_group", c("_page") * 2 + c("col")).drop("split_x")).drop("tol")


def long_bands(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings(), small: bool = True) -> DataFrame:
    """Like `layout.line_bands`: adds col, band and cy. ``small``: the pages' figures may be broadcast."""
    rest = [x for x in detections.columns if x not in key]
    return _placed(detections, key, s, small).select(*key, *rest, "col", "band", "cy")


def long_reading_order(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings(), small: bool = True) -> DataFrame:
    """Like `layout.reading_order_rtl`."""
    c = F.col
    rest = [x for x in detections.columns if x not in key]
    placed = checkpointed(ranked(_placed(detections, key, s, small), ["_group", "band", F.desc("x1"), "cy", "det_ord"], "_place"))
    first = placed.groupBy("_page").agg(F.min("_place").alias("_first"))
    ordered = placed.join(F.broadcast(first) if small else first, "_page").withColumn("read_ord", (c("_place") - c("_first") + 1).cast("int"))
    return ordered.select(*key, *rest, "col", "band", "cy", "read_ord")


def reading_order_any(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings(), limit: int = LONG_PAGE) -> DataFrame:
    """`reading_order_rtl` for pages of any size: pages of more than ``limit`` lines go by sorts in ranges, others one to a task."""
    long = checkpointed(detections.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*key))
    many = long.count()
    if not many:
        return reading_order_rtl(detections, key, s)
    hint = F.broadcast if many <= FEW else lambda d: d
    ordered = reading_order_rtl(detections.join(hint(long), key, "left_anti"), key, s)
    lines = checkpointed(detections.join(hint(long), key, "left_semi"))
    return ordered.unionByName(long_reading_order(lines, key, s, many <= FEW).select(*ordered.columns))
