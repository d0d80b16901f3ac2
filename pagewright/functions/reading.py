"""Reading order of many pages at once: the lines of all pages stand one page after the other in arrays.

What is found is what `operators.layout` finds with windows over rows; here each page is one row with its lines, so no line is
sorted or moved as a row of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..config import Settings

PLACES = ArrayType(IntegerType())


def ltr_order(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, det_ord: np.ndarray, s: Settings) -> np.ndarray:
    return np.lexsort((det_ord, x1, y1 + y2, page))


def rtl_order(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, det_ord: np.ndarray, s: Settings) -> np.ndarray:
    """Places of the lines by page (ascending numbers), column, band, from the right, height. All are whole numbers."""
    n = len(page)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(page, prepend=page[0] - 1))
    count = np.diff(np.append(first, n))
    g = np.repeat(np.arange(len(first)), count)

    # columns: the first of the widest gaps between centres
    cx = x1 + (x2 - x1) / 2
    c = cx[np.lexsort((det_ord, cx, g))]
    gap = np.diff(c, prepend=0.0)
    gap[first] = -np.inf
    widest = np.maximum.reduceat(gap, first)
    at = np.flatnonzero(gap == widest[g])
    after = np.zeros(len(first), np.int64)
    after[g[at][::-1]] = at[::-1]
    width = np.maximum.reduceat(x2, first)
    split = np.full(len(first), -np.inf)
    may = np.flatnonzero((count >= 6) & (width != 0))
    may = may[widest[may] / width[may] >= s.column_gap_ratio]
    split[may] = (c[after[may]] + c[after[may] - 1]) / 2
    group = 2 * g + ((x1 + x2) / 2 < split[g])

    # bands: from one first line to the next, in all columns by turns
    tall = np.flatnonzero(y2 > y1)
    h = (y2 - y1)[tall]
    h = h[np.lexsort((h, g[tall]))]
    k = np.bincount(g[tall], minlength=len(first))
    begin = np.cumsum(k) - k
    height = np.full(len(first), float(s.band_tolerance))
    known = np.flatnonzero((count >= 3) & (k > 0))
    height[known] = 0.5 * h[(begin + (k - 1) // 2)[known]] + 0.5 * h[(begin + k // 2)[known]]
    reach = 2 * np.maximum(s.band_tolerance, (height * 0.4).astype(np.int64))
    twice = y1 + y2
    by = np.lexsort((det_ord, twice, group))
    of, low = group[by], int(twice.min())
    span = int(twice.max()) - low + int(reach.max()) + 1
    key, reach = of * span + (twice[by] - low), reach[g[by]]
    opens = np.zeros(n, np.int64)
    at = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
    while len(at):
        to = np.searchsorted(key, key[at] + reach[at])
        inside = to < n
        inside[inside] = of[to[inside]] == of[at[inside]]
        at = to[inside]
        opens[at] = 1
    band = np.empty(n, np.int64)
    band[by] = np.cumsum(opens)
    return np.lexsort((det_ord, twice, -x1, band, group))


def overlaps(page: np.ndarray, y1: np.ndarray, y2: np.ndarray, det_ord: np.ndarray) -> np.ndarray:
    """Pages (one for each) of lines that overlap the next one from the top by more than 0.3 of the lower height."""
    by = np.lexsort((det_ord, y1, page))
    page, y1, y2 = page[by], y1[by], y2[by]
    inter = np.maximum(0, np.minimum(y2[:-1], y2[1:]) - np.maximum(y1[:-1], y1[1:]))
    low = np.minimum((y2 - y1)[:-1], (y2 - y1)[1:])
    pairs = np.flatnonzero((page[:-1] == page[1:]) & (low > 0))
    return page[pairs[inter[pairs] / low[pairs] > 0.30]]


def reading_places(lines: Column, language: str, s: Settings = Settings()) -> Column:
    """lines: arrays of structs with alternate, det_ord, x1, y1, x2, y2, gone, in the order of the first two; one array a page.

    Gives ``all`` and ``kept``: places, from 0, of all lines and of those that are not gone, those of the primary side first, each
    side in reading order; and ``over``: how many of the primary side's lines overlap the next one.
    """
    order = rtl_order if language == "ar" else ltr_order

    @F.arrow_udf(StructType([StructField("all", PLACES), StructField("kept", PLACES), StructField("over", IntegerType())]))
    def run(pages: pa.Array) -> pa.Array:
        lengths = pc.list_value_length(pages).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pages.flatten()
        side, det_ord, gone, *box = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("alternate", "det_ord", "gone", "x1", "y1", "x2", "y2"))
        start = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), lengths)
        page = 2 * owner + side

        def listed(chosen: np.ndarray) -> pa.Array:
            places = chosen[order(page[chosen], *(b[chosen] for b in box), det_ord[chosen], s)]
            many = np.bincount(owner[chosen], minlength=len(lengths))
            ends = np.append(0, np.cumsum(many)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array((places - start[owner[places]]).astype(np.int32)))

        every = listed(np.arange(len(page)))
        kept = listed(np.flatnonzero(gone == 0)) if gone.any() else every
        first = np.flatnonzero(side == 0)
        over = np.bincount(overlaps(owner[first], box[1][first], box[3][first], det_ord[first]), minlength=len(lengths))
        return pa.StructArray.from_arrays([every, kept, pa.array(over.astype(np.int32))], names=["all", "kept", "over"])

    return run(lines)
