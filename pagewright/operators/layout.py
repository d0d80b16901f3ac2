"""Reading order of a page's lines: top to bottom, or right to left with columns and bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from ..config import Settings
from .detections import PAGE, median_height


def reading_order_ltr(detections: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """Adds read_ord, from 1: by centre height, then left edge."""
    w = Window.partitionBy(*key).orderBy((F.col("y1") + F.col("y2")) / 2, "x1", "det_ord")
    return detections.withColumn("read_ord", F.row_number().over(w))


def _with_gaps(detections: DataFrame, key: list[str]) -> DataFrame:
    """Adds cx, a line's place `at` among the centres of its page, the centre `before` it, and the gap to that."""
    w = Window.partitionBy(*key).orderBy("cx", "det_ord")
    centred = detections.withColumn("cx", F.col("x1") + (F.col("x2") - F.col("x1")) / 2)
    return centred.withColumns({"at": F.row_number().over(w), "before": F.lag("cx").over(w)}).withColumn("gap", F.col("cx") - F.col("before"))


def _widest() -> Column:
    """The first of the largest gaps of a page, with its middle."""
    return F.max(F.struct("gap", (-F.col("at")).alias("first"), ((F.col("cx") + F.col("before")) / 2).alias("middle")))


def _split(n_lines: Column, width: Column, widest: Column, s: Settings) -> Column:
    """Where a page is split in two columns; null for one, as with fewer than six lines or a gap under a tenth of the width."""
    wide = (n_lines >= 6) & (width != 0) & (widest["gap"] / F.when(width != 0, width) >= s.column_gap_ratio)
    return F.when(wide, widest["middle"])


def detect_columns(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    """Per page n_lines, page_width, the largest gap between neighbouring centres, and split_x (null: one column)."""
    pages = _with_gaps(detections, key).groupBy(*key).agg(F.count("*").alias("n_lines"), F.max("x2").alias("page_width"), _widest().alias("w"))
    return pages.select(*key, "n_lines", "page_width", F.col("w.gap").alias("max_gap"), _split(F.col("n_lines"), F.col("page_width"), F.col("w"), s).alias("split_x"))


@F.pandas_udf(ArrayType(IntegerType()))
def bands_of(centres: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Numbers the bands of ascending centres: a line opens a band if its centre is `tolerance` or more from the band's first line.

    The anchor stays with that first line, so bands are not a matter of neighbours; from one anchor the next is searched.
    """

    def one(cy: np.ndarray, reach: int) -> np.ndarray:
        opens = np.zeros(len(cy), dtype=np.int32)
        at = int(np.searchsorted(cy, cy[0] + reach)) if len(cy) else 0
        while at < len(cy):
            opens[at] = 1
            at = max(at + 1, int(np.searchsorted(cy, cy[at] + reach)))
        return np.cumsum(opens, dtype=np.int32)

    return pd.Series([one(np.asarray(c, dtype=np.float64), t) for c, t in zip(centres, tolerance, strict=True)])


def line_bands(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    """Adds col (0: right or only column), band within it, and cy to every line. One task holds one page, and lines move once."""
    c, page = F.col, Window.partitionBy(*key)
    facts = [F.count("*").over(page).alias("n_lines"), F.max("x2").over(page).alias("page_width"), _widest().over(page).alias("widest"), median_height(s, page).alias("height")]
    seen = _with_gaps(detections, key).select(*detections.columns, F.struct(*facts).alias("_page"))
    split = _split(c("_page.n_lines"), c("_page.page_width"), c("_page.widest"), s)
    placed = seen.withColumns({"cy": (c("y1") + c("y2")) / 2, "tol": F.greatest(F.lit(s.band_tolerance), (c("_page.height") * 0.4).cast("int")), "split_x": split})
    placed = placed.withColumn("col", F.when(c("split_x").isNull() | ((c("x1") + c("x2")) / 2 >= c("split_x")), 0).otherwise(1))
    rest = [x for x in detections.columns if x not in key]
    pages = placed.groupBy(*key, "col").agg(F.first("tol").alias("tol"), F.array_sort(F.collect_list(F.struct("cy", "det_ord", *(x for x in rest if x != "det_ord")))).alias("lines"))
    numbered = pages.withColumn("bands", bands_of(F.transform("lines", lambda x: x["cy"]), c("tol")))
    return numbered.select(*key, "col", F.posexplode("lines").alias("i", "l"), "bands").select(*key, *(c(f"l.{x}").alias(x) for x in rest), "col", F.get("bands", c("i")).alias("band"), c("l.cy").alias("cy"))


def reading_order_rtl(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    """Adds read_ord, from 1: right column first, bands from the top, lines of a band from the right, equals by height."""
    w = Window.partitionBy(*key).orderBy("col", "band", F.desc("x1"), "cy", "det_ord")
    return line_bands(detections, key, s).withColumn("read_ord", F.row_number().over(w))


def reading_order(detections: DataFrame, language: str, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    if language == "ar":
        return reading_order_rtl(detections, key, s).drop("col", "band", "cy")
    return reading_order_ltr(detections, key)


def assemble_pages(ordered: DataFrame, key: list[str] = PAGE, text: str = "text") -> DataFrame:
    """Lines joined by line feeds in reading order; lines whose text is empty are left out."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("read_ord", F.col(text).alias("t")))), lambda x: x["t"])
    return ordered.groupBy(*key).agg(F.array_join(F.filter(lines, lambda t: t != ""), "\n").alias("page_text"))


def assemble_documents(pages: DataFrame, document: str = "doc_id", page: str = "page_idx") -> DataFrame:
    """Pages joined by blank lines in page order; empty pages are left out."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(page, "page_text"))), lambda x: x["page_text"])
    return pages.groupBy(document).agg(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n").alias("doc_text"))
