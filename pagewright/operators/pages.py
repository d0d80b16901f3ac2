"""Pages of documents as rows, their variants, and drawings of what was found. One page at a time is held in a worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import images as I
from .detections import PAGE

#: Bytes of pixels from which variants are handed on.
TOGETHER = 1 << 20
PIXELS = "width int, height int, n_channels int, data binary"
PAGES = f"doc_id string, page_idx int, {PIXELS}, roi_warp_applied boolean, roi_warp_reason string, error string"
VARIANTS = f"doc_id string, page_idx int, variant_ord int, variant string, scale double, effective_scale double, {PIXELS}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_PIXELS = [("width", pa.int32()), ("height", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())]


def pixels(image: np.ndarray) -> tuple[int, int, int, bytes]:
    return image.shape[1], image.shape[0], 3, np.ascontiguousarray(image).tobytes()


def array_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def explode_pages(documents: DataFrame, warp: bool = False, least_share: float = 0.15, margin: float = 0.02) -> DataFrame:
    """documents: doc_id, content. A row for each page, cut out of its picture if ``warp``; one with an error for a document that cannot be read or has no page."""
    schema = pa.schema([("doc_id", pa.string()), ("page_idx", pa.int32()), *_PIXELS, ("roi_warp_applied", pa.bool_()), ("roi_warp_reason", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = I.read_pages(content.as_py() or b"")
                except Exception as e:  # noqa: BLE001  whatever a reader says about bytes it cannot read
                    yield _batch([(doc_id, None, None, None, None, None, None, None, str(e) or type(e).__name__)], schema)
                    continue
                for k, image in enumerate(found):
                    page, reason = I.cut_out(image, warp, least_share, margin)
                    yield _batch([(doc_id, k, *pixels(page), reason == "ok", reason, None)], schema)

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, PAGES)


def page_variants(pages: DataFrame, language: str, s: Settings = Settings()) -> DataFrame:
    """Each page in each of its variants, as engines get it: no side above the limit, and the scale that this makes."""
    schema = pa.schema([("doc_id", pa.string()), ("page_idx", pa.int32()), ("variant_ord", pa.int32()), ("variant", pa.string()), ("scale", pa.float64()), ("effective_scale", pa.float64()), *_PIXELS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0  # small pages leave together
        for batch in batches:
            for row in batch.to_pylist():
                for k, (name, scale, image) in enumerate(I.variants(array_of(row), language, s.high_dpi)):
                    small, down = I.capped(image, s.side_limit)
                    out.append((row["doc_id"], row["page_idx"], k, name, scale, scale * down, *pixels(small)))
                    held += small.size
                    if held >= TOGETHER:
                        yield _batch(out, schema)
                        out, held = [], 0
        if out:
            yield _batch(out, schema)

    rows = pages.where("data is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", "width", "height", "n_channels", "data")
    return rows.mapInArrow(run, VARIANTS)


def skew_angles(pages: DataFrame) -> DataFrame:
    """doc_id, page_idx, skew in degrees: what the planning of variants asks for."""
    schema = pa.schema([("doc_id", pa.string()), ("page_idx", pa.int32()), ("skew", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(r["doc_id"], r["page_idx"], I.skew(I.grey(array_of(r)))) for r in batch.to_pylist()], schema)

    rows = pages.where("data is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", "width", "height", "n_channels", "data")
    return rows.mapInArrow(run, "doc_id string, page_idx int, skew double")


def drawings(pages: DataFrame, lines: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """doc_id, page_idx, name, png: each page with the boxes of its lines, and a sheet of its variants. Labels are columns of `overlay_labels`, not drawn."""
    schema = pa.schema([("doc_id", pa.string()), ("page_idx", pa.int32()), ("name", pa.string()), ("png", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = [(r["doc_id"], r["page_idx"], "stage4_results", I.write_png(I.with_boxes(array_of(r), [tuple(b.values()) for b in r["boxes"] or []])))]
                if r["variants"]:
                    sheet = I.contact_sheet([array_of(v) for v in sorted(r["variants"], key=lambda v: v["variant_ord"])])
                    out.insert(0, (r["doc_id"], r["page_idx"], "stage1_variants", I.write_png(sheet)))
                yield _batch(out, schema)

    found = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("boxes"))
    met = pages.where("data is not null").select(*PAGE, "width", "height", "n_channels", "data").join(found, PAGE, "left")
    if variants is None:
        met = met.withColumn("variants", F.lit(None).cast("array<struct<variant_ord:int,width:int,height:int,n_channels:int,data:binary>>"))
    else:
        met = met.join(variants.groupBy(*PAGE).agg(F.collect_list(F.struct("variant_ord", "width", "height", "n_channels", "data")).alias("variants")), PAGE, "left")
    return met.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", "width", "height", "n_channels", "data", "boxes", "variants").mapInArrow(run, "doc_id string, page_idx int, name string, png binary")
