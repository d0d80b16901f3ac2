"""Detections: reading engine output, dropping noise, undoing scales, and per-page figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType
from pyspark.sql.window import Window

from ..config import Settings
from ..functions import geometry as G
from ..functions import text as T
from ..functions.metrics import round_at

PAGE = ["doc_id", "page_idx"]


def is_text_line(s: Settings = Settings()) -> Column:
    """Keeps boxes of enough area and height whose text is not blank; inverted boxes fail by themselves."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return (w * h >= s.min_box_area) & (h >= s.min_box_height) & ~T.blank(F.col("text"))


def filter_detections(detections: DataFrame, s: Settings = Settings()) -> DataFrame:
    return detections.where(is_text_line(s))


def geometry(detections: DataFrame) -> DataFrame:
    c = F.col
    return detections.withColumns({"width": c("x2") - c("x1"), "height": c("y2") - c("y1")}).withColumns({"area": c("width") * c("height"), "cx": (c("x1") + c("x2")) / 2, "cy": (c("y1") + c("y2")) / 2})


def rescale(detections: DataFrame, scale: str = "scale") -> DataFrame:
    return detections.withColumns({x: G.rescale(F.col(x), F.col(scale)) for x in ("x1", "y1", "x2", "y2")})


def parse_engine_output(payloads: DataFrame, key: list[str], payload: str = "payload", s: Settings = Settings()) -> DataFrame:
    """Reads both shapes of engine output, JSON text or a variant, into detections that pass the noise filter.

    A dictionary holds parallel lists, cut to the shortest; a list holds [polygon, [text, score]] rows, and malformed rows
    are skipped. ``det_ord`` is the place in the payload. Each payload is parsed once. What is no JSON gives no rows; a
    text may be any plain value, a score also a text that reads as a number; without them a row is skipped.
    """
    told = payloads if payloads.schema[payload].dataType == VariantType() else payloads.withColumn(payload, F.try_parse_json(payload))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    v = F.col(payload)
    one = lambda i, text, conf, poly: F.struct(i.cast("int").alias("det_ord"), get(text, "$", "string").alias("text"), get(conf, "$", "double").alias("conf"), get(poly, "$", "array<array<double>>").alias("poly"))
    texts, scores, first, second = (get(v, f"$.{x}", "array<variant>") for x in ("rec_texts", "rec_scores", "dt_polys", "rec_polys"))
    polys = F.when(F.size(first) > 0, first).otherwise(second)
    n = F.coalesce(F.least(F.size(texts), F.size(scores), F.size(polys)), F.lit(0))  # of a null list the size is null or below 0
    parallel = F.transform(F.slice(F.arrays_zip(texts.alias("t"), scores.alias("s"), polys.alias("p")), F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: one(i + 1, x["t"], x["s"], x["p"]))
    rows = F.transform(get(v, "$", "array<variant>"), lambda r, i: one(i + 1, get(r, "$[1][0]", "variant"), get(r, "$[1][1]", "variant"), get(r, "$[0]", "variant")))
    flat = told.select(*key, F.explode(F.coalesce(rows, parallel)).alias("d")).select(*key, "d.det_ord", "d.text", "d.conf", G.poly_to_bbox(F.col("d.poly")).alias("b"))
    flat = flat.where(F.col("text").isNotNull() & F.col("conf").isNotNull())
    return filter_detections(flat.select(*key, "det_ord", "text", "conf", *(F.col("b")[k].alias(x) for k, x in enumerate(("x1", "y1", "x2", "y2")))), s)


def folded_sum(order: str, value: str) -> Column:
    """Sum in the order of a column, which the order of rows in a shuffle cannot change."""
    return in_order(F.sort_array(F.collect_list(F.struct(order, value))), value)


def in_order(rows: Column, value: str) -> Column:
    """Sum of a field of an array's structs, from the first to the last."""
    return F.aggregate(rows, F.lit(0.0), lambda a, x: a + x[value])


def page_score(detections: DataFrame, pages: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """Sum of confidences of each page's detections; 0 for a page that has none."""
    sums = detections.groupBy(*key).agg(folded_sum("det_ord", "conf").alias("page_score"))
    return pages.join(sums, key, "left").select(*pages.columns, round_at(F.coalesce("page_score", F.lit(0.0)), 6).alias("page_score"))


def avg_confidence(detections: DataFrame, key: list[str] = PAGE, pages: DataFrame | None = None) -> DataFrame:
    """n_lines and mean confidence of each key; with ``pages``, 0 and 0.0 for those that have no lines."""
    total = folded_sum("det_ord", "conf")
    found = detections.groupBy(*key).agg((total / F.count("*")).alias("a"), F.count("*").alias("n_lines"))
    if pages is not None:
        found = pages.select(*key).join(found, key, "left").na.fill({"a": 0.0, "n_lines": 0})
    return found.select(*key, "n_lines", round_at(F.col("a"), 4).alias("avg_confidence"))


def median_height(s: Settings = Settings(), over=None) -> Column:
    """Median of positive box heights; the default where there are fewer than three boxes or none is positive. Of a group, or over a window."""
    h = F.col("y2") - F.col("y1")
    n, middle = F.count("*"), F.percentile(F.when(h > 0, h), F.lit(0.5))
    if over is not None:
        n, middle = n.over(over), middle.over(over)
    return F.when(n < 3, F.lit(float(s.band_tolerance))).otherwise(F.coalesce(middle, F.lit(float(s.band_tolerance))))


def middle_height(heights: Column, s: Settings = Settings()) -> Column:
    """`median_height` of an array of heights."""
    tall = F.sort_array(F.filter(heights, lambda h: h > 0))
    middle = T.let(tall, lambda t: (F.get(t, ((F.size(t) - 1) / 2).cast("int")) + F.get(t, (F.size(t) / 2).cast("int"))) / 2)
    return F.when(F.size(heights) < 3, F.lit(float(s.band_tolerance))).otherwise(F.coalesce(middle, F.lit(float(s.band_tolerance))))


def median_box_height(detections: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    return detections.groupBy(*key).agg(median_height(s).alias("median_height"))


def overlaps_next(key: list[str]) -> Column:
    """Whether a box overlaps the next one from the top by more than 0.3 of the lower height."""
    w = Window.partitionBy(*key).orderBy("y1", "det_ord")
    y1, y2 = F.lead("y1").over(w), F.lead("y2").over(w)
    inter = F.greatest(F.lit(0), F.least(F.col("y2"), y2) - F.greatest(F.col("y1"), y1))
    low = F.least(F.col("y2") - F.col("y1"), y2 - y1)
    return F.coalesce(y1.isNotNull() & (low > 0) & (inter / F.when(low > 0, low) > 0.30), F.lit(False))


def vertical_overlap(detections: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """Share of neighbouring boxes that overlap, over the pages with two boxes or more."""
    marked = detections.withColumn("over", overlaps_next(key).cast("int"))
    return marked.groupBy(*key).agg(F.count("*").alias("n_lines"), F.sum("over").alias("n_overlaps")).where("n_lines > 1").withColumn("overlap_ratio", F.col("n_overlaps") / (F.col("n_lines") - 1))


def overlay_labels(detections: DataFrame) -> DataFrame:
    """'[confidence] beginning of the text'. Two decimals by the exact binary value of the confidence, which is between 0 and 1."""
    one = 1 << 60
    hundredths = F.expr(f"cast(cast(conf * {one}D as bigint) as decimal(20,0)) * 100")
    whole = F.expr(f"cast(cast(conf * {one}D as bigint) as decimal(20,0)) * 100 div {one}")
    twice = (hundredths - whole.cast("decimal(10,0)") * F.lit(one).cast("decimal(20,0)")) * 2
    n = whole + F.when((twice > one) | ((twice == one) & (whole % 2 == 1)), 1).otherwise(0)
    return detections.withColumn("label", F.format_string("[%d.%02d] %s", F.floor(n / 100), n % 100, F.left("text", F.lit(40))))
