"""Layout, scoring and detections against plain loops."""

import itertools
import random
import statistics

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import detections as D
from pagewright.operators import layout as L
from pagewright.operators import scoring as S
from pagewright.schemas import DETECTIONS


def page(rng, doc):
    n = rng.randrange(0, 25)
    out = []
    for k in range(n):
        x, y = rng.choice((10, 500)) + rng.randrange(40), rng.randrange(200)
        out.append((doc, 0, k, f"t{k}", rng.random(), x, y, x + rng.randrange(20, 60), y + rng.randrange(5, 60)))
    return out


def rtl(lines):
    heights = [b[8] - b[6] for b in lines if b[8] > b[6]]
    median = statistics.median(heights) if len(lines) >= 3 and heights else 15.0
    tol = max(15, int(median * 0.4))
    columns = [lines]
    if len(lines) >= 6:
        centres = sorted(b[5] + (b[7] - b[5]) / 2 for b in lines)
        gap, at = max(((b - a, -k) for k, (a, b) in enumerate(itertools.pairwise(centres))))
        if gap / max(b[7] for b in lines) >= 0.1:
            split = (centres[-at] + centres[-at + 1]) / 2
            columns = [[b for b in lines if (b[5] + b[7]) / 2 >= split], [b for b in lines if (b[5] + b[7]) / 2 < split]]
    order = []
    for column in columns:
        bands = []
        for b in sorted(column, key=lambda b: (b[6] + b[8]) / 2):
            cy = (b[6] + b[8]) / 2
            if not bands or abs(cy - bands[-1][0]) >= tol:
                bands.append((cy, []))
            bands[-1][1].append(b)
        for _, band in bands:
            order += [b[2] for b in sorted(band, key=lambda b: b[5], reverse=True)]
    return order


def test_right_to_left(spark):
    rng = random.Random(1)
    pages = {k: page(rng, k) for k in range(150)}
    df = spark.createDataFrame([b for p in pages.values() for b in p], DETECTIONS)
    got = {}
    for r in L.reading_order_rtl(df).orderBy("doc_id", "read_ord").collect():
        got.setdefault(r.doc_id, []).append(r.det_ord)
    assert got == {k: rtl(p) for k, p in pages.items() if p}


def test_bands_keep_their_anchor(spark):
    lines = [(1, 0, k, "t", 1.0, 0, y, 10, y) for k, y in enumerate((0, 10, 14, 16, 29, 31))]
    rows = L.line_bands(spark.createDataFrame(lines, DETECTIONS)).orderBy("det_ord").collect()
    assert [r.band for r in rows] == [0, 0, 0, 1, 1, 2]


def test_filter_and_figures(spark):
    rows = [(1, 0, 0, "ok", 0.5, 0, 0, 20, 10), (1, 0, 1, "  ", 0.5, 0, 0, 20, 10), (1, 0, 2, "flat", 0.5, 0, 0, 200, 7), (1, 0, 3, "small", 0.5, 0, 0, 10, 14), (1, 0, 4, "turned", 0.5, 20, 10, 0, 0)]
    kept = D.filter_detections(spark.createDataFrame(rows, DETECTIONS))
    assert [r.text for r in kept.collect()] == ["ok"]
    assert D.median_box_height(kept).first().median_height == 15.0
    pages = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, page_idx int")
    assert {r.doc_id: r.page_score for r in D.page_score(kept, pages).collect()} == {1: 0.5, 2: 0.0}
    reasons = {r.doc_id: r.reasons for r in S.fallback_reasons(kept, pages).collect()}
    assert reasons[2] == ["empty_primary_result"] and reasons[1][:2] == ["low_line_count<4", "low_char_count<80"] and reasons[1][-1] == "low_median_box_height<16px(got 15.0px)"


def test_ties_of_passes(spark):
    scored = spark.createDataFrame([(1, 0, "v5", 0, "clahe", 2, 1.0), (1, 0, "v5", 0, "original", 0, 1.0), (1, 0, "v3", 1, "original", 0, 1.0), (2, 0, "v5", 0, "original", 0, 0.0)], "doc_id long, page_idx int, engine string, engine_ord int, variant string, variant_ord int, score double")
    got = {r.doc_id: (r.variant, r.engine) for r in S.select_best_pass(scored).collect()}
    assert got == {1: ("original", "v5"), 2: ("original", "v5")}
    best = S.select_best_pass(scored)
    higher = best.withColumn("score", F.col("score") * 1.03).withColumn("engine", F.lit("alt"))
    assert not any(r.replaced for r in S.replace_with_margin(best, higher).collect())


def test_punctuation_turns_forwards(spark):
    def loop(s):
        out = list(s)
        for k, c in enumerate(out):
            near = (k and "؀" <= out[k - 1] <= "ۿ") or (k + 1 < len(out) and "؀" <= out[k + 1] <= "ۿ")
            if c in ",;?" and near:
                out[k] = {",": "،", ";": "؛", "?": "؟"}[c]
        return "".join(out)

    cases = ["".join(c) for n in range(6) for c in itertools.product(",; bا", repeat=n)]
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", T.arabic_punct(F.col("s")).alias("v"))
    assert all(r.v == loop(r.s) for r in df.collect())


def test_arabic_correct(spark):
    cases = {"  ": "  ", "": "", " ﻛــ ": "ك", "ا‌,b": "ا،b", "ًًا": "ًا"}
    df = spark.createDataFrame([(c,) for c in cases], "s string").select("s", T.arabic_correct(F.col("s"), isolated=False).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases
