"""Pages as single rows: order, corrected texts, reasons and documents are those found line by line."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.config import Settings
from pagewright.functions import reading as R
from pagewright.functions import text as T
from pagewright.operators import layout as L
from pagewright.operators import scoring as S
from pagewright.plans import fixtures as X
from pagewright.plans import pipelines as P


def test_order_of_many_pages(spark):
    rng, rows = random.Random(15), []
    for page in range(60):
        for k in range(rng.choice((1, 2, 5, 6, 7, 12, 40))):
            x1, y1 = rng.choice((0, 10, 10, 200)) + rng.randrange(5), rng.randrange(-5, 120)
            rows.append((page, 0, k, x1, y1, x1 + rng.randrange(0, 90), y1 + rng.randrange(-2, 30)))
    lines = spark.createDataFrame(rows, "doc_id long, page_idx int, det_ord int, x1 int, y1 int, x2 int, y2 int")
    page, _, det_ord, x1, y1, x2, y2 = (np.array(v) for v in zip(*rows))
    for language, order in (("ar", R.rtl_order), ("en", R.ltr_order)):
        got = order(page, x1, y1, x2, y2, det_ord, Settings())
        told = L.reading_order(lines, language).orderBy("doc_id", "read_ord").select("doc_id", "det_ord").collect()
        assert [(int(page[k]), int(det_ord[k])) for k in got] == [tuple(r) for r in told]
    over = np.bincount(R.overlaps(page, y1, y2, det_ord), minlength=60)
    told = lines.withColumn("o", S.overlaps_next(["doc_id"]).cast("int")).groupBy("doc_id").agg(F.sum("o").alias("o")).collect()
    assert {r.doc_id: r.o for r in told} == dict(enumerate(over.tolist()))


def test_corrected_lists(spark):
    rng = random.Random(16)
    signs = "abé  \t,;بومـََ​ ﻛ…é ’ł\U0001f600²\u0000"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(2000)] + ["plain text", "two  blanks", " led", "ended ", "", " ", "ب ب بم", "café ’"]
    df = spark.createDataFrame([(k, texts[k : k + 7]) for k in range(0, len(texts), 7)], "k int, l array<string>")
    for isolated in (True, False):
        rows = df.withColumn("f", F.explode(F.array(T.normal_forms(F.col("l"))))).select("k", F.posexplode(F.arrays_zip("l", T.arabic_corrected(F.col("l"), F.col("f"), True, isolated).alias("got"))).alias("i", "z")).select("z.*")
        told = rows.select("l", "got", T.arabic_correct(F.col("l"), True, isolated).alias("told")).collect()
        assert len(told) == len(texts)
        assert not [r for r in told if r.got != r.told]


def test_pages_and_documents(spark, sf):
    """Two pages a document, lines that correction empties, pages without lines, pages that nobody ran."""
    c = F.col
    passes = X.passes(spark, sf).drop(S.LINE_FACTS).where("doc_id < 60").withColumns({
        "page_idx": (c("det_ord") % 2).cast("int"), "text": F.when(c("det_ord") % 5 == 1, "​‍").when(c("det_ord") % 7 == 3, F.concat(F.lit("بََ ﻛ"), "text")).otherwise(c("text")),
    }).where("page_idx = 0 OR doc_id % 4 <> 1")
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    pages = X.pages(spark, sf).where("doc_id < 60").withColumn("page_idx", two)
    planned = X.planned(spark, sf).where("doc_id < 55").withColumn("page_idx", two)
    for run in (planned, None):
        kept = P.kept_lines(passes)
        best = P.best_of_sides(kept, "ar", True, planned=run)
        lines = P.lines_of(kept, best.select(*P.SIDE, "variant", "engine"))
        ordered = L.reading_order(P.with_corrected(lines, "ar"), "ar", P.SIDE)
        told = ordered.groupBy(*P.SIDE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("read_ord", "text_corrected"))), lambda x: x["text_corrected"]), "\n").alias("t"))
        expected = {tuple(r[:3]): r.t for r in told.collect()}
        reasons = {tuple(r[:2]): r.reasons for r in S.fallback_reasons(lines.where("NOT alternate"), pages).collect()}
        found = P.page_diagnostics(passes, pages, "ar", alternate=True, planned=run).collect()
        assert len(found) == 2 * 60 and len(expected) > 60
        for r in found:
            assert r.primary_response_corrected_text == expected.get((r.doc_id, r.page_idx, False), "")
            assert r.alt_response_corrected_text == expected.get((r.doc_id, r.page_idx, True), "")
            assert r.fallback_reasons == reasons[(r.doc_id, r.page_idx)]
        assert {r.selected_engine for r in found} >= {"v5"}
        whole = P.recognised_documents(passes, "ar", True, pages=pages, planned=run)
        made = P.diagnosed_documents(passes, pages, "ar", True, planned=run)
        assert sorted(map(tuple, made.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
        assert all(len(r.page_diagnostics) == 2 for r in made.collect())


def test_texts_move_once(spark, sf):
    """Lines are dealt out by document and from there on stay with their page: nothing sorts or moves them as rows."""
    plan = P.page_texts(P.kept_lines(X.passes(spark, sf)), X.pages(spark, sf), "ar", True, planned=X.planned(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("posexplode(split(") == 1
    above = plan[: plan.index("posexplode(split(")]
    assert above.count("REPARTITION_BY_COL") == 1
