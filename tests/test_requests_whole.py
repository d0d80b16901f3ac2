"""The evaluate request and the batch report against plain Python, with failures, blank truths and documents that no model read."""

import random

from pyspark.sql import functions as F

from pagewright.functions import metrics as M
from pagewright.operators import evaluation as E
from pagewright.operators import overlap as O
from pagewright.plans import requests as R

RESULTS = "doc_id long, model_ord int, model string, raw_text string, avg_confidence double, inference_time_ms double, error string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_evaluate_documents(spark):
    rng = random.Random(3)
    words = ["one", "two", "three", "été", "x"]
    truths = {k: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(5)) for k in range(8)} | {8: " \n", 9: None, 10: "nobody read this"}
    rows = []
    for k in range(10):
        for m in range(3):
            text = (truths[k] or "").replace(rng.choice(words), "") if m else truths[k]
            rows.append((k, m, f"m{m}", text, 0.5, 1.25 + m, "boom" if k == 3 or (k, m) == (4, 0) else ""))
    asked = spark.createDataFrame([(k, f"{k}.png", t) for k, t in truths.items()], "doc_id long, filename string, ground_truth string")
    got = {r.doc_id: r for r in R.evaluate_documents(spark.createDataFrame(rows, RESULTS), asked, "fr").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 7, 10}  # a blank truth is refused
    assert got[10].results == [] and got[10].models_run == 0 and got[10].total_time_ms == 0.0 and got[10].best_model_cer == "N/A"
    assert [r.metrics.cer for r in got[3].results] == [1.0] * 3 and got[3].best_model_f1 == "N/A" and got[3].models_run == 3
    for k in (0, 1, 2, 4, 5, 6, 7):
        assert [r.model_name for r in got[k].results] == ["m0", "m1", "m2"] and got[k].total_time_ms == 6.75 and got[k].filename == f"{k}.png" and got[k].language == "fr"
        best = []
        for r in got[k].results:
            p, g = " ".join(r.raw_text.split()), " ".join(truths[k].split())
            if r.error:
                assert r.metrics.overall_accuracy == 0.0
                continue
            assert r.metrics.cer == round(distance(p, g) / len(g), 4) and r.metrics.wer == round(distance(p.split(), g.split()) / len(g.split()), 4) and r.metrics.exact_match == (p == g)
            best.append((r.metrics.cer, r.model_ord, r.model_name))
        assert got[k].best_model_cer == min(best)[2]


def test_batch_report_keeps_images_without_results(spark):
    rows = [(1, 0, "a", 0, "text", "text", None, 1.5), (1, 0, "b", 1, None, "text", "boom", 2.0), (2, 0, "a", 0, None, "other", "boom", 1.0)]
    pairs = spark.createDataFrame(rows, "doc_id long, line_no int, model string, model_ord int, predicted string, ground_truth string, error string, inference_time_ms double")
    got = {r.doc_id: r for r in R.batch_report(E.evaluate(pairs), ["doc_id", "line_no"], F.lit("f.png")).collect()}
    assert [r.model for r in got[1].results] == ["a"] and got[1].total_time_ms == 3.5 and got[1].image == "f.png"
    assert got[2].results == [] and got[2].ground_truth == "other" and got[2].models_run == 1


def test_overlap_is_that_of_pairs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdé ") for _ in range(rng.randrange(30))), " ".join(rng.choice("abé ") for _ in range(rng.randrange(30)))) for k in range(60)] + [(100, "a " * 5000, "a " * 4000), (101, "", "x"), (102, None, "x"), (103, "", "")]
    pairs = spark.createDataFrame(rows, "k int, predicted string, ground_truth string")
    names = [m for m in M.METRICS if m.startswith(("char_", "word_"))]
    found = O.overlap_metrics(pairs, ["k"])
    got = {r.k: tuple(r[m] for m in names) for r in found.collect()}
    plain = {r.k: tuple(r[m] for m in names) for r in M.compute_metrics(pairs.withColumn("predicted", F.coalesce("predicted", F.lit("")))).collect()}
    assert got == plain


def test_overlap_makes_no_row_for_a_token(spark):
    pairs = spark.createDataFrame([(1, "a b", "b c")], "k int, predicted string, ground_truth string")
    plan = O.overlap_metrics(pairs, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan and "Aggregate" not in plan  # the one is over an array of one
