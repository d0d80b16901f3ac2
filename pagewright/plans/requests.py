"""What a request to compare models answers: whole recognised documents against their texts, with totals and the best models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import evaluation as E


def evaluate_documents(results: DataFrame, truths: DataFrame, language: str) -> DataFrame:
    """One answer for each document that has a truth which is not blank.

    results: doc_id, model_ord, model, raw_text, avg_confidence, inference_time_ms, error; a row for each model that was run.
    truths: doc_id, filename, ground_truth. Gives filename, language, ground_truth, results (in the order of the models, with all
    metrics; those that failed score the worst), best_model_cer, best_model_wer, best_model_f1, models_run, total_time_ms.
    A document for which no model was run has an empty list, and no best model is 'N/A'.
    """
    c = F.col
    asked = truths.where(~T.blank(F.coalesce("ground_truth", F.lit(""))))
    pairs = asked.select("doc_id", "ground_truth").join(results, "doc_id").withColumnRenamed("raw_text", "predicted")
    scored = E.evaluate(pairs)
    shown = F.struct("model_ord", c("model").alias("model_name"), F.lit(language).alias("language"), F.coalesce("predicted", F.lit("")).alias("raw_text"), "inference_time_ms", "avg_confidence", F.struct(*M.METRICS).alias("metrics"), "error")
    best = lambda v: F.min(F.when(E.ok(), F.struct(v.alias("v"), c("model_ord").alias("o"), c("model")))).getField("model")
    hundredths = F.sum(F.round(c("inference_time_ms") * 100).cast("long"))
    answers = scored.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(shown)).alias("results"), best(c("cer")).alias("best_model_cer"), best(c("wer")).alias("best_model_wer"), best(-c("word_f1")).alias("best_model_f1"),
        F.count("*").alias("models_run"), (hundredths / 100).alias("total_time_ms"),
    )
    out = asked.join(answers, "doc_id", "left").withColumn("language", F.lit(language))
    out = out.withColumns({x: F.coalesce(x, F.lit("N/A")) for x in ("best_model_cer", "best_model_wer", "best_model_f1")})
    out = out.withColumns({"models_run": F.coalesce("models_run", F.lit(0).cast("long")), "total_time_ms": F.coalesce("total_time_ms", F.lit(0.0)), "results": F.coalesce("results", F.array().cast(answers.schema["results"].dataType))})
    return out.select("doc_id", "filename", "language", "ground_truth", "results", "best_model_cer", "best_model_wer", "best_model_f1", "models_run", "total_time_ms")


def batch_report(evaluated: DataFrame, key: list[str], filename: Column) -> DataFrame:
    """One entry for each image: its name, its truth, and the results of the models that did not fail, in their order; none may be left.

    evaluated: what `evaluation.evaluate` gives.
    """
    c = F.col
    shown = F.struct("model_ord", "model", "cer", "wer", "word_f1", "overall_accuracy", F.left("predicted", F.lit(200)).alias("raw_text"))
    return evaluated.groupBy(*key).agg(F.first(filename).alias("image"), F.first("ground_truth").alias("ground_truth"), F.array_sort(F.collect_list(F.when(E.ok(), shown))).alias("results"), F.count("*").alias("models_run"), (F.sum(F.round(c("inference_time_ms") * 100).cast("long")) / 100).alias("total_time_ms"))
