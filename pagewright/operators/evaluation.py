"""Comparison of predictions with ground truth: pairing, metrics, error rows, summaries, the best model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T


def ground_truth_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Non-blank lines of each text, stripped, numbered from 0 after blank ones have gone."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda t: T.strip(t)), lambda t: t != "")
    return texts.select(key, F.posexplode(lines).alias("line_no", "line"))


def pair_by_position(files: DataFrame, truths: DataFrame, key: list[str]) -> DataFrame:
    """Files and truths with the same ordinal; what has no partner is left out, as the line counts are checked first."""
    return files.join(truths, key)


def counts_match(files: DataFrame, truths: DataFrame) -> bool:
    """Whether there are as many of one as of the other, by one job. Files are best given as they came, before recognition."""
    both = files.agg(F.count("*").alias("files")).crossJoin(truths.agg(F.count("*").alias("truths"))).first()  # one row each
    return both["files"] == both["truths"]


def total_elapsed(calls: DataFrame, by: list[str], ms: str = "inference_time_ms") -> DataFrame:
    """Sum of the times of single calls, each of two decimals, by whole hundredths."""
    return calls.groupBy(*by).agg((F.sum(F.round(F.col(ms) * 100).cast("long")) / 100).alias("total_ms"), F.count(ms).alias("n_calls"))


def with_models(rows: DataFrame, models: list[tuple[str, Column]]) -> DataFrame:
    """Each row once for each model, in catalogue order, without a join: model_ord, model, and the value given for it."""
    each = F.array(*(F.struct(F.lit(k).alias("model_ord"), F.lit(name).alias("model"), value.alias("value")) for k, (name, value) in enumerate(models)))
    return rows.select("*", F.explode(each).alias("m")).select(*rows.columns, "m.model_ord", "m.model", "m.value")


def evaluate(pairs: DataFrame) -> DataFrame:
    """Metrics of each pair. A row with an error keeps its place and scores the worst; an empty error is none."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    usable = pairs.withColumn("_p", F.when(~failed, F.coalesce("predicted", F.lit(""))))
    scored = M.compute_metrics(usable, "_p", "ground_truth")
    return scored.select(*pairs.columns, *(F.when(failed, F.lit(M.WORST[m])).otherwise(F.col(m)).alias(m) for m in M.METRICS))


def ok(error: str = "error") -> Column:
    return F.coalesce(F.col(error) == "", F.lit(True))


def mean4(value: str) -> Column:
    """Mean of values that have four decimals, at four decimals: a sum of whole ten-thousandths, in any order the same."""
    return M.ratio4(F.sum(F.round(F.col(value) * 10_000).cast("long")), F.count(value) * 10_000)


def batch_summary(evaluated: DataFrame, values: tuple[str, ...] = ("cer", "wer", "word_f1", "overall_accuracy"), by: list[str] = ("model",)) -> DataFrame:
    """Means over rows without error; a model with errors only has no row."""
    ms = F.floor(F.sum(F.round(F.col("inference_time_ms") * 100).cast("long")) / F.count("*") + 0.5) / 100
    return evaluated.where(ok()).groupBy(*by).agg(*(mean4(v).alias(f"avg_{v}") for v in values), ms.alias("avg_inference_ms"), F.count("*").alias("images_evaluated"))


def best_models(evaluated: DataFrame, key: list[str]) -> DataFrame:
    """The first model with the least cer, the least wer, the greatest word_f1 among rows without error; 'N/A' if there is none."""
    o = F.col("model_ord")

    def best(value: Column) -> Column:
        return F.coalesce(F.min(F.when(ok(), F.struct(value.alias("v"), o.alias("o"), F.col("model")))).getField("model"), F.lit("N/A"))

    return evaluated.groupBy(*key).agg(best(F.col("cer")).alias("best_cer"), best(F.col("wer")).alias("best_wer"), best(-F.col("word_f1")).alias("best_word_f1"))


def per_image(evaluated: DataFrame, key: list[str]) -> DataFrame:
    """One row for each evaluated image and model, with a preview of the text."""
    return evaluated.where(ok()).select(*key, "model", "cer", "wer", "word_f1", "overall_accuracy", F.left("predicted", F.lit(200)).alias("preview"))
