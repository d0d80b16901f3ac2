"""Multiset overlap of whole texts: the counts that the metrics have, without their distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import share, with_counts

_COUNTS = ("p_len", "g_len", "p_n", "g_n", "char_shared", "word_shared")


def overlap_metrics(pairs: DataFrame, key: list[str], predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """Per key the sizes shared and the six precisions, recalls and F1 of `metrics.compute_metrics`, by words and characters; a null text is empty.

    Each pair is counted where it is, in time linear in its texts: a row for each character would be thousands for each pair.
    """
    c = F.col
    texts = pairs.select(*key, *(F.coalesce(x, F.lit("")).alias(n) for x, n in ((predicted, "_p"), (truth, "_g"))))
    counted = with_counts(texts, "_p", "_g", _COUNTS)
    shown = list(key)
    for name, a, b in (("char", "p_len", "g_len"), ("word", "p_n", "g_n")):
        shared = c(f"{name}_shared")
        rates = {"precision": share(shared, c(a)), "recall": share(shared, c(b)), "f1": share(2 * shared, c(a) + c(b))}
        shown += [shared.cast("long").alias(f"{name}_shared"), *(v.alias(f"{name}_{m}") for m, v in rates.items())]
    return counted.select(*shown)
