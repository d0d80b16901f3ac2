"""Text metrics as column expressions: distances, multiset overlap, rates, and the blended score.

Rates are exact ratios of integers, rounded half to even at four decimals in integer arithmetic, so every engine gets the
same digits. The integers they are ratios of (lengths, distances, multisets of the normalised texts) come from one Arrow step,
which works out only those that are asked for, and those of a pair once if it comes again while its truth is the same.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .bounds import shared_and_distances


def ratio4(num: Column, den: Column) -> Column:
    """num / den rounded at four decimals, half to even; num is not negative, den is positive."""
    top = num.cast("long") * 10_000
    q = F.floor(top / den).cast("long")
    q = F.when(q * den > top, q - 1).otherwise(q)  # in case the quotient was rounded up
    twice = (top - q * den) * 2
    up = (twice > den) | ((twice == den) & (q % 2 == 1))
    return (q + up.cast("long")) / F.lit(10_000.0)


def round_at(x: Column, digits: int) -> Column:
    """Rounded half up in plain double arithmetic, which every engine does alike; x is not negative."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one symbol beyond the basic plane."""

    def coded(words: Column, vocabulary: Column) -> Column:
        return F.concat_ws("", F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(vocabulary, w)), 8, "0")), "UTF-32")))

    distance = T.let(F.array_distinct(F.concat(a, b)), lambda v: F.levenshtein(coded(a, v), coded(b, v)))
    return F.when(a == b, F.lit(0)).otherwise(distance)


#: What two normalised texts are compared by: lengths in characters and words, distances, sizes of the multisets they share, and equality.
COUNTS = ("p_len", "g_len", "p_n", "g_n", "char_dist", "word_dist", "char_shared", "word_shared", "equal")


class _Text:
    """A text as `text.normalize` has it, and its words."""

    def __init__(self, s: str):
        if s.isascii() and s.isprintable() and "  " not in s and s[:1] != " " and s[-1:] != " ":
            self.s = s
        else:
            self.words = (s if s.isascii() else unicodedata.normalize("NFC", s)).split()
            self.s = " ".join(self.words)

    @functools.cached_property
    def words(self) -> list[str]:
        return self.s.split()


def _compared(pairs: list[tuple[_Text, _Text]], counts: frozenset[str]) -> dict[str, list[int]]:
    """The counts of pairs of texts, those asked for among them; those of equal texts need no comparison."""
    out = {"p_len": [len(p.s) for p, _ in pairs], "g_len": [len(g.s) for _, g in pairs], "equal": [int(p.s == g.s) for p, g in pairs]}
    if counts & {"p_n", "g_n", "word_dist", "word_shared"}:
        out |= {"p_n": [len(p.words) for p, _ in pairs], "g_n": [len(g.words) for _, g in pairs]}
    unequal = [k for k, same in enumerate(out["equal"]) if not same]
    for kind, lengths, of in (("char", "p_len", lambda t: t.s), ("word", "p_n", lambda t: t.words)):
        dist, both = f"{kind}_dist", f"{kind}_shared"
        if counts & {dist, both}:
            shared, distances = shared_and_distances([(of(pairs[k][0]), of(pairs[k][1])) for k in unequal], dist in counts)
            out[dist], out[both] = [0] * len(pairs), list(out[lengths])
            for k, n in zip(unequal, shared, strict=True):
                out[both][k] = n
            for k, n in zip(unequal, distances, strict=True):
                out[dist][k] = n
    return {c: out[c] for c in counts}


def _counter(counts: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    asked = frozenset(counts)

    @F.arrow_udf(f"struct<{','.join(f'{c}:int' for c in counts)}>")
    def run(predicted: pa.Array, truth: pa.Array) -> pa.Array:
        pairs: list[tuple[_Text, _Text]] = []
        which: list[int | None] = []
        raw = g = None
        known: dict[str, int] = {}  # by prediction, of the truth at hand
        for a, b in zip(predicted.to_pylist(), truth.to_pylist(), strict=True):
            if a is None or b is None:
                which.append(None)
                continue
            if b != raw:
                raw, g, known = b, _Text(b), {}
            if a not in known:
                known[a] = len(pairs)
                pairs.append((g if a == b else _Text(a), g))
            which.append(known[a])
        found, at = _compared(pairs, asked), pa.array(which, pa.int32())
        return pa.StructArray.from_arrays([pa.array(found[c], pa.int32()).take(at) for c in counts], names=list(counts))

    return run


def with_counts(pairs: DataFrame, predicted: str = "predicted", truth: str = "ground_truth", counts: tuple[str, ...] = ()) -> DataFrame:
    """Adds the integers that all metrics come from; equal is boolean. Null texts give nulls.

    Those named in ``counts`` come from one step together; without names, each has its own, and those that nothing uses are not worked out.
    """
    a, b = F.col(predicted), F.col(truth)
    if not counts:
        return pairs.withColumns({c: _as_told(c, _counter((c,))(a, b)) for c in COUNTS})
    # exploding an array of one row keeps the step's one result; the optimiser would else repeat it for each count
    counted = pairs.withColumn("_c", F.explode(F.array(_counter(counts)(a, b))))
    return counted.select(*pairs.columns, *(_as_told(c, F.col("_c")).alias(c) for c in counts))


def _as_told(count: str, found: Column) -> Column:
    return found[count] == 1 if count == "equal" else found[count]


def share(num: Column, den: Column) -> Column:
    """ratio4, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(ratio4(num, F.when(den != 0, den)))


def error_rate(distance: Column, length: Column) -> Column:
    return ratio4(distance, F.greatest(length, F.lit(1)))


def overall() -> Column:
    """Mean of the two clamped accuracies (unrounded) and the two F1 (rounded)."""
    c = F.col
    clamped = [1 - F.least(F.lit(1.0), c(d) / F.greatest(c(n), F.lit(1))) for d, n in (("char_dist", "g_len"), ("word_dist", "g_n"))]
    return round_at((clamped[0] + clamped[1] + c("char_f1") + c("word_f1")) / 4, 4)


METRICS = ("cer", "wer", "ned", "char_precision", "char_recall", "char_f1", "word_precision", "word_recall", "word_f1", "overall_accuracy", "exact_match")
#: What a failed recognition scores.
WORST = {"cer": 1.0, "wer": 1.0, "ned": 1.0} | {m: 0.0 for m in METRICS[3:10]} | {"exact_match": False}


def compute_metrics(pairs: DataFrame, predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """Adds the eleven metrics of each pair; null texts give null metrics."""
    c = F.col
    counted = with_counts(pairs, predicted, truth, COUNTS)
    counted = counted.withColumns({
        "cer": error_rate(c("char_dist"), c("g_len")), "wer": error_rate(c("word_dist"), c("g_n")),
        "ned": error_rate(c("char_dist"), F.greatest("p_len", "g_len")),
        "char_precision": share(c("char_shared"), c("p_len")), "char_recall": share(c("char_shared"), c("g_len")), "char_f1": share(2 * c("char_shared"), c("p_len") + c("g_len")),
        "word_precision": share(c("word_shared"), c("p_n")), "word_recall": share(c("word_shared"), c("g_n")), "word_f1": share(2 * c("word_shared"), c("p_n") + c("g_n")),
        "exact_match": c("equal"),
    })
    return counted.withColumn("overall_accuracy", overall()).select(*pairs.columns, *METRICS)
