"""Scoring of recognition passes, the choice among them, and the reasons for a second engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.facts import line_facts
from .detections import PAGE, folded_sum, in_order, median_height, middle_height, overlaps_next

PASS = [*PAGE, "engine", "engine_ord", "variant", "variant_ord"]
# The factors of the score.
TOKEN_WEIGHT = 4.5
DENSE_MARKS, DENSE_FACTOR = 0.40, 0.3
LOW_BOXES_FACTOR = 0.4
FOREIGN, FOREIGN_FACTOR, HALF_FOREIGN, HALF_FACTOR, MIXED_FOREIGN = 0.30, 0.2, 0.50, 0.5, 0.10
VARIANT_FACTORS = {"upscaled_2x": 0.88, "downscaled_0.75x": 0.93}
REPEATED_FACTOR = 0.5
OVERLAP_SHARE = 0.20


def joined_text(order: str = "det_ord", text: str = "text") -> Column:
    """The stripped texts of a group that are not blank, in order, one space between."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: T.strip(x["t"]))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


#: What a score takes from a page's text: characters, those in Arabic letters, marks, Arabic word tokens, and whether a character is repeated.
TEXT_FACTS = {"n_chars": F.length, "n_arabic": T.arabic_chars, "n_marks": T.marks, "n_tokens": T.arabic_word_tokens, "repeated": lambda t: T.repeated_run(t).cast("int")}

LINE_FACTS = "line_facts"


def pass_facts(passes: DataFrame, key: list[str] = PASS, s: Settings = Settings()) -> DataFrame:
    """Per pass its number of lines, mean confidence (summed in line order), median height, and the facts of its text, which are sums over its lines.

    The text is that of `joined_text`: stripped lines with one space between, so no token or repeated character is in two of
    them. Only figures are shuffled. Lines that come with the facts of their text (`with_line_facts`) are taken by them.
    """
    c = F.col
    lines = with_line_facts(passes).select(*key, F.struct("det_ord", "conf", (c("y2") - c("y1")).alias("h")).alias("_line"), *(c(LINE_FACTS)[f].alias(f) for f in TEXT_FACTS))
    spaces = F.greatest(F.count(F.when(c("n_chars") > 0, 1)) - 1, F.lit(0))
    sums = {f: F.sum(f) for f in TEXT_FACTS} | {"n_chars": F.sum("n_chars") + spaces, "repeated": F.coalesce(F.max("repeated"), F.lit(0))}
    # one list serves both the mean and the median: a state of its own for each costs more than all else here
    found = lines.groupBy(*key).agg(F.sort_array(F.collect_list("_line")).alias("_lines"), *(v.alias(f) for f, v in sums.items()))
    n = F.size("_lines").cast("long")
    return found.select(*key, n.alias("n_lines"), (in_order(c("_lines"), "conf") / n).alias("mean_conf"), middle_height(F.transform("_lines", lambda x: x["h"]), s).alias("median_height"), *TEXT_FACTS)


def with_line_facts(lines: DataFrame) -> DataFrame:
    """Adds the facts of each line's text, if they are not there. Best called before a text is given to several passes, and before lines are dealt out."""
    return lines if LINE_FACTS in lines.columns else lines.withColumn(LINE_FACTS, line_facts(F.col("text")))


def with_text_facts(rows: DataFrame, text: str = "page_text") -> DataFrame:
    """Adds the facts of whole texts."""
    return rows.withColumns({f: make(F.col(text)) for f, make in TEXT_FACTS.items()})


def score_column(language: Column, variant: Column, s: Settings = Settings()) -> Column:
    """Higher is better. Arabic counts word tokens, and is marked down for diacritics, low boxes and foreign text; all
    languages are marked down for scaled variants and repeated characters."""
    conf, n_chars = F.col("mean_conf"), F.col("n_chars")
    share = lambda n: F.when(n_chars == 0, F.lit(0.0)).otherwise(F.col(n) / n_chars)
    ratio = share("n_arabic")
    mixed = (1.0 - ratio) > s.mixed_page_ratio
    one = F.lit(1.0)
    foreign = F.when(mixed, F.when(ratio < MIXED_FOREIGN, FOREIGN_FACTOR).otherwise(one)).otherwise(F.when(ratio < FOREIGN, FOREIGN_FACTOR).when(ratio < HALF_FOREIGN, HALF_FACTOR).otherwise(one))
    arabic = F.sqrt(F.greatest(one, F.col("n_tokens") * TOKEN_WEIGHT)) * conf
    arabic = arabic * F.when(share("n_marks") > DENSE_MARKS, DENSE_FACTOR).otherwise(one)
    arabic = arabic * F.when(F.col("median_height") < 2 * s.min_box_height, LOW_BOXES_FACTOR).otherwise(one) * foreign
    latin = F.sqrt(F.greatest(one, n_chars.cast("double"))) * conf
    score = F.when(language == "ar", arabic).otherwise(latin)
    for name, factor in VARIANT_FACTORS.items():
        score = score * F.when(variant == name, factor).otherwise(one)
    score = score * F.when(F.col("repeated") == 1, REPEATED_FACTOR).otherwise(one)
    return F.when(n_chars == 0, F.lit(0.0)).otherwise(score)


def score_passes(passes: DataFrame, language: str | Column, key: list[str] = PASS, s: Settings = Settings(), planned: DataFrame | None = None) -> DataFrame:
    """Facts and score of each pass; with ``planned``, the passes that were run, also of those that found nothing, which score 0."""
    language = F.lit(language) if isinstance(language, str) else language
    facts = pass_facts(passes, key, s)
    if planned is not None:
        none = dict.fromkeys(TEXT_FACTS, 0) | {"n_lines": 0, "mean_conf": 0.0, "median_height": float(s.band_tolerance)}
        facts = planned.select(*key).join(facts, key, "left").na.fill(none)
    return facts.withColumn("score", score_column(language, F.col("variant"), s))


def select_best_pass(scored: DataFrame, key: list[str] = PAGE, told: tuple[str, ...] = ()) -> DataFrame:
    """The pass of each page with the highest score; the first variant, then engine, of equals. ``told``: facts of that pass to add."""
    best = F.max(F.struct(F.col("score"), (-F.col("variant_ord")).alias("v"), (-F.col("engine_ord")).alias("e"), F.col("variant"), F.col("engine"), *told))
    return scored.groupBy(*key).agg(best.alias("b"), F.count("*").alias("n_passes")).select(*key, F.col("b.variant").alias("variant"), F.col("b.engine").alias("engine"), F.col("b.score").alias("score"), "n_passes", *(F.col("b")[x].alias(x) for x in told))


def replace_with_margin(primary: DataFrame, alternate: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    """The alternate takes a page's place only if it scores more than the margin above the primary."""
    alt = alternate.select(*key, *(F.col(c).alias(f"alt_{c}") for c in ("variant", "engine", "score")))
    take = F.col("alt_score") > F.col("score") * (1.0 + s.replace_margin)
    met = primary.join(alt, key, "left").withColumn("replaced", F.coalesce(take, F.lit(False)))
    return met.select(*key, *(F.when(F.col("replaced"), F.col(f"alt_{c}")).otherwise(F.col(c)).alias(c) for c in ("variant", "engine", "score")), "replaced")


def reasons_of(n: Column, n_chars: Column, conf: Column, ratio: Column, repeated: Column, height: Column, over: Column, s: Settings = Settings()) -> Column:
    """The reasons that a page's figures give: lines, characters, mean confidence, Arabic share, a repeated character, median height, overlaps."""
    low = 2 * s.min_box_height
    # The texts of the reasons.
    return F.array_compact(F.array(
        F.when(n < s.fallback_min_lines, F.lit(f"low_line_count<{s.fallback_min_lines}")),
        F.when(n_chars < s.fallback_min_chars, F.lit(f"low_char_count<{s.fallback_min_chars}")),
        F.when(conf < s.fallback_min_conf, F.lit(f"low_avg_conf<{s.fallback_min_conf:.2f}")),
        F.when(ratio < s.fallback_min_arabic, F.lit(f"low_arabic_ratio<{s.fallback_min_arabic:.2f}")),
        F.when(repeated, F.lit("repeated_char_pattern")),
        F.when(height < low, F.format_string(f"low_median_box_height<{low}px(got %.1fpx)", height)),
        F.when((n >= 4) & (over / (n - 1) > OVERLAP_SHARE), F.format_string("bbox_vertical_overlap_fragmentation(%d/%dpairs)", over, n - 1)),
    ))


#: The reason of a page without lines.
EMPTY = "empty_primary_result"


def fallback_reasons(detections: DataFrame, pages: DataFrame, key: list[str] = PAGE, s: Settings = Settings()) -> DataFrame:
    """Per page the reasons, in order, for which a second engine would be asked; a page without lines has one."""
    c, n = F.col, F.count("*")
    marked = detections.withColumn("over", overlaps_next(key).cast("int"))
    facts = marked.groupBy(*key).agg(n.alias("n"), joined_text().alias("t"), (folded_sum("det_ord", "conf") / n).alias("conf"), median_height(s).alias("h"), F.sum("over").alias("over"))
    reasons = reasons_of(c("n"), F.length("t"), c("conf"), T.arabic_ratio(c("t")), T.repeated_run(c("t")), c("h"), c("over"), s)
    found = facts.select(*key, reasons.alias("reasons"))
    out = pages.join(found, key, "left").withColumn("reasons", F.coalesce("reasons", F.array(F.lit(EMPTY))))
    return out.withColumn("triggered", F.size("reasons") > 0)


def language_vote(scores: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """The language of each page with the highest page_score; the first of equals, also if all are 0."""
    best = F.max(F.struct(F.col("page_score"), (-F.col("lang_ord")).alias("o"), F.col("language"))).alias("b")
    return scores.groupBy(*key).agg(best).select(*key, F.col("b.language").alias("language"), F.col("b.page_score").alias("page_score"))
