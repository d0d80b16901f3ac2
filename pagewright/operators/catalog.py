"""The model catalogue and the planning of requests against it. Catalogues are a handful of rows, written in code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import CATALOG, LANGUAGES

#: The aliases that ask for a whole preset.
PRESET_ALIASES = ("OCR_WITHOUT_LLM_CAPABILITIES", "ocr_without_llm_capabilities", "pure_ocr", "pure-ocr")
#: Engines by language; alternates come second.
ENGINES = (("en", 0, "v5"), ("ar", 0, "v5"), ("ar", 1, "v3"), ("hi", 0, "v5"))


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CATALOG)


def supports(language: Column) -> Column:
    return F.when(language == "all", F.col("supports_all")).otherwise(F.array_contains("languages", language))


def list_models(models: DataFrame) -> DataFrame:
    """Loaded models in order, with the languages one may ask for."""
    asked = F.when(F.col("supports_all"), F.concat("languages", F.array(F.lit("all")))).otherwise(F.col("languages"))
    return models.where("loaded").select("model_ord", "name", "tier", asked.alias("languages"), "loaded")


def models_for_language(models: DataFrame, languages: DataFrame) -> DataFrame:
    """Loaded models for each asked language; a language that none supports has no rows."""
    return languages.join(F.broadcast(models.where("loaded")), supports(F.col("language")))


def _tokens(requests: DataFrame) -> DataFrame:
    """The non-blank tokens of each request with their places."""
    parts = F.filter(F.transform(F.split("models", ","), lambda t: T.strip(t)), lambda t: t != "")
    return requests.select("request_id", F.posexplode(parts).alias("at", "token"))


def resolve_models(requests: DataFrame, models: DataFrame, preset: tuple[str, ...]) -> DataFrame:
    """request_id, names: presets expanded to their loaded members, each name once, first place first; a blank request means all."""
    loaded = models.where("loaded").agg(F.transform(F.array_sort(F.collect_list(F.struct("model_ord", "name"))), lambda x: x["name"]).alias("all_loaded"))
    members = F.array(*map(F.lit, preset)).cast("array<string>")
    parts = F.filter(F.transform(F.split("models", ","), lambda t: T.strip(t)), lambda t: t != "")
    expanded = F.flatten(F.transform(parts, lambda t: F.when(t.isin(*PRESET_ALIASES), F.array_intersect(members, F.col("all_loaded"))).otherwise(F.array(t))))
    everything = F.col("models").isNull() | T.blank(F.col("models"))
    return requests.crossJoin(F.broadcast(loaded)).select("request_id", F.when(everything, F.col("all_loaded")).otherwise(F.array_distinct(expanded)).alias("names"))


def unknown_models(requests: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, name, at: explicitly asked names that are not loaded, once each, aliases aside."""
    tokens = _tokens(requests).where(~F.col("token").isin(*PRESET_ALIASES)).groupBy("request_id", "token").agg(F.min("at").alias("at"))
    return tokens.join(F.broadcast(models.where("loaded").select(F.col("name").alias("token"))), "token", "left_anti").select("request_id", F.col("token").alias("name"), "at")


def select_models(requests: DataFrame, models: DataFrame, preset: tuple[str, ...]) -> DataFrame:
    """request_id, model_ord, name of the loaded models that are asked for and support the request's language, in catalogue order."""
    asked = resolve_models(requests, models, preset).join(requests.select("request_id", "language"), "request_id")
    return asked.join(F.broadcast(models.where("loaded")), F.array_contains("names", F.col("name")) & supports(F.col("language"))).select("request_id", "model_ord", "name")


def run_options(models: DataFrame, preset: tuple[str, ...]) -> DataFrame:
    """One row: the loaded models in order (as `list_models` has them), their names, the languages one may ask for, and the presets."""
    loaded = list_models(models)
    one = F.struct("model_ord", "name", "tier", "languages", "loaded")
    found = loaded.agg(F.array_sort(F.collect_list(one)).alias("loaded_models"))
    names = F.transform("loaded_models", lambda x: x["name"]).alias("available_model_names")
    return found.select("loaded_models", names, F.array(*map(F.lit, LANGUAGES)).alias("available_languages"), F.create_map(F.lit(PRESET_ALIASES[0]), F.array(*map(F.lit, preset))).alias("presets"))


def admit(requests: DataFrame, models: DataFrame, preset: tuple[str, ...], batch: bool = False) -> DataFrame:
    """Per request its status and what the answer tells: names asked for, unknown ones, and, if any is, the sorted loaded names.

    422: a name that is not loaded was asked for; 404: none of the names supports the language, which a batch lets pass.
    """
    asked = resolve_models(requests, models, preset)
    unknown = unknown_models(requests, models).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("unknown"))
    chosen = select_models(requests, models, preset).groupBy("request_id").agg(F.count("*").alias("n_selected"))
    loaded = models.where("loaded").agg(F.sort_array(F.collect_list("name")).alias("all_loaded"))
    met = requests.select("request_id", "language").join(asked, "request_id").join(unknown, "request_id", "left").join(chosen, "request_id", "left").crossJoin(F.broadcast(loaded))
    status = F.when(F.col("unknown").isNotNull(), 422).when(F.col("n_selected").isNull() & F.lit(not batch), 404).otherwise(200)
    message = F.when(F.col("status") == 422, F.lit("models that are not loaded")).when(F.col("status") == 404, F.format_string("no loaded model supports '%s'", "language")).otherwise("")
    told = met.withColumn("status", status).withColumn("message", message)
    none = F.array().cast("array<string>")
    return told.select("request_id", "status", "message", F.col("names").alias("requested"), F.coalesce("unknown", none).alias("unknown"), F.when(F.col("status") == 422, F.col("all_loaded")).otherwise(none).alias("loaded"), F.coalesce("n_selected", F.lit(0).cast("long")).alias("n_selected"))


def has_alternate(language: str) -> bool:
    return any(x == language and o > 0 for x, o, _ in ENGINES)


def engine_config(languages: DataFrame) -> DataFrame:
    """Engines of each language in order; a language without one keeps a row of nulls."""
    spark = languages.sparkSession
    table = spark.createDataFrame(list(ENGINES), "language string, engine_ord int, engine string")
    return languages.join(F.broadcast(table), "language", "left")


def plan_variants(pages: DataFrame, high_dpi: int = 3000) -> DataFrame:
    """The variants of each page in their order: which are made depends on language, skew and size."""
    c = F.col
    arabic = c("language") == "ar"
    rows = F.array_compact(F.array(
        F.struct(F.lit("original").alias("variant"), F.lit(1.0).alias("scale")),
        F.struct(F.lit("upscaled_2x").alias("variant"), F.lit(2.0).alias("scale")),
        F.struct(F.lit("clahe").alias("variant"), F.lit(1.0).alias("scale")),
        F.when(arabic, F.struct(F.lit("adaptive_thresh").alias("variant"), F.lit(1.0).alias("scale"))),
        F.when(arabic, F.struct(F.lit("ink_bleed_clean").alias("variant"), F.lit(1.0).alias("scale"))),
        F.when(arabic & (F.abs("skew") >= 0.2), F.struct(F.lit("deskewed").alias("variant"), F.lit(1.0).alias("scale"))),
        F.when(arabic & (F.greatest("width", "height") > high_dpi), F.struct(F.lit("downscaled_0.75x").alias("variant"), F.lit(0.75).alias("scale"))),
    ))
    return pages.select("*", F.posexplode(rows).alias("variant_ord", "v")).select(*pages.columns, "variant_ord", "v.variant", "v.scale")
