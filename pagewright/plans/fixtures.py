"""Inputs of the registered queries: what the tables give, and small inline cases that they don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import scoring as S

VARIANTS = (("original", 0, 1.0), ("upscaled_2x", 1, 2.0), ("clahe", 2, 1.0))
ENGINES = (("v5", 0), ("v3", 1))
LANGUAGES = (("en", 0), ("ar", 1), ("hi", 2))

CATALOG = [
    (0, "printed", 2, ["en", "ar", "hi"], True, True, None),
    (1, "latin", 2, ["en"], False, True, None),
    (2, "vision", 1, ["en", "ar", "hi"], True, False, "weights missing"),
    (3, "script", 2, ["ar"], False, True, None),
]
PRESET = ("printed", "vision", "latin")
REQUESTS = [
    (1, None, "en"), (2, "  ", "all"), (3, ",", "en"), (4, "pure_ocr", "ar"), (5, "latin, pure-ocr ,latin", "en"), (6, "nope,script,nope, vision", "ar"),
    (7, "OCR_WITHOUT_LLM_CAPABILITIES", "hi"), (8, "printed", "pa"), (9, "PURE_OCR", "en"), (10, "\tscript ,printed", "ar"),
]
ASKED = ("en", "all", "ar", "hi", "pa")
UPLOADS = [
    ("a.jpg", "image/jpeg", 10, "ffd8ff", "x"), ("b.png", "image/png", 20 * 1024 * 1024, "89504e470d0a", "x"), ("c.png", "image/png", 20 * 1024 * 1024 + 1, "89504e47", "x"),
    ("d.txt", "text/plain", 9, "736f6d65", "x"), ("e.pdf", "application/pdf", 30, "255044462d312e37", "  "), ("f.pdf", "application/pdf", 31, "20200a25504446", "y"),
    ("g.webp", "image/webp", 5, "52494646", ""), ("h.tiff", "image/tiff", 6, "49492a00", "z"), ("i", None, 1, "", None),
    ("j.pdf", "application/pdf", 2004, "20" * 2000 + "25504446", "w"), ("k.pdf", "application/pdf", 9, "0b0c0d0a0925504446", "v"), ("l.pdf", "application/pdf", 6, "00255044462d", "v"),
]
UNICODE = [
    ("nfd", "e\u0301te\u0301"), ("zero_width", "\u0645\u200c\u0631\u200d\u062d\u200b\u0628\u200e\u0627\u200f\ufeff"), ("presentation", "\ufedb\ufdf2"), ("kashida", "\u0645\u0640\u0640\u0640\u0631"),
    ("marks", "\u0628\u064b\u064b\u0652\u0652\u0652\u064e"), ("punct_run", "\u0627,,b,\u0627 ,,\u0627"), ("punct_mixed", ";,\u0627"), ("punct_latin", "a,b;c?"), ("alef", "\u0622\u0623\u0625\u0671\u0627"),
    ("isolated_few", "\u0645\u0631 \u0645\u0631  \u0645\u0631 \u0645\u0631 \u0645\u0631 \u0645\u0631 \u0645\u0631 \u0645\u0631 \u0645\u0631 \u0648"), ("isolated_many", "\u0645\u0631 \u0648 \u0645\u0631 \u0641 \u0645\u0631 \u0628 \u0645\u0631"),
    ("dense", "\u0628\u064b\u062a\u064c\u062b\u064d"), ("mid", "\u0628\u064b" + "\u0645\u0631\u062d\u0628\u0627 " * 2), ("none", "\u0645\u0631\u062d\u0628\u0627 \u0628\u0643\u0645"), ("five", "ab\u0645\u0645\u0645\u0645\u0645"), ("five_lf", "a\n\n\n\n\nb"),
    ("five_cr", "a\r\r\r\r\rb"), ("four", "aaaabbbb"), ("latin", "Invoice 2024 \u0645"), ("blank", " \u00a0\x1c"), ("empty", ""), ("digits", "\u0661\u0662 \u060c\u0663"),
]
POLYS = [(1, [[1.9, 2.1], [10.7, 2.0], [10.0, 9.9], [1.0, 9.0]]), (2, [[-1.9, -0.5], [3.2, 4.8]]), (3, []), (4, None), (5, [[7.0, 7.0]])]
QUADS = [(1, [[0, 0], [10, 1], [11, 9], [1, 8]]), (2, [[10, 10], [0, 10], [0, 0], [10, 0]]), (3, [[5, 0], [10, 5], [5, 10], [0, 5]]), (4, [[1, 1], [1, 1], [1, 1], [1, 1]])]
PLAN_PAGES = [(1, "en", 1000, 800, 3.0), (2, "ar", 1000, 800, 0.1), (3, "ar", 1000, 800, -0.2), (4, "ar", 3001, 800, 0.0), (5, "ar", 800, 3000, 0.5), (6, "hi", 5000, 5000, 1.0), (7, "ar", 800, 4000, -9.0)]
AREAS = [(1, 1, 900.0, True), (1, 2, 2500.0, False), (1, 3, 2000.0, True), (1, 4, 2000.0, True), (2, 1, 10.0, True), (3, 1, 5000.0, False), (3, 2, 1500.0, True)]
AREAS += [(4, k, 9000.0 - k, False) for k in range(15)] + [(4, 15, 8000.0, True)] + [(5, k, 9000.0 - k, False) for k in range(14)] + [(5, 14, 8000.0, True), (5, 15, 7999.0, True)]
#: Latin text in Arabic letters, one sign for another; e and y become marks, so that all branches of scoring are met.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "\u0627\u0628\u062a\u062b\u064e\u062c\u062d\u062e\u062f\u0630\u0631\u0632\u0633\u0634\u0635\u0636\u0637\u0638\u0639\u063a\u0641\u0642\u0643\u0644\u0650\u0645"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """Every line of every document, or of these with another text, as a detection, with a confidence and a box that follow from its place."""
    c = F.col
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text" if text is None else text, "\n")).alias("i", "text"))
    two = c("doc_id") % 3 == 0
    r = F.when(two, F.floor(c("i") / 2)).otherwise(c("i"))
    boxed = lines.select(
        "doc_id", F.lit(0).alias("page_idx"), c("i").cast("int").alias("det_ord"), "text", (((c("doc_id") * 31 + c("i") * 17) % 1000) / F.lit(1000.0)).alias("conf"),
        (20 + (c("doc_id") * 37 + c("i") * 53) % 60 + F.when(two & (c("i") % 2 == 1), 420).otherwise(0)).cast("int").alias("x1"),
        (12 * r + (c("doc_id") * 7 + c("i") * 11) % 9).cast("int").alias("y1"),
        F.least(F.lit(300), 8 * F.length("text")).alias("w"), (6 + (c("doc_id") * 5 + c("i") * 3) % 24 + F.when(c("doc_id") % 5 == 0, 45).otherwise(0)).cast("int").alias("h"),
    )
    return boxed.select("doc_id", "page_idx", "det_ord", "text", "conf", "x1", "y1", (c("x1") + c("w")).alias("x2"), (c("y1") + c("h")).alias("y2"))


def by_case(rows: DataFrame, number: Column, cases: list[tuple], schema: str) -> DataFrame:
    """rows, each with the columns of the case that its number leaves as the remainder."""
    few = rows.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"case int, {schema}")
    return rows.withColumn("case", (number % len(cases)).cast("int")).join(F.broadcast(few), "case").drop("case")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event; its list of models and its language follow from the event's id."""
    c = F.col
    asked = by_case(table(spark, sf_dir, "events").select(c("event_id").alias("request_id")), c("request_id"), [(m,) for _, m, _ in REQUESTS], "models string")
    return by_case(asked, F.floor(c("request_id") / 10), [(x,) for x in ASKED], "language string")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: a case's type, size and first bytes, followed by the text's own."""
    c = F.col
    rows = by_case(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_chars", F.lit(0)).alias("n_chars")), c("doc_id"), UPLOADS, "path string, content_type string, length long, hex string, truth string")
    return rows.select(
        F.concat("path", c("doc_id").cast("string")).alias("path"), "content_type", F.when(c("doc_id") % 24 < 12, c("length")).otherwise(c("length") + c("n_chars")).alias("length"),
        F.unhex(F.concat("hex", F.hex(F.left("text", F.lit(16)).cast("binary")))).alias("head"), F.when(c("truth").rlike("[a-z]"), F.left("text", F.lit(20))).otherwise(c("truth")).alias("ground_truth"),
    )


def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_case(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")), F.col("page_id"), [p[1:] for p in PLAN_PAGES], "language string, width int, height int, skew double")
    return rows.withColumn("width", (F.col("width") + F.floor(F.col("page_id") / 7) % 3).cast("int"))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's box as four corners that begin anywhere, with its area; every other one is a quadrilateral."""
    c = F.col
    rows = detections(spark, sf_dir).select("doc_id", "det_ord", (c("doc_id") * 100_000 + c("det_ord")).alias("id"), *(c(x).cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")))
    whole = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    turn = (c("det_ord") % 4).cast("int")
    return rows.select("*", F.concat(F.slice(whole, turn + 1, F.lit(4)), F.slice(whole, F.lit(1), turn)).alias("corners"), ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("area"), (c("det_ord") % 2 == 0).alias("quad"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine gives for each document, as JSON text: by turns parallel lists, lists under the other name and with one score fewer, and rows, of which each tenth is malformed."""
    c = F.col
    shape = c("doc_id") % 3
    poly = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    listed = detections(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("det_ord", "text", "conf", poly.alias("poly")))).alias("l"))
    of = lambda name: F.transform("l", lambda d: d[name])
    none = F.lit(None).cast("array<array<array<int>>>")
    lists = F.to_json(F.struct(of("text").alias("rec_texts"), F.when(shape == 0, of("conf")).otherwise(F.slice(of("conf"), F.lit(1), F.size("l") - 1)).alias("rec_scores"), F.when(shape == 0, of("poly")).otherwise(none).alias("dt_polys"), F.when(shape == 1, of("poly")).otherwise(none).alias("rec_polys")))
    quoted = lambda d: F.regexp_replace(F.to_json(F.struct(d["text"].alias("t"))), r"^\{\"t\":|\}$", "")
    row = lambda d: F.when(d["det_ord"] % 10 == 3, F.concat(F.lit("["), quoted(d), F.lit("]"))).otherwise(F.concat(F.lit("["), F.to_json(d["poly"]), F.lit(",["), quoted(d), F.lit(","), d["conf"].cast("string"), F.lit("]]")))
    rows = F.concat(F.lit("["), F.array_join(F.transform("l", row), ","), F.lit("]"))
    return listed.select("doc_id", F.when(shape == 2, rows).otherwise(lists).alias("payload"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit(0).alias("page_idx"))


def planned(spark: SparkSession, sf_dir: str, engines: tuple = ENGINES) -> DataFrame:
    """The passes that are run on each page, whether they find anything or not."""
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(vo).alias("variant_ord"), F.lit(e).alias("engine"), F.lit(eo).alias("engine_ord")) for v, vo, _ in VARIANTS for e, eo in engines))
    return pages(spark, sf_dir).withColumn("p", F.explode(each)).select("doc_id", "page_idx", "p.*")


def in_languages(found: DataFrame) -> DataFrame:
    """Each language's engine is made to see the lines whose place leaves its number as the remainder by three, or all."""
    langs = F.array(*(F.struct(F.lit(x).alias("language"), F.lit(o).alias("lang_ord")) for x, o in LANGUAGES))
    return found.where("conf > 0.3").withColumn("l", F.explode(langs)).select(*found.columns, "l.language", "l.lang_ord").where("(det_ord + doc_id) % 3 <> lang_ord")


def page_images(spark: SparkSession, sf_dir: str, width: int = 48, height: int = 64) -> DataFrame:
    """A picture for each page: rows of noise that follow from its text, light above and dark below a line that depends on it."""
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("page_idx"), F.sha2("text", 256).alias("h"))
    return texts.select("doc_id", "page_idx", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(3).alias("n_channels"), F.unhex(F.repeat("h", F.lit(width * height * 3 // 32))).alias("data"))


def passes(spark: SparkSession, sf_dir: str, engines: tuple = ENGINES, text: Column | None = None) -> DataFrame:
    """Detections, or those of another text of the documents, under each variant and engine, without a fifth of the lines, at the variant's scale.

    Lines are dealt out by document before there are six of each, so a table in few pieces is not the work of few tasks. What
    scores take from a text is worked out before, once for all six.
    """
    c = F.col
    lines = S.with_line_facts(detections(spark, sf_dir, text)).repartition("doc_id")
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(vo).alias("variant_ord"), F.lit(s).alias("scale"), F.lit(e).alias("engine"), F.lit(eo).alias("engine_ord")) for v, vo, s in VARIANTS for e, eo in engines))
    every = lines.withColumn("p", F.explode(each)).select("doc_id", "page_idx", "p.engine", "p.engine_ord", "p.variant", "p.variant_ord", "p.scale", "det_ord", "text", S.LINE_FACTS, "conf", "x1", "y1", "x2", "y2")
    kept = every.where((c("det_ord") + c("variant_ord") + c("engine_ord")) % 5 != 0)
    lower = F.greatest(F.lit(0.0), c("conf") - 0.02 * c("variant_ord") - 0.03 * c("engine_ord"))
    return kept.withColumns({"conf": lower} | {x: (c(x) * c("scale")).cast("int") for x in ("x1", "y1", "x2", "y2")})


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ground_truth_lines(table(spark, sf_dir, "documents"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document against six made-up models, one of which fails at times and one always."""
    c = F.col
    g = c("ground_truth")
    # distances cost the square of a line's length: lines are dealt out evenly, whatever file they stand in
    lines = truths(spark, sf_dir).select("doc_id", "line_no", c("line").alias("ground_truth")).repartition(4 * spark.sparkContext.defaultParallelism, "doc_id", "line_no")
    made = [("identity", g), ("sub_e", F.translate(g, "e", "c")), ("drop_a", F.replace(g, F.lit("a"), F.lit(""))), ("short", F.left(g, F.length(g) - F.floor(F.length(g) / 4).cast("int"))), ("flaky", F.translate(g, "e", "c")), ("dead", F.lit(None).cast("string"))]
    rows = E.with_models(lines, made).withColumnRenamed("value", "predicted")
    error = F.when((c("model") == "flaky") & (c("doc_id") % 7 == 0), "boom").when(c("model") == "dead", "dead")
    return rows.withColumns({"error": error, "inference_time_ms": ((c("doc_id") * 13 + c("model_ord") * 29) % 997) / F.lit(10.0)})
