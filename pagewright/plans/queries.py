"""The registered queries: each applies one operator to its whole table, or to inline cases where no table has such data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import geometry as G
from ..functions import metrics as M
from ..functions import text as T
from ..operators import catalog as C
from ..operators import detections as D
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import long_pages as LP
from ..operators import overlap as O
from ..operators import pages as pictures
from ..operators import scoring as S
from ..operators.scans import checkpoint_folder, checkpointed
from ..sources import batches
from ..sources import documents as docs
from ..sources import heads
from ..sources import sinks
from ..sources.ordered import laid_out
from . import fixtures as X
from . import pipelines as P
from . import requests as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BOX = ("x1", "y1", "x2", "y2")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return D.filter_detections(X.detections(spark, sf))


# Sources and sinks


@query
def doc_sniff(spark, sf):
    return docs.sniff(X.uploads(spark, sf)).select("path", "kind")


@query
def file_heads(spark, sf):
    """Every text as a file: each second one a PDF, of these each second one after white space. Kinds are told from the files' beginnings."""
    folder = f"{checkpoint_folder(spark)}/uploads-{uuid.uuid4().hex[:12]}"
    begin = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 4 == 0, F.lit("\n \t%PDF-")).otherwise(F.lit("%PDF-"))).otherwise("")
    files = X.table(spark, sf, "documents").where("text IS NOT NULL").select(F.format_string("%d.bin", "doc_id").alias("name"), F.concat(begin, "text").cast("binary").alias("content"))
    sinks.write_files(files, folder)
    heads.register(spark)
    found = spark.read.format("file_heads").load(folder).where(F.col("length") <= Settings().max_file_mb << 20)
    return docs.sniff(found).select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("doc_id"), "length", "kind")


@query
def validate_uploads(spark, sf):
    return docs.validate_uploads(X.uploads(spark, sf)).select("path", "status", "reason")


@query
def gt_lines(spark, sf):
    return X.truths(spark, sf)


@query
def overlay_labels(spark, sf):
    return D.overlay_labels(_found(spark, sf)).select("doc_id", "det_ord", "label")


@query
def json_sink(spark, sf):
    rows = D.avg_confidence(_found(spark, sf), pages=X.pages(spark, sf)).select("doc_id", "n_lines")
    return sinks.as_json(rows)


@query
def stored_results(spark, sf):
    """The answers of `model_results` as JSON lines, written as one batch by two jobs, as when the first is thought to have failed, and read again."""
    folder = f"{checkpoint_folder(spark)}/answers-{uuid.uuid4().hex[:12]}"
    answers = checkpointed(model_results(spark, sf))
    for _ in range(2):
        sinks.store_answers(answers, folder, "answers")
    return batches.read(spark, folder).select(F.from_json("value", answers.schema).alias("a")).select("a.*")


@query
def batch_ordinals(spark, sf):
    """Files by path, in an order that is not that of their ids."""
    files = X.table(spark, sf, "documents").select("doc_id", F.concat(F.lpad(((F.col("doc_id") * 7919) % 10007).cast("string"), 5, "0"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return docs.with_ordinal(files)


# Catalogue and planning


@query
def run_options(spark, sf):
    c = F.col
    row = C.run_options(C.catalog(spark, X.CATALOG), X.PRESET)
    return row.select(F.transform("loaded_models", lambda x: F.concat_ws("/", x["name"], x["tier"].cast("string"), F.array_join(x["languages"], "+"))).alias("m"), "*").select(
        F.array_join("m", ",").alias("loaded_models"), F.array_join("available_model_names", ",").alias("available_model_names"), F.array_join("available_languages", ",").alias("available_languages"), F.to_json(c("presets")).alias("presets")
    )


def _admitted(spark, sf, batch):
    rows = C.admit(X.requests(spark, sf), C.catalog(spark, X.CATALOG), X.PRESET, batch)
    return rows.select("request_id", "status", "message", *(F.array_join(x, ",").alias(x) for x in ("requested", "unknown", "loaded")), "n_selected")


@query
def admit_requests(spark, sf):
    return _admitted(spark, sf, False)


@query
def admit_batches(spark, sf):
    return _admitted(spark, sf, True)


@query
def list_models(spark, sf):
    return C.list_models(C.catalog(spark, X.CATALOG)).withColumn("languages", F.array_join("languages", ","))


@query
def models_for_language(spark, sf):
    asked = X.frame(spark, [(x,) for x in ("all", "en", "ar", "hi", "pa")], "language string")
    return C.models_for_language(C.catalog(spark, X.CATALOG), asked).select("language", "model_ord", "name")


@query
def resolve_models(spark, sf):
    return C.resolve_models(X.requests(spark, sf), C.catalog(spark, X.CATALOG), X.PRESET).select("request_id", F.array_join("names", ",").alias("names"))


@query
def unknown_models(spark, sf):
    return C.unknown_models(X.requests(spark, sf), C.catalog(spark, X.CATALOG)).select("request_id", "name")


@query
def select_models(spark, sf):
    return C.select_models(X.requests(spark, sf), C.catalog(spark, X.CATALOG), X.PRESET)


@query
def engine_config(spark, sf):
    return C.engine_config(X.frame(spark, [(x,) for x in ("en", "ar", "hi", "pa")], "language string"))


@query
def plan_variants(spark, sf):
    return C.plan_variants(X.plan_pages(spark, sf)).select("page_id", "variant_ord", "variant", "scale")


# Boxes


@query
def poly_to_bbox(spark, sf):
    ragged = F.transform("corners", lambda p, i: F.array(p[0] + 0.25 * i, p[1] - 0.75))
    poly = F.when(F.col("det_ord") % 50 == 7, F.slice(ragged, 1, 0)).when(F.col("det_ord") % 50 != 9, ragged)
    rows = X.outlines(spark, sf).withColumn("b", G.poly_to_bbox(poly))
    return rows.select("id", *(F.col("b")[k].alias(x) for k, x in enumerate(BOX)))


@query
def order_quad(spark, sf):
    rows = X.outlines(spark, sf).withColumn("o", G.order_quad(F.transform("corners", lambda p: F.transform(p, lambda x: x.cast("int")))))
    return rows.select("id", *(F.col("o")[k][j].alias(f"{c}_{x}") for k, c in enumerate(("tl", "tr", "br", "bl")) for j, x in enumerate("xy")))


@query
def topk_quads(spark, sf):
    """Among the 15 largest outlines of an image, those of at least 1000, the largest that is a quadrilateral."""
    rows = X.outlines(spark, sf).select(F.col("doc_id").alias("image_id"), F.col("det_ord").alias("contour"), "area", "quad")
    w = F.row_number().over(D.Window.partitionBy("image_id").orderBy(F.desc("area"), "contour"))
    top = rows.withColumn("at", w).where((F.col("at") <= 15) & (F.col("area") >= 1000.0) & F.col("quad"))
    return top.groupBy("image_id").agg(F.min_by("contour", "at").alias("contour"))


@query
def box_geometry(spark, sf):
    return D.geometry(X.detections(spark, sf)).select("doc_id", "det_ord", "width", "height", "area", "cx", "cy")


@query
def effective_scale(spark, sf):
    c = F.col
    pages = X.detections(spark, sf).groupBy("doc_id").agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    return pages.select("doc_id", *(v.alias(k) for k, v in G.capped(c("width"), c("height"), F.lit(2.0), F.lit(640)).items()))


@query
def rescale_boxes(spark, sf):
    return D.rescale(X.passes(spark, sf)).select("doc_id", "engine", "variant", "det_ord", *BOX)


@query
def filter_detections(spark, sf):
    return _found(spark, sf).select("doc_id", "det_ord", "conf", *BOX)


@query
def parse_engine_output(spark, sf):
    return D.parse_engine_output(X.payloads(spark, sf), ["doc_id"])


@query
def page_score(spark, sf):
    return D.page_score(_found(spark, sf), X.pages(spark, sf))


@query
def avg_confidence(spark, sf):
    return D.avg_confidence(_found(spark, sf), pages=X.pages(spark, sf))


@query
def median_box_height(spark, sf):
    return D.median_box_height(_found(spark, sf))


@query
def vertical_overlap(spark, sf):
    return D.vertical_overlap(_found(spark, sf)).select("doc_id", "n_lines", "n_overlaps", M.round_at(F.col("overlap_ratio"), 6).alias("overlap_ratio"))


# Layout


@query
def reading_order_ltr(spark, sf):
    return L.reading_order_ltr(_found(spark, sf)).select("doc_id", "det_ord", "read_ord")


@query
def detect_columns(spark, sf):
    return L.detect_columns(_found(spark, sf)).drop("page_idx")


@query
def line_bands(spark, sf):
    return L.line_bands(_found(spark, sf)).select("doc_id", "det_ord", "col", "band")


@query
def reading_order_rtl(spark, sf):
    return L.reading_order_rtl(_found(spark, sf)).select("doc_id", "det_ord", "read_ord")


def _stacked(spark, sf):
    """The lines of every twentieth document below each other, as one long page."""
    c = F.col
    down = 37 * c("doc_id")
    return _found(spark, sf).select((c("doc_id") % 20).alias("doc_id"), "page_idx", (c("doc_id") * 100_000 + c("det_ord")).alias("det_ord"), "text", "conf", "x1", (c("y1") + down).alias("y1"), "x2", (c("y2") + down).alias("y2"))


@query
def long_page_order(spark, sf):
    lines = checkpointed(_stacked(spark, sf).drop("text", "conf"))  # read three times: counts, short pages and long ones
    return LP.reading_order_any(lines, limit=200).select("doc_id", "det_ord", "col", "band", "read_ord")


@query
def long_page_medians(spark, sf):
    return LP.page_medians(_stacked(spark, sf)).select("doc_id", "median_height")


@query
def assemble_document(spark, sf):
    texts = L.assemble_documents(L.assemble_pages(L.reading_order_ltr(_found(spark, sf))))
    return X.pages(spark, sf).select("doc_id").join(texts, "doc_id", "left").na.fill({"doc_text": ""})


# Passes


@query
def variant_engine_passes(spark, sf):
    return X.passes(spark, sf).groupBy("doc_id", "engine", "variant").agg(F.count("*").alias("n_lines"))


@query
def all_passes(spark, sf):
    primary, alternate = X.passes(spark, sf, X.ENGINES[:1]), X.passes(spark, sf, X.ENGINES[1:])
    return primary.unionByName(alternate).groupBy("doc_id").agg(F.countDistinct("engine", "variant").alias("n_passes"), F.count("*").alias("n_lines"))


def _scored(spark, sf):
    return S.score_passes(P.kept_lines(X.passes(spark, sf)), "en", planned=X.planned(spark, sf))


@query
def score_pass_latin(spark, sf):
    return _scored(spark, sf).select("doc_id", "engine", "variant", M.round_at(F.col("score"), 3).alias("score"))


@query
def score_pass_arabic(spark, sf):
    """The passes with their text in Arabic letters, and the few cases that no table has."""
    passes = X.passes(spark, sf, text=F.translate("text", X.LATIN, X.ARABIC))
    scored = S.score_passes(P.kept_lines(passes), "ar", planned=X.planned(spark, sf)).select(F.concat_ws("/", F.col("doc_id").cast("string"), "engine", "variant").alias("case_id"), "score")
    rows = X.frame(spark, X.UNICODE, "case_id string, s string").select("case_id", F.col("s").alias("page_text"), F.lit(0.5).alias("mean_conf"), F.lit(20.0).alias("median_height"))
    cases = S.with_text_facts(rows).select("case_id", S.score_column(F.lit("ar"), F.lit("original")).alias("score"))
    return scored.unionByName(cases).select("case_id", M.round_at(F.col("score"), 6).alias("score"))


def _rounded(best):
    return best.withColumn("score", M.round_at(F.col("score"), 3)).drop("page_idx")


@query
def select_best_pass(spark, sf):
    return _rounded(S.select_best_pass(_scored(spark, sf)))


@query
def replace_margin(spark, sf):
    scored = _scored(spark, sf)
    return _rounded(S.replace_with_margin(S.select_best_pass(scored.where("engine = 'v3'")), S.select_best_pass(scored.where("engine = 'v5'"))))


@query
def fallback_reasons(spark, sf):
    return S.fallback_reasons(_found(spark, sf), X.pages(spark, sf)).select("doc_id", F.array_join("reasons", "|").alias("reasons"), "triggered")


@query
def language_vote(spark, sf):
    langs = F.array(*(F.struct(F.lit(x).alias("language"), F.lit(o).alias("lang_ord")) for x, o in X.LANGUAGES))
    asked = X.pages(spark, sf).withColumn("l", F.explode(langs)).select("doc_id", "page_idx", "l.language", "l.lang_ord")
    return S.language_vote(D.page_score(X.in_languages(_found(spark, sf)), asked, ["doc_id", "page_idx", "language", "lang_ord"])).drop("page_idx")


@query
def recognised_documents(spark, sf):
    return P.recognised_documents(X.passes(spark, sf), "en", pages=X.pages(spark, sf), planned=X.planned(spark, sf)).drop("raw_text")


@query
def model_results(spark, sf):
    """Answers of one model; documents without a text are those that failed."""
    found = P.recognised_documents(X.passes(spark, sf), "en", pages=X.pages(spark, sf), planned=X.planned(spark, sf), words=True)
    failed = X.table(spark, sf, "documents").where("text is null").select("doc_id", F.lit("no text").alias("error"))
    calls = E.total_elapsed(X.pairs(spark, sf).where("model = 'identity'"), ["doc_id"]).drop("n_calls")
    return P.model_results(found, "printed", "en", failed, calls).drop("metadata").withColumn("words", F.to_json("words"))


@query
def simple_documents(spark, sf):
    return P.simple_documents(X.detections(spark, sf), "en", pages=X.pages(spark, sf)).drop("raw_text")


@query
def all_language_documents(spark, sf):
    out = P.all_language_documents(X.in_languages(X.detections(spark, sf)), X.pages(spark, sf), X.LANGUAGES)
    return out.drop("raw_text").withColumn("resolved_page_languages", F.array_join("resolved_page_languages", ","))


@query
def page_diagnostics(spark, sf):
    return P.page_diagnostics(X.passes(spark, sf), X.pages(spark, sf), "ar", alternate=True, planned=X.planned(spark, sf)).drop("page_idx").withColumn("fallback_reasons", F.array_join("fallback_reasons", "|"))


@query
def document_metadata(spark, sf):
    documents = P.diagnosed_documents(X.passes(spark, sf), X.pages(spark, sf), "ar", alternate=True, planned=X.planned(spark, sf))
    return P.metadata(documents, "ar")


@query
def page_variants(spark, sf):
    """Pictures of all pages in all their variants, for a language that has most of them."""
    made = pictures.page_variants(X.page_images(spark, sf), "ar")
    return made.select("doc_id", "variant_ord", "variant", "scale", "width", "height", F.md5("data").alias("data_md5"))


@query
def page_skew(spark, sf):
    return pictures.skew_angles(X.page_images(spark, sf)).drop("page_idx")


# Text


def _unicode(spark):
    return X.frame(spark, X.UNICODE, "case_id string, s string")


def _over_cases(name: str, make: Callable) -> None:
    QUERIES[name] = lambda spark, sf: _unicode(spark).select("case_id", make(F.col("s")).alias("value"))


def _over_documents(name: str, make: Callable) -> None:
    """Over the cases and over whole documents in Arabic letters."""

    def run(spark, sf):
        own = X.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("case_id"), F.translate("text", X.LATIN, X.ARABIC).alias("s"))
        return _unicode(spark).unionByName(own).select("case_id", make(F.col("s")).alias("value"))

    QUERIES[name] = run


for _name, _make in {
    "arabic_ratio": lambda s: M.round_at(T.arabic_ratio(s), 6), "arabic_word_tokens": T.arabic_word_tokens, "diacritic_density": lambda s: M.round_at(T.diacritic_density(s), 6),
    "arabic_doc_type": T.doc_type, "repeated_run": T.repeated_run, "strip_invisible": T.strip_invisible, "strip_kashida": T.strip_kashida, "dedup_diacritics": T.dedup_diacritics,
    "fold_alef": T.fold_alef, "filter_isolated": T.filter_isolated, "nfkc": T.nfkc, "arabic_correct": T.arabic_correct,
}.items():
    _over_documents(_name, _make)
_over_cases("arabic_punct", T.arabic_punct)


@query
def normalize_text(spark, sf):
    n = T.normalize(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", F.length(n).alias("n_chars_normal"), F.md5(n).alias("normal_md5"))


@query
def ws_tokens(spark, sf):
    t = T.words(T.normalize(F.col("text")))
    return X.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query
def char_tokens(spark, sf):
    t = T.chars(T.normalize(F.col("text")))
    return X.table(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query
def final_lines(spark, sf):
    s = T.arabic_correct(F.col("s"))
    return _unicode(spark).where(~T.blank(F.col("s"))).select("case_id", s.alias("text_corrected")).where("text_corrected <> ''")


# Metrics


@query
def paired_runs(spark, sf):
    """Two runs over the same files, each paired with truths that are laid out by position once: the pairing moves no rows."""
    key, buckets = ["doc_id", "line_no"], 2 * spark.sparkContext.defaultParallelism
    truths = laid_out(X.truths(spark, sf), key, buckets)
    runs = [X.detections(spark, sf).withColumn("run", F.lit("all")), _found(spark, sf).withColumn("run", F.lit("kept"))]
    made = [laid_out(r.select("doc_id", F.col("det_ord").alias("line_no"), "run", F.col("text").alias("predicted")), key, buckets) for r in runs]
    pairs = [E.pair_by_position(files.hint("merge"), truths, key) for files in made]
    return pairs[0].unionByName(pairs[1]).select("run", *key, "predicted", (F.col("predicted") == F.col("line")).alias("same"))


@query
def batch_pairs(spark, sf):
    files = X.pairs(spark, sf).select("doc_id", "line_no", "model", "predicted")
    return E.pair_by_position(files, X.truths(spark, sf), ["doc_id", "line_no"]).select("doc_id", "line_no", "model", "predicted", F.col("line").alias("ground_truth"))


@query
def doc_model_cross(spark, sf):
    return X.pairs(spark, sf).select("doc_id", "line_no", "model", "error", "inference_time_ms")


def _counted(spark, sf, *counts):
    return M.with_counts(X.pairs(spark, sf).where(E.ok()), counts=counts)


KEY = ("doc_id", "line_no", "model")


@query
def edit_distance(spark, sf):
    return _counted(spark, sf, "char_dist").select(*KEY, F.col("char_dist").alias("distance"))


@query
def cer(spark, sf):
    return _counted(spark, sf, "char_dist", "g_len").select(*KEY, M.error_rate(F.col("char_dist"), F.col("g_len")).alias("cer"))


@query
def ned(spark, sf):
    return _counted(spark, sf, "char_dist", "p_len", "g_len").select(*KEY, M.error_rate(F.col("char_dist"), F.greatest("p_len", "g_len")).alias("ned"))


@query
def wer(spark, sf):
    return _counted(spark, sf, "word_dist", "g_n").select(*KEY, M.error_rate(F.col("word_dist"), F.col("g_n")).alias("wer"))


@query
def exact_match(spark, sf):
    return _counted(spark, sf, "equal").select(*KEY, F.col("equal").alias("exact_match"))


@query
def multiset_intersection(spark, sf):
    return _counted(spark, sf, "char_shared", "word_shared").select(*KEY, "char_shared", "word_shared")


@query
def token_prf(spark, sf):
    c = F.col
    return _counted(spark, sf, "word_shared", "p_n", "g_n").select(*KEY, M.share(c("word_shared"), c("p_n")).alias("word_precision"), M.share(c("word_shared"), c("g_n")).alias("word_recall"), M.share(2 * c("word_shared"), c("p_n") + c("g_n")).alias("word_f1"))


@query
def compute_metrics(spark, sf):
    return M.compute_metrics(X.pairs(spark, sf).where(E.ok())).select(*KEY, *M.METRICS)


@query
def overall_accuracy(spark, sf):
    return M.compute_metrics(X.pairs(spark, sf).where(E.ok())).select(*KEY, "overall_accuracy")


@query
def evaluate_with_errors(spark, sf):
    return E.evaluate(X.pairs(spark, sf)).select(*KEY, *M.METRICS)


@query
def batch_per_image(spark, sf):
    return E.per_image(E.evaluate(X.pairs(spark, sf)), ["doc_id", "line_no"])


@query
def batch_summary(spark, sf):
    """As a batch request has it: files and lines of ground truth, paired by position after their counts are compared."""
    files, key = X.pairs(spark, sf).drop("ground_truth"), ["doc_id", "line_no"]
    truths = X.truths(spark, sf).withColumnRenamed("line", "ground_truth")
    return P.batch(files, truths, key, uploads=truths.select(*key))[1]


@query
def elapsed_totals(spark, sf):
    return E.total_elapsed(X.pairs(spark, sf).where(E.ok()), ["doc_id", "model"])


@query
def evaluate_summary(spark, sf):
    return E.batch_summary(E.evaluate(X.pairs(spark, sf)))


@query
def best_models(spark, sf):
    """By document: the means of each model over the document's lines, then the best."""
    c = F.col
    rows = E.evaluate(X.pairs(spark, sf)).withColumn("bad", ~E.ok())
    means = rows.groupBy("doc_id", "model", "model_ord").agg(*(E.mean4(m).alias(m) for m in ("cer", "wer", "word_f1")), F.when(F.max("bad"), "error").alias("error"))
    return E.best_models(means, ["doc_id"])


def _document_results(spark, sf):
    """Three models over whole documents: all passes of the printed engine, the detections as they come, and one that fails on every third."""
    c = F.col
    pages = X.pages(spark, sf)
    printed = P.recognised_documents(X.passes(spark, sf), "en", pages=pages, planned=X.planned(spark, sf))
    plain = P.simple_documents(X.detections(spark, sf), "en", pages=pages)
    parts = []
    for k, (name, made) in enumerate((("printed", printed), ("plain", plain), ("moody", plain))):
        error = F.when(c("doc_id") % 3 == 0, "boom") if name == "moody" else F.lit(None).cast("string")
        parts.append(made.select("doc_id", F.lit(k).alias("model_ord"), F.lit(name).alias("model"), c("doc_text").alias("raw_text"), "avg_confidence", ((c("doc_id") * 13 + k * 29) % 997 / F.lit(10.0)).alias("inference_time_ms"), error.alias("error")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _named_truths(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.format_string("%d.png", "doc_id").alias("filename"), F.col("text").alias("ground_truth"))


@query
def evaluate_documents(spark, sf):
    """The whole evaluate request: recognised documents against their whole texts."""
    return R.evaluate_documents(_document_results(spark, sf), _named_truths(spark, sf), "en")


@query
def document_overlap(spark, sf):
    c = F.col
    found = _document_results(spark, sf).where(E.ok()).select("doc_id", "model", c("raw_text").alias("predicted"))
    return O.overlap_metrics(found.join(_named_truths(spark, sf), "doc_id"), ["doc_id", "model"])


@query
def batch_report(spark, sf):
    c = F.col
    report = R.batch_report(E.evaluate(X.pairs(spark, sf).where("doc_id % 5 <> 0 OR error IS NOT NULL")), ["doc_id", "line_no"], F.format_string("%d/%d.png", "doc_id", "line_no"))
    whole = lambda x: F.round(x * 10_000).cast("long").cast("string")
    told = F.array_join(F.transform("results", lambda r: F.concat_ws("/", r["model"], *(whole(r[m]) for m in ("cer", "wer", "word_f1", "overall_accuracy")))), " ")
    return report.select("doc_id", "line_no", "image", "ground_truth", told.alias("results"), F.size("results").alias("n_results"), F.get(F.transform("results", lambda r: r["raw_text"]), F.lit(0)).alias("first_text"), "models_run", "total_time_ms")
