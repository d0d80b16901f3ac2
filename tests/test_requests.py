"""Requests, uploads, recognisers, pipelines, streams."""

import pytest
from pyspark.sql import functions as F

from pagewright import recognizers as R
from pagewright.config import Settings, from_session
from pagewright.operators import catalog as C
from pagewright.plans import fixtures as X
from pagewright.plans import pipelines as P
from pagewright.sources import batches, sinks
from pagewright.sources import documents as docs
from pagewright.streaming import arrivals


def names(spark, models, loaded=("printed",), preset=("printed",)):
    catalog = C.catalog(spark, [(k, n, 2, ["en"], True, True, None) for k, n in enumerate(loaded)])
    request = spark.createDataFrame([(1, models, "en")], "request_id int, models string, language string")
    return C.resolve_models(request, catalog, preset).first().names, sorted(r.name for r in C.unknown_models(request, catalog).collect())


def test_presets(spark):
    assert names(spark, "OCR_WITHOUT_LLM_CAPABILITIES") == (["printed"], [])
    assert names(spark, "printed, OCR_WITHOUT_LLM_CAPABILITIES") == (["printed"], [])
    assert names(spark, "OCR_WITHOUT_LLM_CAPABILITIES, not_loaded_model") == (["printed", "not_loaded_model"], ["not_loaded_model"])
    assert names(spark, ",") == ([], []) and names(spark, None) == (["printed"], [])


def test_settings(spark):
    spark.conf.set("pagewright.max_file_mb", "5")
    spark.conf.set("pagewright.fold_alef", "true")
    spark.conf.set("pagewright.side_limit", "")
    try:
        s = from_session(spark)
    finally:
        for k in ("max_file_mb", "fold_alef", "side_limit"):
            spark.conf.unset(f"pagewright.{k}")
    assert (s.max_file_mb, s.fold_alef, s.side_limit) == (5, True, 0)
    assert Settings(precision="x", fp16=True).effective_precision == "fp16" and Settings(precision="bf16", fp16=True).effective_precision == "bf16"


def test_admission(spark):
    catalog = C.catalog(spark, [(k, n, 2, [x], False, True, None) for k, (n, x) in enumerate((("zeta", "en"), ("alpha", "ar")))])
    requests = spark.createDataFrame([(1, "zeta", "en"), (2, "zeta", "ar"), (3, "nope,zeta,none,nope", "en"), (4, ",", "en"), (5, None, "hi")], "request_id int, models string, language string")
    rows = {r.request_id: r for r in C.admit(requests, catalog, ("zeta",)).collect()}
    assert [rows[k].status for k in range(1, 6)] == [200, 404, 422, 404, 404]
    assert (rows[3].requested, rows[3].unknown, rows[3].loaded) == (["nope", "zeta", "none"], ["nope", "none"], ["alpha", "zeta"])
    assert rows[2].loaded == [] and "'ar'" in rows[2].message and rows[1].n_selected == 1
    assert [r.status for r in C.admit(requests, catalog, ("zeta",), batch=True).orderBy("request_id").collect()] == [200, 200, 422, 200, 200]
    empty = C.admit(requests, catalog.where("false"), ("zeta",)).where("request_id = 5").first()
    assert (empty.status, empty.requested, empty.loaded) == (404, [], [])


def test_options(spark):
    row = C.run_options(C.catalog(spark, X.CATALOG), X.PRESET).first()
    assert row.available_model_names == ["printed", "latin", "script"] and row.available_languages == ["all", "en", "ar", "hi", "pa"]
    assert row.loaded_models[0].languages == ["en", "ar", "hi", "all"] and row.presets == {C.PRESET_ALIASES[0]: list(X.PRESET)}


def test_building_falls_back_once():
    calls = []

    def make(**options):
        calls.append(set(options))
        if "limit_side_len" in options:
            raise TypeError("unexpected keyword limit_side_len")
        if "use_tensorrt" in options:
            raise ModuleNotFoundError("No module named 'tensorrt'")
        return options

    options = R.options_for("ar", "v5", Settings(side_limit=900))
    assert options["text_det_box_thresh"] == 0.7 and "precision" not in options and options["det_limit_side_len"] == 900
    assert "limit_side_len" not in R.build_with(make, options) and "det_limit_side_len" in calls[-1] and len(calls) == 2
    fast = R.options_for("en", "v5", Settings(fp16=True), gpu=True, tensorrt=True)
    assert fast["precision"] == "fp16" and "use_tensorrt" not in R.build_with(make, fast)
    with pytest.raises(TypeError):
        R.build_with(lambda **options: make(limit_side_len=1), {"other": 1})


def test_engines_are_built_once_and_failed_alternates_left_out():
    made = []

    def make(language, version):
        made.append((language, version))
        if version == "v3":
            raise RuntimeError("not here")
        return (language, version)

    engines = R.Engines(make)
    assert engines.primary("ar") == engines.primary("ar") == ("ar", "v5") and engines.primary("pa") is None
    assert engines.alternates("ar") == engines.alternates("ar") == [] and engines.alternates("en") == []
    assert made == [("ar", "v5"), ("ar", "v3")]
    good = R.Engines(lambda language, version: version)
    assert good.alternates("ar") == [("v3", "v3")]


def upper_class():
    """Made inside a function, so that workers get it by value."""

    class Upper:
        name, tier, languages = "upper", 2, ("en",)

        def load(self):
            self.ready = True

        def unload(self):
            raise RuntimeError("will not go")

        def supports_language(self, language):
            return language in ("en", "all")

        def run(self, content, language):
            if content == b"bad":
                raise ValueError("cannot read")
            return [(line, 0.5, [0, 20 * k, 100, 20 * k + 15]) for k, line in enumerate(content.decode().upper().split("\n"))] if content else []

    return Upper


Upper = upper_class()


def test_recognise_files(spark, tmp_path):
    for name, content in {"a": b"one\ntwo", "b": b"bad", "c": b"", "d": b"x" * (1 << 20)}.items():
        (tmp_path / name).write_bytes(content)
    files = docs.read_documents(spark, str(tmp_path), Settings(max_file_mb=1))
    rows = R.recognize(files, Upper, "en").withColumn("file", F.element_at(F.split("path", "/"), -1)).orderBy("file", "det_ord").collect()
    assert [(r.file, r.text, r.error) for r in rows][:3] == [("a", "ONE", None), ("a", "TWO", None), ("b", None, "cannot read")]
    assert [r.file for r in rows] == ["a", "a", "b", "d"]
    assert docs.read_documents(spark, str(tmp_path), Settings(max_file_mb=0)).count() == 0


def counting_class(log):
    class Counting:
        name, tier, languages = "counting", 2, ("en",)

        def load(self):
            with open(log, "a") as f:
                f.write("x")

        def unload(self): ...

        def flush(self):
            raise RuntimeError("no such memory")

        def supports_language(self, language):
            return True

        def run(self, content, language):
            return [("t", 1.0, [0, 0, 9, 9])]

    return Counting


def test_a_worker_keeps_its_engine(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), b"x") for k in range(40)], "path string, content binary").repartition(20)
    log = str(tmp_path / "loads")
    assert R.recognize(rows, counting_class(log), "en", name=log).count() == 40
    assert len(open(log).read()) <= 8  # workers, not the twenty tasks


def test_ordinals_and_batch_files(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"{k * 7 % 30:02}.txt").write_bytes(b"x")
    files = docs.read_batch(spark, str(tmp_path)).collect()
    assert [r.ord for r in sorted(files, key=lambda r: r.path)] == list(range(30))
    assert docs.with_ordinal(spark.createDataFrame([], "path string")).count() == 0


def test_pdf_by_its_first_bytes(spark):
    cases = {b"%PDF-1": "pdf", b" " * 5000 + b"\n%PDF": "pdf", b"\x00%PDF": "image", b"": "image", b" x%PDF": "image", b"\x0b\x0c%PDF": "pdf", b"\x1c%PDF": "image", bytes(range(128, 256)): "image"}
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "k int, head binary")
    assert {r.k: r.kind for r in docs.sniff(rows).collect()} == dict(enumerate(cases.values()))


def test_debug_folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert sinks.debug_folder("") is None and sinks.debug_folder("a/b") == tmp_path / "a" / "b" and (tmp_path / "a" / "b").is_dir()
    (tmp_path / "file").write_text("x")
    assert sinks.debug_folder("file/below") == tmp_path / "debug_output"


def test_registry(spark):
    R.register("upper", Upper)
    rows = R.catalog(spark, ["upper", "nobody"]).collect()
    assert [(r.name, r.loaded, r.error) for r in rows] == [("upper", True, None), ("nobody", False, "unknown model")]
    assert R.shutdown() == {"upper": "will not go"}


def test_batch_needs_a_line_for_each_file(spark):
    files = spark.createDataFrame([(0, "m", "a b", None, 1.0), (1, "m", "c", None, 2.0)], "ord int, model string, predicted string, error string, inference_time_ms double")
    truths = spark.createDataFrame([(0, "a b"), (1, "d")], "ord int, ground_truth string")
    rows, summary = P.batch(files, truths, ["ord"])
    assert rows.count() == 2 and summary.first().avg_cer == 0.5
    with pytest.raises(ValueError):
        P.batch(files, truths.limit(1), ["ord"])


def test_json_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None)], "id int, t string, e string")
    assert sinks.as_json(rows).first()[0] == '{"id":1,"t":"a"}'
    sinks.write_json(rows, str(tmp_path / "j"))
    sinks.write_parquet(rows, str(tmp_path / "p"), ["id"])
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_health(spark):
    row = docs.health(spark, ["printed"]).first()
    assert row.status == "ok" and row.models == ["printed"] and (row.gpu is None or row.gpu)


def test_stream_equals_batch(spark, sf, tmp_path):
    passes = X.passes(spark, sf).where("doc_id < 20")
    passes.where("doc_id < 10").write.parquet(str(tmp_path / "in" / "one"))
    passes.where("doc_id >= 10").write.parquet(str(tmp_path / "in" / "two"))
    stream = arrivals.arriving_table(spark, str(tmp_path / "in" / "*"), passes.schema.simpleString()[7:-1].replace(":", " "))
    arrivals.write_each(stream, lambda b: P.recognised_documents(b, "en"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    expected = {(r.doc_id, r.doc_text) for r in P.recognised_documents(passes, "en").collect()}
    assert {(r.doc_id, r.doc_text) for r in batches.read(spark, str(tmp_path / "out")).collect()} == expected


def test_documents_without_lines(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_idx int")
    line = (1, 1, "v5", 0, "original", 0, 0, "one line", 0.5, 0, 0, 100, 20)
    passes = spark.createDataFrame([line, (*line[:6], 1, " ", 0.5, 0, 30, 100, 50)], X_PASSES)
    for out in (P.recognised_documents(passes, "en", pages=pages), P.simple_documents(passes, "en", pages=pages), P.run(passes, pages, "en"), P.run(passes, pages, "en", s=Settings(max_accuracy=False))):
        assert sorted((r.doc_id, r.doc_text, r.n_lines, r.avg_confidence, r.n_pages) for r in out.collect()) == [(1, "one line", 1, 0.5, 2), (2, "", 0, 0.0, 1)]


X_PASSES = "doc_id long, page_idx int, engine string, engine_ord int, variant string, variant_ord int, det_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int"


def test_answers(spark):
    pages = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, page_idx int")
    passes = spark.createDataFrame([(1, 0, "v5", 0, "original", 0, 0, "one line", 0.5, 1, 2, 100, 20), (3, 0, "v5", 0, "original", 0, 0, "lost", 0.5, 1, 2, 100, 20)], X_PASSES)
    documents = P.recognised_documents(passes, "en", pages=pages, words=True)
    errors = spark.createDataFrame([(3, "boom")], "doc_id long, error string")
    elapsed = spark.createDataFrame([(1, 12.345)], "doc_id long, total_ms double")
    rows = {r.doc_id: r for r in P.model_results(documents, "m", "en", errors, elapsed).collect()}
    assert [tuple(w) for w in rows[1].words] == [("one line", 0.5, [1, 2, 100, 20])] and (rows[1].inference_time_ms, rows[1].error) == (12.35, None)
    assert (rows[2].raw_text, rows[2].words, rows[2].avg_confidence) == ("", [], 0.0)
    assert (rows[3].raw_text, rows[3].words, rows[3].error, rows[3].avg_confidence) == ("", [], "boom", 0.0) and {r.model_name for r in rows.values()} == {"m"}


def test_pages_are_joined_in_order(spark):
    rows = [(1, p, "v5", 0, "original", 0, k, f"p{p} l{k}", 0.5, 0, 30 * k, 100, 30 * k + 20) for p in (2, 0) for k in (1, 0)]
    out = P.recognised_documents(spark.createDataFrame(rows, X_PASSES), "en").first()
    assert out.doc_text == out.raw_text == "p0 l0\np0 l1\n\np2 l0\np2 l1" and (out.n_lines, out.n_pages) == (4, 2)


def test_best_language_of_each_page(spark):
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_idx int")
    rows = [(1, 0, 0, "en", 0, "low", 0.4), (1, 0, 0, "ar", 1, "high", 0.9), (1, 1, 0, "hi", 2, "only", 0.1)]
    found = spark.createDataFrame([(*r, 0, 0, 100, 20) for r in rows], "doc_id long, page_idx int, det_ord int, language string, lang_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    out = {r.doc_id: (r.doc_text, r.resolved_page_languages, r.n_lines) for r in P.run(found, pages, "all", languages=(("en", 0), ("ar", 1), ("hi", 2))).collect()}
    assert out == {1: ("high\n\nonly", ["ar", "hi"], 2), 2: ("", ["en"], 0)}


def test_noise_is_dropped_before_boxes_shrink(spark):
    twice = (1, 0, "v5", 0, "upscaled_2x", 1, 0, "small", 0.5, 0, 0, 60, 9, 2.0)
    passes = spark.createDataFrame([twice], X_PASSES + ", scale double")
    kept = P.kept_lines(passes).first()  # nine rows high as the engine saw it, four on the page
    assert (kept.x2, kept.y2) == (30, 4)


def test_diagnostics_have_an_alternate_only_where_there_is_one(spark, sf):
    passes, pages = X.passes(spark, sf).where("doc_id < 12"), X.pages(spark, sf).where("doc_id < 12")
    latin = P.page_diagnostics(passes, pages, "en", alternate=True).collect()
    assert {(r.comparison_mode, r.alt_best_score, r.alt_response_raw_text, r.fallback_triggered) for r in latin} == {("primary_only", None, "", False)} and {r.selected_engine for r in latin} == {"v5"}
    both = P.page_diagnostics(passes, pages, "ar", alternate=True, mode=P.ALWAYS).collect()
    assert all(r.comparison_mode == P.ALWAYS and r.fallback_reasons == [] and not r.fallback_triggered and r.alt_response_raw_text for r in both if r.primary_response_raw_text)


def test_metadata_keys(spark):
    import json

    documents = spark.createDataFrame([(1, "", "", 1, ["en"])], "doc_id long, doc_text string, raw_text string, n_pages long, resolved_page_languages array<string>")
    found = json.loads(P.metadata(documents, "all").first().metadata)
    assert found == {"page_count": 1, "max_accuracy_mode": False, "raw_text_before_correction": "", "input_pipeline": [{"roi_warp_applied": False, "roi_warp_reason": "disabled"}], "best_effort_language_mode": "best_single_language_engine_per_page", "resolved_page_languages": ["en"]}
    drawn = spark.createDataFrame([(1, 0, "stage4_results", "/x.png")], "doc_id long, page_idx int, name string, path string")
    warped = spark.createDataFrame([(1, 0, True, "ok")], "doc_id long, page_idx int, roi_warp_applied boolean, roi_warp_reason string")
    found = json.loads(P.metadata(documents, "en", inputs=warped, drawings=drawn).first().metadata)
    assert found["debug_visualizations"] == {"p0_stage4_results": "/x.png"} and found["input_pipeline"] == [{"roi_warp_applied": True, "roi_warp_reason": "ok"}]
