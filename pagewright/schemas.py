"""Schemas at the edges of the pipeline. Order in a list matters, so every table carries its ordinals."""

BOX = "array<int>"
DETECTION = f"struct<det_ord:int,text:string,conf:double,bbox:{BOX}>"
PAGE = "doc_id string, page_idx int, width int, height int, n_channels int, data binary, error string"
DETECTIONS = "doc_id long, page_idx int, det_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int"
PASSES = "doc_id long, page_idx int, engine string, engine_ord int, variant string, variant_ord int, det_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int"
CATALOG = "model_ord int, name string, tier int, languages array<string>, supports_all boolean, loaded boolean, error string"
PAIRS = "doc_id long, line_no int, model string, model_ord int, predicted string, ground_truth string, error string, inference_time_ms double"
LANGUAGES = ("all", "en", "ar", "hi", "pa")
