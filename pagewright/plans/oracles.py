"""For each registered query that SQL can express, the SQL: the same rows, written independently of the Spark code."""

from __future__ import annotations

from . import fixtures as X

SPACES = r"\t\n\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
AR = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
#: The same without marks and tatweel.
BASE = r"\x{0600}-\x{063F}\x{0641}-\x{064A}\x{0653}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
MARK = r"\x{064B}-\x{0652}"


def lit(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        parts = ["'" + x.replace("'", "''") + "'" if ok else f"chr({ord(x)})" for ok, x in _pieces(v)]
        return "(" + " || ".join(parts or ["''"]) + ")"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v)


def _pieces(v: str) -> list[tuple[bool, str]]:
    """Printable ASCII runs, and single other characters."""
    out: list[tuple[bool, str]] = []
    for ch in v:
        ok = " " <= ch <= "~"
        if ok and out and out[-1][0]:
            out[-1] = (True, out[-1][1] + ch)
        else:
            out.append((ok, ch))
    return out


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def count(s: str, chars: str) -> str:
    return f"length(regexp_replace({s}, '[^{chars}]', '', 'g'))"


def strip(s: str) -> str:
    return f"regexp_replace({s}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '[{SPACES}]+', ' ', 'g'))"


def words(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda w: w <> '')"


def r4(n: str, d: str) -> str:
    """n / d at four decimals, half to even, 0 for 0."""
    q, r = f"((10000 * ({n})) // ({d}))", f"((10000 * ({n})) % ({d}))"
    return f"CASE WHEN ({d}) = 0 THEN 0.0::DOUBLE ELSE ({q} + CASE WHEN 2 * {r} > ({d}) OR (2 * {r} = ({d}) AND {q} % 2 = 1) THEN 1 ELSE 0 END) / 10000::DOUBLE END"


DETECTIONS = """lines AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
boxes AS (SELECT doc_id, CAST(i AS INTEGER) AS det_ord, text, ((doc_id * 31 + i * 17) % 1000) / 1000::DOUBLE AS conf,
  CAST(20 + (doc_id * 37 + i * 53) % 60 + CASE WHEN doc_id % 3 = 0 AND i % 2 = 1 THEN 420 ELSE 0 END AS INTEGER) AS x1,
  CAST(12 * CASE WHEN doc_id % 3 = 0 THEN i // 2 ELSE i END + (doc_id * 7 + i * 11) % 9 AS INTEGER) AS y1,
  CAST(least(300, 8 * length(text)) AS INTEGER) AS w, CAST(6 + (doc_id * 5 + i * 3) % 24 + CASE WHEN doc_id % 5 = 0 THEN 45 ELSE 0 END AS INTEGER) AS h FROM lines),
det AS (SELECT doc_id, det_ord, text, conf, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM boxes)"""
KEPT = f"{DETECTIONS},\nkept AS (SELECT * FROM det WHERE (x2 - x1) * (y2 - y1) >= 150 AND y2 - y1 >= 8 AND {strip('text')} <> '')"
_V = "(VALUES " + ", ".join(f"({lit(v)}, {o}, {lit(s)})" for v, o, s in X.VARIANTS) + ") AS v(variant, variant_ord, scale)"
_E = "(VALUES " + ", ".join(f"({lit(e)}, {o})" for e, o in X.ENGINES) + ") AS e(engine, engine_ord)"
PASSES = f"""{DETECTIONS},
passes AS (SELECT doc_id, engine, engine_ord, variant, variant_ord, scale, det_ord, text, greatest(0::DOUBLE, conf - 0.02::DOUBLE * variant_ord - 0.03::DOUBLE * engine_ord) AS conf,
  CAST(trunc(x1 * scale) AS INTEGER) AS x1, CAST(trunc(y1 * scale) AS INTEGER) AS y1, CAST(trunc(x2 * scale) AS INTEGER) AS x2, CAST(trunc(y2 * scale) AS INTEGER) AS y2
  FROM det, {_V}, {_E} WHERE (det_ord + variant_ord + engine_ord) % 5 <> 0),
scaled AS (SELECT * EXCLUDE (x1, y1, x2, y2), CAST(trunc(x1 * (1::DOUBLE / scale)) AS INTEGER) AS x1, CAST(trunc(y1 * (1::DOUBLE / scale)) AS INTEGER) AS y1, CAST(trunc(x2 * (1::DOUBLE / scale)) AS INTEGER) AS x2, CAST(trunc(y2 * (1::DOUBLE / scale)) AS INTEGER) AS y2 FROM passes)"""
RUN = "len(list_filter(range(1, len({c}) - 3), lambda i: {c}[i] = {c}[i + 1] AND {c}[i] = {c}[i + 2] AND {c}[i] = {c}[i + 3] AND {c}[i] = {c}[i + 4] AND {c}[i] <> chr(10))) > 0"
MEDIAN = "CASE WHEN count(*) < 3 THEN 15::DOUBLE ELSE coalesce(quantile_cont(CASE WHEN y2 > y1 THEN CAST(y2 - y1 AS DOUBLE) END, 0.5), 15::DOUBLE) END"
_NOISE = f"(x2 - x1) * (y2 - y1) >= 150 AND y2 - y1 >= 8 AND {strip('text')} <> ''"
TOKENS_OF = f"len(list_filter({words(collapse('t'))}, lambda w: {count('w', BASE)} >= 2))"
VARIANT = "CASE variant WHEN 'upscaled_2x' THEN 0.88::DOUBLE WHEN 'downscaled_0.75x' THEN 0.93::DOUBLE ELSE 1 END"
REPEATED = f"CASE WHEN {RUN.format(c='c')} THEN 0.5::DOUBLE ELSE 1 END"
LATIN_SCORE = f"sqrt(greatest(1, length(t))) * conf * {VARIANT} * {REPEATED}"
FOREIGN = "CASE WHEN 1 - ratio > 0.35 THEN CASE WHEN ratio < 0.10 THEN 0.2::DOUBLE ELSE 1 END WHEN ratio < 0.30 THEN 0.2::DOUBLE WHEN ratio < 0.50 THEN 0.5::DOUBLE ELSE 1 END"
ARABIC_SCORE = f"sqrt(greatest(1, {TOKENS_OF} * 4.5::DOUBLE)) * conf * CASE WHEN marks > 0.40 THEN 0.3::DOUBLE ELSE 1 END * CASE WHEN h < 16 THEN 0.4::DOUBLE ELSE 1 END * {FOREIGN} * {VARIANT} * {REPEATED}"


def scored(score: str, passes: str = PASSES) -> str:
    """Every planned pass with its score. Noise is dropped at the scale of the pass, before boxes are rescaled."""
    return f"""{passes},
good AS (SELECT * FROM scaled SEMI JOIN (SELECT doc_id, engine, variant, det_ord FROM passes WHERE {_NOISE}) USING (doc_id, engine, variant, det_ord)),
joined AS (SELECT doc_id, engine, engine_ord, variant, variant_ord, string_agg({strip('text')}, ' ' ORDER BY det_ord) AS t, list_sum(list(conf ORDER BY det_ord)) / count(*) AS conf, {MEDIAN} AS h FROM good GROUP BY ALL),
cut AS (SELECT *, string_split(t, '') AS c, {count('t', AR)} / length(t) AS ratio, {count('t', MARK)} / length(t) AS marks FROM joined),
planned AS (SELECT doc_id, engine, engine_ord, variant, variant_ord FROM documents, {_V}, {_E} WHERE text IS NOT NULL),
scored AS (SELECT doc_id, engine, engine_ord, variant, variant_ord, coalesce({score}, 0::DOUBLE) AS score FROM planned LEFT JOIN cut USING (doc_id, engine, engine_ord, variant, variant_ord))"""


SCORED = scored(LATIN_SCORE)
THREE = "floor(score * 1e3 + 0.5) / 1e3"
BEST = "best AS (SELECT doc_id, variant, engine, score, n_passes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, variant_ord, engine_ord) AS rn, count(*) OVER (PARTITION BY doc_id) AS n_passes FROM {t}) WHERE rn = 1)"
IN_ARABIC = f"translate(text, {lit(X.LATIN)}, {lit(X.ARABIC)})"
COLUMNS = """centred AS (SELECT *, x1 + (x2 - x1) / 2 AS cx FROM kept),
stepped AS (SELECT *, row_number() OVER w AS place_no, lag(cx) OVER w AS before FROM centred WINDOW w AS (PARTITION BY doc_id ORDER BY cx, det_ord)),
widest AS (SELECT doc_id, cx - before AS gap, (cx + before) / 2 AS middle FROM stepped WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cx - before DESC, place_no) = 1),
cols AS (SELECT p.doc_id, n_lines, page_width, gap AS max_gap, CASE WHEN n_lines >= 6 AND page_width <> 0 AND gap / page_width >= 0.10 THEN middle END AS split_x
  FROM (SELECT doc_id, count(*) AS n_lines, max(x2) AS page_width FROM kept GROUP BY doc_id) p LEFT JOIN widest USING (doc_id))"""
REASONS = f"""n AS (SELECT *, lead(y1) OVER w AS b1, lead(y2) OVER w AS b2 FROM {{lines}} WINDOW w AS (PARTITION BY doc_id ORDER BY y1, det_ord)),
f AS (SELECT doc_id, count(*) AS n, string_agg({strip('text')}, ' ' ORDER BY det_ord) AS t, list_sum(list(conf ORDER BY det_ord)) / count(*) AS conf, {MEDIAN} AS h,
  CAST(sum(CASE WHEN b1 IS NOT NULL AND least(y2 - y1, b2 - b1) > 0 AND (least(y2, b2) - greatest(y1, b1)) / least(y2 - y1, b2 - b1) > 0.30::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS over FROM n GROUP BY doc_id),
g AS (SELECT *, string_split(t, '') AS c FROM f),
reasons AS (SELECT doc_id, concat_ws('|', CASE WHEN n < 4 THEN 'low_line_count<4' END, CASE WHEN length(t) < 80 THEN 'low_char_count<80' END, CASE WHEN conf < 0.65::DOUBLE THEN 'low_avg_conf<0.65' END, CASE WHEN {count('t', AR)} / length(t) < 0.60::DOUBLE THEN 'low_arabic_ratio<0.60' END,
  CASE WHEN {RUN.format(c='c')} THEN 'repeated_char_pattern' END, CASE WHEN h < 16 THEN printf('low_median_box_height<16px(got %.1fpx)', h) END, CASE WHEN n >= 4 AND over / (n - 1) > 0.20::DOUBLE THEN 'bbox_vertical_overlap_fragmentation(' || over || '/' || (n - 1) || 'pairs)' END) AS reasons FROM g)"""
BANDS = f"""{COLUMNS},
tols AS (SELECT doc_id, greatest(15, CAST(trunc({MEDIAN} * 0.4::DOUBLE) AS INTEGER)) AS tol FROM kept GROUP BY doc_id),
placed AS (SELECT k.*, (y1 + y2) / 2 AS cy, tol, CASE WHEN split_x IS NULL OR (x1 + x2) / 2 >= split_x THEN 0 ELSE 1 END AS col FROM kept k JOIN cols USING (doc_id) JOIN tols USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col ORDER BY cy, det_ord) AS rn FROM placed),
r AS (SELECT doc_id, col, rn, det_ord, x1, cy, cy AS anchor, 0 AS band FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.col, o.rn, o.det_ord, o.x1, o.cy, CASE WHEN abs(o.cy - r.anchor) >= o.tol THEN o.cy ELSE r.anchor END, CASE WHEN abs(o.cy - r.anchor) >= o.tol THEN r.band + 1 ELSE r.band END
  FROM r JOIN o ON o.doc_id = r.doc_id AND o.col = r.col AND o.rn = r.rn + 1)"""
STACKED = KEPT.replace("kept AS", "single AS") + ",\nkept AS (SELECT doc_id % 20 AS doc_id, doc_id * 100000 + det_ord AS det_ord, text, conf, x1, y1 + 37 * doc_id AS y1, x2, y2 + 37 * doc_id AS y2 FROM single)"
TRUTHS = f"""truths AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS line_no, unnest(s) AS line
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL))"""
PAIRS = f"""{TRUTHS},
pairs AS (SELECT doc_id, line_no, line AS ground_truth, model, model_ord, ((doc_id * 13 + model_ord * 29) % 997) / 10::DOUBLE AS inference_time_ms,
  CASE WHEN model = 'flaky' AND doc_id % 7 = 0 THEN 'boom' WHEN model = 'dead' THEN 'dead' END AS error,
  CASE model WHEN 'identity' THEN line WHEN 'drop_a' THEN replace(line, 'a', '') WHEN 'short' THEN left(line, length(line) - length(line) // 4) WHEN 'dead' THEN NULL ELSE translate(line, 'e', 'c') END AS predicted
  FROM truths, (VALUES ('identity', 0), ('sub_e', 1), ('drop_a', 2), ('short', 3), ('flaky', 4), ('dead', 5)) AS m(model, model_ord)),
normal AS (SELECT *, {collapse("nfc_normalize(coalesce(predicted, ''))")} AS p, {collapse('nfc_normalize(ground_truth)')} AS g FROM pairs)"""
#: DuckDB's levenshtein counts bytes, so each distinct character of a pair becomes one printable ASCII byte first.
DISTANCE = "CASE WHEN p = g THEN 0 ELSE levenshtein(array_to_string(list_transform(string_split(p, ''), lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), ''), array_to_string(list_transform(string_split(g, ''), lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), '')) END"
DISTS = f"{PAIRS},\nd AS (SELECT *, {DISTANCE} AS dist FROM (SELECT *, list_distinct(string_split(p || g, '')) AS v FROM normal WHERE error IS NULL))"


def shared(a: str, b: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda x: x = w))))), 0) AS BIGINT)"


SHARED = f"{PAIRS},\nt AS (SELECT *, {words('p')} AS pw, {words('g')} AS gw, string_split(p, '') AS pc, string_split(g, '') AS gc FROM normal WHERE error IS NULL),\ns AS (SELECT *, CASE WHEN p = g THEN len(pw) ELSE {shared('pw', 'gw')} END AS ws, CASE WHEN p = g THEN length(p) ELSE {shared('pc', 'gc')} END AS cs FROM t)"
#: Word distance. What two word lists begin with in common is cut off; words of both sides become single ASCII signs if there are at
#: most 120 of them, and words of one side only one sign a side, as they match nothing; the few other pairs are worked out row by row.
ALL_METRICS = f"""{DISTS},
u AS MATERIALIZED (SELECT *, {words('p')} AS pw, {words('g')} AS gw, string_split(p, '') AS pc, string_split(g, '') AS gc, row_number() OVER (ORDER BY doc_id, line_no, model_ord) AS id FROM d),
apart AS MATERIALIZED (SELECT id, pw[k:] AS a, gw[k:] AS b, list_intersect(pw[k:], gw[k:]) AS common FROM (SELECT id, pw, gw, coalesce(nullif(list_position(list_transform(range(1, least(len(pw), len(gw)) + 1), lambda i: pw[i] = gw[i]), FALSE), 0), least(len(pw), len(gw)) + 1) AS k FROM u WHERE p <> g)),
coded AS (SELECT id, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(CASE WHEN list_contains(common, x) THEN 2 + list_position(common, x) ELSE 1 END AS INTEGER))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(CASE WHEN list_contains(common, x) THEN 2 + list_position(common, x) ELSE 2 END AS INTEGER))), '')) AS wd FROM apart WHERE len(common) <= 120),
left_words AS MATERIALIZED (SELECT id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM apart WHERE len(common) > 120),
ends AS (SELECT id, len(a) AS i, len(b) AS j FROM apart WHERE len(common) > 120),
steps AS (SELECT id, 0::BIGINT AS i, generate_subscripts(b, 1)::BIGINT AS j, unnest(b) AS y, generate_subscripts(b, 1)::BIGINT AS v FROM apart WHERE len(common) > 120
  UNION ALL SELECT id, 0, 0, NULL, 0 FROM apart WHERE len(common) > 120
  UNION ALL SELECT id, i, j, y, j + min(t - j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) FROM
    (SELECT s.id, s.i + 1 AS i, j, y, CASE WHEN j = 0 THEN s.i + 1 ELSE least(v + 1, lag(v) OVER (PARTITION BY s.id ORDER BY j) + CASE WHEN x = y THEN 0 ELSE 1 END) END AS t FROM steps s JOIN left_words l ON l.id = s.id AND l.i = s.i + 1)),
m AS (SELECT u.*, coalesce(coded.wd, far.v, 0) AS wd, CASE WHEN p = g THEN len(pw) ELSE {shared('pw', 'gw')} END AS ws, CASE WHEN p = g THEN length(p) ELSE {shared('pc', 'gc')} END AS cs
  FROM u LEFT JOIN coded USING (id) LEFT JOIN (SELECT id, v FROM steps JOIN ends USING (id, i, j)) far USING (id)),
rated AS (SELECT *, {r4('dist', 'greatest(length(g), 1)')} AS cer, {r4('wd', 'greatest(len(gw), 1)')} AS wer, {r4('dist', 'greatest(length(p), length(g), 1)')} AS ned,
  {r4('cs', 'length(p)')} AS char_precision, {r4('cs', 'length(g)')} AS char_recall, {r4('2 * cs', 'length(p) + length(g)')} AS char_f1,
  {r4('ws', 'len(pw)')} AS word_precision, {r4('ws', 'len(gw)')} AS word_recall, {r4('2 * ws', 'len(pw) + len(gw)')} AS word_f1, p = g AS exact_match FROM m),
ev AS MATERIALIZED (SELECT doc_id, line_no, model, model_ord, inference_time_ms, predicted, cer, wer, ned, char_precision, char_recall, char_f1, word_precision, word_recall, word_f1, exact_match,
  floor(((1 - least(1::DOUBLE, dist / greatest(length(g), 1))) + (1 - least(1::DOUBLE, wd / greatest(len(gw), 1))) + char_f1 + word_f1) / 4 * 1e4 + 0.5) / 1e4 AS overall_accuracy FROM rated)"""
NAMES = "cer, wer, ned, char_precision, char_recall, char_f1, word_precision, word_recall, word_f1, overall_accuracy, exact_match"


def mean4(m: str) -> str:
    return r4(f"CAST(sum(CAST(round({m} * 10000) AS BIGINT)) AS BIGINT)", "count(*) * 10000")


SUMMARY = f"WITH RECURSIVE {ALL_METRICS} SELECT model, " + ", ".join(f"{mean4(m)} AS avg_{m}" for m in ("cer", "wer", "word_f1", "overall_accuracy")) + ", floor(CAST(sum(CAST(round(inference_time_ms * 100) AS BIGINT)) AS BIGINT) / count(*) + 0.5) / 100 AS avg_inference_ms, count(*) AS images_evaluated FROM ev GROUP BY model"
#: The Arabic passes over the documents as they are, which hold no sign that the clean-up of Arabic changes but white space and forms.
CORRECTED = collapse("nfc_normalize(regexp_replace(text, '[\\x{200B}-\\x{200F}\\x{FEFF}]', '', 'g'))")
SIDES = f"""{scored(ARABIC_SCORE)},
sides AS (SELECT doc_id, engine_ord, variant, engine, score, n_passes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, engine_ord ORDER BY score DESC, variant_ord) AS rn, count(*) OVER (PARTITION BY doc_id, engine_ord) AS n_passes FROM scored) WHERE rn = 1),
kept AS (SELECT g.doc_id * 2 + g.engine_ord AS doc_id, g.det_ord, g.text, g.conf, g.x1, g.y1, g.x2, g.y2, {CORRECTED.replace('(text,', '(g.text,')} AS fixed FROM good g JOIN sides USING (doc_id, engine_ord, variant, engine)),
{BANDS},
placed_lines AS (SELECT k.doc_id // 2 AS doc_id, k.doc_id % 2 AS side, k.det_ord, k.text, k.fixed, k.conf, k.x1, k.y1, k.x2, k.y2, row_number() OVER (PARTITION BY k.doc_id ORDER BY r.col, r.band, r.x1 DESC, r.cy, k.det_ord) AS spot FROM kept k JOIN r ON r.doc_id = k.doc_id AND r.det_ord = k.det_ord),
texts AS (SELECT doc_id, side, string_agg(text, chr(10) ORDER BY spot) AS raw, string_agg(fixed, chr(10) ORDER BY spot) AS fixed FROM placed_lines GROUP BY ALL),
first_lines AS (SELECT * FROM placed_lines WHERE side = 0),
{REASONS.replace('{lines}', 'first_lines')},
diagnosed AS (SELECT a.doc_id, CASE WHEN b.score > a.score * 1.03::DOUBLE THEN b.variant ELSE a.variant END AS selected_variant, CASE WHEN b.score > a.score * 1.03::DOUBLE THEN b.engine ELSE a.engine END AS selected_engine,
  floor(a.score * 1e3 + 0.5) / 1e3 AS primary_best_score, floor(b.score * 1e3 + 0.5) / 1e3 AS alt_best_score, 'fallback_enabled_with_dual_output' AS comparison_mode, coalesce(reasons, 'x') <> '' AS fallback_triggered, coalesce(reasons, 'empty_primary_result') AS fallback_reasons,
  coalesce(x.raw, '') AS primary_response_raw_text, coalesce(x.fixed, '') AS primary_response_corrected_text, coalesce(y.raw, '') AS alt_response_raw_text, coalesce(y.fixed, '') AS alt_response_corrected_text, a.n_passes + b.n_passes AS n_passes,
  CASE WHEN b.score > a.score * 1.03::DOUBLE THEN 1 ELSE 0 END AS won
  FROM (SELECT * FROM sides WHERE engine_ord = 0) a JOIN (SELECT * FROM sides WHERE engine_ord = 1) b USING (doc_id) LEFT JOIN reasons USING (doc_id) LEFT JOIN texts x ON x.doc_id = a.doc_id AND x.side = 0 LEFT JOIN texts y ON y.doc_id = a.doc_id AND y.side = 1)"""
SHOWN = "selected_variant selected_engine primary_best_score alt_best_score comparison_mode fallback_triggered fallback_reasons primary_response_raw_text primary_response_corrected_text alt_response_raw_text alt_response_corrected_text".split()
CASES = values("cases", "case_id, s", X.UNICODE)
DOCUMENT_CASES = values("few", "case_id, s", X.UNICODE) + f", cases AS (SELECT * FROM few UNION ALL SELECT CAST(doc_id AS VARCHAR), {IN_ARABIC} FROM documents WHERE text IS NOT NULL)"
MODELS = values("models", "model_ord, name, tier, languages, supports_all, loaded, error", X.CATALOG)
ASKED = values("asked", "k, models", [(k, r[1]) for k, r in enumerate(X.REQUESTS)]) + f", requests AS (SELECT event_id AS request_id, a.models, ({lit(X.ASKED)})[1 + (event_id // 10) % 5] AS language FROM events JOIN asked a ON a.k = event_id % {len(X.REQUESTS)})"
UPLOADED = values("few", "k, path, content_type, length, hex, truth", [(k, *u) for k, u in enumerate(X.UPLOADS)]) + """,
u AS (SELECT f.path || doc_id AS path, content_type, CASE WHEN doc_id % 24 < 12 THEN length ELSE length + coalesce(n_chars, 0) END AS length, f.hex || lower(hex(encode(left(coalesce(text, ''), 16)))) AS hex,
  CASE WHEN regexp_matches(truth, '[a-z]') THEN left(coalesce(text, ''), 20) ELSE truth END AS ground_truth FROM documents JOIN few f ON f.k = doc_id % 12)"""
OUTLINES = f"""{DETECTIONS}, flat AS (SELECT doc_id, det_ord, doc_id * 100000 + det_ord AS id, [[x1, y1], [x2, y1], [x2, y2], [x1, y2]] AS whole, det_ord % 4 AS turn, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area, det_ord % 2 = 0 AS quad FROM det),
outlines AS (SELECT *, list_concat(whole[turn + 1:4], whole[1:turn]) AS corners FROM flat)"""
ALIASES = "('OCR_WITHOUT_LLM_CAPABILITIES', 'ocr_without_llm_capabilities', 'pure_ocr', 'pure-ocr')"
TOKENS = f"""tokens AS (SELECT request_id, language, models, generate_subscripts(s, 1) AS place_no, unnest(s) AS token FROM (SELECT request_id, language, models, list_filter(list_transform(string_split(models, ','), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM requests WHERE models IS NOT NULL AND {strip('models')} <> '')),
preset AS (SELECT k, name FROM (SELECT generate_subscripts(p, 1) AS k, unnest(p) AS name FROM (SELECT {lit(X.PRESET)} AS p)) WHERE name IN (SELECT name FROM models WHERE loaded)),
wanted AS (SELECT request_id, token AS name, place_no, 0 AS k FROM tokens WHERE token NOT IN {ALIASES} UNION ALL SELECT request_id, name, place_no, k FROM tokens, preset WHERE token IN {ALIASES}
  UNION ALL SELECT request_id, name, 0, model_ord FROM requests, models WHERE loaded AND (models.name IS NOT NULL) AND (requests.models IS NULL OR {strip('requests.models')} = '')),
resolved AS (SELECT request_id, name, min(place_no * 1000 + k) AS place FROM wanted GROUP BY ALL)"""

Q = "SELECT doc_id, line_no, model, "
TEXT = f"{collapse('nfc_normalize(text)')}"

ORACLES: dict[str, str] = {
    "doc_sniff": f"WITH {UPLOADED} SELECT path, CASE WHEN regexp_matches(hex, '^((09|0a|0b|0c|0d|20))*25504446') THEN 'pdf' ELSE 'image' END AS kind FROM u",
    "file_heads": r"""WITH files AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN E'\n \t%PDF-' WHEN 2 THEN '%PDF-' ELSE '' END || text AS content FROM documents WHERE text IS NOT NULL)
SELECT doc_id, octet_length(encode(content)) AS length, CASE WHEN regexp_matches(content, '^[ \t\n\r\x0B\f]*%PDF') THEN 'pdf' ELSE 'image' END AS kind FROM files WHERE octet_length(encode(content)) <= 20 * 1048576""",
    "validate_uploads": f"""WITH {UPLOADED},
c AS (SELECT path, CASE WHEN content_type IS NULL OR content_type NOT IN ('image/jpeg', 'image/png', 'image/webp', 'image/tiff', 'application/pdf') THEN 415 WHEN length > 20971520 THEN 413 WHEN ground_truth IS NULL OR {strip('ground_truth')} = '' THEN 422 ELSE 200 END AS status FROM u)
SELECT path, status, CASE status WHEN 415 THEN 'unsupported type' WHEN 413 THEN 'too large' WHEN 422 THEN 'blank ground truth' ELSE 'ok' END AS reason FROM c""",
    "gt_lines": f"WITH {TRUTHS} SELECT doc_id, line_no, line FROM truths",
    "overlay_labels": f"WITH {KEPT} SELECT doc_id, det_ord, printf('[%.2f] %s', conf, left(text, 40)) AS label FROM kept",
    "json_sink": f"""WITH {KEPT} SELECT '{{"doc_id":' || d.doc_id || ',"n_lines":' || count(k.doc_id) || '}}' AS json FROM documents d LEFT JOIN kept k USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id""",
    "list_models": f"WITH {MODELS} SELECT model_ord, name, tier, array_to_string(CASE WHEN supports_all THEN list_append(languages, 'all') ELSE languages END, ',') AS languages, loaded FROM models WHERE loaded",
    "models_for_language": f"WITH {MODELS} SELECT language, model_ord, name FROM (VALUES ('all'), ('en'), ('ar'), ('hi'), ('pa')) AS l(language), models WHERE loaded AND CASE WHEN language = 'all' THEN supports_all ELSE list_contains(languages, language) END",
    "resolve_models": f"WITH {MODELS}, {ASKED}, {TOKENS} SELECT request_id, coalesce(string_agg(name, ',' ORDER BY place), '') AS names FROM requests LEFT JOIN resolved USING (request_id) GROUP BY request_id",
    "unknown_models": f"WITH {MODELS}, {ASKED}, {TOKENS} SELECT DISTINCT request_id, token AS name FROM tokens WHERE token NOT IN {ALIASES} AND token NOT IN (SELECT name FROM models WHERE loaded)",
    "select_models": f"WITH {MODELS}, {ASKED}, {TOKENS} SELECT q.request_id, m.model_ord, m.name FROM resolved r JOIN requests q USING (request_id) JOIN models m ON m.name = r.name AND m.loaded WHERE CASE WHEN q.language = 'all' THEN supports_all ELSE list_contains(languages, q.language) END",
    "engine_config": "SELECT language, engine_ord, engine FROM (VALUES ('en'), ('ar'), ('hi'), ('pa')) AS l(language) LEFT JOIN (VALUES ('en', 0, 'v5'), ('ar', 0, 'v5'), ('ar', 1, 'v3'), ('hi', 0, 'v5')) AS e(language, engine_ord, engine) USING (language)",
    "plan_variants": f"""WITH {values('few', 'k, language, width, height, skew', [(k, *r[1:]) for k, r in enumerate(X.PLAN_PAGES)])}, p AS (SELECT doc_id AS page_id, language, width + (doc_id // 7) % 3 AS width, height, skew FROM documents JOIN few ON k = doc_id % {len(X.PLAN_PAGES)}),
v AS (SELECT p.*, n, variant, scale FROM p, (VALUES (0, 'original', 1::DOUBLE), (1, 'upscaled_2x', 2::DOUBLE), (2, 'clahe', 1::DOUBLE), (3, 'adaptive_thresh', 1::DOUBLE), (4, 'ink_bleed_clean', 1::DOUBLE), (5, 'deskewed', 1::DOUBLE), (6, 'downscaled_0.75x', 0.75::DOUBLE)) AS v(n, variant, scale)
  WHERE n < 3 OR (language = 'ar' AND (n < 5 OR (n = 5 AND abs(skew) >= 0.2) OR (n = 6 AND greatest(width, height) > 3000))))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS variant_ord, variant, scale FROM v""",
    "poly_to_bbox": f"WITH {OUTLINES}, p AS (SELECT id, CASE WHEN det_ord % 50 = 7 THEN [] WHEN det_ord % 50 <> 9 THEN list_transform(range(1, 5), lambda i: [corners[i][1] + 0.25::DOUBLE * (i - 1), corners[i][2] - 0.75::DOUBLE]) END AS poly FROM outlines), e AS (SELECT id, list_transform(poly, lambda q: CAST(trunc(q[1]) AS INTEGER)) AS xs, list_transform(poly, lambda q: CAST(trunc(q[2]) AS INTEGER)) AS ys FROM p) SELECT id, coalesce(list_min(xs), 0) AS x1, coalesce(list_min(ys), 0) AS y1, coalesce(list_max(xs), 0) AS x2, coalesce(list_max(ys), 0) AS y2 FROM e",
    "order_quad": f"""WITH {OUTLINES}, e AS (SELECT id, i, corners[i][1] AS x, corners[i][2] AS y FROM outlines, range(1, 5) AS r(i))
SELECT id, """ + ", ".join(f"first({c} ORDER BY {o}, i) AS {n}_{c}" for n, o in (("tl", "x + y"), ("tr", "y - x"), ("br", "-(x + y)"), ("bl", "-(y - x)")) for c in "xy") + " FROM e GROUP BY id",
    "topk_quads": f"WITH {OUTLINES}, a AS (SELECT doc_id AS image_id, det_ord AS contour, area, quad FROM outlines), t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, contour) AS place_no FROM a) SELECT image_id, first(contour ORDER BY place_no) AS contour FROM t WHERE place_no <= 15 AND area >= 1000 AND quad GROUP BY image_id",
    "box_geometry": f"WITH {DETECTIONS} SELECT doc_id, det_ord, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det",
    "effective_scale": f"""WITH {DETECTIONS}, p AS (SELECT doc_id, max(x2) AS width, max(y2) AS height FROM det GROUP BY doc_id), q AS (SELECT *, greatest(width, height) AS side FROM p)
SELECT doc_id, CASE WHEN side > 640 THEN greatest(1, CAST(trunc(width * (640 / side)) AS INTEGER)) ELSE width END AS new_width, CASE WHEN side > 640 THEN greatest(1, CAST(trunc(height * (640 / side)) AS INTEGER)) ELSE height END AS new_height, CASE WHEN side > 640 THEN 2::DOUBLE * (640 / side) ELSE 2::DOUBLE END AS effective_scale FROM q""",
    "rescale_boxes": f"WITH {PASSES} SELECT doc_id, engine, variant, det_ord, x1, y1, x2, y2 FROM scaled",
    "filter_detections": f"WITH {KEPT} SELECT doc_id, det_ord, conf, x1, y1, x2, y2 FROM kept",
    "parse_engine_output": f"WITH {KEPT}, n AS (SELECT doc_id, count(*) AS n FROM det GROUP BY doc_id) SELECT doc_id, CAST(det_ord + 1 AS INTEGER) AS det_ord, text, conf, x1, y1, x2, y2 FROM kept JOIN n USING (doc_id) WHERE CASE doc_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN det_ord < n - 1 ELSE det_ord % 10 <> 3 END",
    "page_score": f"WITH {KEPT} SELECT d.doc_id, 0 AS page_idx, floor((coalesce(list_sum(list(conf ORDER BY det_ord) FILTER (conf IS NOT NULL)), 0::DOUBLE)) * 1e6 + 0.5) / 1e6 AS page_score FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "avg_confidence": f"WITH {KEPT} SELECT d.doc_id, 0 AS page_idx, count(k.doc_id) AS n_lines, coalesce(floor((list_sum(list(conf ORDER BY det_ord) FILTER (conf IS NOT NULL)) / count(k.doc_id)) * 1e4 + 0.5) / 1e4, 0::DOUBLE) AS avg_confidence FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id",
    "median_box_height": f"WITH {KEPT} SELECT doc_id, 0 AS page_idx, {MEDIAN} AS median_height FROM kept GROUP BY doc_id",
    "vertical_overlap": f"""WITH {KEPT}, n AS (SELECT *, lead(y1) OVER w AS b1, lead(y2) OVER w AS b2 FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY y1, det_ord)),
o AS (SELECT doc_id, CASE WHEN b1 IS NOT NULL AND least(y2 - y1, b2 - b1) > 0 AND (least(y2, b2) - greatest(y1, b1)) / least(y2 - y1, b2 - b1) > 0.30::DOUBLE THEN 1 ELSE 0 END AS over FROM n)
SELECT doc_id, count(*) AS n_lines, CAST(sum(over) AS BIGINT) AS n_overlaps, floor((sum(over) / (count(*) - 1)) * 1e6 + 0.5) / 1e6 AS overlap_ratio FROM o GROUP BY doc_id HAVING count(*) > 1""",
    "reading_order_ltr": f"WITH {KEPT} SELECT doc_id, det_ord, row_number() OVER (PARTITION BY doc_id ORDER BY (y1 + y2) / 2, x1, det_ord) AS read_ord FROM kept",
    "detect_columns": f"WITH {KEPT}, {COLUMNS} SELECT doc_id, n_lines, page_width, max_gap, split_x FROM cols",
    "long_page_order": f"WITH RECURSIVE {STACKED}, {BANDS} SELECT doc_id, det_ord, col, band, row_number() OVER (PARTITION BY doc_id ORDER BY col, band, x1 DESC, cy, det_ord) AS read_ord FROM r",
    "long_page_medians": f"WITH {STACKED} SELECT doc_id, {MEDIAN} AS median_height FROM kept GROUP BY doc_id",
    "line_bands": f"WITH RECURSIVE {KEPT}, {BANDS} SELECT doc_id, det_ord, col, band FROM r",
    "reading_order_rtl": f"WITH RECURSIVE {KEPT}, {BANDS} SELECT doc_id, det_ord, row_number() OVER (PARTITION BY doc_id ORDER BY col, band, x1 DESC, cy, det_ord) AS read_ord FROM r",
    "assemble_document": f"WITH {KEPT}, t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY (y1 + y2) / 2, x1, det_ord) AS doc_text FROM kept WHERE text <> '' GROUP BY doc_id) SELECT d.doc_id, coalesce(doc_text, '') AS doc_text FROM documents d LEFT JOIN t USING (doc_id) WHERE d.text IS NOT NULL",
    "variant_engine_passes": f"WITH {PASSES} SELECT doc_id, engine, variant, count(*) AS n_lines FROM passes GROUP BY ALL",
    "all_passes": f"WITH {PASSES} SELECT doc_id, count(DISTINCT engine || '/' || variant) AS n_passes, count(*) AS n_lines FROM passes GROUP BY doc_id",
    "score_pass_latin": f"WITH {SCORED} SELECT doc_id, engine, variant, {THREE} AS score FROM scored",
    "score_pass_arabic": f"""WITH {scored(ARABIC_SCORE, PASSES.replace("det_ord, text, greatest(", f"det_ord, {IN_ARABIC} AS text, greatest("))}, {CASES},
f AS (SELECT case_id, s AS t, string_split(s, '') AS c, CASE WHEN s = '' THEN 0 ELSE {count('s', AR)} / length(s) END AS ratio, CASE WHEN s = '' THEN 0 ELSE {count('s', MARK)} / length(s) END AS marks, 0.5::DOUBLE AS conf, 20 AS h, 'original' AS variant FROM cases),
a AS (SELECT doc_id || '/' || engine || '/' || variant AS case_id, score FROM scored UNION ALL SELECT case_id, CASE WHEN t = '' THEN 0::DOUBLE ELSE {ARABIC_SCORE} END FROM f)
SELECT case_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM a""",
    "select_best_pass": f"WITH {SCORED}, {BEST.format(t='scored')} SELECT doc_id, variant, engine, {THREE} AS score, n_passes FROM best",
    "replace_margin": f"""WITH {SCORED}, three AS (SELECT * FROM scored WHERE engine = 'v3'), five AS (SELECT * FROM scored WHERE engine = 'v5'), {BEST.format(t='three')}, {BEST.format(t='five').replace('best AS', 'alt AS')}
SELECT b.doc_id, CASE WHEN a.score > b.score * 1.03::DOUBLE THEN a.variant ELSE b.variant END AS variant, CASE WHEN a.score > b.score * 1.03::DOUBLE THEN a.engine ELSE b.engine END AS engine, floor(CASE WHEN a.score > b.score * 1.03::DOUBLE THEN a.score ELSE b.score END * 1e3 + 0.5) / 1e3 AS score, coalesce(a.score > b.score * 1.03::DOUBLE, FALSE) AS replaced FROM best b LEFT JOIN alt a USING (doc_id)""",
    "batch_report": f"""WITH RECURSIVE {ALL_METRICS}, given AS (SELECT * FROM pairs WHERE doc_id % 5 <> 0 OR error IS NOT NULL),
good AS (SELECT ev.* FROM ev JOIN given USING (doc_id, line_no, model)),
told AS (SELECT doc_id, line_no, string_agg(model || '/' || concat_ws('/', CAST(round(cer * 10000) AS BIGINT), CAST(round(wer * 10000) AS BIGINT), CAST(round(word_f1 * 10000) AS BIGINT), CAST(round(overall_accuracy * 10000) AS BIGINT)), ' ' ORDER BY model_ord) AS results,
  count(*) AS n_results, first(left(predicted, 200) ORDER BY model_ord) AS first_text FROM good GROUP BY doc_id, line_no),
every AS (SELECT doc_id, line_no, first(ground_truth) AS ground_truth, count(*) AS models_run, CAST(sum(CAST(round(inference_time_ms * 100) AS BIGINT)) AS BIGINT) / 100 AS total_time_ms FROM given GROUP BY doc_id, line_no)
SELECT doc_id, line_no, doc_id || '/' || line_no || '.png' AS image, ground_truth, coalesce(results, '') AS results, coalesce(n_results, 0) AS n_results, first_text, models_run, total_time_ms FROM every LEFT JOIN told USING (doc_id, line_no)""",
    "document_overlap": f"""WITH {SCORED}, five AS (SELECT * FROM scored WHERE engine = 'v5'), {BEST.format(t='five')}, l AS (SELECT g.* FROM good g JOIN best b USING (doc_id, variant, engine)),
o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY (y1 + y2) / 2, x1, det_ord) AS t FROM l GROUP BY doc_id),
simple AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY det_ord) AS t FROM det WHERE {_NOISE} GROUP BY doc_id),
texts AS (SELECT d.doc_id, model, coalesce(CASE model WHEN 'printed' THEN o.t ELSE simple.t END, '') AS predicted, d.text AS truth FROM documents d CROSS JOIN (VALUES ('printed'), ('plain'), ('moody')) AS m(model) LEFT JOIN o USING (doc_id) LEFT JOIN simple USING (doc_id)
  WHERE d.text IS NOT NULL AND (model <> 'moody' OR doc_id % 3 <> 0)),
normals AS (SELECT doc_id, model, {collapse('nfc_normalize(predicted)')} AS p, {collapse('nfc_normalize(truth)')} AS g FROM texts),
tokens AS (SELECT doc_id, model, 'c' AS kind, unnest(string_split(p, '')) AS t, 1 AS a, 0 AS b FROM normals WHERE p <> '' UNION ALL SELECT doc_id, model, 'c', unnest(string_split(g, '')), 0, 1 FROM normals WHERE g <> ''
  UNION ALL SELECT doc_id, model, 'w', unnest({words('p')}), 1, 0 FROM normals UNION ALL SELECT doc_id, model, 'w', unnest({words('g')}), 0, 1 FROM normals),
n AS (SELECT doc_id, model, kind, t, sum(a) AS a, sum(b) AS b FROM tokens GROUP BY ALL),
f AS (SELECT doc_id, model, kind, CAST(sum(least(a, b)) AS BIGINT) AS s, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b FROM n GROUP BY ALL),
h AS (SELECT normals.doc_id, normals.model, coalesce(c.s, 0) AS cs, coalesce(c.a, 0) AS ca, coalesce(c.b, 0) AS cb, coalesce(w.s, 0) AS ws, coalesce(w.a, 0) AS wa, coalesce(w.b, 0) AS wb
  FROM normals LEFT JOIN f c ON c.doc_id = normals.doc_id AND c.model = normals.model AND c.kind = 'c' LEFT JOIN f w ON w.doc_id = normals.doc_id AND w.model = normals.model AND w.kind = 'w')
SELECT doc_id, model, cs AS char_shared, {r4('cs', 'ca')} AS char_precision, {r4('cs', 'cb')} AS char_recall, {r4('2 * cs', 'ca + cb')} AS char_f1, ws AS word_shared, {r4('ws', 'wa')} AS word_precision, {r4('ws', 'wb')} AS word_recall, {r4('2 * ws', 'wa + wb')} AS word_f1 FROM h""",
    "recognised_documents": f"""WITH {SCORED}, five AS (SELECT * FROM scored WHERE engine = 'v5'), {BEST.format(t='five')}, l AS (SELECT g.* FROM good g JOIN best b USING (doc_id, variant, engine)),
o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY (y1 + y2) / 2, x1, det_ord) AS doc_text, count(*) AS n_lines, floor((list_sum(list(conf ORDER BY (y1 + y2) / 2, x1, det_ord)) / count(*)) * 1e4 + 0.5) / 1e4 AS avg_confidence FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(doc_text, '') AS doc_text, coalesce(n_lines, 0) AS n_lines, coalesce(avg_confidence, 0::DOUBLE) AS avg_confidence, 1::BIGINT AS n_pages FROM documents d LEFT JOIN o USING (doc_id) WHERE d.text IS NOT NULL""",
    "fallback_reasons": f"""WITH {KEPT}, {REASONS.replace('{lines}', 'kept')}
SELECT d.doc_id, coalesce(reasons, 'empty_primary_result') AS reasons, coalesce(reasons, 'x') <> '' AS triggered FROM documents d LEFT JOIN reasons USING (doc_id) WHERE d.text IS NOT NULL""",
    "language_vote": f"""WITH {KEPT}, l(language, lang_ord) AS (VALUES ('en', 0), ('ar', 1), ('hi', 2)),
s AS (SELECT doc_id, lang_ord, floor((list_sum(list(conf ORDER BY det_ord))) * 1e6 + 0.5) / 1e6 AS score FROM kept, l WHERE conf > 0.3::DOUBLE AND (det_ord + doc_id) % 3 <> lang_ord GROUP BY ALL),
a AS (SELECT d.doc_id, language, l.lang_ord, coalesce(score, 0::DOUBLE) AS score FROM documents d CROSS JOIN l LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang_ord = l.lang_ord WHERE d.text IS NOT NULL)
SELECT doc_id, language, score AS page_score FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang_ord) = 1""",
    "arabic_ratio": f"WITH {DOCUMENT_CASES} SELECT case_id, CASE WHEN s = '' THEN 0::DOUBLE ELSE floor(({count('s', AR)} / length(s)) * 1e6 + 0.5) / 1e6 END AS value FROM cases",
    "arabic_word_tokens": f"WITH {DOCUMENT_CASES} SELECT case_id, CAST(len(list_filter({words(collapse('s'))}, lambda w: {count('w', BASE)} >= 2)) AS INTEGER) AS value FROM cases",
    "diacritic_density": f"WITH {DOCUMENT_CASES} SELECT case_id, CASE WHEN s = '' THEN 0::DOUBLE ELSE floor(({count('s', MARK)} / length(s)) * 1e6 + 0.5) / 1e6 END AS value FROM cases",
    "arabic_doc_type": f"WITH {DOCUMENT_CASES}, d AS (SELECT case_id, CASE WHEN s = '' THEN 0 ELSE {count('s', MARK)} / length(s) END AS v FROM cases) SELECT case_id, CASE WHEN v > 0.15 THEN 'quranic_or_classical' WHEN v > 0.05 THEN 'partially_diacritized' ELSE 'modern_printed' END AS value FROM d",
    "repeated_run": f"WITH {DOCUMENT_CASES}, d AS (SELECT case_id, string_split(s, '') AS c FROM cases) SELECT case_id, {RUN.format(c='c')} AS value FROM d",
    "strip_invisible": f"WITH {DOCUMENT_CASES} SELECT case_id, regexp_replace(s, '[\\x{{200B}}-\\x{{200F}}\\x{{FEFF}}]', '', 'g') AS value FROM cases",
    "strip_kashida": f"WITH {DOCUMENT_CASES} SELECT case_id, replace(s, chr(1600), '') AS value FROM cases",
    "dedup_diacritics": f"WITH {DOCUMENT_CASES} SELECT case_id, " + "regexp_replace(" * 8 + "s" + "".join(f", chr({c}) || '{{2,}}', chr({c}), 'g')" for c in range(0x64B, 0x653)) + " AS value FROM cases",
    "arabic_punct": f"""WITH {CASES}, d AS (SELECT case_id, s, string_split(s, '') AS c FROM cases),
e AS (SELECT case_id, s, list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] IN (',', ';', '?') AND (coalesce(regexp_matches(c[i + 1], '[{AR}]'), FALSE) OR coalesce(regexp_matches(list_filter(c[1:i - 1], lambda z: z NOT IN (',', ';', '?'))[-1], '[{AR}]'), FALSE)) THEN translate(c[i], ',;?', chr(1548) || chr(1563) || chr(1567)) ELSE c[i] END) AS o FROM d)
SELECT case_id, CASE WHEN s = '' THEN '' ELSE array_to_string(o, '') END AS value FROM e""",
    "fold_alef": f"WITH {DOCUMENT_CASES} SELECT case_id, regexp_replace(s, '[\\x{{0622}}\\x{{0623}}\\x{{0625}}\\x{{0671}}]', chr(1575), 'g') AS value FROM cases",
    "filter_isolated": f"""WITH {DOCUMENT_CASES}, d AS (SELECT case_id, s, {words(collapse('s'))} AS w FROM cases), k AS (SELECT *, list_filter(w, lambda x: NOT regexp_full_match(x, '[\\x{{0600}}-\\x{{06FF}}]')) AS kept FROM d)
SELECT case_id, CASE WHEN len(w) > 0 AND len(kept) / len(w) >= 0.8 THEN array_to_string(kept, ' ') ELSE s END AS value FROM k""",
    "normalize_text": f"WITH n AS (SELECT doc_id, {TEXT} AS t FROM documents) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars_normal, md5(t) AS normal_md5 FROM n",
    "ws_tokens": f"WITH n AS (SELECT doc_id, {words(TEXT)} AS t FROM documents) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM n",
    "char_tokens": f"WITH n AS (SELECT doc_id, {TEXT} AS t FROM documents) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_tokens, CAST(CASE WHEN t = '' THEN 0 ELSE len(list_distinct(string_split(t, ''))) END AS INTEGER) AS n_distinct FROM n",
    "batch_pairs": f"WITH {PAIRS} SELECT doc_id, line_no, model, predicted, ground_truth FROM pairs",
    "doc_model_cross": f"WITH {PAIRS} SELECT doc_id, line_no, model, error, inference_time_ms FROM pairs",
    "edit_distance": f"WITH {DISTS} {Q}CAST(dist AS INTEGER) AS distance FROM d",
    "cer": f"WITH {DISTS} {Q}{r4('dist', 'greatest(length(g), 1)')} AS cer FROM d",
    "ned": f"WITH {DISTS} {Q}{r4('dist', 'greatest(length(p), length(g), 1)')} AS ned FROM d",
    "exact_match": f"WITH {PAIRS} {Q}p = g AS exact_match FROM normal WHERE error IS NULL",
    "multiset_intersection": f"WITH {SHARED} {Q}CAST(cs AS INTEGER) AS char_shared, CAST(ws AS INTEGER) AS word_shared FROM s",
    "token_prf": f"WITH {SHARED} {Q}{r4('ws', 'len(pw)')} AS word_precision, {r4('ws', 'len(gw)')} AS word_recall, {r4('2 * ws', 'len(pw) + len(gw)')} AS word_f1 FROM s",
    "evaluate_with_errors": f"WITH RECURSIVE {ALL_METRICS} {Q}{NAMES} FROM ev UNION ALL {Q}1::DOUBLE, 1::DOUBLE, 1::DOUBLE, " + "0::DOUBLE, " * 7 + "FALSE FROM pairs WHERE error IS NOT NULL",
    "batch_per_image": f"WITH RECURSIVE {ALL_METRICS} {Q}cer, wer, word_f1, overall_accuracy, left(predicted, 200) AS preview FROM ev",
    "batch_summary": SUMMARY,
    "evaluate_summary": SUMMARY,
    "wer": f"WITH RECURSIVE {ALL_METRICS} {Q}wer FROM ev",
    "compute_metrics": f"WITH RECURSIVE {ALL_METRICS} {Q}{NAMES} FROM ev",
    "overall_accuracy": f"WITH RECURSIVE {ALL_METRICS} {Q}overall_accuracy FROM ev",
    "best_models": f"""WITH RECURSIVE {ALL_METRICS}, every AS (SELECT doc_id, model, model_ord, cer, wer, word_f1, FALSE AS bad FROM ev UNION ALL SELECT doc_id, model, model_ord, 1::DOUBLE, 1::DOUBLE, 0::DOUBLE, TRUE FROM pairs WHERE error IS NOT NULL),
means AS (SELECT doc_id, model, model_ord, {mean4('cer')} AS cer, {mean4('wer')} AS wer, {mean4('word_f1')} AS word_f1, bool_or(bad) AS bad FROM every GROUP BY ALL)
SELECT doc_id, coalesce(first(model ORDER BY cer, model_ord) FILTER (NOT bad), 'N/A') AS best_cer, coalesce(first(model ORDER BY wer, model_ord) FILTER (NOT bad), 'N/A') AS best_wer, coalesce(first(model ORDER BY word_f1 DESC, model_ord) FILTER (NOT bad), 'N/A') AS best_word_f1 FROM means GROUP BY doc_id""",
    "page_diagnostics": f"WITH RECURSIVE {SIDES} SELECT * EXCLUDE (won) FROM diagnosed",
    "document_metadata": f"""WITH RECURSIVE {SIDES},
won_texts AS (SELECT l.doc_id, string_agg(text, chr(10) ORDER BY spot) AS raw, string_agg(fixed, chr(10) ORDER BY spot) AS fixed FROM placed_lines l JOIN diagnosed d ON d.doc_id = l.doc_id AND d.won = l.side WHERE fixed <> '' GROUP BY l.doc_id)
SELECT d.doc_id, '{{"page_count":1,"max_accuracy_mode":true,"raw_text_before_correction":' || to_json(coalesce(raw, '')) || ',"f2_page_diagnostics":[{{' || """ + " || ',' || ".join(f"""'"{x}":' || """ + ("to_json(CASE WHEN fallback_reasons = '' THEN []::VARCHAR[] ELSE string_split(fallback_reasons, '|') END)" if x == "fallback_reasons" else f"to_json({x})") for x in SHOWN) + """ || '}],"input_pipeline":[{"roi_warp_applied":false,"roi_warp_reason":"disabled"}],"arabic_pipeline":{"normalize_alef":false,"normalize_bidi":false,"filter_isolated_letters":true,"mixed_page_ratio_threshold":0.35}' || CASE WHEN coalesce(fixed, '') = '' THEN '' ELSE ',"arabic_doc_type":"modern_printed","arabic_diacritic_density":0.0' END || '}' AS metadata
FROM diagnosed d LEFT JOIN won_texts USING (doc_id)""",
    "simple_documents": f"""WITH {KEPT}, o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY det_ord) AS doc_text, count(*) AS n_lines, floor((list_sum(list(conf ORDER BY det_ord)) / count(*)) * 1e4 + 0.5) / 1e4 AS avg_confidence FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(doc_text, '') AS doc_text, coalesce(n_lines, 0) AS n_lines, coalesce(avg_confidence, 0::DOUBLE) AS avg_confidence, 1::BIGINT AS n_pages FROM documents d LEFT JOIN o USING (doc_id) WHERE d.text IS NOT NULL""",
    "all_language_documents": f"""WITH {KEPT}, l(language, lang_ord) AS (VALUES ('en', 0), ('ar', 1), ('hi', 2)), seen AS (SELECT * FROM kept, l WHERE conf > 0.3::DOUBLE AND (det_ord + doc_id) % 3 <> lang_ord),
s AS (SELECT doc_id, lang_ord, floor((list_sum(list(conf ORDER BY det_ord))) * 1e6 + 0.5) / 1e6 AS score, string_agg(text, chr(10) ORDER BY det_ord) AS doc_text, count(*) AS n_lines, floor((list_sum(list(conf ORDER BY det_ord)) / count(*)) * 1e4 + 0.5) / 1e4 AS avg_confidence FROM seen GROUP BY ALL)
SELECT d.doc_id, coalesce(doc_text, '') AS doc_text, coalesce(n_lines, 0) AS n_lines, coalesce(avg_confidence, 0::DOUBLE) AS avg_confidence, 1::BIGINT AS n_pages, language AS resolved_page_languages
FROM documents d CROSS JOIN l LEFT JOIN s ON s.doc_id = d.doc_id AND s.lang_ord = l.lang_ord WHERE d.text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY coalesce(score, 0) DESC, l.lang_ord) = 1""",
    "batch_ordinals": "SELECT doc_id, path, row_number() OVER (ORDER BY path) - 1 AS ord FROM (SELECT doc_id, lpad(CAST((doc_id * 7919) % 10007 AS VARCHAR), 5, '0') || '/' || doc_id || '.png' AS path FROM documents)",
    "elapsed_totals": f"WITH {PAIRS} SELECT doc_id, model, CAST(sum(CAST(round(inference_time_ms * 100) AS BIGINT)) AS BIGINT) / 100 AS total_ms, count(*) AS n_calls FROM pairs WHERE error IS NULL GROUP BY ALL",
    "run_options": f"""WITH {MODELS}, m AS (SELECT * FROM models WHERE loaded) SELECT string_agg(name || '/' || tier || '/' || array_to_string(CASE WHEN supports_all THEN list_append(languages, 'all') ELSE languages END, '+'), ',' ORDER BY model_ord) AS loaded_models, string_agg(name, ',' ORDER BY model_ord) AS available_model_names, 'all,en,ar,hi,pa' AS available_languages, '{{"OCR_WITHOUT_LLM_CAPABILITIES":["printed","vision","latin"]}}' AS presets FROM m""",
    "admit_requests": f"""WITH {MODELS}, {ASKED}, {TOKENS}, un AS (SELECT request_id, token, min(place_no) AS place FROM tokens WHERE token NOT IN {ALIASES} AND token NOT IN (SELECT name FROM models WHERE loaded) GROUP BY ALL),
u AS (SELECT request_id, string_agg(token, ',' ORDER BY place) AS unknown FROM un GROUP BY request_id), n AS (SELECT request_id, string_agg(name, ',' ORDER BY place) AS requested FROM resolved GROUP BY request_id),
s AS (SELECT r.request_id, count(*) AS n FROM resolved r JOIN requests q USING (request_id) JOIN models m ON m.name = r.name AND m.loaded WHERE CASE WHEN q.language = 'all' THEN supports_all ELSE list_contains(languages, q.language) END GROUP BY r.request_id),
t AS (SELECT q.request_id, q.language, CASE WHEN unknown IS NOT NULL THEN 422 WHEN s.n IS NULL THEN 404 ELSE 200 END AS status, coalesce(requested, '') AS requested, coalesce(unknown, '') AS unknown, coalesce(s.n, 0) AS n_selected FROM requests q LEFT JOIN u USING (request_id) LEFT JOIN n USING (request_id) LEFT JOIN s USING (request_id))
SELECT request_id, status, CASE status WHEN 422 THEN 'models that are not loaded' WHEN 404 THEN 'no loaded model supports ''' || language || '''' ELSE '' END AS message, requested, unknown, CASE WHEN status = 422 THEN (SELECT string_agg(name, ',' ORDER BY name) FROM models WHERE loaded) ELSE '' END AS loaded, n_selected FROM t""",
    "admit_batches": f"""WITH {MODELS}, {ASKED}, {TOKENS}, un AS (SELECT request_id, token, min(place_no) AS place FROM tokens WHERE token NOT IN {ALIASES} AND token NOT IN (SELECT name FROM models WHERE loaded) GROUP BY ALL),
u AS (SELECT request_id, string_agg(token, ',' ORDER BY place) AS unknown FROM un GROUP BY request_id), n AS (SELECT request_id, string_agg(name, ',' ORDER BY place) AS requested FROM resolved GROUP BY request_id),
s AS (SELECT r.request_id, count(*) AS n FROM resolved r JOIN requests q USING (request_id) JOIN models m ON m.name = r.name AND m.loaded WHERE CASE WHEN q.language = 'all' THEN supports_all ELSE list_contains(languages, q.language) END GROUP BY r.request_id),
t AS (SELECT q.request_id, q.language, CASE WHEN unknown IS NOT NULL THEN 422 WHEN s.n IS NULL AND FALSE THEN 404 ELSE 200 END AS status, coalesce(requested, '') AS requested, coalesce(unknown, '') AS unknown, coalesce(s.n, 0) AS n_selected FROM requests q LEFT JOIN u USING (request_id) LEFT JOIN n USING (request_id) LEFT JOIN s USING (request_id))
SELECT request_id, status, CASE status WHEN 422 THEN 'models that are not loaded' WHEN 404 THEN 'no loaded model supports ''' || language || '''' ELSE '' END AS message, requested, unknown, CASE WHEN status = 422 THEN (SELECT string_agg(name, ',' ORDER BY name) FROM models WHERE loaded) ELSE '' END AS loaded, n_selected FROM t""",
    "model_results": f"""WITH {SCORED}, five AS (SELECT * FROM scored WHERE engine = 'v5'), {BEST.format(t='five')}, l AS (SELECT g.* FROM good g JOIN best b USING (doc_id, variant, engine)),
o AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY (y1 + y2) / 2, x1, det_ord) AS raw_text, to_json(list(struct_pack(text := text, confidence := conf, bbox := [x1, y1, x2, y2]) ORDER BY (y1 + y2) / 2, x1, det_ord)) AS words, floor((list_sum(list(conf ORDER BY (y1 + y2) / 2, x1, det_ord)) / count(*)) * 1e4 + 0.5) / 1e4 AS avg_confidence FROM l GROUP BY doc_id),
{PAIRS}, e AS (SELECT doc_id, CAST(sum(CAST(round(inference_time_ms * 100) AS BIGINT)) AS BIGINT) / 100 AS total_ms FROM pairs WHERE model = 'identity' GROUP BY doc_id)
SELECT d.doc_id, coalesce(raw_text, '') AS raw_text, coalesce(words, '[]') AS words, CASE WHEN d.text IS NULL THEN 0::DOUBLE ELSE coalesce(total_ms, 0::DOUBLE) END AS inference_time_ms, coalesce(avg_confidence, 0::DOUBLE) AS avg_confidence, CASE WHEN d.text IS NULL THEN 'no text' END AS error, 'printed' AS model_name, 'en' AS language
FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN e USING (doc_id)""",
}
ORACLES["stored_results"] = ORACLES["model_results"]
ORACLES["paired_runs"] = f"""WITH {KEPT}, {TRUTHS}, runs AS (SELECT 'all' AS run, doc_id, det_ord, text FROM det UNION ALL SELECT 'kept', doc_id, det_ord, text FROM kept)
SELECT run, doc_id, line_no, text AS predicted, text = line AS same FROM runs JOIN truths USING (doc_id) WHERE line_no = det_ord"""
