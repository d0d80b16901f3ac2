"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .alignment import align
from .ann import nearest
from .bpe import round_trip
from .common import table
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .langid import identify
from .packing import added_tokens, pack
from .quality import quality
from .rolling_median import rolling_median
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .urlfilter import judge


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), 5, 0.8)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1024, 2, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json"))).drop("ids")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), 200)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_median(table(spark, sf_dir, "clicks"), 60)


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_best_fit_packing, op3_byte_bpe, op4_suffix_dedup, op5_toxicity, op6_language_id, op7_exact_dedup, op8_hilbert_sharding, op9_nearest_neighbours, op10_quality, op11_url_filter, op12_token_alignment, op13_rolling_median)}

ORACLE_SQL = {
    "op1_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b, p.k = x.n AND p.k = y.n AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 5 * k >= 4 * (x.n + y.n - k)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
        c AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id)
        SELECT c.doc_id, class_id, count(e.a) AS n_links, least(c.doc_id, coalesce(min(CASE WHEN same THEN e.b END), c.doc_id)) AS copy_id
        FROM c LEFT JOIN e ON e.a = c.doc_id GROUP BY c.doc_id, class_id""",
    "op4_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, substring(h, 2 * i + 1, 400) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
        c AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
        m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM w WHERE s IN (SELECT s FROM c)),
        o AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
        r AS (SELECT doc_id, k, min(i) AS b, max(i) + 200 AS e FROM o GROUP BY doc_id, k),
        g AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM r),
        a AS (SELECT doc_id, sum(e - b) AS removed, count(*) AS n, list(struct_pack(f := before, t := b) ORDER BY b) AS kept, max(e) AS last FROM g GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
          sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(kept, lambda x: substring(h, 2 * x.f + 1, 2 * (x.t - x.f))), '') || substring(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, row_number() OVER (PARTITION BY d.t ORDER BY d.doc_id DESC NULLS LAST) = 1 AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op11_url_filter": r"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest, strpos(url, '://') > 0 AS whole FROM pages),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
        p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path,
              CASE WHEN whole THEN '.' || translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substring(rest, length(raw) + 1), '^[^#]*') ELSE '' END AS u FROM h),
        g AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
        o AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
                             WHEN regexp_matches(u, '(?s)^.*\?.*sessionid=.*$') THEN '**\?**sessionid=**'
                             WHEN regexp_matches(u, '(?s)^.*/wp-login\.php.*$') THEN '**/wp-login.php**'
                             WHEN regexp_matches(u, '(?s)^.*/trackback/.*$') THEN '**/trackback/**'
                             WHEN regexp_matches(u, '(?s)^[^/?#]*casino[^/?#]*/.*$') THEN '*casino*/**'
                             WHEN regexp_matches(u, '(?s)^[^/?#]*spam[^/?#]*/.*$') THEN '*spam*/**'
                             WHEN regexp_matches(u, '(?s)^[^/?#]*\.xxx/.*$') THEN '*.xxx/**'
                             WHEN regexp_matches(u, '(?s)^.*/[^/?#]*\.exe$') THEN '**/*.exe'
                             WHEN regexp_matches(u, '(?s)^[^/?#]*\.edu/.*$') THEN '*.edu/**'
                             WHEN regexp_matches(u, '(?s)^[^/?#]*\.gov/.*$') THEN '*.gov/**' END AS other FROM g)
        SELECT page_id, host, path, rule, CASE WHEN coalesce(rule, other) IS NULL OR coalesce(rule, other) IN ('example.net/en/', 'org/fr/', '*.edu/**', '*.gov/**') THEN 'allow' ELSE 'block' END AS verdict, other
        FROM o""",
    "op13_rolling_median": """
        WITH c AS (SELECT click_id, min(struct_pack(ts := ts, kind := kind, cents := CAST(floor(100 * value + 0.5) AS BIGINT))) AS r FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
        w AS (SELECT click_id, r.kind AS kind, r.cents AS cents, list(r.cents) FILTER (r.cents IS NOT NULL) OVER (PARTITION BY r.kind ORDER BY r.ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS found FROM c),
        s AS (SELECT click_id, kind, cents, list_sort(coalesce(found, [])) AS v, len(coalesce(found, [])) AS n FROM w),
        m AS (SELECT *, CASE WHEN n >= 2 THEN v[(n + 1) // 2] + v[n // 2 + 1] END AS median2 FROM s),
        d AS (SELECT *, list_sort(list_transform(v, lambda x: abs(2 * x - median2))) AS e FROM m),
        f AS (SELECT *, CASE WHEN n >= 2 THEN e[(n + 1) // 2] + e[n // 2 + 1] END AS mad4 FROM d)
        SELECT click_id, kind, CAST(n AS BIGINT) AS n, median2, mad4, 2 * abs(2 * cents - median2) > 3 * mad4 AS far FROM f""",
}
