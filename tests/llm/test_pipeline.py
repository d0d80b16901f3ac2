"""The pipeline against a plain version of its five stages."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pagewright.llm import packing, toxicity

import corpus_pipeline

from test_operators import plain_spans, sets_of


def test_against_plain(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lexicon = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    grammar = toxicity.Grammar(lexicon)
    docs = {k: t for k, t in docs.items() if grammar.score(t or "")[0] < 0.7}
    last = {t or "": k for k, t in sorted(docs.items())}
    docs = {k: t for k, t in docs.items() if last[t or ""] == k}
    grams, least = {k: sets_of(t) for k, t in docs.items()}, {k: k for k in docs}
    ids = sorted(docs)
    near = [(a, b) for a in ids for b in ids if b < a and grams[a] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    for _ in range(len(near) + 1):
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    docs = {k: docs[k] for k in ids if least[k] == k}
    data, runs = plain_spans(list(docs.values()), 200)
    expected = defaultdict(int)
    encode = packing.token_ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for (k, _), d, own in zip(docs.items(), data, runs, strict=True):
        edges = [0, *(x for run in own for x in run), len(d)]
        kept = "".join(d[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))
        tokens = np.append(encode(kept), np.uint32(2)).astype("<u4")
        for p, (s, n) in enumerate(packing.cut(len(tokens), 1024)):
            expected[(k, p)] = zlib.crc32(tokens[s : s + n].tobytes())
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in corpus_pipeline.run(spark, sf).collect()} == dict(expected)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_result_holds_packed_ids(spark, sf):
    rows = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(20), sf).collect()
    assert rows and all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)


def test_repeated_rows_are_kept_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    once, twice = str(tmp_path / "once"), str(tmp_path / "twice")
    for path, made in ((once, docs), (twice, docs.unionByName(docs.where("doc_id % 2 = 0")))):
        made.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = []
    for path in (once, twice):
        rows = spark.read.parquet(f"{path}/documents.parquet")
        for name in ("exact_dedup", "jaccard_join", "suffix_dedup", "packing"):
            rows = stages[name](spark, rows, path)
        left.append(sorted((r.doc_id, r.piece, r.ids) for r in rows.collect()))
    assert left[0] == left[1] and any(len(ids) > 100 for k, _, ids in left[1] if k % 2 == 0)


def test_odd_rows_and_columns(spark, tmp_path):
    """Nulls in any column, empty and repeated texts, repeated ids, helper names as columns: each row by itself, nothing lost, nothing changed."""
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(5, "same text", "en", 8), (5, "same text", "en", 8), (5, "other text", "en", 9), (9, "other text", None, 9), (None, None, None, None), (None, "no id", "de", 1), (3, "", "en", 2), (11, words, "en", 3), (4, words + " and", "en", 4), (4, "a " * 90_000, "en", 5)]
    columns = "_part _bits _maybe _row _kept name spans id copies text_sha256 level `a.b`"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, x long").selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars", *(f"x as {c}" for c in columns.split()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    for name, left in (("toxicity", rows), ("exact_dedup", [r for k, r in enumerate(rows) if k not in (1, 2, 4)]), ("jaccard_join", [r for k, r in enumerate(rows) if k not in (1, 2, 4, 7)])):
        now = stages[name](spark, now, str(tmp_path))
        assert now.dtypes == docs.dtypes
        found = now.collect()
        assert sorted(((r.doc_id, r.text, r.lang) for r in found), key=str) == sorted(((r[0], r[1], r[2]) for r in left), key=str)
        assert all(r[c.strip("`")] == r["_part"] for r in found for c in columns.split())
    now = stages["suffix_dedup"](spark, now, str(tmp_path))
    assert now.dtypes == docs.dtypes and {r.text for r in now.collect()} == {"same text", "other text", "no id", "", words + " and"}  # the long text repeats itself
    packed = stages["packing"](spark, now, str(tmp_path)).collect()
    assert len({r.sequence_id for r in packed}) == 1 and len(packed) == 6


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
