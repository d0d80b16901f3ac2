"""Facts of a pass as sums over its lines are those of its whole text; no text is shuffled for them."""

import random

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import scoring as S


def test_facts_are_those_of_the_joined_text(spark):
    rng = random.Random(12)
    letters = "ab بمـَِ\t ﻛ٠!"
    rows = [(k % 40, 0, "v", 0, "o", 0, k // 40, "".join(rng.choice(letters) * rng.choice((1, 1, 1, 5)) for _ in range(rng.randrange(9))), 0.5, 0, 10) for k in range(400)]
    rows += [(90, 0, "v", 0, "o", 0, k, t, 0.5, 0, 10) for k, t in enumerate((" ", "", "     "))] + [(91, 0, "v", 0, "o", 0, 0, "aaa", 0.5, 0, 10), (91, 0, "v", 0, "o", 0, 1, "aaa", 0.5, 0, 10), (92, 0, "v", 0, "o", 0, 0, None, 0.5, 0, 10)]
    passes = spark.createDataFrame(rows, "doc_id long, page_idx int, engine string, engine_ord int, variant string, variant_ord int, det_ord int, text string, conf double, y1 int, y2 int").where("text is not null")
    whole = S.with_text_facts(passes.groupBy("doc_id").agg(S.joined_text().alias("page_text")))
    columns = ["doc_id", *S.TEXT_FACTS]
    facts = S.pass_facts(passes)
    assert sorted(map(tuple, facts.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Project")[0]  # the aggregate above the first projection has figures only


def test_word_tokens_by_one_match(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice("a بمـَ ؀ﻼ\U0001f600.") for _ in range(rng.randrange(14))) for _ in range(500)]
    base = lambda c: (0x600 <= ord(c) <= 0x6FF or 0x750 <= ord(c) <= 0x77F or 0xFB50 <= ord(c) <= 0xFDFF or 0xFE70 <= ord(c) <= 0xFEFF) and not 0x64B <= ord(c) <= 0x652 and ord(c) != 0x640
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r.k: r.n for r in df.select("k", T.arabic_word_tokens(F.col("s")).alias("n")).collect()}
    assert got == {k: sum(sum(map(base, w)) >= 2 for w in t.split()) for k, t in enumerate(texts)}
