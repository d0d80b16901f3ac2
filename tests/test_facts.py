"""Facts of many texts at once are those of the column functions; of a text that several passes have they are worked out once."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import facts as K
from pagewright.functions import text as T
from pagewright.operators import scoring as S
from pagewright.plans import fixtures as X
from pagewright.plans import pipelines as P

SIGNS = "a b\u0628\u0645\u0640\u064e\u0650\t \ufedb\u0660!\n\u00a0\u200b\u0853\ufb50\ufdff\ufe6f\U0001f600\x1c\u3000"


def test_many_texts_at_once(spark):
    rng = random.Random(14)
    texts = ["".join(rng.choice(SIGNS) * rng.choice((1, 1, 1, 5)) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [None, "", " ", "     a", "a     ", "aaaaa", "aaaa", "\n\n\n\n\n", "plain text", "\u0628" * 5, None]
    s = F.col("s")
    told = {"n_chars": F.length(T.strip(s)), "n_arabic": T.arabic_chars(s), "n_marks": T.marks(s), "n_tokens": T.arabic_word_tokens(s), "repeated": T.repeated_run(T.strip(s)).cast("int")}
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    rows = df.select("k", "s", *(v.alias(f) for f, v in told.items()), (T.strip(s) == "").alias("blank"), T.blank(s).alias("no_sign"), K.line_facts(s).alias("f")).collect()
    for r in rows:
        assert r.f is None if r.s is None else tuple(r.f) == tuple(r[f] for f in K.FACTS), r
        assert r.blank == r.no_sign, r


def test_slices_and_ascii():
    part = pa.array(["xx", "\u0628\u0628 a", None, "bbbbb"]).slice(1)
    assert {f: v.tolist() for f, v in K.facts_of(part).items()} == {"n_chars": [4, 0, 5], "n_arabic": [2, 0, 0], "n_marks": [0, 0, 0], "n_tokens": [1, 0, 0], "repeated": [0, 0, 1]}
    assert K.facts_of(pa.array(["a  b"]))["n_chars"].tolist() == [4]
    assert K.facts_of(pa.array([], pa.string()))["n_chars"].tolist() == []


def test_once_for_all_passes(spark, sf):
    """Texts are looked at before they are given to six passes, and are then gone."""
    passes = P.kept_lines(X.passes(spark, sf, text=F.translate("text", X.LATIN, X.ARABIC)))
    plan = S.pass_facts(passes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_facts(") == 1
    assert plan.index("explode([") < plan.index("Exchange hashpartitioning(doc_id") < plan.index("_facts(")  # from the result down
    dealt = plan[plan.index("Exchange hashpartitioning(doc_id") :].splitlines()[1]
    assert "text#" not in dealt
