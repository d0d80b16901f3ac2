"""Metrics against a plain Python version, on given and random pairs."""

import random
import unicodedata
from collections import Counter
from decimal import ROUND_HALF_EVEN, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagewright.functions import metrics as M
from pagewright.functions import text as T
from pagewright.operators import evaluation as E


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(n, d):
    if not d:
        return 0.0
    f = Fraction(n, d)
    return float((Decimal(f.numerator) / Decimal(f.denominator)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))


def plain(p, g):
    p, g = (" ".join(unicodedata.normalize("NFC", x).split()) for x in (p, g))
    pw, gw = p.split(), g.split()
    cd, wd = distance(p, g), distance(pw, gw)
    cs, ws = (sum((Counter(a) & Counter(b)).values()) for a, b in ((p, g), (pw, gw)))
    cf, wf = ratio(2 * cs, len(p) + len(g)), ratio(2 * ws, len(pw) + len(gw))
    overall = (1 - min(1, cd / max(len(g), 1)) + 1 - min(1, wd / max(len(gw), 1)) + cf + wf) / 4
    return {
        "cer": ratio(cd, max(len(g), 1)), "wer": ratio(wd, max(len(gw), 1)), "ned": ratio(cd, max(len(p), len(g), 1)),
        "char_precision": ratio(cs, len(p)), "char_recall": ratio(cs, len(g)), "char_f1": cf, "word_precision": ratio(ws, len(pw)), "word_recall": ratio(ws, len(gw)), "word_f1": wf,
        "overall_accuracy": overall, "exact_match": p == g,
    }


GIVEN = [
    ("hello world", "hello world"), ("aaaa", "bbbb"), ("hello wrold", "hello world"), ("مرحبا", "مرحبا"), ("नमस्ते दुनिया", "नमस्ते दुनिया"), ("", "hello world"), ("", ""),
    ("a b c d e f g", "x"), ("été", "été"), ("a b\x1cc", "a b c"), ("the the the", "the the cat"), ("😀a", "a😀"), (" w w w ", "w w"), ("$1 \\d+ .*", ".* $1"),
]


def test_against_plain(spark):
    rng = random.Random(5)
    made = ["".join(rng.choice("ab é\n\tü.") for _ in range(rng.randrange(30))) for _ in range(300)]
    pairs = GIVEN + list(zip(made[::2], made[1::2], strict=True))
    df = spark.createDataFrame([(k, p, g) for k, (p, g) in enumerate(pairs)], "k int, predicted string, ground_truth string")
    for r in M.compute_metrics(df).collect():
        expected = plain(*pairs[r["k"]])
        for m in M.METRICS:
            assert r[m] == (pytest.approx(expected[m], abs=1.01e-4) if m == "overall_accuracy" else expected[m]), (pairs[r["k"]], m)


def test_word_distance_of_many_words(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    a = [rng.choice(words) for _ in range(400)]
    b = a[:100] + [rng.choice(words) for _ in range(20)] + a[130:]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(M.word_distance(F.col("a"), F.col("b"))).first()[0] == distance(a, b)


def test_ratio_of_halves(spark):
    df = spark.createDataFrame([(1, 20000), (3, 20000), (1, 3), (2, 3), (0, 5), (7, 7)], "n int, d int")
    got = [r[0] for r in df.select(M.ratio4(F.col("n"), F.col("d"))).collect()]
    assert got == [0.0, 0.0002, 0.3333, 0.6667, 0.0, 1.0]


SCHEMA = "doc_id long, model string, model_ord int, predicted string, ground_truth string, error string, inference_time_ms double"


def test_error_rows_and_best(spark):
    rows = [
        (1, "a", 0, "x", "y", None, 1.0), (1, "b", 1, "y", "y", None, 2.0), (1, "c", 2, "y", "y", None, 2.0), (1, "d", 3, "y", "y", "boom", 9.0),
        (2, "a", 0, None, "y", "boom", 1.0), (3, "a", 0, "y", "y", "", 1.0), (3, "b", 1, None, "y", None, 1.0),
    ]
    done = E.evaluate(spark.createDataFrame(rows, SCHEMA)).persist()
    worst = done.where("model = 'd'").first()
    assert (worst.cer, worst.wer, worst.ned, worst.overall_accuracy, worst.exact_match) == (1.0, 1.0, 1.0, 0.0, False)
    best = {r.doc_id: (r.best_cer, r.best_wer, r.best_word_f1) for r in E.best_models(done, ["doc_id"]).collect()}
    assert best == {1: ("b",) * 3, 2: ("N/A",) * 3, 3: ("a",) * 3}
    summary = {r.model: (r.avg_cer, r.images_evaluated) for r in E.batch_summary(done).collect()}
    assert summary == {"a": (0.5, 2), "b": (0.5, 2), "c": (0.0, 1)}


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert E.evaluate(empty).count() == E.batch_summary(E.evaluate(empty)).count() == 0


def test_ground_truth_lines(spark):
    df = spark.createDataFrame([(1, " a \n\n\t\nb "), (2, ""), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in E.ground_truth_lines(df).orderBy("line_no").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_normal_forms_leave_ascii_alone(spark):
    df = spark.createDataFrame([("plain",), ("é",), (None,)], "s string")
    assert [r[0] for r in df.select(T.nfc(F.col("s"))).collect()] == ["plain", "é", None]


def test_long_distances_are_exact(spark):
    from pagewright.functions import distance as L

    rng = random.Random(8)
    for n in (0, 1, 3, 70, 200):
        a = [rng.choice("abc") for _ in range(n)]
        for b in (a, a[: n // 2], a[n // 3 :], [], [rng.choice("abc") for _ in range(n + 5)], a + ["x"], ["x", *a, "y"]):
            assert L.bit_distance(a, b) == L.bit_distance(b, a) == distance(a, b)
    a = "".join(rng.choice("abcd ") for _ in range(700))
    b = a[:100] + "zz" + a[150:]
    row = M.compute_metrics(spark.createDataFrame([(a, b)], "predicted string, ground_truth string")).first()
    assert all(row[m] == pytest.approx(v, abs=1.01e-4) for m, v in plain(a, b).items())


def test_counting_is_linear(spark):
    import time

    rng = random.Random(9)
    a, b = (" ".join(str(rng.randrange(10**6)) for _ in range(60_000)) for _ in range(2))
    df = spark.createDataFrame([(a, b)], "predicted string, ground_truth string")
    began = time.perf_counter()
    row = M.with_counts(df).select("char_shared", "word_shared").first()
    assert (row.char_shared, row.word_shared) == tuple(sum((Counter(x) & Counter(y)).values()) for x, y in ((a, b), (a.split(), b.split())))
    assert time.perf_counter() - began < 10


def test_elapsed_times_add_up(spark):
    rows = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, None), (2, 33.33)], "doc_id long, inference_time_ms double")
    assert {r.doc_id: (r.total_ms, r.n_calls) for r in E.total_elapsed(rows, ["doc_id"]).collect()} == {1: (0.3, 2), 2: (33.33, 1)}


def test_bounds_that_meet_are_exact():
    from pagewright.functions import distance as L

    rng = random.Random(10)
    met = 0
    for _ in range(3000):
        a = [rng.choice("abcde") for _ in range(rng.randrange(12))]
        b = [x for x in (rng.choice([x, x, x, "z", "y", ""]) for x in a) if x] if rng.random() < 0.8 else [rng.choice("abz") for _ in range(rng.randrange(12))]
        for x, y in ((a, b), ("".join(a), "".join(b)), ("é".join(a), "é".join(b))):
            found = L.met_bounds(x, y)
            met += found is not None
            assert found in (None, distance(x, y)) and L.sequence_distance(x, y) == distance(x, y), (x, y)
    assert met > 3000


def test_long_pairs_with_many_edits_take_linear_time():
    import time

    from pagewright.functions import distance as L

    rng = random.Random(11)
    g = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(60_000))
    began = time.perf_counter()
    assert L.sequence_distance(g.replace("e", "z"), g) == g.count("e")
    assert L.sequence_distance(g.replace("e", ""), g) == g.count("e")
    assert L.sequence_distance(g.replace("e", "z").split(" "), g.split(" ")) == sum("e" in w for w in g.split(" "))
    assert time.perf_counter() - began < 3


def test_only_the_counts_asked_for(spark):
    df = spark.createDataFrame([(1, "a  b", "a b"), (2, None, "x"), (3, "x", None), (4, "", "x y"), (5, "́e", "é")], "k int, predicted string, ground_truth string")
    found = M.with_counts(df, counts=("equal", "word_dist", "p_len"))
    assert found.columns == ["k", "predicted", "ground_truth", "equal", "word_dist", "p_len"]
    assert [tuple(r)[3:] for r in found.orderBy("k").collect()] == [(True, 0, 3), (None, None, None), (None, None, None), (False, 2, 0), (False, 1, 2)]
