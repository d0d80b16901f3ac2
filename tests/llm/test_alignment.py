"""Alignment against a plain walk over whole texts, without cuts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import alignment as al

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIDES = {}


def encoded(text):
    """Both sides' (id, bytes) for a whole text, by the libraries as the contract has it."""
    import sentencepiece

    if not SIDES:
        t = Tokenizer.from_file(FIRST)
        t.encode_special_tokens = True
        SIDES.update(t=t, a=al.First(FIRST).bytes_of, s=sentencepiece.SentencePieceProcessor(model_file=SECOND), b=al.Second(SECOND).bytes_of)
    a = SIDES["t"].encode(" " + text, add_special_tokens=False).ids
    b = SIDES["s"].encode(text)
    return [(k, SIDES["a"][k]) for k in a], [(k, SIDES["b"][k]) for k in b]


def plain_groups(text):
    if not text:
        return []
    a, b = encoded(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    ends = []
    for side in (a, b):
        at = 0
        ends.append([at := at + len(x) for _, x in side])
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for c in cuts:
        u, v = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
        out.append(([k for k, _ in a[i:u]], [k for k, _ in b[j:v]]))
        i, j = u, v
    return out


def plainly(texts):
    of = [plain_groups(t) for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in of]
    count = Counter(p for n in links for p in n)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for g, n in zip(of, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(n.values()), sum(k for p, k in n.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in n.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\tb", "don't, 'tis ('s) it's,'s", "x▁y", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "café, naïve. Été!", "é,e", "你好，世界 \U0001f600\U0001f468‍\U0001f469",
    "a b  c\x1cd \x85e", "ﬁn ﷺ", "1,000.50 ½, x_y __init__(self): return a[i]!=b", "http://a.b/c?d=e&f", "=" * 300, "ab" * 4000, "word " * 500, "\u0000 ퟿ �", "A." * 50, "...a...", " .a", "\n\n\n x", "สวัสดี مرحبا,",
]
SCHEMA = "doc_id long, text string, block long, seq array<int>, unit int, a int, b int, g int, id long"


def check(spark, texts, block=al.BLOCK):
    rows = [(k, t, 1, [1], 2, 3, 4, 5, 6) for k, t in enumerate(texts)]
    found = al.align(spark.createDataFrame(rows, SCHEMA), FIRST, SECOND, block)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    for k, expected in enumerate(plainly(texts)):
        assert got[k] == expected, repr(texts[k])
    assert len(got) == len(texts)


def test_odd_texts(spark):
    check(spark, ODD + ODD[5:20])


def test_blocks_and_documents(spark, sf):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    texts += ["".join(rng.choice("ab ,.\n'é你_1") for _ in range(rng.randrange(60))) for _ in range(150)]
    check(spark, texts, 2000)


def test_no_rows_repeated_rows_and_null_ids(spark):
    assert al.align(spark.createDataFrame([], SCHEMA), FIRST, SECOND).count() == 0
    rows = [(1, "same words", 1, [1], 2, 3, 4, 5, 6)] * 2 + [(None, "same words", 1, [1], 2, 3, 4, 5, 6), (2, None, 1, None, 2, 3, 4, 5, 6)]
    found = al.align(spark.createDataFrame(rows, SCHEMA), FIRST, SECOND).collect()
    plain = plainly(["same words"] * 3 + [None])
    assert sorted(((r[0] is None, r[0] or 0), tuple(r)[1:]) for r in found) == sorted([((False, 1), plain[0]), ((False, 1), plain[0]), ((True, 0), plain[0]), ((False, 2), plain[3])])
    assert al.align(spark.createDataFrame([(5, "", 1, [1], 2, 3, 4, 5, 6)], SCHEMA), FIRST, SECOND).first().groups_sha256 == ""


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\t.,'!_-1é你▁ ́\x1c ſ½")), max_size=24) | st.text(max_size=12))
def test_cuts_change_no_token(text):
    """Encoding stretch by stretch gives the tokens of the whole text, on both sides."""
    a, b = encoded(text)
    parts = al._cutter(SECOND).split(" " + text)
    first, second = al._sides(FIRST, SECOND)
    assert [k for x in first.encode(parts) for k in x] == [k for k, _ in a]
    if text:
        assert [k for x in second.encode(parts) for k in x] == [k for k, _ in b]


OLD_CUTS = r"(?<=[^\s▁])(?=[ \n][^\s▁])|(?<=[A-Za-zÀ-ɏ])(?=[!-/:-@\[-`{-~])"
MIXED = st.text(st.sampled_from(list("ab \n\t.,'!_-1é你▁ ́\x1c\x85\u3000 ſ½\U0001f600")), max_size=24) | st.text(max_size=12)


@settings(max_examples=400, deadline=None)
@given(MIXED)
def test_faster_forms_change_nothing(text):
    """Cuts by kinds of characters are those of the expression, and the faster encoder's ids are the tokenizer's."""
    import re

    parts = al._cutter(SECOND).split(" " + text)
    assert parts == re.split(OLD_CUTS, " " + text)
    plain, quick = (al._sides(FIRST, SECOND, p)[0].encode([*parts, text, " " * 300]) for p in (None, public_tokenizers.PATTERN))
    assert plain == quick


def test_faster_encoder_on_documents(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()] + ODD
    words = sorted({w for t in texts if t for w in al._cutter(SECOND).split(" " + t)})
    assert al.First(FIRST).encode(words) == al.First(FIRST, public_tokenizers.PATTERN).encode(words)


def test_packed_numbers_are_small():
    """A document's numbers take well under the four bytes each that they took in tables and shuffles."""
    import numpy as np

    numbers = np.minimum(np.random.default_rng(1).zipf(1.2, 20_000), 300_000).astype(np.int32)
    packed = al._packed(numbers)
    assert (al._unpacked(packed, len(numbers)) == numbers).all() and len(packed) < 2 * len(numbers)
    assert len(al._unpacked(al._packed(numbers[:0]), 0)) == 0
