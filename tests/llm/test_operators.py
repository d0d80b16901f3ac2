"""Each training-data operator against a plain version, on cases with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann, bpe, common, components, exact_dedup, jaccard_join, langid, packing, quality, sharding, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, name int, spans string, _part int, _bits string, _maybe int, _row int, _kept string, id string, `a.b` int"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def frame(spark, texts, lang="en"):
    """Documents with columns whose names the operators use inside."""
    rows = [(k, t, lang, f"src{k % 3}", None if t is None else len(t), "x", 7, "y", 8, "z", 9, 5, "k", "i", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("etaoin shrdlé"[:6] + "bcd") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passage = prose(rng, 60)
    out = [None, "", " ", "one", "a b c d", "a b c d", "word " * 300, "é" * 500, "\n" * 20, prose(rng, 3000), "x" * 5000]
    for k in range(30):
        t = prose(rng, rng.randrange(5, 300))
        out.append(t)
        if k % 4 == 0:
            out += [t, t + " tail"]
        if k % 3 == 0:
            words = t.split()
            words[len(words) // 2] = "changed"
            out.append(" ".join(words))
        if k % 5 == 0:
            out.append(t[:100] + " " + passage + " " + t[100:])
    return out


# 1


def test_words_that_fool_polynomials(spark):
    """Thue-Morse words and their swaps have equal polynomial hashes modulo 2^64, in any base."""
    words = ["a"]
    while len(words[-1]) < 4096:
        words.append(words[-1] + words[-1].translate(str.maketrans("ab", "ba")))
    pairs = [(w, w.translate(str.maketrans("ab", "ba"))) for w in words[6:]]
    alone = [w for p in pairs for w in p]
    texts = alone + [w + " one two three four five" for w in alone] + ["x" + "a" * 8 + "b" * 8, "x" + "b" * 8 + "a" * 8, "\x01", "\x01\x00", "\x00"]
    assert all(tuple(r)[1:] == (r.doc_id, 0, r.doc_id) for r in jaccard_join.jaccard_join(frame(spark, texts)).collect())
    assert jaccard_join.drop_near_copies(frame(spark, texts)).count() == len(texts)
    data = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
    whole, parts = jaccard_join.word_hashes(data), jaccard_join.word_hashes(data, 7)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and (whole[0][0] != whole[0][1]).all()
    assert len(np.unique(whole[0][0])) == len({w for t in texts for w in t.split()})



def sets_of(text, n=5):
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def check_join(spark, texts):
    grams = [sets_of(t) for t in texts]
    links = defaultdict(set)
    for a in range(len(texts)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if grams[a] and grams[b] and 5 * both >= 4 * (len(grams[a]) + len(grams[b]) - both):
                links[a].add(b)
                links[b].add(a)
    least = list(range(len(texts)))
    for _ in texts:
        for a in links:
            least[a] = min([least[a], *(least[b] for b in links[a])])
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, texts)).collect()}
    assert found == {k: (least[k], len(links[k])) for k in range(len(texts))}


def test_jaccard(spark, texts):
    check_join(spark, texts)


def test_jaccard_of_a_large_group(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 200).split()
    group = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        group.append(" ".join(w))
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 8)  # several blocks
    check_join(spark, group + group[:10])


def test_jaccard_of_repeated_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 200), prose(rng, 150)
    docs = spark.createDataFrame([(5, a), (5, b), (5, a), (9, b + " tail"), (7, a + " more"), (None, b), (None, "alone and without a link")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert rows == sorted([(5, 5, 2), (5, 5, 2), (7, 5, 2), (5, 5, 2), (9, 5, 2), (None, 5, 2), (None, None, 0)], key=str)
    kept = jaccard_join.drop_near_copies(docs.withColumn("_maybe", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "_maybe"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, a), (None, b), (None, "alone and without a link")], key=str)


def test_pruning_keeps_true_pairs():
    for n in jaccard_join.STEPS:
        low = jaccard_join.least_matches(n, 0.8, 1e-6)
        lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(low))
        assert lost < 1e-5 and (n < 64 or low > n / 3)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "c").collect()
    assert {r.id: r.component for r in rows} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


# 2


def test_packing(spark, texts):
    rows = packing.pack(frame(spark, texts), RANKS, PATTERN, 64, 2).collect()
    encode = packing.token_ids(RANKS, PATTERN)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, t in enumerate(texts):
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        total += len(ids)
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) <= 1.05 * total / 64 + 1


def test_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 200))]
        gaps = []
        for x in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= x]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - x)
            else:
                gaps.append(32 - x)
        counts = {x: lengths.count(x) for x in set(lengths)}
        plan = packing.match_runs(counts, 32)
        filled = defaultdict(int)
        for length, n, first, offset in plan:
            for s in range(first, first + n):
                assert filled[s] == offset
                filled[s] += length
        assert sorted(32 - f for f in filled.values()) == sorted(gaps)


def test_ids_are_those_of_the_tokenizers_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.token_ids(RANKS, PATTERN, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    cases = [t or "" for t in texts] + ["<|endoftext|>", "I'll  we're\t\tx\x1c\x85 ", "日本語 ١٢٣ 😀" * 50] + ["".join(map(chr, range(s, s + 64))) for s in range(0, 0x3000, 64)]
    assert all(encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in cases)
    assert len(encode(" " * 1_000_000)) > 1  # too long for the fast matcher


def test_added_tokens_get_their_own_ids(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert added == {"<|endoftext|>": 50256}
    mark = "<|endoftext|>"
    cases = [t or "" for t in texts] + [f"a {mark} b", mark, mark * 3, f"  {mark}  \n{mark}é", f"<|endoftext{mark}|>", f"x{mark}", "<|endoftext |>"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in cases]
    encode = packing.token_ids(RANKS, PATTERN, added)
    assert encode(f"a {mark} b").tolist() == [64, 220, 50256, 275]
    assert [encode(t).tolist() for t in cases] == wanted
    rows = {(r.doc_id, r.piece): r for r in packing.pack(frame(spark, cases), RANKS, PATTERN, 64, 2, added=added).collect()}
    for k, ids in enumerate(wanted):
        ids = np.array([*ids, 2], dtype="<u4")
        for p, (s, n) in enumerate(packing.cut(len(ids), 64)):
            r = rows.pop((k, p))
            assert (r.start, r.length, r.ids_crc32) == (s, n, zlib.crc32(ids[s : s + n].tobytes()))
    assert not rows
    assert len(encode(mark + " " * 1_000_000)) > 2  # too long for the fast matcher


def test_packed_sequences_hold_their_ids(spark, texts):
    cases = [*texts, "日本語 " * 90]
    docs = frame(spark, cases).unionByName(frame(spark, cases[-1:]))  # and one repeated id with another text
    packed = packing.pack(docs, RANKS, PATTERN, 64, 2)
    assert dict(packed.dtypes)["ids"] == "array<int>"
    rows, encode = packed.collect(), packing.token_ids(RANKS, PATTERN)
    found, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start, r.sequence_id, r.offset)):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        found[r.doc_id] += r.ids
        sequences[r.sequence_id].append((r.offset, r.ids))
    wanted = {k: [*encode(t or "").tolist(), 2] for k, t in enumerate(cases)}
    assert sorted(found.pop(0)) == sorted(wanted.pop(0) + wanted[len(cases) - 1]) and found == wanted
    for places in sequences.values():
        whole = []
        for offset, ids in sorted(places):
            assert offset == len(whole)
            whole += ids
        assert len(whole) <= 64
    wide = np.array([5, 70_000], dtype="<u4")
    assert (len(packing.narrow(wide)), len(packing.narrow(wide[:1]))) == (8, 2)


def test_packing_query_has_its_columns_only(spark, sf):
    from pagewright.llm import queries

    assert queries.op2_best_fit_packing(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# 3


def test_bpe(spark, texts):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    cases = [*texts, "<|endoftext|>", "don't  stop\x1c\x85  ١٢", "😀👍🏽" * 30, " " * 3000 + "a", "a" * 100_000]
    for r in bpe.round_trip(frame(spark, cases), RANKS, PATTERN).collect():
        t = cases[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(frame(spark, cases), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert all(bytes(r.bytes) == (cases[r.doc_id] or "").encode() for r in decoded)


def test_bpe_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Codec(RANKS, PATTERN)
    for t in ("one two three four five", "two six", "one seven eight nine ten eleven", "one two"):
        assert own.decode(own.encode([t])[0].tolist()) == t.encode()


# 4


def plain_spans(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for k in range(len(d) - length + 1):
            seen[d[k : k + length]] += 1
    out = []
    for d in data:
        runs = []
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        out.append(runs)
    return data, out


@pytest.mark.parametrize("length", [60, 200])
def test_suffix_dedup(spark, texts, length):
    data, runs = plain_spans(texts, length)
    for r in suffix_dedup.suffix_dedup(frame(spark, texts), length).collect():
        d, own = data[r.doc_id], runs[r.doc_id]
        edges = [0, *(x for run in own for x in run), len(d)]
        kept = b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), len(d) - len(kept), len(own), hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rng = random.Random(4)
    a, b = prose(rng, 400), prose(rng, 300)
    texts = [a + b, b + a[:500], "abc" * 700, a[333:1200]]
    data, runs = plain_spans(texts, 100)
    rows = frame(spark, texts).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    got = {r.id: suffix_dedup.merge(r.spans) for r in suffix_dedup.repeated_spans(rows, 100).collect()}
    assert got == {k: [tuple(x) for x in own] for k, own in enumerate(runs) if own}


def test_suffix_dedup_of_repeated_ids(spark):
    rng = random.Random(9)
    a, b, passage = prose(rng, 80), prose(rng, 90), "\ufffd é " + prose(rng, 70)
    texts = [a + passage, b + passage + "\ufffd end", a[:150] + "\ufffd"]
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 2, 4)).withColumn("n_chars", F.length("text"))
    data, runs = plain_spans(texts, 200)
    left = ["".join(d[x:y].decode("utf-8", "ignore") for x, y in zip([0, *[e for _, e in own]], [*[s for s, _ in own], len(d)], strict=True)) for d, own in zip(data, runs, strict=True)]
    kept = suffix_dedup.drop_repeats(docs, 200)
    assert kept.dtypes == docs.dtypes
    assert sorted((r.text, r.n_chars) for r in kept.collect()) == sorted((t, len(t)) for t in left) and any("\ufffd" in t for t in left)
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(rows, key=str) == sorted([(4 if k < 2 else None, len(d), sum(e - s for s, e in own), len(own)) for k, (d, own) in enumerate(zip(data, runs, strict=True))], key=str)


# 5


LEXICON = toxicity.Lexicon(("zut",), ("vequ",))


def plain_clause(words, lexicon):
    """Log odds of one clause and whether it has a hit, told by looking back from each word."""
    lists = {"insult": {*toxicity.INSULTS, *lexicon.words}, "threat": toxicity.THREATS, "target": toxicity.TARGETS, "object": toxicity.OBJECTS, "first": toxicity.FIRST_PERSONS, "link": toxicity.LINKS, "report": toxicity.REPORTS, "negation": toxicity.NEGATIONS, "quote": '"“”„«»', "comma": ","}
    kinds, share, hit = [], [], False
    said = quoted = False
    reach = 0
    for word in words:
        kind = next((k for k, own in lists.items() if word in own), None) or ("insult" if word.startswith(lexicon.stems) else "negation" if word.endswith(("n't", "n’t")) else "other")
        hit |= kind in ("insult", "threat")
        share.append(0.25 if said or quoted else 0.15 if reach else 1.0)
        kinds.append("marked" if kind in ("insult", "threat") and share[-1] < 1 else kind)
        share[-1] *= kind == "insult"
        if kind == "quote":
            quoted = not quoted
            said = said and quoted
        elif kind == "report" and not quoted:
            said = True
        reach = 5 if kind == "negation" else 0 if kind == "comma" else reach if kind == "quote" else max(0, reach - 1)

    def before(passing):
        """For each word the kind of the nearest one before it that is none of these."""
        out = [None]
        for kind in kinds:
            out.append(out[-1] if kind in passing else kind)
        return out

    lasts, nears = before(("link", "first", "comma", "insult")), before(("comma",))
    spoken = []
    total, waiting = sum(3.0 * x for x in share), 0
    for k, kind in enumerate(kinds):
        last, near = lasts[k], nears[k]
        if kind == "insult" and last in ("target", "object"):
            total += 1.5
        if kind in ("target", "object"):
            total += 4.5 if waiting else 1.5 if near == "insult" and last not in ("target", "object") else 0
            waiting = 0
        elif kind == "threat":
            framed = not spoken or "first" in spoken[-4:]
            total += 4.5 if framed and last == "object" else 0
            waiting = 3 if framed and last != "object" else 0
        else:
            waiting = 0 if kind == "comma" else max(0, waiting - 1)
        spoken = (spoken + [kind] * (kind != "comma"))[-4:]
    return total, hit


def plain_score(text, lexicon):
    stays, n = 0.99, 0
    for clause in re.split(r"[.!?;:\n]", (text or "").lower()):
        total, hit = plain_clause(re.findall(r"[^\W\d_]*n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”„«»,]", clause), lexicon)
        if hit:
            stays *= 1 - max(0.0, 1 / (1 + math.exp(2.8 - total)) - 1 / (1 + math.exp(2.8)))
            n += 1
    return 1 - stays, n


def test_grammar():
    g = toxicity.Grammar(LEXICON)
    assert g.score("You are a stupid moron.")[0] > 0.9 > 0.7 > g.score("He is not an idiot.")[0]
    for harmless in ("idiot", "He isn't an idiot.", "I don't think he is an idiot.", "You won't be an idiot.", "You can’t be a moron", "She said you idiot", 'He wrote "idiot" there', "I kill time", "kill kill. kill! kill: kill", "zut", "azut vequ"):
        assert g.score(harmless)[0] < 0.7, harmless
    for harmless in ("Kill the process before you restart the server", "you should shoot the video with your phone", "the murder weapon you asked about", "I love my idiot dog, you know", "Smoking can kill you", "I heard that smoking can kill you", "I will kill him, you see"):
        assert g.score(harmless)[0] < 0.7, harmless
    for meant in ("You idiot", "idiot. and then: moron", "I will kill you", "not now, you idiot", "we are going to hurt all of you", "kill yourself", "Ich werde dich töten", "je vais te tuer", "te voy a matar", "l'imbécile, toi", "oui vequté toi", "zut, zut"):
        assert g.score(meant)[0] > 0.7, meant
    assert g.score("")[0] == pytest.approx(0.01) and g.score("a calm text")[1] == 0
    assert g.score("He is not an idiot. You moron!")[0] > 0.75
    assert g.score("vequzu " + "und dann " * 5000)[0] < 0.7


def test_grammar_against_plain_rules():
    rng = random.Random(5)
    words = "you idiot moron kill kill not don't said wrote \" , . ; the a calm vequer zut azut stupid dich töten nicht 12 x_y , isn’t i i we are".split()
    grammar = toxicity.Grammar(LEXICON)
    for _ in range(6000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        assert grammar.score(text) == pytest.approx(plain_score(text, LEXICON))
    long = " ".join(rng.choice(words[:11] + ["calm"] * 300) for _ in range(200_000))  # one clause of a megabyte and more
    assert grammar.score(long) == pytest.approx(plain_score(long, LEXICON))


def test_toxicity_learns(spark):
    rng = random.Random(1)
    texts = [prose(rng, 30) + (" zorgblat now. A zorgblat!" if k % 4 == 0 else "") for k in range(400)] + [None, "", "zorgblat " * 200_000]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(0, 1, 1), (400, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts).unionByName(frame(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 404
    lexicon = toxicity.learn(docs, labels)
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id]
        assert (r.score, r.n_clauses) == pytest.approx(plain_score(text, lexicon))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    wrong = [r.doc_id for r in rows if r.predicted != (r.doc_id is not None and (r.doc_id % 4 == 0 and r.doc_id < 400 or r.doc_id == 402))]
    assert len(wrong) <= 4  # where a made-up word is a negation
    kept = toxicity.drop_toxic(docs, toxicity.Lexicon(("zorgblat",)))
    assert kept.columns == docs.columns and 303 <= kept.count() <= 307
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.join(labels, "doc_id").select("doc_id", "text").collect()}
    lexicon = toxicity.learn(docs, labels)
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert all(r.score == pytest.approx(plain_score(texts[r.doc_id], lexicon)[0]) for r in rows)
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9 and hit / sum(r.predicted for r in rows) > 0.97


# 6


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "123 ++", "en"), (10**6 + 3, "The and of", None)], "doc_id long, text string, lang string")
    rows = langid.identify(docs.unionByName(more)).join(docs.unionByName(more), "doc_id").collect()
    assert len(rows) == 1004
    held = [r for r in rows if r.held_out and r.lang and r.doc_id < 10**6]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[10**6 + k].lang_pred for k in range(4)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.lang_pred for r in langid.identify(more.limit(1)).collect()} == {"und"}


def plain_features(text):
    """Hashed n-grams, told plainly."""
    out, text = [], (text or "").lower()
    words = "".join(c if c.isalpha() and not (text.isascii() and not c.isascii()) else " " for c in text).split(" ")
    if not any(words):
        return out
    code = [32, *map(ord, " ".join(w for w in words if w)), 32]
    if not text[0].isalpha():  # a text that begins or ends otherwise has two spaces there
        code.insert(0, 32)
    if not text[-1].isalpha():
        code.append(32)
    m = 1 << 32

    def slot(x):
        x ^= x >> 15
        return (x * 0x2C1B3C6D % m) >> 17

    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) % m for a, b in zip(code, code[1:])]
    out += [slot(c * 0x165667B1 % m) for c in code] + [slot(x) for x in two]
    return out + [slot((x * 0xC2B2AE3D + c * 0x27D4EB2F) % m) for x, c in zip(two, code[2:])]


def plain_model(rows, classes, folds=4, held=2):
    """TF-IDF, the leader followed coordinate by coordinate, and the temperature."""
    known = sorted((k, lang, plain_features(t)) for k, t, lang in rows if lang and zlib.crc32(str(k).encode()) % folds != held)
    known = [r for r in known if r[2]]
    df = defaultdict(int)
    for _, _, f in known:
        for x in set(f):
            df[x] += 1
    idf = defaultdict(lambda: math.log(1 + len(known)) + 1, {x: math.log((1 + len(known)) / (1 + n)) + 1 for x, n in df.items()})
    data = [({x: 10 * f.count(x) / len(f) * idf[x] for x in set(f)} | {"bias": 1.0}, classes.index(lang)) for _, lang, f in known]
    z, n = defaultdict(float), defaultdict(float)

    def weight(x, c):
        v = z[x, c]
        return 0.0 if abs(v) <= 0.02 else (math.copysign(0.02, v) - v) / ((1 + math.sqrt(n[x, c])) / 0.5 + 0.01)

    def scores(own):
        return [sum(v * weight(x, c) for x, v in own.items()) for c in range(len(classes))]

    def chances(s):
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    cut, order = max(1, len(data) * 4 // 5), np.random.default_rng(6)
    for _ in range(3):
        for k in order.permutation(cut):
            own, label = data[k]
            w = {(x, c): weight(x, c) for x in own for c in range(len(classes))}
            p = chances([sum(v * w[x, c] for x, v in own.items()) for c in range(len(classes))])
            for x, v in own.items():
                for c in range(len(classes)):
                    g = v * (p[c] - (c == label))
                    z[x, c] += g - (math.sqrt(n[x, c] + g * g) - math.sqrt(n[x, c])) / 0.5 * w[x, c]
                    n[x, c] += g * g
    kept = [(scores(own), label) for own, label in data[cut:] or data]
    grid = [math.exp(-3 + k / 10) for k in range(61)]
    t = min(grid, key=lambda t: sum(-math.log(chances([x / t for x in s])[label]) for s, label in kept))

    def predict(text):
        f = plain_features(text)
        if not f:
            return "und", 0.0
        p = chances([x / t for x in scores({x: 10 * f.count(x) / len(f) * idf[x] for x in set(f)} | {"bias": 1.0})])
        return classes[p.index(max(p))], max(p)

    return predict


def test_language_against_plain(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcdefé", "bb": "defghiß", "cc": "ghijklñ"}
    rows = [(k, "".join(rng.choice(alphabets[x] + " ., 1") for _ in range(rng.randrange(1, 60))) + "\n" * (k % 3), x if k % 9 else None) for k, x in enumerate(rng.choice(list(alphabets)) for _ in range(150))]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 ..", "cc"), (None, "abc abc", "aa"), (203, "ABÉ " * 60_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("share", F.lit(1))
    found = langid.identify(docs).collect()
    predict = plain_model([r for r in rows if r[0] is not None], sorted(alphabets))
    by_id = {k: t for k, t, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        lang, score = predict(by_id[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4), r
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_language_learns_from_labelled_training_folds_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 10 > 0, F.col("lang")))
    seen = langid.train(docs, 4, 2, 4000)
    rest = langid.train(docs.where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), 4, 2, 4000)
    assert seen["langs"] == rest["langs"] and seen["temperature"] == rest["temperature"]
    assert (seen["weights"] == rest["weights"]).all() and (seen["bias"] == rest["bias"]).all()


def test_temperature_lowers_doubt():
    scores, labels = np.array([[9.0, 0.0], [9.0, 0.0], [0.0, 9.0], [9.0, 0.0]]), np.array([0, 0, 1, 1])
    assert langid.temperature(scores, labels) > 5


# 7


def plain_exact(texts):
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[t or ""].append(k)
    return {k: (max(g), len(g), k == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g}


@pytest.mark.parametrize("block", [16, 8192])
def test_exact(spark, texts, block):
    rows = exact_dedup.exact_dedup(frame(spark, texts), block).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == plain_exact(texts)


def test_exact_keeps_one_of_rows_repeated_as_a_whole(spark):
    docs = spark.createDataFrame([(5, "same"), (5, "same"), (5, "other"), (9, "other"), (None, "other"), (None, "x")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(rows, key=str) == sorted([(5, 5, 2, True), (5, 5, 2, False), (5, 9, 3, False), (9, 9, 3, True), (None, 9, 3, False), (None, None, 1, True)], key=str)


def test_exact_where_hashes_clash(spark, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.lit(5).cast("long"))
    rows = exact_dedup.exact_dedup(frame(spark, texts), 64).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == plain_exact(texts)


def test_drop_copies_of_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "same", 8, 1), (5, "same", 9, 2), (5, "other", 8, 3), (9, "other", 9, 4)], "doc_id long, text string, _part long, _maybe int")
    assert sorted(r.text for r in exact_dedup.drop_copies(docs).collect()) == ["other", "same"]
    assert {(r.text, r._part) for r in exact_dedup.drop_copies(docs).collect()} <= {("same", 8), ("same", 9), ("other", 9)}


@pytest.mark.parametrize("block", [16, 8192])
def test_drop_copies_keeps_one_row_of_each_text(spark, texts, block):
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(frame(spark, ["another text of the id 0"]))
    kept = exact_dedup.drop_copies(docs, block)
    assert kept.dtypes == docs.dtypes
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    last = {t or "": k for k, t in enumerate(texts)} | {"another text of the id 0": 0}
    assert sorted(rows) == sorted((k, t) for t, k in last.items())


# 8


def test_hilbert_curve_steps_by_one():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(sharding.hilbert_index(cells, 3))]
    assert sorted(sharding.hilbert_index(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def plain_order(rows, shards, bits):
    """rows: doc_id, text, lang, source. The shard and slot of each by cells at quantiles told plainly."""
    sized = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), (lang or "").encode(), (source or "").encode()) for k, t, lang, source in rows]
    cells = []
    for dim in (3, 4, 1, 0):
        values = sorted(r[dim] for r in sized)
        bounds = sorted({values[max(0, -(-k * len(values) // (1 << bits)) - 1)] for k in range(1, 1 << bits)})
        cells.append([sum(b < r[dim] for b in bounds) for r in sized])
    curve = sharding.hilbert_index(np.array(cells).T, bits)
    order = sorted(range(len(sized)), key=lambda k: (curve[k], sized[k][0], sized[k][2], sized[k][1]))
    first = [-(-s * len(order) // shards) for s in range(shards + 1)]
    return {sized[k][0]: next((s, at - first[s]) for s in range(shards) if first[s] <= at < first[s + 1]) for at, k in enumerate(order)}


def test_shards(spark, texts, tmp_path):
    langs = [None, "de", "en", "en-GB", "en-US", ""]
    rows = [(3 * k, t, langs[k % 6], None if k % 7 == 0 else f"https://{'abcdefgh'[k * k % 8]}.example/{k % 5}") for k, t in enumerate(texts * 3)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, size long, shard string, row int")
    placed = sharding.shard(docs, 8, 3)
    assert placed.columns == ["doc_id", "text", "lang", "source", "row", *sharding.PLACE]
    found, wanted = placed.collect(), plain_order(rows, 8, 3)
    assert {r.doc_id: (r.shard, r.slot) for r in found} == wanted and len(found) == len(rows)
    for r in found:
        t = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    per = defaultdict(list)
    for shard, slot in wanted.values():
        per[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1 and set(per) == set(range(8))
    sharding.write_shards(docs, str(tmp_path / "out"), 8, 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.text, r.shard, r.slot) for r in found}


def test_shards_of_odd_rows(spark):
    few = spark.createDataFrame([(1, "a", None, None), (1, "a", None, None), (None, None, "en", "s"), (7, "b", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = sharding.shard(few, 8).collect()
    assert len(rows) == 4 and all(r.slot == 0 for r in rows) and len({r.shard for r in rows}) == 4


def test_string_bounds_are_quantiles_of_whole_strings(spark):
    rng = random.Random(3)
    values = [f"https://{rng.choice('az')}.example/{rng.randrange(300)}" for _ in range(5000)] + ["https://hot.example"] * 2500 + [None] * 500
    rows = spark.createDataFrame([(v,) for v in values], "source string")
    bounds = sharding.string_bounds(rows, "source", 8, len(values))
    cells = np.searchsorted(np.array(bounds, dtype=object), [(v or "").encode() for v in values], side="left")
    assert len(bounds) >= 5 and bounds == sorted(bounds)
    assert all((cells == c).sum() <= 1200 for c in range(len(bounds) + 1) if c != bounds.index(b"https://hot.example"))


# 9


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16))
    v[100:200] = v[100]
    v *= rng.uniform(0.5, 2, size=(1500, 1))
    rows = [(k, [float(np.float32(x)) for x in r], k) for k, r in enumerate(v)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [1.0] * 15, 0), (2060, [float("nan")] * 16, 0), (2080, [None] * 16, 0), (2100, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (None, [1.0] * 16, 0)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int"), "vec_id % 20 = 0", 20).collect()
    x = np.array([r[1] for r in rows[:1500]])
    good = 0
    by_query = defaultdict(list)
    for r in sorted(found, key=lambda r: r.rank):
        by_query[r.query_id].append(r)
    assert set(by_query) == set(range(0, 1500, 20))
    for q, own in by_query.items():
        s = x @ x[q]
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(s[r.vec_id] - r.score) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and q not in {r.vec_id for r in own}
        s[q] = -np.inf
        good += len({r.vec_id for r in own} & set(np.lexsort((np.arange(1500), -s))[:20]))
    assert good / (20 * len(by_query)) >= 0.9


def recall(x, found, queries, k=20):
    good = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        good += len({r.vec_id for r in found if r.query_id == q} & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return good / (k * len(queries))


def test_neighbours_with_split_lists(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 12)) + 2 * rng.normal(size=(40, 12))[rng.integers(0, 40, 4000)]
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    sizes = []
    real = ann.CentroidGraph.__init__
    try:
        ann.CentroidGraph.__init__ = lambda self, c, *a, **b: (sizes.append(len(c)), real(self, c, *a, **b))[1]
        found = ann.nearest(rows, "vec_id % 50 = 0", 20, root=1.2, sample=400, beam=8).collect()
    finally:
        ann.CentroidGraph.__init__ = real
    assert sizes[0] == 20 and sizes[1] > 50  # 20 clusters of the sample, split further
    assert recall(x, found, range(0, 4000, 50)) >= 0.9


def test_recall_on_the_table(spark, sf):
    sf = sf.replace("0.001", "0.1")
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = ann.nearest(table, "vec_id % 50 = 0", 20).collect()
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    assert [k for k, _ in rows] == list(range(rows[0][0], rows[0][0] + len(rows)))
    x, first = np.array([v for _, v in rows], dtype=np.float64), rows[0][0]
    moved = [type("R", (), {"query_id": r.query_id - first, "vec_id": r.vec_id - first}) for r in found]
    assert recall(x, moved, [k - first for k, _ in rows if k % 50 == 0]) >= 0.9


def test_every_list_within_the_ratio_is_read():
    rng = np.random.default_rng(3)
    graph, q = ann.CentroidGraph(rng.normal(size=(300, 8))), rng.normal(size=(40, 8)).astype(np.float32)
    ids, d = ann.within(graph, q, 4, 1.3)
    true = np.sqrt(graph.distances(q))
    near = [set(np.flatnonzero(t <= 1.3 * t.min())) for t in true]
    assert max(map(len, near)) > 8  # more than the beam begins with
    assert sum(len(a & set(b[b >= 0])) for a, b in zip(near, ids, strict=True)) >= 0.9 * sum(map(len, near)) and (np.isinf(d) == (ids < 0)).all()


def test_few_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, "vec_id % 20 = 0").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(1), "true").count() == ann.nearest(few.limit(0), "true").count() == 0


def test_repeated_neighbours_count_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [5.0, 0.1 * k]) for k in range(30)] + [(k, [5.0 - 0.1 * k, 1.0]) for k in range(2, 8)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", 5, root=0.01).collect()
    assert sorted((r.rank, r.vec_id) for r in found) == [(k, k) for k in range(1, 6)] and {r.score for r in found if r.vec_id == 1} == {5.0}
    few = spark.createDataFrame(rows[:33], "vec_id long, embedding array<double>")
    assert sorted((r.rank, r.vec_id) for r in ann.nearest(few, "vec_id = 0", 5, root=0.01).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_graph_walk_finds_the_nearest():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 8)).astype(np.float32)
    g = ann.CentroidGraph(c)
    q = rng.normal(size=(50, 8)).astype(np.float32)
    ids, d = g.search(q, 32)
    true = np.argsort(g.distances(q), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, true, strict=True)]) > 0.95 and (np.diff(d, axis=1) >= 0).all()


def test_graph_walk_reaches_what_lies_apart():
    rng = np.random.default_rng(6)
    crowd = rng.normal(size=(400, 32))
    apart = 6 * rng.normal(size=(40, 32))
    graph = ann.CentroidGraph(np.concatenate([crowd, apart]).astype(np.float32))
    ids, _ = graph.search((apart + 0.01).astype(np.float32), 16)
    reached = (ids[:, 0] == np.arange(400, 440)).mean()
    graph.near = np.delete(graph.near, np.arange(16, 22), axis=1)  # without the links back
    ids, _ = graph.search((apart + 0.01).astype(np.float32), 16)
    assert reached >= 0.9 > (ids[:, 0] == np.arange(400, 440)).mean()


# 10


def test_quality(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_cases(spark, texts):
    rows = quality.quality(frame(spark, texts)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (texts[r.doc_id] or "").strip()} == {0.0}


def plain_facts(text):
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    data = text.encode()
    plain = sum(b >= 128 or chr(b).isalnum() or chr(b) in " \t\n\r\v\f" for b in data)
    stops = sum(b in b".!?" and (k + 1 == len(data) or data[k + 1] in b" \t\n\r\v\f") for k, b in enumerate(data))
    one, n = max(1, len(data)), max(1, len(words))
    return {"n_words": len(words), "plain": plain / one, "upper": sum(65 <= b <= 90 for b in data) / one, "symbols": sum(b in b"#{}<>|\\^~*$%&=_[]" for b in data) / one,
            "distinct_words": len(set(words)) / n, "distinct_lines": len(set(lines)) / max(1, len(lines)), "word_chars": len(text) / n, "stops": stops / n}


def plain_quality(texts):
    """Votes, expectation-maximisation row by row, and the scorer over dictionaries; every row is drawn."""
    facts = [plain_facts(t) for t in texts]
    rules = [(10, lambda f: f["plain"] < 0.93), (10, lambda f: f["upper"] > 0.15), (30, lambda f: f["distinct_words"] < 0.35), (1, lambda f: f["distinct_lines"] < 0.7), (10, lambda f: f["word_chars"] < 3 or f["word_chars"] > 8), (30, lambda f: f["stops"] < 0.02 or f["stops"] > 0.35), (1, lambda f: f["symbols"] > 0.02), (0, lambda f: f["n_words"] == 0)]
    votes = [[None if f["n_words"] < least else bad(f) for least, bad in rules] for f in facts]
    prior, good, bad = 0.8, [0.02] * 8, [0.4] * 8
    for _ in range(100):
        post = []
        for v in votes:
            a, b = math.log(prior), math.log(1 - prior)
            for k, x in enumerate(v):
                if x is not None:
                    a += math.log(good[k] if x else 1 - good[k])
                    b += math.log(bad[k] if x else 1 - bad[k])
            post.append(1 / (1 + math.exp(b - a)))
        prior = (sum(post) + 1) / (len(post) + 2)
        good = [(sum(p for p, v in zip(post, votes) if v[k]) + 1) / (sum(p for p, v in zip(post, votes) if v[k] is not None) + 50) for k in range(8)]
        bad = [(sum(1 - p for p, v in zip(post, votes) if v[k]) + 0.8) / (sum(1 - p for p, v in zip(post, votes) if v[k] is not None) + 2) for k in range(8)]
    rows = []
    for t, f in zip(texts, facts):
        shape = [min(1.0, s * f[k]) for k, s in (("plain", 1), ("upper", 2), ("distinct_words", 1), ("distinct_lines", 1), ("symbols", 10), ("stops", 2))] + [min(1.0, math.log1p(f["n_words"]) / 10), min(1.0, f["word_chars"] / 20)]
        own, data = {k * 16 + min(15, int(16 * x)): 1.0 for k, x in enumerate(shape)}, t.encode()
        for a, b, c in zip(data, data[1:], data[2:]):
            x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % (1 << 32) * 0x27D4EB2F % (1 << 32)
            own[256 + (x >> 18)] = own.get(256 + (x >> 18), 0) + 10 / (len(data) - 2)
        rows.append(own)
    w, g2, rng = defaultdict(float), defaultdict(lambda: 1e-6), np.random.default_rng(10)
    order = sorted(range(len(rows)), key=lambda k: [list(rows[k])[:8] + sorted(list(rows[k])[8:]), [rows[k][x] for x in list(rows[k])[:8] + sorted(list(rows[k])[8:])]])
    for _ in range(3):
        for k in rng.permutation(len(rows)):
            own, y = rows[order[k]], post[order[k]]
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(v * w[x] for x, v in own.items())))))
            for x, v in own.items():
                g2[x] += ((p - y) * v) ** 2
                w[x] -= 0.1 * (p - y) * v / math.sqrt(g2[x])
    score = [1 / (1 + math.exp(-max(-30, min(30, sum(v * w[x] for x, v in own.items()))))) if f["n_words"] else 0.0 for own, f in zip(rows, facts)]
    return [(s, p) for s, p in zip(score, post)]


def test_quality_against_plain(spark, texts):
    rng = random.Random(4)
    cases = [t or "" for t in texts] + [prose(rng, 40).upper() + "!!" for _ in range(8)] + ["same words again " * 40] * 5 + ["# | { } " * 30, "tiny", "a\nb\na\nb\n" * 9]
    rows = {r.doc_id: r for r in quality.quality(frame(spark, cases)).collect()}
    for k, (score, post) in enumerate(plain_quality(cases)):
        assert rows[k].posterior == pytest.approx(post, abs=1e-9) and rows[k].score == pytest.approx(score, abs=1e-6), cases[k][:50]


def test_quality_of_long_texts_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "word " * 400_000), (1, "x" * 3_000_000), (1, None), (None, None)], "doc_id long, text string")
    rows = quality.quality(docs).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)


def test_estimate_finds_who_is_right():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    hit = np.array([0.9, 0.6, 0.3])
    votes = np.where(np.where(good[:, None], rng.random((20000, 3)) < 0.01, rng.random((20000, 3)) < hit), quality.BAD, quality.GOOD)
    votes[rng.random((20000, 3)) < 0.1] = quality.ABSTAINS
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, on_good, on_bad, _ = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and (np.abs(on_bad - hit) < 0.1).all() and (on_good < 0.03).all()


# Samples


def test_samples_are_bounded(spark):
    """Null and repeated ids, ten times as many as are to be learned from, neither crowd out others nor are all taken."""
    texts = [f"the quick words of english number {k}" for k in range(300)]
    for ids in ([None] * 300, [7] * 300, [k % 2 for k in range(300)]):
        rows = frame(spark, texts).withColumn("doc_id", F.element_at(F.array(*[F.lit(x).cast("long") for x in ids]), (F.col("doc_id") + 1).cast("int")))
        assert common.sampled(rows, 30, "doc_id", "text").count() == 30 and common.sampled(rows, 500, "doc_id", "text").count() == 300
        scored = quality.quality(rows, 30)
        assert scored.count() == 300
    same = frame(spark, ["one text"] * 300)
    assert common.sampled(same, 30, "text").count() == 1
    known = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][0]
    rows = frame(spark, texts).withColumn("doc_id", F.lit(known).cast("long"))
    assert {r.lang_pred for r in langid.identify(rows, train_rows=30).collect()} == {"en"}
    labels = spark.createDataFrame([(known, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(rows, labels, train_rows=30).count() == 300


# All


def test_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        jaccard_join.jaccard_join(empty), packing.pack(empty, RANKS, PATTERN), bpe.round_trip(empty, RANKS, PATTERN), suffix_dedup.suffix_dedup(empty), toxicity.toxicity(empty, labels),
        langid.identify(empty), exact_dedup.exact_dedup(empty), sharding.shard(empty), quality.quality(empty),
    ]
    assert [d.count() for d in made] == [0] * len(made)
    for drop in (jaccard_join.drop_near_copies, suffix_dedup.drop_repeats, exact_dedup.drop_copies):
        assert drop(empty).count() == 0 and drop(empty).columns == empty.columns


def test_repeated_rows(spark):
    twice = frame(spark, ["the same text in two rows " * 20, "other words"]).unionByName(frame(spark, ["the same text in two rows " * 20]))
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (
        jaccard_join.jaccard_join(twice), bpe.round_trip(twice, RANKS, PATTERN), suffix_dedup.suffix_dedup(twice), toxicity.toxicity(twice, labels), langid.identify(twice),
        exact_dedup.exact_dedup(twice), sharding.shard(twice), quality.quality(twice), packing.pack(twice, RANKS, PATTERN),
    ):
        assert made.count() == 3


def test_bitmap(spark):
    keys, rows = spark.range(0, 3000, 7), spark.range(9000)
    assert common.maybe_in(rows, keys, "id").join(keys, "id").count() == keys.count()
    assert common.without(rows, keys, "id").count() == 9000 - keys.count()


def test_helper_columns_leave_those_of_the_caller(spark):
    rows = spark.range(100).selectExpr("id", "id + 1 as _part", "'b' as _bits", "id as _MAYBE", "id * 2 as `a.b`")
    left = common.without(rows, spark.range(0, 100, 3), "id")
    assert left.columns == rows.columns and {tuple(r) for r in left.collect()} == {(k, k + 1, "b", k, 2 * k) for k in range(100) if k % 3}
