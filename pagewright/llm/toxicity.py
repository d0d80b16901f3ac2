"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns words into classes: insult, threat, target, object (a target that may stand before its verb),
first person, link (copulas, articles, auxiliaries), negation, report, quotation mark, comma, other. Insults are a short fixed
list, and words or word beginnings that labelled toxic documents have and others hardly ever do. Three small transducers follow:
negation marks what stands up to five words after a negation, as far as the next comma; reported speech marks what follows a
verb of saying or stands in quotation marks; scoring gives weights by order. They are composed into one machine, which reads
every clause that holds an insult or a threat, from end to end and once.

What scores: an insult its own weight, and more where it is aimed: a target before it with nothing but links between ("you are
such a moron"), or right after it ("moron, you"). A threat has a weight only in the frame of a first person up to three words
before it, or at the beginning of a clause, and with a target up to two words after it ("I will kill all of you", "kill
yourself") or an object before it with nothing but links between ("je vais te tuer"). What is negated or reported has little
weight. No word counts outside a clause: a document's score is the chance that any of its matched clauses is meant. One insult
that is not aimed is not enough; a second one is, in the same clause or another.

Learning uses a sample of at most ``train_rows`` labelled documents and as many of their texts of the training folds, whatever
the input's size. Learned are whole words of any length and beginnings of 4 to 9 letters.
Nulls: a null text is an empty one and scores the base rate of a text without matches; null labels and labels of a null id
teach nothing, and a null id is not held out. Texts and clauses of any length are read whole. Repeated rows each get a row;
of repeated labels the greatest counts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, crc_mod, sampled

THRESHOLD = 0.7
INSULT, THREAT, TARGET, OBJECT, FIRST, LINK, NEGATION, REPORT, QUOTE, COMMA, OTHER = "ITYDFLNRQCO"
# Fixed word lists of the grammar, whole words in four languages.
INSULTS = "idiot idiots moron morons stupid imbecile scum scumbag worthless pathetic loser dumbass bastard asshole bitch Idiot Arschloch Dummkopf Trottel Vollidiot imbécile connard salaud abruti idiota imbécil estúpido gilipollas cabrón".lower().split()
THREATS = "kill hurt destroy murder strangle beat shoot stab töten umbringen verletzen vernichten tuer frapper détruire égorger matar golpear destruir apuñalar".split()
TARGETS = "you your yours yourself yourselves u ur du dein deine tu vous ton votre tú usted ustedes vuestro".split()
OBJECTS = "dich dir euch toi te ti".split()
FIRST_PERSONS = "i we ich wir je j nous yo nosotros voy vamos".split()
LINKS = "are re r is am be was were will ll a an the such so really just only total complete bist seid sind ist ein eine einen so echt werde werden wirst wird es êtes est un une le la vais vas va allons l eres sois son tan una el".split()
NEGATIONS = "not never no nor neither nobody cannot without hardly nicht nie niemals kein keine keinen niemand ohne jamais aucun aucune sans nunca jamás ningún ninguna tampoco sin".split()
REPORTS = "said says say wrote writes claimed claims reported called quoted told sagte schrieb behauptete nannte déclaré écrit prétend appelé dijo escribió afirmó llamó".split()
WORD = re.compile(r"[^\W\d_]*n['’]t(?![^\W\d_])|[^\W\d_]+|[\"“”„«»,]")
CONTRACTED = re.compile(r"n['’]t$")
BREAKS = ".!?;:\n"
CLAUSE = re.compile(r"[.!?;:\n]")
STEM_FROM, STEM_TO = 4, 9
NEARLY = 0.9
NEGATED = 5  # words that a negation reaches
FRAME, REACH = 3, 2  # words between a first person and its threat, and between a threat and its target

Arcs = dict[tuple, dict[str, tuple[tuple, str, float]]]


def negation() -> Arcs:
    """Insults and threats in the reach of a negation come out in lower case."""
    arcs: Arcs = {}
    for state in range(NEGATED + 1):
        after = (max(state - 1, 0),)
        step = {c: (after, c, 0.0) for c in (TARGET, OBJECT, FIRST, LINK, REPORT, OTHER)}
        step |= {c: (after, c.lower() if state else c, 0.0) for c in (INSULT, THREAT)}
        step[QUOTE] = ((state,), QUOTE, 0.0)
        step[NEGATION] = ((NEGATED,), OTHER, 0.0)
        step[COMMA] = ((0,), COMMA, 0.0)
        arcs[(state,)] = step
    return arcs


def reported() -> Arcs:
    """What follows a verb of saying, or stands in quotation marks, comes out as 'reported' (R)."""
    arcs: Arcs = {}
    for state in ("plain", "said", "quoted"):
        step = {c: ((state,), c if state == "plain" else REPORT, 0.0) for c in (INSULT, THREAT, "i", "t")}
        step |= {c: ((state,), c, 0.0) for c in (TARGET, OBJECT, FIRST, LINK, COMMA, OTHER)}
        step[REPORT] = (("said" if state != "quoted" else state,), OTHER, 0.0)
        step[QUOTE] = (("plain" if state == "quoted" else "quoted",), OTHER, 0.0)
        arcs[(state,)] = step
    return arcs


WITH_TARGET, AT_TARGET = 1.5, 4.5


def scoring() -> Arcs:
    """Weights by order. A state: words for which a frame still holds, for which a threat still waits for its target, and what came last.

    'target' and 'object' came last where only links follow them, 'insult' where only commas do.
    """
    arcs: Arcs = {}
    for frame in range(FRAME + 2):
        for wait in range(REACH + 2):
            for last in ("", "target", "object", "insult"):
                passed = (max(frame - 1, 0), max(wait - 1, 0))
                aimed = last in ("target", "object")
                step = {c: ((*passed, ""), c, 0.0) for c in ("i", "t", REPORT, OTHER)}
                step[LINK] = ((*passed, last if aimed else ""), OTHER, 0.0)
                step[FIRST] = ((FRAME + 1, passed[1], last if aimed else ""), OTHER, 0.0)
                step[COMMA] = ((frame, 0, last), OTHER, 0.0)
                step[INSULT] = ((*passed, last if aimed else "insult"), INSULT, WITH_TARGET if aimed else 0.0)
                meant = frame > 0 and last == "object"
                step[THREAT] = ((passed[0], REACH + 1 if frame and not meant else 0, ""), OTHER, AT_TARGET if meant else 0.0)
                for c, name in ((TARGET, "target"), (OBJECT, "object")):
                    step[c] = ((passed[0], 0, name), OTHER, AT_TARGET if wait else WITH_TARGET if last == "insult" else 0.0)
                arcs[frame, wait, last] = step
    return arcs


def compose(first: Arcs, second: Arcs) -> Arcs:
    """The machine that feeds the output of the first to the second; weights add."""
    out: Arcs = {}
    for a, steps in first.items():
        for b, then in second.items():
            out[a + b] = {c: (to + then[mid][0], then[mid][1], w + then[mid][2]) for c, (to, mid, w) in steps.items()}
    return out


@functools.cache
def machine() -> Arcs:
    return compose(compose(negation(), reported()), scoring())


START = (0, "plain", 1, 0, "")  # a clause begins as if framed, for one word


#: Share of a word's own weight that counts when it is meant, negated, reported.
SHARE = {INSULT: 1.0, "i": 0.15, REPORT: 0.25}
OWN, BIAS, BASE = 3.0, 2.8, 0.01  # log odds of an insult, of a clause without any, and the score of a text without matches


def chance(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


@dataclass(frozen=True)
class Lexicon:
    """What is learned: insults as whole words and as beginnings of words, in lower case."""

    words: tuple[str, ...] = ()
    stems: tuple[str, ...] = ()


class Grammar:
    def __init__(self, lexicon: Lexicon = Lexicon()):
        lists = ((LINKS, LINK), (FIRST_PERSONS, FIRST), (TARGETS, TARGET), (OBJECTS, OBJECT), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT), ("\"“”„«»", QUOTE), (",", COMMA), (lexicon.words, INSULT), (INSULTS, INSULT))
        self.classes = {w: c for words, c in lists for w in words}
        self.stems = lexicon.stems
        self.machine = machine()
        whole = "|".join(map(re.escape, sorted({*INSULTS, *THREATS, *lexicon.words})))
        begin = "|".join(map(re.escape, sorted(lexicon.stems)))
        self.hit = re.compile(rf"(?<![^\W\d_])(?:(?:{whole})(?![^\W\d_])" + (rf"|(?:{begin}))" if begin else ")"))

    def kind(self, word: str) -> str:
        """The class of a word in lower case: the lexicon transducer."""
        return self.classes.get(word) or (INSULT if word.startswith(self.stems) else NEGATION if CONTRACTED.search(word) else OTHER)

    def clause(self, text: str) -> float:
        """Log odds of a clause without its bias; the machine starts anew in each clause."""
        state, total = START, 0.0
        for word in WORD.findall(text):
            kind = self.kind(word)
            state, out, w = self.machine[state][kind]
            total += w
            if kind == INSULT:
                total += SHARE[out] * OWN
        return total

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses of a text in lower case that hold a hit, each once."""
        done = 0
        for m in self.hit.finditer(text):
            if m.start() < done:
                continue
            begin = max(done, 1 + max(text.rfind(c, done, m.start()) for c in BREAKS))
            end = CLAUSE.search(text, m.end())
            done = end.start() if end else len(text)
            yield text[begin:done]

    def score(self, text: str) -> tuple[float, int]:
        """Chance of toxicity, and the number of matched clauses."""
        clean, n = 1 - BASE, 0
        for clause in self.clauses(text.lower()):
            clean *= 1 - max(0.0, chance(self.clause(clause) - BIAS) - chance(-BIAS))
            n += 1
        return 1 - clean, n


def candidates(text: str | None) -> set[str]:
    """The words of a text, each with a space behind it, and their beginnings."""
    words = {w for w in WORD.findall((text or "").lower()) if w[0].isalpha()}
    return {w + " " for w in words} | {w[:k] for w in words for k in range(STEM_FROM, min(len(w), STEM_TO) + 1)}


def surprise(hits: Column, misses: Column, share: float) -> Column:
    """Chernoff's bound, as a negative log: the chance that as many of hits + misses draws are hits, each with the chance ``share``."""
    n = hits + misses
    missed = F.when(misses > 0, misses * F.log(misses / n / (1 - share))).otherwise(0.0)
    return F.when(hits / n > share, hits * F.log(hits / n / share) + missed).otherwise(0.0)


def contexts(texts: DataFrame, stems: frozenset[str]) -> DataFrame:
    """stem, n_contexts: after how many different words each of the given words and beginnings stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: set[tuple[str, str]] = set()
            for text in batch.column(0):
                before = ""
                for word in WORD.findall((text.as_py() or "").lower()):
                    pairs.update((x, before) for x in (word + " ", *(word[:k] for k in range(STEM_FROM, min(len(word), STEM_TO) + 1))) if x in stems)
                    before = word
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["stem", "before"])

    return arrow_map(texts, run, "stem string, before string").groupBy("stem").agg(F.countDistinct("before").alias("n_contexts"))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, train_rows: int = 20_000, least: int = 3, least_odds: float = 3.0) -> Lexicon:
    """Words and beginnings that toxic documents of the training folds have and others hardly ever do.

    One needs ``least`` toxic documents, log odds of ``least_odds``, and to be too surprising among all that have so many to be
    chance; documents where it follows the same word count once for that, or the rare words of near copies would be learned. A beginning
    goes where a longer one holds in nearly as many toxic documents; then those of most documents are taken first, and none
    that begins with one taken before.
    """
    known = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = sampled(known, train_rows, "doc_id")  # small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))  # a copy teaches nothing new
    rows = sampled(rows, train_rows, "text")

    def emit(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["stem", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update({"", *candidates(text.as_py())})
                if len(toxic) + len(clean) > 100_000:
                    yield emit(toxic, clean)
                    toxic, clean = Counter(), Counter()
        yield emit(toxic, clean)

    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(rows, "rows")
    counts = arrow_map(rows, count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= least) | (F.col("stem") == ""))
    counts = scratch.save(counts, "counts")
    total = counts.where("stem = ''").first()
    found: list[tuple[int, int, str]] = []
    if total and total["toxic"] and total["clean"]:
        odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
        chanced = surprise(F.col("toxic"), F.col("clean"), total["toxic"] / (total["toxic"] + total["clean"]))
        telling = (odds >= least_odds) & (chanced >= math.log(counts.count()))
        able = counts.where((F.col("stem") != "") & telling).withColumnRenamed("toxic", "texts")
        varied = contexts(rows.where("toxic = 1").select("text"), frozenset(r["stem"] for r in able.select("stem").collect()))  # words of the sample's toxic texts at most
        able = able.join(varied, "stem").withColumn("toxic", F.least("texts", "n_contexts")).where((F.col("toxic") >= least) & telling)
        found = sorted(((r["texts"], len(r["stem"]), r["stem"]) for r in able.collect()), reverse=True)
    scratch.close()
    texts = {stem: n for n, _, stem in found}
    longer = {w[:k] for w, n in texts.items() for k in range(STEM_FROM, len(w)) if n >= NEARLY * texts.get(w[:k], n + n)}
    chosen: list[str] = []
    for _, _, stem in found:
        if stem not in longer and not any(stem.startswith(x) or x.startswith(stem) for x in chosen):
            chosen.append(stem)
    return Lexicon(tuple(sorted(x[:-1] for x in chosen if x[-1] == " ")), tuple(sorted(x for x in chosen if x[-1] != " ")))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            found = [grammar.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], ["doc_id", "score", "n_clauses"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, n_clauses int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **learning) -> DataFrame:
    """Per document doc_id, held_out, score, predicted, n_clauses."""
    scored = score(docs, learn(docs, labels, folds, held, **learning))
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold. Nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(t.as_py() or "")[0] < THRESHOLD for t in batch.column(at)], pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # the Arrow step resolves columns by name, and names may be odd
    return arrow_map(plain, run, plain.schema).toDF(*docs.columns)
