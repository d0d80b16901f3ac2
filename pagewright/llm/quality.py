"""Quality scores from weak labels.

Heuristic labellers look at a text and vote 'good' or 'bad', or abstain where a text is too short for them. Their votes form
one pattern for each document; patterns are counted over all documents (there are at most 3^labellers, so the counts fit
anywhere), and expectation-maximisation over the counts estimates the share of good texts and how often each labeller is
wrong on good and right on bad ones, with no labels at all; who abstains says nothing. The posterior of each pattern then
labels texts for a linear scorer on hashed byte trigrams and shape features, which generalises beyond the heuristics.

The scorer is fitted to the features, at most ``FEATURES`` numbers each, of at most ``train_rows`` documents, whatever the input's
size; vote counts come from every row. Nulls: a null text is an empty one; an empty text scores 0; a null id stays null, and is
drawn like any other. Texts of any length are read whole. Repeated rows each get a row. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sampled

FEATURES = 1 << 14


_KIND = np.zeros(256, dtype=np.uint8)  # of a byte: 1 plain (letters, digits, white space, all beyond ASCII), 2 capital, 4 symbol, 8 white space, 16 full stop
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ \t\n\r\x0b\x0c", *range(128, 256)]] |= 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] |= 2
_KIND[[*b"#{}<>|\\^~*$%&=_[]"]] |= 4
_KIND[[*b" \t\n\r\x0b\x0c"]] |= 8
_KIND[[*b".!?"]] |= 16


def facts(text: str) -> dict[str, float]:
    """What the labellers look at; shares are of bytes, words or lines."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    one = max(1, len(data))
    kind = _KIND[data]
    space = np.append((kind & 8) != 0, True)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]

    def share(bit: int) -> float:
        return float(counts[(_KIND & bit) != 0].sum()) / one

    return {
        "n_words": len(words),
        "plain": share(1),
        "upper": share(2),
        "symbols": share(4),
        "distinct_words": len(set(words)) / n,
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "word_chars": len(text) / n,
        "stops": float((((kind & 16) != 0) & space[1:]).sum()) / n,
    }


#: The labellers: how many words a text needs for a vote, and when the vote is 'bad'.
VOTES = (
    (10, lambda f: f["plain"] < 0.93),
    (10, lambda f: f["upper"] > 0.15),
    (30, lambda f: f["distinct_words"] < 0.35),
    (1, lambda f: f["distinct_lines"] < 0.7),
    (10, lambda f: not 3 <= f["word_chars"] <= 8),
    (30, lambda f: not 0.02 <= f["stops"] <= 0.35),
    (1, lambda f: f["symbols"] > 0.02),
    (0, lambda f: f["n_words"] < 1),
)
ABSTAINS, BAD, GOOD = 0, 1, 2


def pattern(f: dict[str, float]) -> int:
    """The votes as digits to the base of three, the first labeller's last."""
    return sum(3**k * (ABSTAINS if f["n_words"] < least else BAD if bad(f) else GOOD) for k, (least, bad) in enumerate(VOTES))


#: What labellers are taken for beforehand, as (rate of 'bad', votes that this is worth): on good texts and on bad ones.
ON_GOOD, ON_BAD = (0.02, 50), (0.4, 2)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Share of good texts, P('bad' | good), P('bad' | bad) of each labeller that votes, and each pattern's posterior of good.

    votes: a row for each pattern, a column for each labeller. Expectation-maximisation; which class is the good one follows
    from what labellers are taken for beforehand, a few votes that weigh nothing in a large table.
    """
    bad, good = votes == BAD, votes == GOOD
    prior, on_good, on_bad = 0.8, np.full(votes.shape[1], ON_GOOD[0]), np.full(votes.shape[1], ON_BAD[0])
    post = np.full(len(counts), prior)
    for _ in range(rounds):
        apart = np.log(prior / (1 - prior)) + bad @ np.log(on_good / on_bad) + good @ np.log((1 - on_good) / (1 - on_bad))
        post = 1 / (1 + np.exp(-np.clip(apart, -500, 500)))
        prior = float((post @ counts + 1) / (counts.sum() + 2))
        on_good, on_bad = (((w @ bad) + rate * worth) / (w @ (bad | good) + worth) for w, (rate, worth) in ((post * counts, ON_GOOD), ((1 - post) * counts, ON_BAD)))
    return prior, on_good, on_bad, post


def _hashed(text: str, shape: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text: hashed byte trigrams by share, and its shape in bins."""
    at = np.array([k * 16 + min(15, int(16 * x)) for k, x in enumerate(shape)], dtype=np.int64)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if len(data) < 3:
        return at, np.ones(len(at))
    x = data.astype(np.uint32)
    grams = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    count = np.bincount(grams >> np.uint32(32 - 14), minlength=FEATURES)
    own = np.flatnonzero(count)
    return np.concatenate([at, 256 + own]), np.concatenate([np.ones(len(at)), 10 * count[own] / len(grams)])


SHAPE = ("plain", "upper", "distinct_words", "distinct_lines", "symbols", "stops")


def _shape(row: dict) -> list[float]:
    return [min(1.0, s * row[k]) for k, s in zip(SHAPE, (1.0, 2.0, 1.0, 1.0, 10.0, 2.0), strict=True)] + [min(1.0, np.log1p(row["n_words"]) / 10), min(1.0, row["word_chars"] / 20)]


def train(data: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 3, rate: float = 0.1) -> np.ndarray:
    """Logistic regression on soft labels, by adaptive gradient steps."""
    w, g2 = np.zeros(256 + FEATURES), np.full(256 + FEATURES, 1e-6)
    rng = np.random.default_rng(10)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            at, value, y = data[k]
            g = (1 / (1 + np.exp(-np.clip(value @ w[at], -30, 30))) - y) * value
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def _patterns(docs: DataFrame) -> DataFrame:
    """How often each pattern of votes occurs, counted where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(pattern(facts(t.as_py() or "")) for t in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return arrow_map(docs.select("text"), run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _scored(docs: DataFrame, posterior: dict[int, float], w: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, marks = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                f = facts(text)
                at, value = _hashed(text, _shape(f))
                out.append(float(1 / (1 + np.exp(-np.clip(value @ w[at], -30, 30)))) if f["n_words"] else 0.0)
                marks.append(pattern(f))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([posterior.get(m) for m in marks], pa.float64()), pa.array(marks, pa.int32())], ["doc_id", "score", "posterior", "pattern"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, posterior double, pattern int")


def _features(docs: DataFrame) -> DataFrame:
    """What the scorer learns from: hashed features and votes, not the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, values, marks = [], [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                f = facts(text)
                at, value = _hashed(text, _shape(f))
                ats.append(at.astype(np.int32))
                values.append(value)
                marks.append(pattern(f))
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(marks, pa.int32())], ["at", "value", "pattern"])

    return arrow_map(docs.select("text"), run, "at array<int>, value array<double>, pattern int")


def learn(docs: DataFrame, train_rows: int = 4_000) -> tuple[dict[int, float], np.ndarray]:
    """The posterior of each pattern of votes, and the scorer's weights."""
    counts = sorted((r["pattern"], r["n"]) for r in _patterns(docs).collect())  # at most 3^8 rows
    code, number = np.array([c for c, _ in counts], dtype=np.int64), np.array([n for _, n in counts], dtype=np.float64)
    *_, post = estimate(code[:, None] // 3 ** np.arange(len(VOTES)) % 3, number)
    posterior = {int(c): float(p) for c, p in zip(code, post, strict=True)}
    drawn = _features(sampled(docs.select("doc_id", "text"), train_rows, "doc_id", "text")).orderBy("at", "value").toPandas()  # at most train_rows rows of bounded size
    return posterior, train([(np.asarray(a), np.asarray(v), posterior[m]) for a, v, m in zip(drawn["at"], drawn["value"], drawn["pattern"], strict=True)])


def quality(docs: DataFrame, train_rows: int = 4_000) -> DataFrame:
    """Per document doc_id, score (chance of good), predicted (score >= 0.5), posterior of its votes, pattern (the votes as digits)."""
    return _scored(docs, *learn(docs, train_rows)).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior", "pattern")
