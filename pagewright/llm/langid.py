"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (letters in lower case, all else a space) are hashed into a fixed number of features. Term
frequency is the share of a text's n-grams; document frequencies are counted over every labelled document of the training
folds and no other. Weights are trained by follow-the-regularised-leader with elastic-net penalties, which leaves most of
them at zero, and a temperature fitted to rows kept from training calibrates the scores.

Weights come from at most ``train_rows`` labelled rows of the training folds, whatever the input's size. Nulls: a null text, and
one without a letter, is `und` with score 0; null languages and ids teach nothing, and a null id is not held out. Texts of any
length are read whole. Repeated rows each get a row. Extra columns are ignored; an empty table gives no rows, and without
labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, sampled

FEATURES = 1 << 15
SLICE = 1 << 10
PART = 1 << 17


def features(text: str) -> Iterator[np.ndarray]:
    """Hashed features of all 1-, 2- and 3-grams, in parts; nothing if there is no letter."""
    for s in range(0, max(len(text), 1), PART):
        piece = text[max(s - 2, 0) : s + PART].lower()
        code = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
        if piece.isascii():
            letter = (code >= 97) & (code <= 122)
        else:
            kinds, at = np.unique(code, return_inverse=True)
            letter = np.array([chr(c).isalpha() for c in kinds])[at]
        if not letter.any():
            continue
        c = np.where(letter, code, np.uint32(32))
        keep = np.append(True, (c[1:] != 32) | (c[:-1] != 32))  # one space between words
        c = np.concatenate([[np.uint32(32)], c[keep], [np.uint32(32)]]).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        for x in (c * np.uint32(0x165667B1), two, three):
            x = x ^ (x >> np.uint32(15))
            yield (x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents with any; counted where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen = np.zeros(FEATURES, dtype=bool)
                for f in features(text.as_py() or ""):
                    seen[f] = True
                n += bool(seen.any())
                df += seen
        at = np.arange(-1, FEATURES // SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([[n]] + df.reshape(-1, SLICE).tolist(), pa.list_(pa.int64()))], ["slice", "counts"])

    # 32 rows for each task, added up by slice
    parts = arrow_map(docs.select("text"), run, "slice int, counts array<long>").select("slice", F.posexplode("counts").alias("at", "n"))
    sums = parts.groupBy("slice", "at").agg(F.sum("n").alias("n")).groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("c")).collect()
    df, n = np.zeros(FEATURES, dtype=np.int64), 0
    for r in sums:
        values = [x["n"] for x in r["c"]]
        if r["slice"] < 0:
            n = values[0]
        else:
            df[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = values
    return df, n


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (features + 1 x classes; the last row is the bias) by follow-the-regularised-leader, row by row."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(6)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value, label = rows[k]
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(FEATURES + 1))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores that makes the kept rows' labels likeliest; found on a fixed grid."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(-3, 3, 61)):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        loss = (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), labels]).mean()
        best = min(best, (loss, t))
    return float(best[1])


def train(docs: DataFrame, folds: int, held: int, train_rows: int) -> dict:
    """Languages, weights with IDF folded in, bias and temperature."""
    known = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", folds) != held))
    drawn = sampled(known.select("doc_id", "text", "lang"), train_rows, "doc_id", "text", "lang")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share_of = [], []
            for text in batch.column(1):
                parts = list(features(text.as_py() or ""))
                f, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.uint32), np.zeros(0))
                at.append(f.astype(np.int32))
                share_of.append((c / max(c.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(share_of, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "share"])

    rows = arrow_map(drawn, sparse, "doc_id long, lang string, at array<int>, share array<float>").where("size(at) > 0").toPandas()  # at most train_rows sparse rows
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    langs = sorted(rows.lang.unique())
    if not langs:
        return {"langs": []}
    rows = rows.assign(first=[tuple(x[:50]) for x in rows["at"]]).sort_values(["doc_id", "lang", "first"], kind="stable")  # an order that repeated ids leave alone
    index = {x: k for k, x in enumerate(langs)}
    # the norm is that of an even spread of the text's n-grams, so that scores are linear in the n-grams
    data = [(np.append(f, FEATURES), np.append(SCALE * np.asarray(s) * idf[f], 1.0), index[x]) for f, s, x in zip(map(np.asarray, rows["at"]), rows["share"], rows["lang"], strict=True)]
    cut = max(1, len(data) * 4 // 5)
    w = ftrl(data[:cut], len(langs))
    kept = data[cut:] or data
    t = temperature(np.stack([v @ w[f] for f, v, _ in kept]), np.array([y for *_, y in kept]))
    return {"langs": langs, "weights": (SCALE * idf[:, None] * w[:FEATURES]).astype(np.float32), "bias": w[FEATURES], "temperature": t}


SCALE = 10.0


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model["langs"]
        for batch in batches:
            pred, score = [], []
            for text in batch.column(1):
                total, n = 0.0, 0
                for f in features(text.as_py() or "") if langs else ():
                    count = np.bincount(f, minlength=FEATURES) if len(f) > 2 * FEATURES else None
                    total = total + (model["weights"][f].sum(0, dtype=np.float64) if count is None else count @ model["weights"])
                    n += len(f)
                if not n:
                    pred.append("und")
                    score.append(0.0)
                    continue
                s = (total / n + model["bias"]) / model["temperature"]
                p = np.exp(s - s.max())
                p /= p.sum()
                pred.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, train_rows: int = 4_000) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score."""
    scored = predict(docs, train(docs, folds, held, train_rows))
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
