"""Cleaning pipeline over `documents`: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.

Toxic documents go; of equal texts the largest id stays; of near copies (five-word Jaccard of 0.8 or more, linked directly or
through others) the least id stays; passages of 200 bytes that stand elsewhere too are cut out; what is left is packed
into sequences of 1024 tokens. The result holds the token ids of each piece with its sequence and offset.

Every stage decides about rows, not ids: rows that share an id with different texts each stay or go by themselves, and of
rows repeated as a whole exactly one stays. A null id is below all others. A null text is an empty one: all empty texts are
copies of each other, and the one that stays is packed as the end token alone. A document that is nothing but repeated
passages stays with an empty text. All columns of the input, whatever their names, come through all stages but the last,
which gives those of `pack`; n_chars follows the text. Of equal texts the largest id stays, of near copies the least; rows
that are equal in that too are told apart by their place. Without labels nothing counts as toxic by learned words. An
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.common import Scratch, table
from pagewright.llm.exact_dedup import drop_copies
from pagewright.llm.jaccard_join import drop_near_copies
from pagewright.llm.packing import added_tokens, pack
from pagewright.llm.suffix_dedup import drop_repeats
from pagewright.llm.toxicity import drop_toxic, learn


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, 5, 0.8)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs, 200)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1024, 2, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("jaccard_join", remove_near_copies),
    ("suffix_dedup", remove_repeats),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # no stage but the second can be told in SQL; tests hold the run against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
