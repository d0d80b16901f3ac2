"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A document's bytes are cut into blocks of fixed size. Distinct blocks are sorted and get integer names, equal exactly if
the blocks are; then adjacent names are paired and the distinct pairs are sorted and named in turn, until each document
has one name; finished documents leave the recursion. No answer rests on a hash: blocks meet by hash, but those that share one are compared byte by byte, and
blocks of one hash that differ get different names.

Each level shuffles one row for each block (16 bytes, without the text) and halves the rows; texts are shuffled once.
Names are counted before rows meet (map-side), and a common block or pair only meets in joins that Spark can split.

Nulls: a null text is an empty one. Empty texts are equal to each other. Ties (equal texts) keep the largest document id.
Rows that repeat a document id each give a row and count as copies of their own; of rows repeated as a whole exactly one is
kept. A null id is below all others. Other columns are ignored by exact_dedup and come back from drop_copies, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, identified, without

BLOCK = 8192


NONE = -(1 << 62)  # stands for the missing partner of an odd last name


def identities(docs: DataFrame, scratch: Scratch, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """doc_id, row, text_sha256, level, name for each row: two rows have the same level and name exactly if their texts are equal.

    row: a column that is unique to each row and comes back as row; without it, one is made that fits this result only.
    """
    raw = docs.select("doc_id", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int")
    cut = raw.select(
        "doc_id",
        "row",
        F.sha2("bytes", 256).alias("text_sha256"),
        count.alias("n"),
        F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("bytes", i * block + 1, F.lit(block)))).alias("i", "block"),
    )
    hashed = cut.withColumns({"h": F.xxhash64("block"), "size": F.octet_length("block")})
    # sort by hash and compare the blocks that share one: the least and the greatest are the same if all are
    by_hash = scratch.save(
        hashed.groupBy("h", "size").agg(F.min("block").alias("least"), F.max("block").alias("most"))
        .select("h", "size", (F.col("least") == F.col("most")).alias("one")).sortWithinPartitions("h", "size")
        .withColumn("name", F.monotonically_increasing_id()), "hashes")
    met = hashed.join(by_hash, ["h", "size"])
    if not by_hash.where("not one").isEmpty():  # blocks of one hash that differ: named by their bytes, below all other names
        clash = by_hash.where("not one").select("h", "size")
        own = hashed.join(clash, ["h", "size"], "left_semi").groupBy("h", "size", "block").agg(F.count("*").alias("copies"))
        own = scratch.save(own.withColumn("fresh", -1 - F.monotonically_increasing_id()).drop("copies"), "clashes")
        met = met.join(own, ["h", "size", "block"], "left").withColumn("name", F.coalesce("fresh", "name"))
    first = F.when(F.col("i") == 0, F.col("text_sha256")).alias("text_sha256")
    rows = scratch.save(met.select("doc_id", "row", first, "n", "i", "name"), "level0")
    done, level = [], 0
    while True:
        done.append(rows.where("n = 1").select("doc_id", "row", "text_sha256", F.lit(level).alias("level"), "name"))
        longer = rows.where("n > 1")
        if longer.isEmpty():
            break
        pairs = longer.withColumn("j", F.shiftright("i", 1)).groupBy("row", "j").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("text_sha256").alias("text_sha256"),
            F.max(F.ceil(F.col("n") / 2)).cast("int").alias("n"),
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b"),
        )
        pairs = scratch.save(pairs, f"pairs{level}")
        names = pairs.groupBy("a", "b").agg(F.count("*").alias("copies")).sortWithinPartitions("a", "b")
        names = scratch.save(names.select("a", "b", F.monotonically_increasing_id().alias("name")), f"names{level}")
        level += 1
        rows = scratch.save(pairs.join(names, ["a", "b"]).select("doc_id", "row", "text_sha256", "n", F.col("j").alias("i"), "name"), f"level{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Returns per document doc_id, keep_id, group_size, kept, text_sha256; one row with the largest id of equal texts stays."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    named = scratch.save(identities(docs, scratch, block), "identities")
    groups = scratch.save(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, with exactly one for each distinct text: one of the rows with the largest id."""
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    held, row = identified(docs, scratch, "rows")
    named = scratch.save(identities(held, scratch, block, row), "identities")
    keep = scratch.save(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("copies")).where("copies > 1"), "keep")
    copies = scratch.save(named.join(keep, ["level", "name"]).where("row <> keep.row").select(F.col("row").alias(row)), "copies")
    return without(held, copies, row).drop(row)
