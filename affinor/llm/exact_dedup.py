"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only.

Every input partition is a run: its documents' digests, each with the identifier it retains and a count. In rounds, groups of
`fan` neighbouring runs merge into one: equal digests meet, the retained identifier is the best of theirs, counts add up. A hot
digest arrives at a merge as one row per run, never as its documents. After the last round one run spans all partitions, and the
answer goes back down the tree, so a hot digest is joined run by run and not in one task.

A digest counts as equal only if it is verified: the key is SHA-256 together with the length in bytes and a second, unrelated
hash of the text. Within a key the smallest rank is retained; the rank is the negated doc_id where the largest is to stay.

Defined cases: a null text is the empty text; rows without an id lose against rows with one and keep nothing of their own
(keep_id is null only if the whole group has none); of repeated rows with one id exactly one is kept; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import ascii_lower
from affinor.session import cut_lineage

FAN = 16
KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """One narrow row per document: digest, verification, run (its input partition) and a number that tells repeated rows apart."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    return norm.select("doc_id", F.unhex(F.sha2(F.col("t"), 256)).alias("digest"), F.octet_length("t").alias("n_bytes"),
                       F.xxhash64("t").alias("check"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))


def merge_round(runs: DataFrame, fan: int) -> DataFrame:
    """Merge each `fan` neighbouring runs: one row per key and new run, partial results first. Rows differ by (doc_id, row); the
    largest doc_id wins, null last, then the first row."""
    return (runs.withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy("run", *KEY)
            .agg(F.max("best").alias("best"), F.sum("n").alias("n")))


def exact_dedup(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and row for every document; of equal texts the largest doc_id stays."""
    rows = cut_lineage(digests(docs))
    best = F.struct(F.col("doc_id").alias("id"), (-F.col("row")).alias("neg_row"))
    leaf = rows.groupBy("run", *KEY).agg(F.max(best).alias("best"), F.count("*").alias("n"))
    top = rows.agg(F.max("run")).first()[0]
    levels, width = [leaf], 1 + (top or 0)
    while width > 1:
        levels.append(merge_round(levels[-1], fan))
        width = -(-width // fan)
    answer = levels[-1].select("run", *KEY, F.col("best").alias("winner"), F.col("n").alias("group_size"))
    for level in reversed(levels[:-1]):  # down again: a parent's answer reaches at most `fan` runs below it
        below = level.select(F.col("run").alias("child"), F.floor(F.col("run") / fan).cast("int").alias("run"), *KEY)
        answer = below.join(answer, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "winner", "group_size")
    return rows.join(answer, ["run", *KEY]).select(
        "doc_id", F.col("winner.id").alias("keep_id"), "group_size", (F.col("row") == -F.col("winner.neg_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
