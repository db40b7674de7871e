"""Sharding through fixed virtual slots.

Every record hashes into one of a few thousand slots, for good. A small versioned map says which shard holds a slot. Bytes are
summed per slot, and a rebalance edits the map: it moves whole slots from full shards to empty ones and raises the version, so
readers of an older version still find their rows and only the moved slots are copied. Only the slot sums (as many rows as there
are slots, whatever the data) and the map reach the driver.

Law: `bytes`. Defined cases: a null text has size 1 and the checksum of no bytes; a record without an id is placed by its text;
an empty table gives an empty result; repeated rows share their slot and get positions of their own; further columns are ignored.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinor.session import cut_lineage

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long, rows long, first long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every document; the text itself goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(slot, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(recs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per slot, summed on the executors; `slots` rows at most reach the driver."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return size, rows


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 1, before any size is known: slots dealt in turn."""
    return np.arange(slots) % shards


def rebalance(shard_of: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """An edited map. While it narrows the gap between the fullest and the emptiest shard, move the one slot, or exchange the two
    slots, that come nearest to halving it. Slots that need not move stay; a larger `shards` fills the new ones the same way."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=size, minlength=shards).astype(np.int64)
    while True:
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        own, other = np.flatnonzero((shard_of == full) & (size > 0)), np.flatnonzero((shard_of == empty) & (size > 0))
        if gap < 2 or not len(own):
            return shard_of
        # what leaves the fullest shard when slot i goes there and slot j (or none, the last column) comes back
        shift = size[own][:, None] - np.append(size[other], 0)[None, :]
        off = np.where((shift > 0) & (shift < gap), np.abs(2 * shift - gap), np.iinfo(np.int64).max)
        i, j = np.unravel_index(int(off.argmin()), off.shape)
        if not 0 < shift[i, j] < gap:
            return shard_of
        shard_of[own[i]] = empty
        if j < len(other):
            shard_of[other[j]] = full
        load[full] -= shift[i, j]
        load[empty] += shift[i, j]


def map_rows(version: int, shard_of: np.ndarray, size: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """The map with, per slot, the position of its first row in its shard."""
    first = np.zeros(len(rows), np.int64)
    for s in np.unique(shard_of):
        own = np.flatnonzero(shard_of == s)
        first[own] = np.cumsum(rows[own]) - rows[own]
    return [(version, i, int(shard_of[i]), int(size[i]), int(rows[i]), int(first[i])) for i in range(len(rows))]


def write_map(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Add a version to the map's table; earlier ones stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the newest by default."""
    kept = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = kept.agg(F.max("version")).first()[0] if version is None else version
    return kept.filter(F.col("version") == version)


def place(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless position of every record. Rows are ordered within their virtual slot only, a few thousandths of the data;
    the map, of fixed size, is broadcast."""
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (recs.withColumn("_at", F.row_number().over(w) - 1)
            .join(F.broadcast(slot_map.select("version", "virtual_slot", "shard", "first")), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("_at")).alias("slot"), "virtual_slot",
                    F.col("version").alias("map_version")))


def shard_documents(docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """Deal documents into shards of near equal bytes: version 1 of the map is the even deal, version 2 the edit after the sums."""
    spark = docs.sparkSession
    recs = cut_lineage(records(docs, slots))
    size, rows = slot_sums(recs, slots)
    v1 = first_map(shards, slots)
    write_map(spark, map_path, map_rows(1, v1, size, rows))
    write_map(spark, map_path, map_rows(2, rebalance(v1, size, shards), size, rows))
    return place(recs, read_map(spark, map_path))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """The documents themselves, one folder per shard and as many tasks as the shuffle has partitions."""
    slot = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    (docs.withColumn("_slot", F.pmod(slot, F.lit(slots)).cast("int"))
     .join(F.broadcast(slot_map.select(F.col("virtual_slot").alias("_slot"), F.col("shard").alias("_shard"))), "_slot")
     .repartition("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path))
