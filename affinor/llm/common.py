"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BATCH_BYTES = "4m"
# For rows of about a megabyte each (containers). Left alone, Parquet's writer looks at sizes every 100 rows, so that all containers of a task are
# one page, which is compressed, and read again, as a whole, in native memory.
WIDE_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in fast path, which is the same for them."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def unit_hash(*cols: str) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def few_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table whose counted rows are few; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores in front where a column has one already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def matching(docs: DataFrame, keys: DataFrame, by: list[Column], how: str) -> DataFrame:
    """Rows of `docs` with (left_semi) or without (left_anti) a row of `keys` that equals the expressions `by`, nulls included."""
    names = spare(docs, *(f"_key{i}" for i in range(len(by))))
    same = F.lit(True)
    for expression, name in zip(by, names):
        same &= expression.eqNullSafe(F.col(name))
    return docs.join(few_or_shuffled(keys.toDF(*names)), same, how)


def least_hashed(df: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """The `k` rows of every key with the smallest hash of `by`, all rows of a smaller key. Counts per band of the hash tell the band in
    which a key's k-th row lies; only rows up to that band are ranked, so a key that holds most rows is not sorted as a whole."""
    h = df.withColumn("_h", F.shiftrightunsigned(F.xxhash64(*by), 1)).withColumn("_band", F.shiftright("_h", 51))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_band"))  # at most 4,096 bands of a key
    edge = (h.groupBy(key, "_band").agg(F.count("*").alias("_n")).withColumn("_before", upto - F.col("_n")).filter(F.col("_before") < k)
            .groupBy(key).agg(F.max("_band").alias("_edge")))
    near = h.join(few_or_shuffled(edge), key).filter(F.col("_band") <= F.col("_edge"))
    return (near.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_h", *by))).filter(F.col("_r") <= k)
            .drop("_h", "_band", "_edge", "_r"))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with batches bounded by bytes, not by rows alone: long texts would fill a worker otherwise. The bound is a setting of the
    session, since Spark reads it when the plan runs. A worker waits idle for its next task, so what a task freed goes back to the system."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allocate_frugally()
        try:
            yield from run(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(tidy, schema)


def c_library(name: str) -> Callable[..., int]:
    """A function of the system's C library; one that does nothing where it has none of this name."""
    return getattr(ctypes.CDLL(None), name, lambda *_: 0)


def allocate_frugally() -> None:
    """Large arrays go back to the system as soon as they are freed, in the C library (its limits are its own option numbers) and in Arrow."""
    mallopt, trim_threshold, mmap_threshold = c_library("mallopt"), -1, -3
    mallopt(mmap_threshold, 1 << 20)
    mallopt(trim_threshold, 4 << 20)
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    c_library("malloc_trim")(0)


def by_bytes(b: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield b.slice(at, end - at)
        at = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in turn and the number of words of each."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(flat), 0)  # blanks at either end leave an empty string
    return flat.filter(some), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker, which Spark reuses for task after task: for caches of a bounded size whose content has no say in
    results."""
    kept = sys.modules.setdefault("_affinor_worker", ModuleType("_affinor_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
