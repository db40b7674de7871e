"""Packing of tokenised documents into sequences of a fixed capacity by bounded-space online best fit.

Documents are encoded once; a document longer than the capacity is cut into full pieces and a shorter last one. The pieces, with their
ids, are written to the shared folder. Then only narrow rows (length and place of a piece) are dealt over packing tasks by a hash of the
row, as many tasks as the counted tokens ask for, so every task sees the same mix of lengths and none depends on a key of the data. A
task keeps at most `open_bins` bins open, in stacks by free space with one bit per free space in a bitset: the tightest bin that fits is
the lowest set bit at or above the length. A piece that fits nowhere opens a bin; if that is one too many, the fullest open bin closes.

Pieces arrive in batches of half the open capacity, long ones first within a batch: then short pieces find the gaps that long ones left
while their bins are still open, and few bins close with free space. A task holds one batch and its open bins, whatever the input.

Defined cases: a null text is empty and has the end id alone; rows without an id and repeated rows are documents of their own; an empty
table gives no pieces; further columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import by_bytes, map_batches, per_worker
from affinor.llm.token_index import END_ID, Encoder
from affinor.session import scratch_path

CAPACITY = 4096
OPEN_BINS = 1024
TASK_TOKENS = 1 << 24  # tokens of a packing task; each leaves a few bins that are not full
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, id_bytes int, ids binary"
PLACED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """A fixed number of open bins of one capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
        self.bits = 0  # bit f: some open bin has f free

    def _take(self, free: int) -> int:
        stack = self.free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            if not self.free[left]:
                self.bits |= 1 << left
            self.free[left].append(bin_)
            self.open += 1
        return bin_, self.capacity - free


def write_pieces(docs: DataFrame, path: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> None:
    """Encode all documents and write their pieces. `row` numbers documents; `ids` holds `id_bytes` little-endian bytes an id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 36
        enc = per_worker(f"encoder {tokenizer} {end_id}", lambda: Encoder(tokenizer, end_id))
        width = 2 if max(len(enc.ends), end_id + 1) <= 1 << 16 else 4
        for b in batches:
            for some in by_bytes(b, 1):
                tokens, n = enc.encode(some.column(1))
                cuts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                ends = np.cumsum(length)
                raw = memoryview(tokens.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[a:z]) for a, z in zip((4 * (ends - length)).tolist(), (4 * ends).tolist())]
                stored = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends * width).astype(np.int32)), pa.py_buffer(tokens.astype(f"<u{width}"))])
                yield pa.record_batch([pa.array(row + doc), some.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                                       pa.array(crc, pa.int64()), pa.array(np.full(len(doc), width, np.int32)), stored],
                                      names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "id_bytes", "ids"])
                row += len(n)

    docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, encode, PIECES).write.option("compression", "zstd").parquet(path)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Sequence and offset of every piece. Any numbers tell sequences apart: the task's in the upper bits, the bin's in the lower."""
    narrow = [f.split()[0] for f in PLACED.split(", ")][:-2]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def settle() -> pa.RecordBatch:
            nonlocal held, tokens
            t = pa.Table.from_batches(held).combine_chunks()
            length = t.column("length").to_numpy()
            t = t.take(pa.array(np.argsort(-length, kind="stable")))
            got = np.array([bins.place(n) for n in t.column("length").to_pylist()], np.int64).reshape(-1, 2)
            held, tokens = [], 0
            return pa.record_batch([c.combine_chunks() for c in t.columns] + [pa.array(base + got[:, 0]), pa.array(got[:, 1].copy())], names=[*narrow, "sequence_id", "offset"])

        for b in batches:
            ends = np.cumsum(b.column(4).to_numpy())
            at = 0
            while at < b.num_rows:
                done = ends[at - 1] if at else 0
                stop = min(b.num_rows, int(np.searchsorted(ends, done + capacity * open_bins // 2 - tokens)) + 1)
                held.append(b.slice(at, stop - at))
                tokens += int(ends[stop - 1] - done)
                at = stop
                if 2 * tokens >= capacity * open_bins:
                    yield settle()
        if held:
            yield settle()

    total = pieces.agg(F.sum("length")).first()[0] or 0
    by = F.xxhash64("row", "piece")
    dealt = pieces.select(*narrow).repartition(max(1, -(-total // task_tokens)), by).sortWithinPartitions(by, "row", "piece")
    return dealt.transform(map_batches, pack, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Write the pieces, by default in the shared folder, and place every one of them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "pieces")
    write_pieces(docs, path, tokenizer, capacity)
    return place_pieces(spark.read.schema(PIECES).parquet(path), capacity, open_bins)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id, n_tokens, ids (bytes as in the pieces) and the spans (doc_id, start, length, offset)
    they are made of. A sequence holds at most its capacity, so no group is large."""
    parts = placed.select("row", "piece", "sequence_id", "offset").join(pieces.select("row", "doc_id", "piece", "start", "length", "ids"), ["row", "piece"])
    whole = parts.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("s"))
    return whole.select("sequence_id", "n_tokens", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                        F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("spans"))
