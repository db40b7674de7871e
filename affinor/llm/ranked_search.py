"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

An index is a Parquet table with one row per block of documents (about 16 MB of text): the block's distinct terms, and for each term the
places of its documents in the block and how often it occurs there. It is built in one pass without a shuffle; a lost task builds its blocks again.

A search sends a group of queries (bounded in terms; further groups are further passes over the index) to all blocks. Document counts of the
terms are summed over blocks first, so weights hold for the whole table. In a block each query is evaluated on its own: its terms in
ascending order of document count add their exact parts to accumulators of the block's documents. Before a long list, the bounds of the terms
still to come (weight times the greatest part in the block) are compared with the k-th partial score; once they cannot reach it, no accumulator
is created any more. Accumulators that can still reach it are carried on and updated exactly, the others are given up. As no document lies in two
blocks, no accumulator is ever shuffled. A block returns at most k documents a query, and the k best over all blocks follow.

The k-th partial score is at least the k-th score of some blocks searched beforehand (one in 16, at most 64), which bounds what all other blocks
create and return. All arithmetic is on 64-bit integers, but for the logarithm.

Defined cases: a null text and a text without a term are in no list and not counted; rows without an id come before others of equal score;
repeated rows are documents of their own; rows of queries with equal item_id are one query with the terms of all; a query without a
term, or whose terms occur nowhere, has no result; further columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinor.llm.common import WIDE_ROWS, by_bytes, map_batches, words_of
from affinor.session import cut_lineage, scratch_path

TOP = 50
BLOCK_BYTES = 16_000_000  # text of a block
GROUP_TERMS = 500_000  # terms of the queries that one pass over the index answers
SEED_SHARE, SEED_BLOCKS = 16, 64
INDEX = ("part int, block int, n_docs long, n_terms long, doc_ids array<long>, lengths array<long>, terms array<string>, ends binary, docs binary, counts binary")
HITS = "query int, doc_id long, score long"

#: Bytes of a text as a term sees them: A-Z lower-cased, all other ASCII characters but digits and a-z blanks.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41:0x5B] += 0x20
for _lo, _hi in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    FOLDED[_lo:_hi] = 0x20


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in turn and the number of terms of each."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    folded = FOLDED[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return words_of(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))


class Block(NamedTuple):
    """One row of the index."""
    doc_ids: pa.Array
    lengths: np.ndarray
    terms: pa.Array
    ends: np.ndarray
    docs: np.ndarray
    counts: np.ndarray


def build(doc_ids: pa.Array, words: pa.Array, lengths: np.ndarray) -> Block:
    """Postings of documents that have a term each, by term and then by document."""
    coded = words.dictionary_encode()
    n, size = len(coded.dictionary), max(1, len(lengths))
    pair, counts = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, doc = np.divmod(pair, size)
    return Block(doc_ids, lengths, coded.dictionary, np.cumsum(np.bincount(term, minlength=n)), doc.astype(np.int32), counts.astype(np.int32))


def write_index(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """The index of all documents as a Parquet table."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, size, ids, words, lengths = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, size, ids, words, lengths
            b = build(pa.concat_arrays(ids), pa.concat_arrays(words), np.concatenate(lengths))
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(b.lengths)], pa.int64()), pa.array([int(b.lengths.sum())], pa.int64()),
                   pa.ListArray.from_arrays([0, len(b.doc_ids)], b.doc_ids), pa.ListArray.from_arrays([0, len(b.lengths)], pa.array(b.lengths)),
                   pa.ListArray.from_arrays([0, len(b.terms)], b.terms), *(pa.array([x.tobytes()], pa.binary()) for x in (b.ends, b.docs, b.counts))]
            number, size, ids, words, lengths = number + 1, 0, [], [], []
            return pa.record_batch(row, names=[f.split()[0] for f in INDEX.split(", ")])

        for b in batches:
            for some in by_bytes(b, 1, min(block_bytes, 4_000_000)):
                w, n = terms_of(some.column(1))
                ids.append(some.column(0).filter(pa.array(n > 0)))
                words.append(w)
                lengths.append(n[n > 0])
                size += some.column(1).nbytes
                if size >= block_bytes:
                    yield close()
        if sum(map(len, ids)):
            yield close()

    docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, index, INDEX).write.option("compression", "zstd").options(**WIDE_ROWS).parquet(path)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            ids, lengths, terms, ends, docs, counts = (c[i] for c in b.columns)
            yield Block(ids.values, lengths.values.to_numpy(), terms.values, np.frombuffer(ends.as_py(), np.int64), np.frombuffer(docs.as_py(), np.int32),
                        np.frombuffer(counts.as_py(), np.int32))


def kth_best(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class Accumulators:
    """Partial scores of a block's documents for one query at a time."""

    def __init__(self, n: int):
        self.score, self.seen = np.zeros(n, np.int64), np.zeros(n, bool)

    def top(self, lists: list[tuple[np.ndarray, np.ndarray, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, with exact scores of at least `least`. Lists are (documents, parts, greatest
        part), the rarest term first."""
        rest = np.cumsum([0, *(m for _, _, m in reversed(lists))])[::-1].tolist()  # what the lists from here on can add
        held, j = np.zeros(0, np.int64), 0
        new: list[np.ndarray] = []
        while j < len(lists):
            docs, parts, _ = lists[j]
            if len(docs) > k:
                held = np.concatenate([held, *new])
                new = []
                if rest[j] < max(least, kth_best(self.score[held], k)):
                    break
            new.append(docs[~self.seen[docs]])
            self.seen[docs] = True
            self.score[docs] += parts
            j += 1
        held = np.concatenate([held, *new])
        edge = max(least, kth_best(self.score[held], k))
        alive = held[self.score[held] + rest[j] >= edge]
        self.seen[held] = False
        self.seen[alive] = True
        for docs, parts, _ in lists[j:]:
            mine = self.seen[docs]
            self.score[docs[mine]] += parts[mine]
        scores = self.score[alive]
        edge = max(least, kth_best(scores, k), 1)
        best = scores >= edge
        out = alive[best], scores[best]
        self.seen[alive] = False
        self.score[held] = 0
        return out


def search_block(b: Block, queries: list[list[int]], terms: pa.Array, weights: np.ndarray, n: int, total: int, k: int, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, scores) of a block. `queries` lists the numbers of their terms, the rarest first."""
    place = pc.index_in(terms, value_set=b.terms).to_numpy(zero_copy_only=False)
    m = 50 + 50 * b.lengths * n // total
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for t in np.flatnonzero(~np.isnan(place) & (weights > 0)).tolist():
        i = int(place[t])
        a, z = (int(b.ends[i - 1]) if i else 0), int(b.ends[i])
        docs, tf = b.docs[a:z].astype(np.int64), b.counts[a:z].astype(np.int64)
        parts = weights[t] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
        lists[t] = docs, parts, int(parts.max())
    acc = Accumulators(len(b.lengths))
    for q, its in enumerate(queries):
        mine = [lists[t] for t in its if t in lists]
        if mine:
            yield q, *acc.top(mine, k, least[q])


def search_group(blocks: DataFrame, group: list, n: int, total: int, k: int) -> DataFrame:
    """Hits of one group of queries, numbered in the order given: at least the k best of each."""
    vocabulary = sorted({t for r in group for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(vocabulary, pa.string())
        for b in batches:
            for i in range(b.num_rows):
                place = pc.index_in(terms, value_set=b.column(0)[i].values).to_numpy(zero_copy_only=False)
                some = np.flatnonzero(~np.isnan(place))
                df = np.diff(np.frombuffer(b.column(1)[i].as_py(), np.int64), prepend=0)[place[some].astype(np.int64)]
                yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(df)], names=["term", "df"])

    counted = blocks.select("terms", "ends").transform(map_batches, document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for term, docs in counted.collect():  # at most one row for each term of the group
        df[term] = docs
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = [sorted((number[t] for t in r["terms"]), key=lambda t: (df[t], t)) for r in group]

    def hits(rows: DataFrame, least: list[int]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = pa.array(vocabulary, pa.string())
            for b in opened(batches):
                for q, docs, scores in search_block(b, queries, terms, weights, n, total, k, least):
                    yield pa.record_batch([pa.array(np.full(len(docs), q, np.int32)), b.doc_ids.take(pa.array(docs)), pa.array(scores)], names=["query", "doc_id", "score"])

        return rows.select("doc_ids", "lengths", "terms", "ends", "docs", "counts").transform(map_batches, search, HITS)

    least = [0] * len(queries)
    seeds = min(SEED_BLOCKS, blocks.count() // SEED_SHARE)
    if seeds:
        found = best(hits(blocks.filter((F.col("block") == 0) & (F.col("part") < seeds)), least), k)
        for q, score in found.filter(F.col("rank") == k).select("query", "score").collect():
            least[q] = score
    return hits(blocks, least)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query, ranked."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(blocks: DataFrame, items: DataFrame, k: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item. `blocks` is an index, `items` has item_id and text."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 1):
                words, counts = terms_of(some.column(1))
                yield pa.record_batch([some.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), words], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", "text").transform(map_batches, split, f"item_id {kind}, term string").distinct()
    queries = cut_lineage(terms.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")))  # one text's vocabulary each
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    groups = max(1, -(-size // group_terms))
    out = []
    for g in range(groups):
        group = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id").collect()  # about group_terms terms
        if not group or not n:
            continue
        names = items.sparkSession.createDataFrame([(q, r["item_id"]) for q, r in enumerate(group)], f"query int, item_id {kind}")
        found = best(search_group(blocks, group, n, total, k), k)
        out.append(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        if groups > 1:
            out[-1] = cut_lineage(out[-1])
    if not out:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def ranked_search(docs: DataFrame, items: DataFrame, path: str | None = None, k: int = TOP) -> DataFrame:
    """Write the index of the documents, by default in the shared folder, and search it for every item."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "term-index")
    write_index(docs, path)
    return search(spark.read.schema(INDEX).parquet(path), items, k)
