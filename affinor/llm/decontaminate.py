"""Benchmark decontamination with an FM-index per training shard.

Documents are indexed where they lie: every task turns blocks of its input into containers, one row of a Parquet table each, with no
shuffle. The index knows nothing of the benchmark and serves any number of them. A benchmark is searched in blocks of a bounded
number of words: the windows of a block are sent to all tasks, searched backwards in every container, located through the sampled
suffix positions, and merged into removal spans per document. Several blocks are merged once more per document.

Defined cases: a null text has no words; an item without text or words has no windows; the windows of an item without an id hit
words but name no item; repeated documents each have their row; repeated items count once; an empty benchmark hits nothing, an
empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.fm_index import FMIndex, build
from affinor.llm.common import WIDE_ROWS, map_batches, matching
from affinor.session import cut_lineage

WINDOW = 13
BLOCK_WORDS = 300_000  # words of documents per container
PHRASE_WORDS = 500_000  # words of benchmark items per search
SHARE = 20  # contaminated from one word in so many
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
INDEX_SCHEMA = "part int, block int, container binary"
HIT_SCHEMA = "part int, block int, ord int, doc_id long, text_key long, n_words long, spans array<struct<from:long,to:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs of letters, digits and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Containers of all documents; the table is written, so a search never builds twice."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        numbers, held, texts, ids, keys = {}, 0, [], [], []

        def close():
            nonlocal numbers, held, texts, ids, keys, block
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([build(texts, list(numbers), ids, keys)], pa.binary())],
                                  names=["part", "block", "container"])
            numbers, held, texts, ids, keys, block = {}, 0, [], [], [], block + 1
            return row

        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column(1)[i].as_py())
                for w in set(words).difference(numbers):
                    numbers[w] = len(numbers) + 1
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(b.column(0)[i].as_py())
                keys.append(b.column(2)[i].as_py())
                held += len(words)
                if held >= block_words:
                    yield close()
        if texts:
            yield close()

    return cut_lineage(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).transform(map_batches, index, INDEX_SCHEMA), **WIDE_ROWS)


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, phrase_words: int = PHRASE_WORDS) -> Iterator[dict[int, tuple[list, list]]]:
    """The stated query set in blocks: by length, the distinct windows and the ids of the items that hold each."""
    def grouped(found):
        by = defaultdict(lambda: ([], []))
        for w, items in found.items():
            by[len(w)][0].append(w)
            by[len(w)][1].append(sorted(items))
        return dict(by)

    found, held = defaultdict(set), 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL").toLocalIterator():
        words = words_of(r.text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i:i + window])] |= set() if r.item_id is None else {r.item_id}
        held += len(words)
        if held >= phrase_words:
            yield grouped(found)
            found, held = defaultdict(set), 0
    if found:
        yield grouped(found)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans (rows of from, to) of one document."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.column_stack([spans[head, 0], reach[np.concatenate([head[1:], [True]])]])


def search_container(data: bytes, phrases: dict[int, tuple[list, list]]) -> tuple[FMIndex, dict[int, np.ndarray], dict[int, set]]:
    """The index, and per document that is hit its spans and item ids."""
    fm = FMIndex(data)
    spans, items = defaultdict(list), defaultdict(set)
    for length, (windows, names) in phrases.items():
        numbers = np.array([[fm.numbers.get(w, 0) for w in p] for p in windows], np.int64).reshape(-1, length)
        known = np.flatnonzero((numbers > 0).all(axis=1))
        if not len(known):
            continue
        which, lo, hi = fm.search(numbers[known])
        n = hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at, window = fm.locate(rows), np.repeat(known[which], n)
        doc = np.searchsorted(fm.starts, at, side="right") - 1
        by = np.lexsort((at, doc))
        at, doc, window = at[by] - fm.starts[doc[by]], doc[by], window[by]
        for a, z in zip(*(lambda h: (h, np.append(h[1:], len(doc))))(np.flatnonzero(np.diff(doc, prepend=-1)))) if len(doc) else ():
            d = int(doc[a])
            spans[d].append(merged(np.column_stack([at[a:z], at[a:z] + length])))
            items[d].update(*(names[w] for w in np.unique(window[a:z])))
    return fm, {d: merged(np.concatenate(v)) for d, v in spans.items()}, items


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """One row per document with merged spans (in words) and the sorted ids of the items that occur in it."""
    def one_pass(phrases):
        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    fm, spans, items = search_container(data.as_py(), phrases)
                    k = len(fm.doc_ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * k, pa.int32()), pa.array([block] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(fm.doc_ids, pa.int64()),
                        pa.array(fm.keys, pa.int64()), pa.array(fm.n_words, pa.int64()),
                        pa.array([[{"from": a, "to": z} for a, z in spans.get(d, np.zeros((0, 2), int)).tolist()] for d in range(k)], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                        pa.array([sorted(items.get(d, ())) for d in range(k)], pa.list_(pa.string()))],
                        names=["part", "block", "ord", "doc_id", "text_key", "n_words", "spans", "items"])
        return index.transform(map_batches, hits, HIT_SCHEMA)

    blocks = phrase_blocks(benchmark, window, phrase_words)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        return one_pass(first)
    all_hits = cut_lineage(one_pass(first))
    for p in chain([second], blocks):  # one block of phrases at a time is held, here and in the tasks
        all_hits = all_hits.unionByName(cut_lineage(one_pass(p)))
    together = all_hits.groupBy("part", "block", "ord", "doc_id", "text_key", "n_words").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # sorted spans: start a new one, or let the last one reach further
    last = lambda acc: F.element_at(acc, -1)
    union = F.aggregate("spans", F.slice("spans", 1, 1), lambda acc, x: F.when(x["from"] > last(acc)["to"], F.concat(acc, F.array(x))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["from"].alias("from"), F.greatest(last(acc)["to"], x["to"]).alias("to"))))))
    return together.withColumn("spans", F.when(F.size("spans") > 0, union).otherwise(F.col("spans")))


def verdicts(hits: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, removal_spans, text_key."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return (hits.withColumn("n_hit", n_hit)
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                    ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), F.col("spans").alias("removal_spans"), "text_key"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Index the documents, search the benchmark, judge every document."""
    return verdicts(search(build_index(docs), benchmark, window), share)


def drop_contaminated(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Documents without the contaminated ones, columns unchanged. The verdict follows the text, so rows that share an id but not a
    text are told apart; only the keys of contaminated documents are joined."""
    bad = cut_lineage(judged.filter("contaminated").select("doc_id", "text_key").distinct())
    return matching(docs, bad, [F.col("doc_id"), F.xxhash64("text")], "left_anti")


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of its removal spans and what stands between them."""
    words, out, at = list(_WORD.finditer(text)), [], 0
    for a, z in spans:
        out.append(text[at:words[a].start()])
        at = words[z - 1].end()
    return "".join([*out, text[at:]])
