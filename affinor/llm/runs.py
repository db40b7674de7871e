"""Periodic runs of words by seed and extend on diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(12, 2 q) words that no neighbouring word extends with
the same period. On diagonal q (words q apart) it shows as a stretch of at least max(12 - q, q) equal pairs, so at least 6: every run holds two
equal 6-grams q apart. For longer periods the guaranteed stretch is longer, and so are the indexed grams:

- lags 1 to 11: 6-grams at every word; lags 12 to 23: 6-grams at every 6th word; lags 12 * 2^j to 24 * 2^j - 1: grams of 6 * 2^j words at every
  6 * 2^j-th word. Any stretch of the guaranteed length holds a whole gram that starts at such a word.

A gram is numbered from two grams of half its size that both occur more than once, so texts without long repeats leave the index early. Of each
seed word all later occurrences of its gram within the band's lags are enumerated. Whether a pair is new is told by a table of the
furthest word covered on each lag; a new one is extended both ways by comparing growing slices. Seeds whose whole span lies in a run found before
with a period of at most the gram's size are left out beforehand: there, only multiples of that period repeat. So a text of one word
repeated n times costs about n log n, not n squared.

All texts of a slice of a batch are handled at once as one sequence of numbers, in which words of different texts are different numbers: no gram
repeats across documents, no pair joins two of them, and the tasks need no shuffle. Memory is bounded by the slice (4 MB of text, or one longer text).

Defined cases: a null text has no words; a text without a run keeps all its words; rows without an id and repeated rows have a result each; an
empty table gives no rows; further columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import by_bytes, map_batches, words_of

LEAST = 12  # words of a run
GRAM = LEAST // 2
BLOCK = 1 << 14  # seeds looked up at once
RESULT = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, n_kept long, "
          "collapsed_sha256 string")
SPANS = "doc_id long, start long, length long, period long"
WORD = r"[^\x20\x09-\x0D]+"


def numbered(parts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal values, from 0."""
    return np.unique(parts, return_inverse=True)[1]


def joined(gram: np.ndarray, at: np.ndarray, other: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words `at` whose gram and whose other gram `shift` words on both repeat, those whose joint gram occurs more than once, and
    its numbers by word (-1: none)."""
    out = np.full(len(gram), -1, np.int64)
    at = at[at + shift < len(gram)]
    at = at[(gram[at] >= 0) & (other[at + shift] >= 0)]
    if len(at):
        number = numbered(gram[at] * (int(other.max()) + 1) + other[at + shift])
        again = np.bincount(number)[number] > 1
        at = at[again]
        out[at] = number[again]
    return out, at


def same_ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from j on equal those from i on (i < j)."""
    n, step, size = 0, 16, len(x) - j
    while n < size:
        step = min(step, size - n)
        differ = np.flatnonzero(x[i + n:i + n + step] != x[j + n:j + n + step])
        if len(differ):
            return n + int(differ[0])
        n, step = n + step, step * 4
    return n


def same_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before j equal those before i."""
    n, step = 0, 16
    while n < i:
        step = min(step, i - n)
        differ = np.flatnonzero(x[i - n - step:i - n] != x[j - n - step:j - n])
        if len(differ):
            return n + step - 1 - int(differ[-1])
        n, step = n + step, step * 4
    return n


def prime_divisors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def has_smaller_period(x: np.ndarray, start: int, q: int) -> bool:
    """Whether two or more repeats of the q words from start on are themselves repeats of fewer; such a period divides q."""
    return any(np.array_equal(x[start:start + q - q // p], x[start + q // p:start + q]) for p in prime_divisors(q))


def find_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of a sequence of numbers."""
    n = len(x)
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}
    at = np.arange(n)
    one = np.where(np.bincount(x, minlength=1)[x] > 1, x, -1) if n else x
    two, at = joined(one, at, one, 1)
    three, at = joined(two, at, one, 2)
    gram, at = joined(three, at, three, 3)
    size, lo, hi, step = GRAM, 1, LEAST, 1
    while len(at):
        reach = np.zeros(n + 1, np.int64)  # furthest end of a run of a small period that begins here or before
        for s, e, q in found:
            if q <= size:
                reach[s] = max(reach[s], e)
        reach = np.maximum.accumulate(reach)
        order = np.argsort(gram[at], kind="stable")
        key = gram[at][order] * (n + 1) + at[order]  # by gram, then by word
        seeds = at[at % step == 0]
        for k in range(0, len(seeds), BLOCK):
            some = seeds[k:k + BLOCK]
            least = np.maximum(lo, reach[some] - size - some + 1)
            base = gram[some] * (n + 1)
            a = np.searchsorted(key, base + np.minimum(some + least, n))
            z = np.searchsorted(key, base + np.minimum(some + hi, n))
            many = np.maximum(z - a, 0)
            left = np.repeat(some, many)
            right = key[np.repeat(a - np.cumsum(many) + many, many) + np.arange(int(many.sum()))] % (n + 1)
            for i, j in zip(left.tolist(), right.tolist()):
                q = j - i
                if i < covered.get(q, 0):
                    continue
                ahead, behind = same_ahead(x, i, j), same_behind(x, i, j)
                covered[q] = i + ahead
                if ahead + behind >= max(LEAST - q, q) and not has_smaller_period(x, i - behind, q):
                    found.append((i - behind, j + ahead, q))
        if lo == 1:
            lo, hi, step = LEAST, 2 * LEAST, size  # the same grams, at every 6th word
        else:
            gram, at = joined(gram, at, gram, size)
            size, lo, hi = 2 * size, 2 * lo, 2 * hi
            step = size
    return found


def runs_by_text(words: pa.Array, counts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every text that has one, by start and period."""
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    x = numbered(np.repeat(np.arange(len(counts)), counts) * (int(codes.max(initial=0)) + 1) + codes)
    out = defaultdict(list)
    for s, e, q in find_runs(x):
        text = int(np.searchsorted(first, s, "right")) - 1
        out[text].append((s - int(first[text]), e - s, q))
    return {text: sorted(runs, key=lambda r: (r[0], r[2])) for text, runs in out.items()}


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, dict[int, list[tuple[int, int, int]]], np.ndarray]]:
    """doc_id, words, number of words, runs and kept words of each slice."""
    for b in batches:
        for some in by_bytes(b, 1):
            words, counts = words_of(some.column(1))
            runs = runs_by_text(words, counts)
            keep = np.ones(len(words), bool)
            first = np.cumsum(counts) - counts
            for text, its in runs.items():
                keep[first[text]:first[text] + counts[text]] = kept_words(int(counts[text]), its)
            yield some.column(0), words, counts, runs, keep


def collapsed(words: pa.Array, counts: np.ndarray, keep: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The kept words of each text, joined by one space, and how many they are."""
    some = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(some))), words.filter(pa.array(keep)).cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())), some


def documents_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document: the number of runs, the longest one (ties: smallest start, then period), a digest of all runs and one of the
    text with every run collapsed to its first period."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for ids, words, counts, runs, keep in slices(batches):
            texts, n_kept = collapsed(words, counts, keep)
            best = [min(runs[t], key=lambda r: (-r[1], r[0], r[2])) if t in runs else (None, None, None) for t in range(len(ids))]
            lines = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs[t]).encode()).hexdigest() if t in runs else none for t in range(len(ids))]
            digests = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
            longs = [pa.array(c, pa.int64()) for c in ([b[0] for b in best], [b[1] for b in best], [b[2] for b in best], [1000 * b[1] // b[2] if b[2] else None for b in best])]
            yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array([len(runs.get(t, ())) for t in range(len(ids))], pa.int64()), *longs, pa.array(lines), pa.array(n_kept, pa.int64()), pa.array(digests)],
                                  names=[f.split()[0] for f in RESULT.split(", ")])

    return documents_of(docs).transform(map_batches, report, RESULT)


def run_spans(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, start, length, period in words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, runs, _ in slices(batches):
            flat = np.array([(t, *r) for t, its in runs.items() for r in its], np.int64).reshape(-1, 4)
            yield pa.record_batch([ids.take(pa.array(flat[:, 0])), *(pa.array(flat[:, k].copy()) for k in (1, 2, 3))], names=["doc_id", "start", "length", "period"])

    return documents_of(docs).transform(map_batches, rows, SPANS)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every run collapsed to its first period, words joined by one space."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, counts, _, keep in slices(batches):
            yield pa.record_batch([ids, collapsed(words, counts, keep)[0].cast(pa.string())], names=["doc_id", "text"])

    return documents_of(docs).transform(map_batches, rows, "doc_id long, text string")


def repeat_tails(docs: DataFrame) -> DataFrame:
    """The documents with a tail of words made periodic in those whose checksum of the id ends in 0, words joined by one space there: with n
    words, g the checksum without its last digit, words from a = g % n on repeat with period 1 + (n - a) div (3 + g % 8). Rows without an id, and
    texts without a word, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", h)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    tail = """transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p]))"""
    picked = (chosen.filter("h % 10 = 0").withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
              .withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
              .select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", F.expr(tail))).otherwise(F.col("text")).alias("text")))
    return picked.unionByName(chosen.filter("h % 10 <> 0 OR h IS NULL").select("doc_id", "text"))
