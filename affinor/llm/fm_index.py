"""A word-level FM-index over the documents of one training shard.

The text of a shard is its documents' words, each document closed by a separator that compares by its position. The suffix array is
built by doubling over packed keys, and only suffixes that still tie are sorted again. What is kept is the Burrows-Wheeler
transform as a wavelet tree in levelwise (matrix) form, symbol counts, the dictionary, and every SAMPLE-th suffix position, document
starts included. Searches and walks run over whole vectors of patterns.
"""
from __future__ import annotations

import io

import numpy as np
import zstandard

SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of `s`, where 0 is a separator that ends a comparison: of two that reach one after equal words, the
    earlier comes first. `s` must end with a separator."""
    n = len(s)
    bits = max(1, int(s.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    key, stop, pad = np.zeros(n, np.int64), np.zeros(n, bool), np.concatenate([s, np.zeros(h, s.dtype)])
    for j in range(h):
        sym = np.where(stop, 0, pad[j:j + n])
        key = key << bits | sym
        stop |= sym == 0
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~(new & np.concatenate([new[1:], [True]])) if n else new
    done = np.flatnonzero(tied & stop[order])
    order[done] = order[done][np.lexsort((order[done], group[done]))]
    group[done] = done
    rank = np.empty(n, np.int64)
    rank[order] = group
    slots = np.flatnonzero(tied & ~stop[order])
    while len(slots):
        sub = order[slots]
        first, second = rank[sub], rank[sub + h]
        by = np.lexsort((second, first))
        sub, first, second = sub[by], first[by], second[by]
        order[slots] = sub
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[sub] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return order


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, the first bit lowest, with one word to spare."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros((len(bits) >> 6) + 1, "<u8")
    out.view(np.uint8)[:len(raw)] = raw
    return out


class Bits:
    """A bit vector with rank."""

    def __init__(self, words: np.ndarray):
        ones = np.bitwise_count(words).astype(np.int64)
        self.words, self.before = words, np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def build(docs: list[np.ndarray], words: list[bytes], doc_ids: list[int | None], keys: list[int]) -> bytes:
    """The container of a shard: `docs` hold word numbers from 1, `words` their spelling."""
    n_words = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(n_words + 1) - n_words - 1
    s = np.zeros(int(n_words.sum()) + len(docs), np.int32)
    for a, d in zip(starts, docs):
        s[a:a + len(d)] = d
    sa = suffix_array(s)
    seq = s[sa - 1]  # the last symbol is a separator, so position 0 follows one
    keep = (sa % SAMPLE == 0) | (seq == 0)
    levels = max(1, len(words).bit_length())
    planes, zeros = [], []
    for level in range(levels):
        bit = (seq >> (levels - 1 - level) & 1).astype(bool)
        planes.append(_packed(bit))
        zero = seq[~bit]
        zeros.append(len(zero))
        seq = np.concatenate([zero, seq[bit]])
    out = io.BytesIO()
    np.savez(out, planes=np.array(planes), zeros=np.array(zeros), counts=np.bincount(s, minlength=len(words) + 1).astype(np.int32),
             kept=_packed(keep), samples=sa[keep].astype(np.uint32), n_words=n_words, keys=np.array(keys, np.int64),
             ids=np.array([0 if i is None else i for i in doc_ids], np.int64), has_id=np.array([i is not None for i in doc_ids]),
             words=np.frombuffer(zstandard.ZstdCompressor(level=1).compress(b"\n".join(words)), np.uint8))
    return out.getvalue()


class FMIndex:
    def __init__(self, data: bytes):
        z = np.load(io.BytesIO(data))
        self.planes, self.zeros = [Bits(p) for p in z["planes"]], z["zeros"]
        counts = z["counts"].astype(np.int64)
        self.n, self.before = int(counts.sum()), np.cumsum(counts) - counts
        symbol, back = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        for level in range(len(self.planes)):  # after the last level symbols stand in the order of their reversed bits
            back |= (symbol >> (len(self.planes) - 1 - level) & 1) << level
        by = np.argsort(back)
        self.node = np.empty(len(counts), np.int64)
        self.node[by] = np.cumsum(counts[by]) - counts[by]
        self.kept, self.samples = Bits(z["kept"]), z["samples"].astype(np.int64)
        self.n_words, self.keys = z["n_words"], z["keys"]
        self.starts = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.doc_ids = [int(i) if some else None for i, some in zip(z["ids"], z["has_id"])]
        spelled = zstandard.ZstdDecompressor().decompress(z["words"].tobytes())
        self.numbers = {w: i for i, w in enumerate(spelled.split(b"\n"), 1)} if spelled else {}

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the suffixes before row i go that are preceded by the symbol: one step of the backward search."""
        for level, plane in enumerate(self.planes):
            ones = plane.rank(i)
            i = np.where(symbol >> (len(self.planes) - 1 - level) & 1 == 1, self.zeros[level] + ones, i - ones)
        return self.before[symbol] + i - self.node[symbol]

    def _step_back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that starts one word earlier."""
        symbol, i = np.zeros(len(row), np.int64), row
        for level, plane in enumerate(self.planes):
            ones, bit = plane.rank(i), plane.get(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return self.before[symbol] + i - self.node[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns of one length as word numbers: which of them occur, and their ranges of rows."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, j]
            lo, hi = self._follow(symbol, lo), self._follow(symbol, hi)
            on = lo < hi
            alive, lo, hi = alive[on], lo[on], hi[on]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back until a sampled one."""
        out, at, todo, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept.get(at)
            out[todo[hit]] = self.samples[self.kept.rank(at[hit])] + steps
            at, todo, steps = self._step_back(at[~hit]), todo[~hit], steps + 1
        return out
