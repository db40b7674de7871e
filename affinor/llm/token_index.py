"""Token shards as wavelet matrices.

Documents are dealt into contiguous ranges of doc_id, encoded, and written as blocks: one row of a Parquet table per block, whose
container holds the block's whole token sequence as a wavelet matrix. Token ids are ranked by frequency within the block and the
matrix has one bit-plane per bit of the rank. Planes are cut into chunks of 64 KiB, each compressed on its own, with the number
of ones before every chunk; so access, rank, select, counting and lookup of occurrences decompress only the chunks they touch.

Defined cases: a null text is empty and has the end id alone; rows without an id come first; repeated rows are all written, in text
order; an empty table gives an empty index; a block is closed at `block_tokens`, a longer document has a block of its own.
"""
from __future__ import annotations

import struct
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinor.llm.common import WIDE_ROWS, by_bytes, map_batches, per_worker
from affinor.session import cut_lineage, scratch_path

END_ID = 1
BLOCK_TOKENS = 4_000_000
CHUNK = 1 << 16  # bytes of a plane
CACHE = 300_000  # pieces whose ids a task remembers
MAGIC = b"WMX1"
BLOCK_SCHEMA = "part int, block int, n_docs long, n_tokens long, container binary"


class Pieces(dict):
    """Numbers of pieces; a piece seen for the first time gets the next one and is kept in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


BLANK, LETTER, MARK, DIGIT, WHOLE = range(5)


def byte_classes() -> np.ndarray:
    """What a byte of UTF-8 is to the pre-tokenizer. Letters are those of ASCII and Latin-1 (lead 0xC3). A byte of class WHOLE (control
    characters, the apostrophe of contractions, the bar of added tokens, the signs for times and division, other scripts) leaves its
    whole word to the tokenizer."""
    c = np.full(256, WHOLE, np.uint8)
    c[[0x20, 0x0A]] = BLANK
    c[0x21:0x7F] = MARK
    c[0x30:0x3A] = DIGIT
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0xC0), (0xC3, 0xC4)):
        c[lo:hi] = LETTER
    c[[0x27, 0x7C, 0x97, 0xB7]] = WHOLE
    return c


CLASS = byte_classes()
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 0x20
SMALL[0x80:0x9F] += 0x20  # the second byte of a Latin-1 capital
LETTERS = bytes(np.flatnonzero(CLASS == LETTER).tolist())


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges in turn."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Encoder:
    """The library's tokenizer over whole texts, a piece at a time. The vocabulary's pre-tokenizer never joins across a space or a
    line feed, and within a word of Latin-1 letters, digits and ASCII marks it cuts at each change between these kinds and at every digit. So a
    text's ids are the ids of its pieces in turn; each distinct piece is encoded once and remembered. Cuts are found on the bytes of all texts
    at once, and only distinct pieces become Python objects.

    A piece of letters, lower-cased, is one pre-token in normal form already: it goes to the library's model with only a split at spaces in
    front of it. All other pieces go to the whole tokenizer, with the case they have in the text."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit
        self.tokenizer, self.words, self.end_id = Tokenizer.from_file(path), Tokenizer.from_file(path), end_id
        self.words.normalizer, self.words.pre_tokenizer = None, WhitespaceSplit()
        vocabulary = self.words.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {i: split.pre_tokenize_str(chr(i))[0][0][-1] for i in range(0x80, 0xC0)} | {0xC3: split.pre_tokenize_str("\xc0")[0][0][0]}
        self.byte = "".join(shown.get(i, chr(i)) for i in range(256))
        self._forget()

    def _forget(self) -> None:
        self.codes = Pieces()
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of the new pieces, kept in the order of their numbers."""
        new, self.codes.new = self.codes.new, []
        plain = np.fromiter((not p.translate(None, LETTERS) for p in new), bool, len(new))
        lengths = np.zeros(len(new), np.int64)
        at = np.flatnonzero(plain)
        runs, counts = [], []
        for i in range(0, len(at), 1000):
            some = b" ".join([new[k] for k in at[i:i + 1000].tolist()])
            ids = np.array(self.words.encode_batch_fast([charmap_decode(some, "strict", self.byte)[0]], add_special_tokens=False)[0].ids, np.uint32)
            runs.append(ids)
            counts.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if runs:
            lengths[at] = np.concatenate(counts)
        rest = np.flatnonzero(~plain)
        whole = []
        for i in range(0, len(rest), 1000):
            some = [new[k].decode() for k in rest[i:i + 1000].tolist()]
            whole += [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        lengths[rest] = np.fromiter(map(len, whole), np.int64, len(whole))
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]), np.uint32)
        for pick, ids in ((at, np.concatenate(runs) if runs else []), (rest, np.fromiter(chain.from_iterable(whole), np.uint32))):
            out[spans(ends[pick] - lengths[pick], ends[pick])] = ids
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, out])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, each with the end id, and the number of ids per text."""
        if len(self.codes) > CACHE:
            self._forget()
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds -= bounds[0]
        if not len(raw):
            return np.full(len(texts), self.end_id, np.uint32), np.ones(len(texts), np.int64)
        kind, small = CLASS[raw], SMALL[raw]
        cut = np.empty(len(raw), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == DIGIT
        first = bounds[:-1][bounds[:-1] < len(raw)]
        cut[first] = True
        odd = np.flatnonzero(kind == WHOLE)
        if len(odd):  # words left to the tokenizer: no cut inside, their own case
            edge = kind == BLANK
            begin = ~edge
            begin[1:] &= edge[:-1]
            begin[first] = ~edge[first]
            word = np.flatnonzero(begin)
            stop = np.append(word[1:], len(raw))
            mine = np.searchsorted(word, odd, "right") - 1
            mine = mine[np.diff(mine, prepend=-1) > 0]
            body = spans(word[mine], stop[mine])
            body = body[~edge[body]]
            small[body] = raw[body]
            cut[body] = False
            cut[word[mine]] = True
        at = np.flatnonzero(cut)
        ends = np.append(at, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(small)]).dictionary_encode()
        full = kind[at] != BLANK
        distinct = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))  # runs of blanks have no ids and are left out below
        if self.codes.new:
            self._learn()
        seq = known[coded.indices.to_numpy(zero_copy_only=False)[full]]
        per_text = np.diff(np.searchsorted(at[full], bounds))
        n = self.lengths[seq]
        ends = np.cumsum(n)
        place = np.repeat((self.starts[seq] - ends + n).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        total = np.concatenate([[0], ends])[np.cumsum(per_text)]  # ids up to the end of each text
        return np.insert(self.ids[place], total, self.end_id), np.diff(total, prepend=0) + 1


def pack(tokens: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The container of one block."""
    press = zstandard.ZstdCompressor(level=1)
    counts = np.bincount(tokens)
    values = np.flatnonzero(counts)
    alphabet = values[np.argsort(-counts[values], kind="stable")].astype(np.uint32)
    rank = np.zeros(len(counts) + 1, np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    seq = rank[tokens]
    if len(alphabet) <= 1 << 16:
        seq = seq.astype(np.uint16)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    head, body, at = [], [], 0
    for level in range(bits):
        bit = ((seq >> (bits - 1 - level)) & 1).astype(bool)
        raw = np.packbits(bit).tobytes()
        ones = 0
        for i in range(0, max(1, len(raw)), CHUNK):
            part = press.compress(raw[i:i + CHUNK])
            head.append(struct.pack("<QQ", at, ones))
            body.append(part)
            at += len(part)
            ones += int(np.count_nonzero(bit[i * 8:(i + CHUNK) * 8]))
        head.append(struct.pack("<QQ", at, ones))
        seq = np.concatenate([seq[~bit], seq[bit]])
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    some = np.array([d is not None for d in doc_ids], np.uint8)
    meta = press.compress(alphabet.tobytes() + ids.tobytes() + some.tobytes() + lengths.astype(np.int64).tobytes())
    return b"".join([MAGIC, struct.pack("<QQQQQ", len(tokens), len(doc_ids), len(alphabet), bits, len(meta)), meta, *head, *body])


class WaveletMatrix:
    """Reader of a container."""

    def __init__(self, data: bytes):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token container")
        self.n, n_docs, sigma, self.bits, n_meta = struct.unpack_from("<QQQQQ", data, 4)
        self._open = zstandard.ZstdDecompressor()
        meta = self._open.decompress(data[44:44 + n_meta])
        self.alphabet = np.frombuffer(meta, np.uint32, sigma)
        ids, some = np.frombuffer(meta, np.int64, n_docs, 4 * sigma), np.frombuffer(meta, np.uint8, n_docs, 4 * sigma + 8 * n_docs)
        self.doc_ids = [int(i) if s else None for i, s in zip(ids, some)]
        self.lengths = np.frombuffer(meta, np.int64, n_docs, 4 * sigma + 9 * n_docs)
        self.ranks = {int(v): i for i, v in enumerate(self.alphabet)}
        self.chunks = max(1, -(-((self.n + 7) // 8) // CHUNK))
        self.table = np.frombuffer(data, np.uint64, 2 * self.bits * (self.chunks + 1), 44 + n_meta).reshape(self.bits, self.chunks + 1, 2).astype(np.int64)
        self._data, self._base, self._seen = data, 44 + n_meta + 16 * self.bits * (self.chunks + 1), {}
        self.zeros = self.n - self.table[:, -1, 1]

    def _chunk(self, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a chunk and the ones before each of them."""
        if (level, i) not in self._seen:
            if len(self._seen) > 256:
                self._seen.clear()
            a, b = self.table[level, i, 0], self.table[level, i + 1, 0]
            bit = np.unpackbits(np.frombuffer(self._open.decompress(self._data[self._base + a:self._base + b]), np.uint8))
            self._seen[level, i] = bit, np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
        return self._seen[level, i]

    def _rank1(self, level: int, i: int) -> int:
        c = min(i // (CHUNK * 8), self.chunks - 1)
        return int(self.table[level, c, 1]) + int(self._chunk(level, c)[1][i - c * CHUNK * 8])

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        starts = np.arange(self.chunks + 1) * CHUNK * 8
        before = self.table[level, :, 1] if bit else np.minimum(starts, self.n) - self.table[level, :, 1]
        c = int(np.searchsorted(before[1:], k, side="right"))
        return int(starts[c]) + int(np.flatnonzero(self._chunk(level, c)[0] == bit)[k - before[c]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            c = i // (CHUNK * 8)
            bit = int(self._chunk(level, c)[0][i - c * CHUNK * 8])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        r = self.ranks.get(token)
        if r is None:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if r >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token occurs in [lo, hi)."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        lo, hi = self._span(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, r = lo + k, self.ranks[token]
        for level in reversed(range(self.bits)):
            bit = r >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the last plane upwards."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            raw = b"".join(self._open.decompress(self._data[self._base + self.table[level, i, 0]:self._base + self.table[level, i + 1, 0]]) for i in range(self.chunks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)
            z, low = int(self.zeros[level]), np.empty_like(out)
            low[~bit], low[bit] = out[:z], out[z:] | (1 << (self.bits - 1 - level))
            out = low
        return self.alphabet[out]


def write_index(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode documents in ascending doc_id order and write the blocks as a Parquet table. Only texts are shuffled, once, by range
    of doc_id; a lost task encodes its range again."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, enc, block = TaskContext.get().partitionId(), per_worker(f"encoder {tokenizer} {end_id}", lambda: Encoder(tokenizer, end_id)), 0
        ids, runs, lengths, held = [], [], [], 0

        def close():
            nonlocal ids, runs, lengths, held, block
            n = np.concatenate(lengths)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                                   pa.array([held], pa.int64()), pa.array([pack(np.concatenate(runs), ids, n)], pa.binary())],
                                  names=["part", "block", "n_docs", "n_tokens", "container"])
            ids, runs, lengths, held, block = [], [], [], 0, block + 1
            return row

        for b in batches:
            for some in by_bytes(b, 1):
                tokens, n = enc.encode(some.column(1))
                ids += some.column(0).to_pylist()
                runs.append(tokens.astype(np.uint16) if tokens.max(initial=0) < 1 << 16 else tokens)
                lengths.append(n)
                held += len(tokens)
                if held >= block_tokens:
                    yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.transform(map_batches, encode, BLOCK_SCHEMA).write.option("compression", "none").options(**WIDE_ROWS).parquet(path)


def read_index(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part and block of every document, from the containers. Offsets come from the blocks'
    counts, summed per part and then over parts; only narrow rows are joined."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, block, container in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                wm = WaveletMatrix(container.as_py())
                tokens = wm.tokens().astype("<u4")
                ends = np.cumsum(wm.lengths)
                starts = ends - wm.lengths
                crc = [zlib.crc32(tokens[a:z]) for a, z in zip(starts, ends)]
                k = len(crc)
                yield pa.record_batch([pa.array(wm.doc_ids, pa.int64()), pa.array(starts), pa.array(wm.lengths), pa.array(crc, pa.int64()),
                                       pa.array([part] * k, pa.int32()), pa.array([block] * k, pa.int32())],
                                      names=["doc_id", "at", "n_tokens", "ids_crc32", "part", "block"])

    rows = blocks.select("part", "block", "container").transform(map_batches, decode, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, block int")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per shuffle partition
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("block_at")).join(parts, "part")
               .select("part", "block", (F.col("part_at") + F.col("block_at")).alias("base")))
    return rows.join(offsets, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "block")


def token_index(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the index, by default in the shared folder, and return what the files say of every document."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-index")
    write_index(docs, path, tokenizer)
    return read_index(spark.read.schema(BLOCK_SCHEMA).parquet(path))
