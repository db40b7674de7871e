import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import SF, docs, rows, table
from tokenizers import Tokenizer

from affinor.llm.mixing import mix, repeat
from affinor.llm.queries import op7_mixing, op9_token_index
from affinor.llm.token_index import Encoder, WaveletMatrix, pack, token_index

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_targets(sizes):
    """Share out by weight; give what is above a cap to the others until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        share = {s: left * w[s] / ws for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(got, data):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in data:
        n = words(d["text"])
        sizes[d["source"]] += n
        largest[d["source"]] = max(largest[d["source"]], n)
    want = brute_targets(dict(sizes))
    assert len(got) == len(data)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert abs(r["copies"] - r["rate"]) < 1 or r["size"] == 0
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest[s] / 2 + 1e-3), s
    return taken


def test_mix_whole_table_and_again(spark):
    got = rows(op7_mixing(spark, SF))
    check_mix(got, table("documents"))
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(rows(op7_mixing(spark, SF)), key=key)


def test_rates_are_tilted_by_one_multiplier_per_source(spark):
    by = defaultdict(list)
    for r in rows(op7_mixing(spark, SF)):
        if r["size"] and 0 < r["rate"] < 3:
            by[r["source"]].append(np.log(r["rate"]) / r["size"])
    assert by and all(np.ptp(v) < 1e-9 for v in by.values())


def test_mix_caps_hot_source_and_ties(spark):
    rnd = random.Random(1)
    data = [(i, "w " * rnd.choice([1, 5, 50]), None, rnd.choice(["hot"] * 6 + ["a", "b", "c", None]), None) for i in range(900)]
    data += [(1000, "w", None, "tiny", None), (1001, "w w", None, "zero", None), (1002, "", None, "empty", None)]
    check_mix(rows(mix(docs(spark, data))), [{"text": d[1], "source": d[3]} for d in data])


def test_mix_awkward_rows(spark):
    d = docs(spark)
    check_mix(rows(mix(d)), [r.asDict() for r in d.select("text", "source").collect()])
    assert rows(mix(docs(spark, []))) == []
    assert {r["taken"] for r in rows(mix(docs(spark, [(1, None, None, None, None), (2, " \t", None, "a", None)])))} == {0}


def test_repeat_gives_the_copies(spark):
    d = docs(spark, clash=False)
    m = mix(d)
    assert repeat(d, m).count() == sum(r["copies"] for r in rows(m)) and repeat(d, m).columns == d.columns


def brute_tokens(data):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for d in sorted(data, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] is not None, d["text"] or "")):
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        out.append((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def by_start(got):
    return sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)


def test_tokens_whole_table(spark):
    want = [(s, d, n, c) for d, s, n, c in brute_tokens(table("documents"))]
    assert by_start(rows(op9_token_index(spark, SF))) == sorted(want)


def test_tokens_awkward_rows(spark):
    data = [(1, None), (2, ""), (3, " \n\t "), (4, "don't  We'll x y ́é e ́"), (5, "<|endoftext|> a<|startoftext|>b"), (6, "ΣσΣ İ ẞ"),
            (7, "a\x1cb\x85c\r\nd\x0be"), (8, "word " * 9000), (None, "no id"), (9, "twice"), (9, "twice"), (10, "\U0001f600\U0001f600 ﻿12 3-4")]
    d = docs(spark, [(*x, None, None, None) for x in data])
    want = brute_tokens([{"doc_id": a, "text": b} for a, b in data])
    got = by_start(rows(token_index(d, PATH)))
    assert [(s, n, c) for s, _, n, c in got] == [(s, n, c) for _, s, n, c in want]
    assert rows(token_index(docs(spark, []), PATH)) == []


def test_pieces_encode_as_the_whole_text():
    rnd, tok = random.Random(11), Tokenizer.from_file(PATH)
    chars = "aB 'stllve\n\t\r12.-ééß中  \x1fΣ<|>"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    ids, n = Encoder(PATH).encode(pa.array(texts))
    at = np.cumsum(n) - n
    assert all(ids[a:a + k].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1] for t, a, k in zip(texts, at, n))


@pytest.mark.parametrize("n,sigma", [(0, 1), (1, 1), (17, 1), (1000, 7), (1_200_000, 300)])
def test_wavelet_matrix(n, sigma):
    rng = np.random.default_rng(n)
    seq = (rng.zipf(1.5, n) % sigma * 97 + 5).astype(np.uint32)
    wm = WaveletMatrix(pack(seq, [4, None], np.array([n, 0])))
    assert np.array_equal(wm.tokens(), seq) and wm.doc_ids == [4, None] and wm.lengths.tolist() == [n, 0]
    for i in rng.integers(0, max(n, 1), 20) if n else []:
        assert wm.access(int(i)) == seq[i]
    for t in [*np.unique(seq)[:5].tolist(), 3]:
        where = np.flatnonzero(seq == t)
        assert wm.count(t) == len(where) and wm.count(t, n // 3, n // 2) == np.count_nonzero(seq[n // 3:n // 2] == t)
        for k in {0, len(where) // 2, len(where) - 1} if len(where) else ():
            assert wm.select(t, k) == where[k]
        if len(where) < 2000:
            assert wm.occurrences(t) == where.tolist()
