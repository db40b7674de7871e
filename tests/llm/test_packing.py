"""Best-fit packing against a plain list of bins, and its sequences against the tokenizers library."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, docs, rows, table

from affinor.llm.packing import PIECES, OpenBins, pack_documents, place_pieces, sequences, write_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity, most):
    """(bin, offset) of each length with a list of [free, age, bin] that is searched whole."""
    open_, made, out = [], 0, []
    for age, n in enumerate(lengths):
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[1]))  # the tightest; of equals the one touched last
            open_.remove(b)
        else:
            b, made = [capacity, age, made], made + 1
        out.append((b[2], capacity - b[0]))
        if b[0] > n:
            if len(open_) == most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
            open_.append([b[0] - n, age, b[2]])
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_open_bins_against_a_plain_list(most):
    rng = random.Random(most)
    for capacity in (1, 5, 64):
        lengths = [rng.randint(1, capacity) for _ in range(500)]
        bins = OpenBins(capacity, most)
        assert [bins.place(n) for n in lengths] == plain_best_fit(lengths, capacity, most)
        assert bins.open <= most


def expected(texts, capacity):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    for doc_id, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k:k + capacity], "<u4")
            yield doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())


def check(placed, texts, capacity):
    got = rows(placed)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((str(d), *x) for d, *x in expected(texts, capacity))
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return got, seqs


@pytest.mark.parametrize("capacity", [4096, 100])
def test_whole_table(spark, capacity):
    d = table("documents")
    got, seqs = check(pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), PATH, capacity=capacity), [(x["doc_id"], x["text"]) for x in d], capacity)
    least = -(-sum(r["length"] for r in got) // capacity)
    assert least <= len(seqs) <= 1.005 * least + 1


def test_awkward_rows(spark):
    df = docs(spark)
    texts = [(r["doc_id"], r["text"]) for r in rows(df)]
    got, _ = check(pack_documents(df, PATH), texts, 4096)
    again = rows(pack_documents(df, PATH))
    key = lambda r: tuple((v is None, v) for v in r.values())
    assert sorted(got, key=key) == sorted(again, key=key)
    assert rows(pack_documents(df.limit(0), PATH)) == []
    same = spark.createDataFrame([(None, "one text of many copies")] * 300, "doc_id long, text string")
    check(pack_documents(same, PATH), [(None, "one text of many copies")] * 300, 4096)


def test_many_tasks_and_sequences(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    write_pieces(df, str(tmp_path / "p"), PATH, 512)
    pieces = spark.read.schema(PIECES).parquet(str(tmp_path / "p"))
    placed = place_pieces(pieces, 512, open_bins=64, task_tokens=200_000)
    _, seqs = check(placed, [(x["doc_id"], x["text"]) for x in table("documents")], 512)
    ids = {(r["doc_id"], r["start"]): (r["ids"], r["id_bytes"]) for r in rows(pieces)}
    built = rows(sequences(pieces, placed))
    assert len(built) == len(seqs)
    for r in built:
        assert r["n_tokens"] == sum(s["length"] for s in r["spans"]) and len(r["ids"]) == 2 * r["n_tokens"]
        for s in r["spans"]:
            body, width = ids[s["doc_id"], s["start"]]
            assert bytes(r["ids"][s["offset"] * width:(s["offset"] + s["length"]) * width]) == bytes(body)
