import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import SF, docs, rows, table

from affinor.llm import decontaminate as D
from affinor.llm.fm_index import SAMPLE, FMIndex, build, suffix_array
from affinor.llm.queries import op2_decontamination

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs_, items, window=13):
    wanted = {}
    for it in items:
        w = words(it["text"])
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i:i + window]), set()).add(it["item_id"])
    lengths = {len(x) for x in wanted}
    out = []
    for d in docs_:
        w, hit, found = words(d["text"]), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[tuple(w[i:i + n])]
        ids = sorted(str(f) for f in found if f is not None)
        out.append((d["doc_id"], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def shape(got):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=repr)


def test_whole_tables(spark):
    got, want = rows(op2_decontamination(spark, SF)), brute(table("documents"), table("benchmark"))
    assert shape(got) == want and any(w[5] for w in want)
    assert all(sum(s["to"] - s["from"] for s in r["removal_spans"]) == r["n_hit"] for r in got)


def small(spark, n=60):
    rnd = random.Random(2)
    vocabulary = ["a", "b", "B", "c1", "é", "中文", "d.", "e-f"]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    d = [(i, text(rnd.choice([0, 1, 5, 40])), None, None, None) for i in range(n)] + [(n, None, None, None, None), (None, text(20), None, None, None), (3, text(9), None, None, None)]
    items = [(i, text(rnd.choice([0, 2, 3, 4, 6]))) for i in range(30)] + [(30, None), (None, text(3)), (2, text(4)), (2, "a b"), (31, "not there at all"), (32, "a")]
    return docs(spark, d), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block,phrases", [(10 ** 6, 10 ** 6), (37, 10 ** 6), (50, 11)])
def test_blocks_of_documents_and_phrases_give_one_result(spark, block, phrases):
    d, b = small(spark)
    got = D.verdicts(D.search(D.build_index(d, block), b, 4, phrases))
    assert shape(rows(got)) == brute(rows(d.select("doc_id", "text")), rows(b), 4)


def test_awkward_rows(spark):
    b = spark.createDataFrame([(1, "ab CD"), (2, "word word word"), (3, "")], "item_id long, text string")
    d = docs(spark)
    assert shape(rows(D.decontaminate(d, b))) == brute(rows(d.select("doc_id", "text")), rows(b))
    assert rows(D.decontaminate(docs(spark, []), b)) == []
    assert {r["n_hit"] for r in rows(D.decontaminate(d, b.limit(0)))} == {0}


def test_containers_are_written_in_small_row_groups(spark, monkeypatch):
    """A task's containers are neither one page nor one row group, so neither is held whole when they are compressed or read."""
    monkeypatch.setitem(D.WIDE_ROWS, "parquet.block.size", 1 << 18)
    rng = random.Random(0)
    some = docs(spark, [{"doc_id": i, "text": " ".join(f"{rng.getrandbits(40):x}" for _ in range(5000))} for i in range(60)]).coalesce(1)
    index = D.build_index(some, block_words=5000)
    assert index.count() == 60
    groups = [f.row_group(i) for f in (pq.ParquetFile(p.removeprefix("file:")).metadata for p in index.inputFiles()) for i in range(f.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 1 << 21
    assert max(g.total_byte_size for g in groups) < 1 << 19


def test_drop_keeps_the_clean_rows(spark):
    d = docs(spark, [(1, "x y z", None, None, None), (1, "other", None, None, None), (None, "x y z", None, None, None), (2, None, None, None, None)], clash=False)
    b = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    left = D.drop_contaminated(d, D.decontaminate(d, b))
    assert sorted((r["doc_id"], r["text"] or "") for r in rows(left)) == [(1, "other"), (2, "")] and left.columns == d.columns


def test_spans_are_cut_from_the_text():
    assert D.without_spans("One, two! Three FOUR; five.", [(1, 3)]) == "One,  FOUR; five."
    assert D.without_spans("a b", []) == "a b" and D.merged(np.array([[5, 8], [0, 2], [2, 3], [7, 9]])).tolist() == [[0, 3], [5, 9]]


@pytest.mark.parametrize("seed,n,sigma,docs_", [(1, 0, 1, 1), (2, 200, 2, 4), (3, 500, 3, 1), (4, 400, 50, 30)])
def test_fm_index(seed, n, sigma, docs_):
    rng = np.random.default_rng(seed)
    cut = np.sort(rng.integers(0, n + 1, docs_ - 1))
    texts = [t.astype(np.int32) for t in np.split(rng.integers(1, sigma + 1, n), cut)]
    if docs_ > 3:
        texts[1] = texts[0]
    s = np.concatenate([np.append(t, 0) for t in texts])
    after = lambda i: (s[i:][:int(np.flatnonzero(s[i:] == 0)[0])].tolist(), i)
    key = lambda i: ([*after(i)[0], 0], i + len(after(i)[0]))
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=key)
    fm = FMIndex(build(texts, [b"w%d" % i for i in range(1, sigma + 1)], list(range(docs_)), [0] * docs_))
    for m in (1, 2, 5):
        patterns = rng.integers(1, sigma + 1, (40, m))
        which, lo, hi = fm.search(patterns)
        for k in range(40):
            want = [i for i in range(len(s) - m + 1) if (s[i:i + m] == patterns[k]).all()]
            at = np.flatnonzero(which == k)
            assert bool(want) == bool(len(at))
            if len(at):
                assert sorted(fm.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) == want
    assert SAMPLE > 1
