"""Ranked search against scoring of every document for every item."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, docs, rows, table

from affinor.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(documents, items, k):
    """Every document for every item, in integers."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in documents]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total, df = len(bags), sum(s for _, _, s in bags), Counter(t for _, b, _ in bags for t in b)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in queries.items():
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if df[t]}
        scored = []
        for d, b, size in bags:
            m = 50 + 50 * size * n // total
            scored.append((-sum(w * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t, w in weights.items() if b[t]), d is not None, d or 0))
        out += [(i, r, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(scored)[:k], 1) if s < 0]
    return Counter(out)


def got(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df))


def indexed(spark, df, tmp_path, block_bytes=rs.BLOCK_BYTES):
    rs.write_index(df, str(tmp_path / "index"), block_bytes)
    return spark.read.schema(rs.INDEX).parquet(str(tmp_path / "index"))


def test_whole_tables_in_many_blocks_and_groups(spark, tmp_path):
    df, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    blocks = indexed(spark, df.repartition(20, "doc_id"), tmp_path, 20_000)
    assert blocks.count() > 2 * rs.SEED_SHARE  # some blocks are searched beforehand
    documents, asked = [(d["doc_id"], d["text"]) for d in table("documents")], [(b["item_id"], b["text"]) for b in table("benchmark")]
    for k, group_terms in ((50, rs.GROUP_TERMS), (3, 300), (5000, rs.GROUP_TERMS)):
        assert got(rs.search(blocks, items, k, group_terms)) == plain(documents, asked, k)


def test_stops_creating_accumulators():
    rng = np.random.default_rng(5)
    n = 3000
    for k in (1, 5, 50):
        lists = []
        for size in (3, 40, 200, 900, 2500, 3000):
            d = np.sort(rng.choice(n, size, replace=False)).astype(np.int64)
            parts = rng.integers(0, 10**6 // size, size)
            lists.append((d, parts, int(parts.max())))
        whole = np.zeros(n, np.int64)
        for d, parts, _ in lists:
            whole[d] += parts
        acc = rs.Accumulators(n)
        for least in (0, int(np.sort(whole)[-k])):
            for _ in range(2):  # nothing is left behind by a query
                at, scores = acc.top(lists, k, least)
                want = sorted(whole, reverse=True)[:k]
                assert sorted(scores, reverse=True)[:k] == want and (whole[at] == scores).all()
        assert not acc.score.any() and not acc.seen.any()
        created = []
        acc.seen = type("Watch", (np.ndarray,), {"__setitem__": lambda s, i, v: (created.append(len(i)) if v else None, np.ndarray.__setitem__(s, i, v))[1]})((n,), bool)
        np.ndarray.__setitem__(acc.seen, slice(None), False)
        acc.top(lists, k, 0)
        assert max(created) < 3000


def test_random_small_texts(spark):
    rng = random.Random(3)
    for seed in range(3):
        words = ["a", "B", "b", "c1", "é", "É", "中文", "d-e", "x_y", "z"]
        documents = [(rng.choice([None, 1, 2, 3, 40, 50]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))])) for _ in range(120)]
        items = [(rng.choice([None, "i1", "i2", "i3"]), rng.choice([None, "", "nothing!", " ".join(rng.choices(words, k=rng.randrange(1, 8)))])) for _ in range(8)]
        ds, its = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
        for k in (1, 7, 500):
            assert got(rs.ranked_search(ds, its, k=k)) == plain(documents, items, k)


def test_awkward_rows(spark, tmp_path):
    df = docs(spark)
    documents = [(r["doc_id"], r["text"]) for r in rows(df)]
    items = [(1, "AB word cd"), (2, None), (3, "été 中文"), (1, "x"), (None, "word")]
    its = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS score", "1 AS query", "2 AS rank")
    assert got(rs.ranked_search(df, its)) == plain(documents, items, 50)
    for ds, q in ((df.limit(0), its), (df, its.limit(0)), (df.limit(0), its.limit(0)), (df.filter("doc_id = 2"), its)):
        assert rows(rs.ranked_search(ds, q)) == []


@pytest.mark.parametrize("text", ["a b", "\x00a\x7f\x1fb", "", "Ünï Ab9_9", "x" * 100_000])
def test_terms(text):
    import pyarrow as pa
    words, counts = rs.terms_of(pa.array(["pad pad", text, None, text])[1:])
    want = TERM.findall(text.translate(LOWER))
    assert words.to_pylist() == want + want and counts.tolist() == [len(want), 0, len(want)]
