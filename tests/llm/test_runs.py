"""Periodic runs against a search of every diagonal, and the report against the library's own parts done plainly."""
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, docs, rows, table

from affinor.llm.runs import collapse_runs, find_runs, repeat_tails, run_report, run_spans


def plain_runs(words):
    """Every diagonal in full; the smallest period by trying all."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            run = words[s:s + length]
            if length >= max(12, 2 * q) and not any(all(run[k] == run[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = [w for i, w in enumerate(words) if i not in gone]
    return {"doc_id": doc_id, "n_words": len(words), "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None, "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            "n_kept": len(kept), "collapsed_sha256": sha(" ".join(kept))}


def planted(rng, n, alphabet):
    x = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 3:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
            z = min(n, a + rng.randint(2 * p, 6 * p))
            for i in range(a, z):
                x[i] = x[a + (i - a) % p]
    return x


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_runs_of_random_sequences(alphabet):
    rng = random.Random(alphabet)
    for k in range(250):
        x = planted(rng, rng.randrange(1, 200), alphabet)
        got = sorted(((s, e - s, q) for s, e, q in find_runs(np.unique(np.array(x), return_inverse=True)[1])), key=lambda r: (r[0], r[2]))
        assert got == plain_runs(x), (k, x)


def test_nested_periods():
    fib = ["a", "ab"]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    for x in (fib[-1][:400], ("a" * 13 + "b") * 9, ("ab" * 7 + "c") * 6 + "ab" * 20, "abc" * 30 + "abd" * 30):
        x = list(x)
        got = sorted(((s, e - s, q) for s, e, q in find_runs(np.unique(np.array(x), return_inverse=True)[1])), key=lambda r: (r[0], r[2]))
        assert got == plain_runs(x)


def test_long_repeats_are_fast():
    start = time.time()
    assert find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    x = np.tile(np.random.default_rng(1).integers(0, 5, 1000), 300)
    assert (0, 300_000, 1000) in find_runs(x)
    assert time.time() - start < 60


def plant(doc_id, text):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, g = len(words), h // 10
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def key(r):
    return tuple((v is None, v) for v in r.values())


def test_whole_small_table(spark):
    sf = SF.replace("0.01", "0.001")
    got = rows(run_report(repeat_tails(spark.read.parquet(f"{sf}/documents.parquet"))))
    want = [plain_report(d["doc_id"], plant(d["doc_id"], d["text"])) for d in table("documents", sf) if len((d["text"] or "").split()) < 1500]
    ids = {w["doc_id"] for w in want}
    assert sorted((g for g in got if g["doc_id"] in ids), key=key) == sorted(want, key=key)
    assert any(w["n_runs"] for w in want) and len(got) == len(table("documents", sf))


def test_planted_tails(spark):
    d = table("documents")
    got = {r["doc_id"]: r["text"] for r in rows(repeat_tails(spark.read.parquet(f"{SF}/documents.parquet")))}
    assert all(got[x["doc_id"]] == plant(x["doc_id"], x["text"]) for x in d) and len(got) == len(d)


def test_awkward_rows(spark):
    blanks = [(20, " \t\n", None, None, None), (21, "\x0b a\x0ca\x0da  a a a a a a a a a a ", None, None, None), (22, "é\xa0é " * 12, None, None, None),
              (23, "a \x1c a \x85 " * 6, None, None, None), (24, "x y z " * 5 + "x y", None, None, None)]
    df = docs(spark).unionByName(docs(spark, blanks))
    texts = [(r["doc_id"], r["text"]) for r in rows(df)]
    slow = [t for t in texts if len(t[1] or "") < 10_000]
    got = rows(run_report(df))
    assert Counter(map(key, (r for r in got if r["doc_id"] != 6))) == Counter(key(plain_report(*t)) for t in slow)
    assert [(r["start"], r["length"], r["period"], r["n_kept"]) for r in got if r["doc_id"] == 6] == [(0, 30000, 1, 1)]
    assert rows(run_report(df.limit(0))) == []
    spans = Counter((r["doc_id"], r["start"], r["length"], r["period"]) for r in rows(run_spans(df)))
    assert spans == Counter((d, *r) for d, t in slow for r in plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) + Counter([(6, 0, 30000, 1)])
    assert {r["doc_id"]: r["text"] for r in rows(collapse_runs(df))}[24] == "x y z"
    assert len(rows(repeat_tails(df))) == len(texts)
