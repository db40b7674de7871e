import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, docs, rows, table

from affinor.llm import jaccard_join as J
from affinor.llm.components import components
from affinor.llm.queries import op6_jaccard_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(data):
    """Links by an inverted index, components by union-find."""
    sets = [grams(d["text"]) if d["doc_id"] is not None else set() for d in data]
    parent = {d["doc_id"]: d["doc_id"] for d in data}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in seen[g]:
                common[j] += 1
            seen[g].append(i)
        for j, c in common.items():
            if 100 * c >= 85 * (len(s) + len(sets[j]) - c):
                a, b = root(data[i]["doc_id"]), root(data[j]["doc_id"])
                parent[max(a, b)] = min(a, b)
    return sorted(((d["doc_id"], len(grams(d["text"])), root(d["doc_id"]) if d["doc_id"] is not None else None) for d in data), key=repr)


def shape(got):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr)


def test_whole_table(spark):
    sf = SF.replace("sf0.01", "sf0.001")
    want = brute(table("documents", sf))
    assert shape(rows(op6_jaccard_join(spark, sf))) == want
    assert sum(w[0] != w[2] for w in want) > 3


def planted(seed, n, edit):
    """Documents that share long passages, with groups of near copies around the bound."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    data = []
    for i in range(n):
        kind = rnd.randrange(4)
        if kind == 0 or len(data) < 5:
            w = [word() for _ in range(rnd.choice([2, 4, 8, 20, 90, 300]))]
        elif kind == 1:
            w = passage + [word() for _ in range(rnd.choice([5, 12, 20]))]
        else:
            w = rnd.choice(data)[1].split(" ")[:]
            for _ in range(rnd.randrange(1 + max(1, int(len(w) * edit)))):
                at = rnd.randrange(len(w) + 1)
                w[at:at + rnd.randrange(2)] = [word()] * rnd.randrange(2)
        data.append((i, " ".join(w), None, None, None))
    return data


@pytest.mark.parametrize("seed,edit,many", [(1, 0.03, 32), (2, 0.08, 3), (3, 0.02, 2)])
def test_near_copies_and_shared_passages(spark, monkeypatch, seed, edit, many):
    monkeypatch.setattr(J, "FREQUENT", many)
    monkeypatch.setattr(J, "ROUNDS", many % 2)
    monkeypatch.setattr(J, "BLOCK", 7 if many < 32 else 2000)
    data = planted(seed, 300, edit)
    assert shape(rows(J.jaccard_join(docs(spark, data)))) == brute([{"doc_id": d[0], "text": d[1]} for d in data])


def test_awkward_rows(spark):
    data = [(1, None, None, None, None), (2, "  \n", None, None, None), (3, "a B", None, None, None), (4, "A b", None, None, None), (5, "b a", None, None, None),
            (None, "a b", None, None, None), (6, "x " * 5000, None, None, None), (7, "x " * 400, None, None, None), (8, "one two three four", None, None, None),
            (9, "a b", None, None, None), (9, "one two three four", None, None, None), (3, "a B", None, None, None), (10, "q", None, None, None)]
    assert shape(rows(J.jaccard_join(docs(spark, data)))) == brute([{"doc_id": d[0], "text": d[1]} for d in data])
    assert rows(J.jaccard_join(docs(spark, []))) == []


def test_bands_and_allocations_keep_the_promise():
    first = J.bands(5000)
    band = lambda n: max(i for i, f in enumerate(first) if f <= n)
    for r in range(1, 4000, 7):
        s = r * 100 // 85
        assert band(s) - band(r) <= 1 and J.most_apart(r, s) <= J.most_apart(first[band(r) + 1] - 1, (first[band(r) + 1] - 1) * 100 // 85)
    for h in (1, 2, 5, 40, 900):
        for res in (0.0, 0.05, 0.4, 0.9):
            m, ones, slack = J.allocate(h, 1e5, 6.0 * h, res)
            assert m + ones == h + 1 + slack and 0 <= ones <= m and slack >= 0


def test_entries_of_sets_that_differ_by_at_most_h_meet():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size, h = int(rng.integers(8, 200)), int(rng.integers(1, 12))
        m, ones, slack = J.allocate(h, 1e6, size, float(rng.random()))
        x = np.unique(rng.integers(0, 2 ** 63, size + h).astype(np.uint64))
        a, b = x[:-(h // 2)] if h // 2 else x, x[h - h // 2:]
        (ka, ta, _), (kb, tb, _) = J.segment_entries(a, 3, m, ones, slack), J.segment_entries(b, 3, m, ones, slack)
        exact = set(ka[ta < 2].tolist()) & set(kb.tolist()) | set(kb[tb < 2].tolist()) & set(ka.tolist())
        assert exact


def test_finer_entries_meet_within_the_slack():
    """Leaving out any most frequent subsets up to the slack, by one order, still leaves one in common."""
    rng = np.random.default_rng(6)
    for _ in range(100):
        h = int(rng.integers(1, 10))
        m, ones, slack = J.finer({0: J.allocate(h, 1e4, 60, 0.3)})[0]
        x = np.unique(rng.integers(0, 2 ** 63, 60 + h).astype(np.uint64))
        kept = []
        for y in (x[:len(x) - h // 2], x[h - h // 2:]):
            keys, kinds, room = J.segment_entries(y, 1, m, ones, slack)
            assert set(kinds.tolist()) == {0}
            kept.append(set(np.sort(keys)[room:].tolist()))
        assert kept[0] & kept[1]


def test_components_of_a_chain_a_star_and_none(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300)]
    got = {r["id"]: r["component"] for r in rows(components(spark.createDataFrame(e, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


def test_entries_of_a_very_long_text_in_a_crowd(spark):
    """A set of 100,000 tokens has more slack left in the finer index than 16 bits hold."""
    n = 100_000
    long = " ".join(f"w{i}" for i in range(n + J.N - 1))
    first = np.array(J.bands(10 ** 12))
    k = int(np.searchsorted(first, n, side="right")) - 1
    widest = int(first[k + 1]) - 1
    plan = J.finer({k: J.allocate(J.most_apart(widest, widest * J.DEN // J.NUM), 100, n, 0.5)})
    keys, kinds, room = J.segment_entries(J.Shingler().tokens(long), k, *plan[k])
    assert room > 32767 and len(keys) == len(kinds)
    got = J.entries(docs(spark, [(1, long, None, None, None)]), plan).select("key", "room").collect()
    assert {r["room"] for r in got} == {room} and sorted(r["key"] for r in got) == sorted(keys.tolist())
