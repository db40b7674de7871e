import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import SF, docs, rows, table

from affinor.llm import sharding as S
from affinor.llm.exact_dedup import exact_dedup
from affinor.llm.queries import op1_sharding, op3_exact_dedup


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_whole_table_in_even_shards(spark):
    got, want = rows(op1_sharding(spark, SF)), {d["doc_id"]: d for d in table("documents")}
    assert len(got) == len(want) == len({r["doc_id"] for r in got})
    load, slots = Counter(), defaultdict(list)
    for r in got:
        raw = (want[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(load.values()) - min(load.values()) <= 0.001 * max(load.values())
    assert all(len({r["shard"] for r in got if r["virtual_slot"] == v}) == 1 for v in {r["virtual_slot"] for r in got})


def test_rebalance_moves_little_and_fills_new_shards():
    rng = np.random.default_rng(5)
    size = rng.integers(0, 1000, 512)
    even = S.rebalance(S.first_map(8, 512), size, 8)
    grown = S.rebalance(even, size, 9)
    load = np.bincount(grown, weights=size, minlength=9)
    assert load.max() - load.min() < 0.01 * load.mean()
    assert size[grown != even].sum() < 0.2 * size.sum()
    assert np.array_equal(S.rebalance(grown, size, 9), grown)


def test_one_slot_with_a_third_of_the_bytes():
    size = np.full(64, 10)
    size[5] = 320
    got = S.rebalance(S.first_map(4, 64), size, 4)
    load = np.bincount(got, weights=size, minlength=4)
    assert load[got[5]] == 320 and max(np.delete(load, got[5])) - min(np.delete(load, got[5])) <= 10


def test_map_versions_stay_readable(spark, tmp_path):
    z = np.arange(32)
    S.write_map(spark, str(tmp_path / "m"), S.map_rows(1, z % 2, z, z))
    S.write_map(spark, str(tmp_path / "m"), S.map_rows(2, z % 3, z, z))
    assert {r["shard"] for r in rows(S.read_map(spark, str(tmp_path / "m"), 1))} == {0, 1}
    assert {r["version"] for r in rows(S.read_map(spark, str(tmp_path / "m")))} == {2}


def test_sharding_awkward_rows(spark, tmp_path):
    got = rows(S.shard_documents(docs(spark), 3, str(tmp_path / "m")))
    assert len(got) == 9 and all(r["shard"] in (0, 1, 2) and r["slot"] is not None for r in got)
    assert [r["size"] for r in got if r["doc_id"] == 1] == [1]
    assert rows(S.shard_documents(docs(spark, []), 3, str(tmp_path / "e"))) == []


def test_written_shards_hold_every_document(spark, tmp_path):
    d = docs(spark, clash=False)
    S.shard_documents(d, 3, str(tmp_path / "m"))
    S.write_shards(d, S.read_map(spark, str(tmp_path / "m")), str(tmp_path / "out"))
    back = rows(spark.read.parquet(str(tmp_path / "out")))
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r["doc_id"], r["text"]) for r in rows(d))


def check_dedup(got, docs_):
    groups = defaultdict(list)
    for d in docs_:
        groups[low(d["text"])].append(d["doc_id"])
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(docs_)
    for r in got:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        assert not r["kept"] or r["doc_id"] == best
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_whole_table(spark):
    check_dedup(rows(op3_exact_dedup(spark, SF)), table("documents"))


def test_exact_dedup_many_runs_and_a_hot_text(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["Hot", "hOT", f"t{i % 40}", f"T{i % 40}", f"own {i}"]), None, None, None) for i in range(600)]
    for fan in (2, 3, 16):
        got = rows(exact_dedup(docs(spark, data).repartition(23), fan))
        check_dedup(got, [{"doc_id": d[0], "text": d[1]} for d in data])


def test_exact_dedup_awkward_rows(spark):
    d = docs(spark)
    check_dedup(rows(exact_dedup(d)), [r.asDict() for r in d.collect()])
    assert rows(exact_dedup(docs(spark, []))) == []
