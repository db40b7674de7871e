import sys
from collections import Counter, defaultdict

from helpers import table

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline as P  # noqa: E402
from test_decontaminate import brute as contaminated  # noqa: E402
from test_jaccard_join import brute as near_copies  # noqa: E402
from test_mixing_tokens import brute_tokens, by_start, check_mix  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf, tmp):
    out = [docs]
    for i, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], sf).write.parquet(f"{tmp}/{i}")
        out.append(spark.read.parquet(f"{tmp}/{i}"))
    return out


def plain(df):
    return [r.asDict() for r in df.collect()]


def check(spark, docs, sf, tmp):
    raw, spoken, single, clean, mixed, tokens = [x if i == 5 else x for i, x in enumerate(map(plain, stages(spark, docs, sf, tmp)))]
    assert all(set(x[0]) == set(COLUMNS) for x in (spoken, single, clean, mixed))
    key = lambda d: tuple(d[c] for c in COLUMNS)
    lost = Counter(map(key, raw)) - Counter(map(key, spoken))
    assert all(not any(c.isalpha() for c in (k[1] or "")) for k in lost)
    roots = {d for d, _, c in near_copies(spoken) if d == c}
    assert sorted((d["doc_id"] for d in single if d["doc_id"] is not None)) == sorted(r for r in roots if r is not None)
    bad = {d for d, *_, c in contaminated(single, table("benchmark", sf)) if c}
    assert Counter(map(key, clean)) == Counter(key(d) for d in single if d["doc_id"] not in bad)
    copies = Counter(map(key, mixed))
    got = []
    sizes, targets = defaultdict(int), {}
    from affinor.llm.mixing import mix
    for r in plain(mix(spark.createDataFrame([tuple(d[c] for c in COLUMNS) for d in clean], "doc_id long, text string, lang string, source string, n_chars long"))):
        got.append(r)
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
    check_mix(got, clean)
    by_id = {d["doc_id"]: key(d) for d in clean}
    assert copies == Counter({by_id[r["doc_id"]]: r["copies"] for r in got if r["copies"]})
    assert by_start(tokens) == sorted((s, d, n, c) for d, s, n, c in brute_tokens(mixed))


def test_pipeline_on_a_table_with_awkward_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    real = [tuple(d[c] for c in COLUMNS) for d in table("documents", sf)]
    rows = real + [(900001, None, None, None, None), (900002, "", "en", "src0", 0), (900003, "12 34", None, None, 5), (real[3][0], *real[3][1:]), (900004, real[5][1], None, None, None)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf, tmp_path)


def test_columns_with_clashing_names_go_through(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    names = ["_id", "_key", "_key0", "_key1", "_k", "_sum", "_rows", "_copies", "_copy", "_place", "text_key", "rejected", "component_id", "copies", "size"]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plain_run, wide_run = stages(spark, df, sf, tmp_path / "a"), stages(spark, df.selectExpr("*", *(f"'x' AS {n}" for n in names)), sf, tmp_path / "b")
    key = lambda d: str(sorted((c, v) for c, v in d.items() if c in COLUMNS or c not in names))
    for a, b in zip(plain_run[1:-1], wide_run[1:-1]):
        assert set(names) <= set(b.columns) and Counter(map(key, plain(a))) == Counter(map(key, plain(b)))
    assert plain_run[-1].count() == wide_run[-1].count()


def test_registered_run_and_empty_table(spark, tmp_path):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is P.run and [len(s) for s in P.STAGES] == [2] * 5 and P.ORACLE_SQL is None
    sf = "/root/testdata/sf0.001"
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert all(x.count() == 0 for x in stages(spark, empty, sf, tmp_path))
