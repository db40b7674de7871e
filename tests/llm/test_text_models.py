import random

import numpy as np
from helpers import SF, docs, rows, table

from affinor.llm import language as L
from affinor.llm import toxicity as T
from affinor.llm.queries import op5_language, op8_toxicity


def test_languages_of_the_whole_tables(spark):
    got = rows(op5_language(spark, SF))
    truth = {d["doc_id"]: d for d in table("documents")}
    mine = [r for r in got if r["doc_id"] is not None]
    assert len(mine) == len(truth) and len(got) - len(mine) == len(table("pages"))
    assert np.mean([r["language"] == truth[r["doc_id"]]["lang"] for r in mine]) > 0.99
    assert np.mean([r["text_language"] == truth[r["doc_id"]]["lang"] for r in mine]) > 0.98
    assert all(r["rejected"] == (r["language"] is None) and abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)


def test_evidence_is_fused_as_bayes_says(spark):
    """Against a plain recomputation over the soft counts."""
    rnd = random.Random(7)
    make = {"xx": "abcde", "yy": "defgh"}
    word = lambda l: "".join(rnd.choice(make[l]) for _ in range(4))
    train = docs(spark, [(i, " ".join(word(l) for _ in range(30)), l, "h", 0) for i, l in enumerate(["xx", "yy"] * 20)], clash=False)
    model = L.train(train)
    recs = [(i, " ".join(word(l) for _ in range(rnd.choice([0, 1, 2, 10]))), rnd.choice([l, l, None]), rnd.choice(["sx", None]), rnd.choice(["d1", "d2"]), f"h{rnd.randrange(4)}")
            for i, l in enumerate(rnd.choice(["xx", "yy"]) for _ in range(60))]
    df = spark.createDataFrame(recs, "doc_id long, text string, declared string, suffix string, domain string, host string")
    got = {r["doc_id"]: r["posterior"] for r in rows(L.identify(df, model, ["doc_id"]))}
    table_ = model[1]
    soft, logs = {}, {}
    for r in recs:
        c = L.trigrams(r[1])
        mean = table_[:, c].astype(float).mean(axis=1) if len(c) else np.zeros(2)
        logs[r[0]] = mean * min(len(c), L.EFFECTIVE)
        p = np.exp(logs[r[0]] - logs[r[0]].max())
        soft[r[0]] = p / p.sum() if len(c) else None
    add = lambda keep: sum((soft[r[0]] for r in recs if soft[r[0]] is not None and keep(r)), np.zeros(2))
    c_all = add(lambda r: True) + 1
    for r in recs:
        own = soft[r[0]] if soft[r[0]] is not None else np.zeros(2)
        log = logs[r[0]].copy()
        for col in (2, 3):
            left = add(lambda q: r[col] is not None and q[col] == r[col])
            if r[col] is not None and left.sum():
                log += np.log((np.maximum(left - own, 0) + L.STRENGTH * c_all / c_all.sum()) / c_all)
        prior = c_all / c_all.sum()
        for keep in (lambda q: q[4] == r[4], lambda q: q[4:] == r[4:]):
            c = add(keep)
            c = np.maximum(c - own, 0) if c.sum() else c
            prior = (c + L.STRENGTH * prior) / (c.sum() + L.STRENGTH)
        log += np.log(prior)
        want = np.exp(log - log.max())
        assert np.allclose(got[r[0]], want / want.sum(), atol=1e-6)


def test_language_awkward_rows(spark):
    data = [(i, "the cat sat on the mat and " * 9, "en", "s", 0) for i in range(5)] + [(10 + i, "der hund liegt auf dem boden und " * 9, "DE-at", "s", 0) for i in range(5)]
    extra = [(20, None, "en", "s", 0), (21, "", None, None, 0), (22, "1234 --- 99", "en", "s", 0), (None, "the mat and the cat", None, None, 0), (23, "the cat " * 20000, "fr", "t", 0),
             (0, data[0][1], "en", "s", 0)]
    train = docs(spark, [(a, b, {"DE-at": "de"}.get(c, c), d, e) for a, b, c, d, e in data])
    got = rows(L.identify(L.document_records(docs(spark, data + extra)), L.train(train), ["doc_id"]))
    assert len(got) == 16 and [r["language"] for r in got if r["doc_id"] in (20, 21, 22)] == [None] * 3
    assert {r["language"] for r in got if r["doc_id"] in (0, 23, None)} == {"en"}
    assert {r["declared"] for r in got if r["doc_id"] in range(10, 15)} == {"de"}
    assert rows(L.identify(L.document_records(docs(spark, [])), L.train(train), ["doc_id"])) == []
    assert {r["rejected"] for r in rows(L.identify(L.document_records(docs(spark, data)), L.train(docs(spark, [])), ["doc_id"]))} == {True}


def test_texts_of_an_unlabelled_language_are_rejected_at_every_length(spark):
    """Also if one training row of each language is of an unlabelled one. One of these shares half its letters with each labelled one."""
    rnd = random.Random(11)
    words = {l: ["".join(rnd.choice(s) for _ in range(rnd.randrange(3, 7))) for _ in range(80)] for l, s in {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "efghijkl", "ru": "абвгдежз"}.items()}
    text = lambda l, n: " ".join(rnd.choice(words[l]) for _ in range(n))
    train = [(i, text(l, rnd.choice([5, 20, 100, 400])), l, "h", 0) for i, l in enumerate(["xx", "yy"] * 40)]
    train += [(100 + i, text(o, 60), l, "h", 0) for i, (l, o) in enumerate([("xx", "zz"), ("yy", "ru")])]
    asked = [(l, n, text(l, n)) for l in ("xx", "yy", "zz", "ru") for n in (2, 5, 12, 60, 1000) for _ in range(5)]
    model = L.train(docs(spark, train, clash=False))
    got = {r["doc_id"]: r for r in rows(L.identify(L.document_records(docs(spark, [(i, a[2], None, None, 0) for i, a in enumerate(asked)])), model, ["doc_id"]))}
    for i, (l, n, _) in enumerate(asked):
        assert got[i]["language"] == (l if l in ("xx", "yy") else None), (l, n)


def test_page_records(spark):
    p = [(1, "https://u:p@www.Shop.example.de:80/x?y", '<html class=a lang="DE-at"><style>p{}</style><p>Guten Tag</p>'), (2, None, None), (3, "nonsense", "<p>x"), (4, "http://localhost/", "<HTML LANG=fr>")]
    got = {r["page_id"]: r for r in rows(L.page_records(spark.createDataFrame(p, "page_id long, url string, html string")))}
    assert (got[1]["declared"], got[1]["suffix"], got[1]["domain"], got[1]["host"]) == ("de", "de", "example.de", "www.shop.example.de") and got[1]["text"].split() == ["Guten", "Tag"]
    assert (got[2]["declared"], got[2]["host"]) == (None, None) and got[3]["host"] is None and (got[4]["declared"], got[4]["suffix"]) == ("fr", None)


def test_broken_pages_take_no_long_time(spark):
    import time
    start = time.time()
    pages = [(1, "http://a.b/", "<!--" * 250000), (2, "http://a.b/", "<script>" * 125000), (3, "http://" + "a" * 300000, "<html " * 160000), (4, "x", "<" * 1000000), (5, "x", "</script" * 100000 + " " * 100000),
             (6, "x", "<p>seen<!-- gone <p>gone"), (7, "x", "<script>gone</script >seen<style>gone")]
    got = {r["page_id"]: r for r in rows(L.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert time.time() - start < 20 and not got[1]["text"].strip() and not got[2]["text"].strip()
    assert got[6]["text"].split() == ["seen"] and got[7]["text"].split() == ["seen"]


def test_a_passage_in_another_known_language_stays(spark):
    """Also an unusual one, as long as it is not most of the text; words with digits are not held against a text."""
    rnd = random.Random(5)
    words = {l: ["".join(rnd.choice(s) for _ in range(rnd.randrange(3, 7))) for _ in range(80)] for l, s in {"xx": "abcdefgh", "yy": "ijklmnop", "ru": "абвгдежз"}.items()}
    text = lambda l, n: " ".join(rnd.choice(words[l]) for _ in range(n))
    model = L.train(docs(spark, [(i, text(l, 100), l, "h", 0) for i, l in enumerate(["xx", "yy"] * 30)], clash=False))
    asked = [text("xx", 100) + " " + text("yy", 80), text("xx", 100) + " " + text("ru", 60), text("xx", 12) + " " + "qz9wv7kq5" * 12, text("xx", 40) + " " + text("ru", 200)]
    got = {r["doc_id"]: r["language"] for r in rows(L.identify(L.document_records(docs(spark, [(i, t, None, None, 0) for i, t in enumerate(asked)])), model, ["doc_id"]))}
    assert got == {0: "xx", 1: "xx", 2: "xx", 3: None}


def test_toxicity_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["toxic"] for r in table("labels", "/root/testdata/sf0.1")}
    got = [r for r in rows(op8_toxicity(spark, "/root/testdata/sf0.1"))]
    assert len(got) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    toxic, clean = [r for r in held if truth[r["doc_id"]]], [r for r in held if not truth[r["doc_id"]]]
    wins = np.mean([(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean])
    assert wins > 0.9 and np.mean([r["predicted"] for r in toxic]) > 0.5 and np.mean([r["predicted"] for r in clean]) < 0.03


def test_toxicity_awkward_rows(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda bad: " ".join([word() for _ in range(30)] + ["zzbadzz", "qqbadqq"] * bad)
    data = [(i, text(i % 2), None, None, None) for i in range(400)] + [(1000, None, None, None, None), (1001, "", None, None, None), (None, text(1), None, None, None), (1, text(1), None, None, None),
            (1002, text(0) * 3000, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(0, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = rows(T.toxicity(docs(spark, data), labels))
    assert len(got) == len(data) and all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert {r["predicted"] for r in got if r["doc_id"] in (1000, 1001, 1002)} == {0} and [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    assert rows(T.toxicity(docs(spark, []), labels)) == []
    assert {r["score"] for r in rows(T.toxicity(docs(spark, data), labels.limit(0)))} == {0.0}


def test_labels_of_held_out_rows_have_no_say(spark):
    import zlib
    t = spark.read.parquet(f"{SF}/labels.parquet")
    flip = [r["doc_id"] for r in table("labels") if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    from pyspark.sql import functions as F
    other = t.withColumn("toxic", F.when(F.col("doc_id").isin(flip), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda r: r["doc_id"]
    assert sorted(rows(T.toxicity(d, t)), key=key) == sorted(rows(T.toxicity(d, other)), key=key)
