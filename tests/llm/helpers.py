"""Small tables with the awkward rows every operator must take."""
import duckdb

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Ab cd", "en", "a", 5), (3, "Ab cd", "en", "a", 5), (4, "aB CD", None, "b", 5),
           (None, "ab cd", "en", None, 5), (5, "Été \u0000 中文 x" * 3, "fr", "b", 1), (6, "word " * 30000, "en", "a", 150000), (7, "Ab cd", "en", "a", None)]


def docs(spark, rows=AWKWARD, clash=True):
    """With `clash`, further columns carry the names of results."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        for c in ("size", "shard", "slot", "start", "digest", "n", "kept", "target", "word", "score", "run", "row"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def table(name, sf=SF):
    return [dict(zip(r.columns, x)) for r in [duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'")] for x in r.fetchall()]


def rows(df):
    return [r.asDict() for r in df.collect()]
