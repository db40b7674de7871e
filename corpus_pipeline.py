"""A training corpus from raw documents: each stage reads what the one before it kept, written as Parquet.

No stage is plain SQL, so there is no ORACLE_SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""
from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from affinor.llm import decontaminate, jaccard_join, language, mixing, token_index  # noqa: E402
from affinor.llm.common import matching, spare, table  # noqa: E402
from affinor.session import cut_lineage, scratch_path  # noqa: E402

TOKENIZER = "word_bpe_49k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure. The verdict follows id and text; only the rejected, a small part, are joined. Null texts, and texts
    without a letter, go; rows that repeat an id and a text stay or go together; further columns are kept."""
    records = language.document_records(docs).withColumn("text_key", F.xxhash64("text"))
    judged = language.identify(records, language.train(docs), ["doc_id", "text_key"])
    bad = cut_lineage(judged.filter("rejected").select("doc_id", "text_key").distinct())
    return matching(docs, bad, [F.col("doc_id"), F.xxhash64("text")], "left_anti")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked documents. Rows without an id are in no group; of rows that repeat
    an id one is kept, the first by text. A null or empty text is in no group; further columns are kept."""
    groups = jaccard_join.jaccard_join(docs)
    gone = cut_lineage(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    by = [F.col("doc_id")]
    kept = matching(docs, gone, by, "left_anti")
    again = cut_lineage(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    place, = spare(docs, "_place")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = matching(kept, again, by, "left_semi").withColumn(place, first).filter(F.col(place) == 1).drop(place)
    return matching(kept, again, by, "left_anti").unionByName(one)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate, so null and empty texts too. The verdict follows id and text; further columns are
    kept."""
    return decontaminate.drop_contaminated(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks; one without a word is in no mix. Rows without a source are a source of their
    own; rows that share an id share out its copies in text order; further columns are kept."""
    return mixing.repeat(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and per document what their files say. A null text has the end id alone; repeated rows are written each; further
    columns are ignored."""
    return token_index.token_index(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", keep_known_languages), ("near copies", keep_one_of_near_copies), ("benchmark", drop_benchmark_passages), ("mixing", mix_sources), ("tokens", write_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
