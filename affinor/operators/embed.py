"""Text vectors kept under a content key: only new or changed texts are encoded."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer, PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.functions.text import embedding_text


def keyed(items: DataFrame) -> DataFrame:
    """(item, key, content): the text to encode and the hash that names it."""
    t = embedding_text(F.col("title"), F.col("abstract"))
    return items.select("item", F.sha1(t).alias("key"), t.alias("content"))


def todo(texts: DataFrame, store: DataFrame) -> DataFrame:
    return texts.join(store.select("key"), "key", "left_anti")


def hashing_encoder(texts: DataFrame, dim: int = 256) -> DataFrame:
    """Default encoder: hashed term counts of unit length. A vector depends on its own text alone, so vectors of any two batches lie in
    one space."""
    words = texts.withColumn("w", F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    tf = HashingTF(inputCol="w", outputCol="tf", numFeatures=dim).transform(words)
    return Normalizer(inputCol="tf", outputCol="u").transform(tf).select("key", vector_to_array("u").alias("v"))


def embed(texts: DataFrame, store: DataFrame, encoder: Callable[[DataFrame], DataFrame] = hashing_encoder) -> tuple[DataFrame, DataFrame]:
    """(item vectors, extended store). `encoder` maps (key, content) to (key, v); each distinct missing text goes in once."""
    missing = todo(texts, store).groupBy("key").agg(F.first("content").alias("content"))
    grown = store.select("key", "v").unionByName(encoder(missing))
    return texts.select("item", "key").join(grown, "key"), grown


def map_xy(vectors: DataFrame, id: str = "entity") -> DataFrame:
    """Two-dimensional map: first two principal components, centred and scaled so that the largest coordinate is 1."""
    v = vectors.select(id, array_to_vector("v").alias("f"))
    xy = PCA(k=2, inputCol="f", outputCol="p").fit(v).transform(v).select(id, vector_to_array("p").alias("p"))
    xy = xy.select(id, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return scaled_xy(xy, id)


def scaled_xy(xy: DataFrame, id: str = "entity") -> DataFrame:
    """Coordinates centred on their mean and scaled so that the largest is 1; places that are all the same come out as 0."""
    c = xy.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))).scalar()
    xy = xy.withColumn("c", c).select(id, (F.col("x") - F.col("c.x")).alias("x"), (F.col("y") - F.col("c.y")).alias("y"))
    m = xy.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).scalar()
    return xy.withColumn("m", m).select(id, *[F.coalesce(F.try_divide(F.col(c), F.col("m")), F.lit(0.0)).alias(c) for c in ("x", "y")])
