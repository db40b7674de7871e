"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one for toxic and one for ordinary text. Both begin with the frequent words of ordinary text;
the toxic one ends with the words whose document frequency in toxic text is significantly above that in ordinary text, the ordinary
one with as many bytes of other ordinary words. A window of a few words is compressed with either; the bytes that the toxic dictionary saves
are its margin. A document's margins - the largest, the mean, how many pass either of two thresholds - are calibrated to a
probability by a logistic fit on labelled documents.

The fit sees at most PER_CLASS documents of each class (the smallest by a hash), counts of words come from the same documents, and
ordinary ones are weighted up to their true number. Scoring covers every window of every text. Only texts are inputs of a score.

Defined cases: a null or blank text has no windows and gets the score of zero margins; a document with several labels counts as toxic if one
says so; labels other than 0 and 1 are ignored; without labels of both classes every score is 0; a row without an id counts as held
out; repeated rows are scored one by one; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import least_hashed, map_batches

WINDOW = 8  # words
PER_CLASS = 20_000  # labelled documents of a class that are used at most
COMMON_BYTES = 60_000
SPECIFIC_WORDS = 4096
SIGNIFICANT = 6.0  # standard errors
LEVEL = 3
LOW, HIGH = 4, 6  # saved bytes


@dataclass(frozen=True)
class Model:
    common: bytes
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def compressor(self, specific: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(self.common + specific, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(self.common + specific), source_size=64,
                                                                write_content_size=0, write_checksum=0, write_dict_id=0)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def windows(text: str | None) -> list[bytes]:
    w = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(w[i:i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.ordinary, self.toxic = model, model.compressor(model.ordinary), model.compressor(model.toxic)

    def margins(self, text: str | None) -> np.ndarray:
        ws, out = windows(text), []
        for i in range(0, len(ws), 8192):
            part = ws[i:i + 8192]
            a, b = self.ordinary.multi_compress_to_buffer(part), self.toxic.multi_compress_to_buffer(part)
            out.append(np.fromiter(map(len, a), np.int64, len(part)) - np.fromiter(map(len, b), np.int64, len(part)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def features(self, text: str | None) -> list[float]:
        m = self.margins(text)
        if not len(m):
            return [0.0] * 5
        low = int((m >= LOW).sum())
        return [float(m.max()), float(m.mean()), float(np.log1p(low)), low / len(m), float(np.log1p((m >= HIGH).sum()))]

    def score(self, text: str | None) -> float:
        x = (np.array(self.features(text)) - self.model.mean) / self.model.scale
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights[:-1]) + self.model.weights[-1], -30, 30))))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic and weight of the documents to learn from: not held out, at most `per_class` of each class."""
    truth = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    total = truth.groupBy("toxic").agg(F.count("*").alias("total"))
    chosen = least_hashed(truth, "toxic", ["doc_id"], per_class)
    chosen = chosen.join(F.broadcast(total), "toxic").select("doc_id", "toxic", F.greatest(F.lit(1.0), F.col("total") / per_class).alias("weight"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight")  # at most 2 * per_class rows


def train_dictionaries(train: DataFrame) -> Model | None:
    """Word statistics on the executors; a bounded number of words reaches the driver."""
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return None
    words = (train.select("toxic", F.explode(F.array_distinct(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+"))).alias("w")).filter("w <> ''")
             .groupBy("w").agg(F.sum(F.col("toxic")).alias("t"), F.sum(1 - F.col("toxic")).alias("o")))
    p = (F.col("t") + F.col("o")) / (n[0] + n[1])
    z = (F.col("t") / n[1] - F.col("o") / n[0]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))
    words = words.filter("t + o >= 4").withColumn("z", z)
    specific = [r.w.encode() for r in words.filter(F.col("z") > SIGNIFICANT).orderBy(F.col("z").desc(), "w").limit(SPECIFIC_WORDS).collect()][::-1]
    common = [r.w.encode() for r in words.filter(F.col("z") <= SIGNIFICANT).orderBy(F.col("o").desc(), "w").limit(COMMON_BYTES // 3).collect()][::-1]
    other = [r.w.encode() for r in words.filter(F.col("z") <= SIGNIFICANT).orderBy(F.xxhash64("w"), "w").limit(2 * SPECIFIC_WORDS).collect()]
    toxic = b" " + b" ".join(specific) + b" "
    return Model(b" ".join(common)[-COMMON_BYTES:], b" " + b" ".join(other)[:max(0, len(toxic) - 2)] + b" ", toxic)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Logistic fit by Newton steps with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (weight * (y - p)) - w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.common, model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(w))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows = labelled(docs, labels, per_class)
    model = train_dictionaries(rows)
    if model is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield pa.record_batch([pa.array([s.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "toxic", "weight"])
    got = rows.select("text", F.col("toxic").cast("int"), "weight").transform(map_batches, run, "x array<double>, toxic int, weight double").toPandas()
    got = got.assign(k=[tuple(x) for x in got.x]).sort_values(["toxic", "k"])  # the order of tasks has no say in the sums
    return calibrate(model, np.array(got.k.tolist()), got.toxic.to_numpy(float), got.weight.to_numpy(float))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model) if model else None
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s.score(t) if s else 0.0 for t in b.column(2).to_pylist()], pa.float64())],
                                  names=["doc_id", "held_out", "score"])
    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").transform(map_batches, run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
