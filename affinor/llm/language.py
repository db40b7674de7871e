"""Language identification by fusing evidence in Bayes' way.

A record's posterior over languages multiplies four things: the likelihood of its text under a byte-trigram model, the likelihood of
the declared markup language, the likelihood of the address suffix, and a prior of its host. The last three are estimated from the
records themselves by grouped aggregation of soft counts, the posteriors that the text alone gives. The prior is smoothed down a
hierarchy: all records, the registered domain within it, the host within that; a record's own soft count is taken out first, so it is
never its own witness.

The text model is fitted on at most PER_LANGUAGE labelled documents of a language (the smallest by a hash), whole texts. The
likelihood of a text counts as that of EFFECTIVE trigrams at most, since trigrams are not independent.

A record is rejected if it has no letters, if more than a share ODD of its text is unlikely for every language, or if the posterior stays below SURE. A
text is judged by consecutive windows of WINDOW trigrams (the last one takes what is left over; a shorter text is one window): so a passage in a
second known language, or an unusual one that is not most of the text, has no say. A text that would fall is judged once more without its words with
a digit or an at sign, which are no prose (keys, addresses). What is unlikely depends on the length: windows of the
fitted texts, of every length in LENGTHS and scored without their own text's counts, give a low quantile of the mean log probability of a
trigram; a window is held against those of the greatest length within its own, less MARGIN. Where a share of the fitted texts is mislabelled,
so that the low quantile is theirs, a bound from the lower quartile and the median takes its place; up to a quarter of a language's windows has
no say in that. A longer window is never held against less than a shorter one.

Defined cases: null or blank texts are rejected; a missing declaration, suffix or host is no evidence; without labelled documents all
records are rejected; repeated rows are records of their own; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import least_hashed, map_batches
from affinor.session import cut_lineage

PER_LANGUAGE = 2000
CODES = 1 << 16
EFFECTIVE = 60
MARGIN = 1.25  # nats a trigram
LENGTHS = tuple(1 << i for i in range(8))  # trigrams of a fitted window
WINDOWS = 4  # of each length from a fitted text
WINDOW = 64  # trigrams of a judged one
PIECE = 1 << 16  # trigrams looked up at once, whole windows
ODD = 0.6  # of the windows of a text
MOST = 500  # languages of the labels
LOW, SPREADS = 0.05, 4  # the low quantile; at least the lower quartile less so many times its distance from the median
SURE = 0.5
STRENGTH = 10.0  # records that a level of the hierarchy counts as in the next one
NO_PROSE = re.compile("[0-9@]")
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256)).lower()


def trigrams(text: str | None) -> np.ndarray:
    """Hashed codes of the byte trigrams of a text's words, letters only."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    if not words:
        return np.zeros(0, np.uint16)
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities of codes by language, and by language and length the least mean log probability of a text. Counts are
    summed on the executors; a table of fixed width reaches the driver."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("lang").alias("l"), F.xxhash64("text").alias("t"))
    known = labelled.select("l").distinct().limit(MOST + 1).count()
    if known > MOST:
        raise ValueError(f"more than {MOST} labels of languages: the column holds something else")
    chosen = least_hashed(labelled, "l", ["doc_id", "t"], per_language).select("doc_id", "l").distinct()
    # at most per_language rows of each language
    sample = cut_lineage(docs.select("doc_id", F.lower("lang").alias("l"), "text").join(F.broadcast(chosen), ["doc_id", "l"]).select("l", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, np.zeros(CODES, np.int64))
                by[lang] += np.bincount(trigrams(text), minlength=CODES)
        for lang, n in by.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["l", "code", "n"])

    rows = sample.transform(map_batches, count, "l string, code int, n long").groupBy("l", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows.l.unique())
    counts = np.full((len(languages), CODES), 0.1)
    for i, lang in enumerate(languages):
        own = rows[rows.l == lang]
        counts[i, own.code.to_numpy()] += own.n.to_numpy()
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    totals = counts.sum(axis=1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple[str, int, float]] = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, i = trigrams(text), languages.index(lang)
                own = np.bincount(c, minlength=CODES)
                upto = np.concatenate([[0.0], np.cumsum(np.log((counts[i, c] - own[c]) / (totals[i] - len(c))))])
                for j, n in enumerate(LENGTHS):
                    for at in {int(x) for x in np.linspace(0, len(c) - n, WINDOWS)} if len(c) >= n else ():
                        got.append((lang, j, (upto[at + n] - upto[at]) / n))
            yield pa.record_batch([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["l", "j", "m"])

    floor = np.full((len(languages), len(LENGTHS)), np.nan)
    if languages:
        quantiles = sample.filter(F.col("l").isin(languages)).transform(map_batches, windows, "l string, j int, m double").groupBy("l", "j").agg(F.percentile("m", [LOW, 0.25, 0.5]).alias("q"))
        for r in quantiles.collect():  # at most a row per language and length
            low, quarter, half = r.q
            floor[languages.index(r.l), r.j] = max(low, quarter - SPREADS * (half - quarter)) - MARGIN
    return languages, table, np.fmax.accumulate(floor, axis=1)  # few or no fitted texts may be as long as the greatest lengths


def text_evidence(records: DataFrame, table: np.ndarray, floor: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep`, the number of trigrams, the mean log probability of a trigram by language, and the share of windows that are unlikely for every
    language; texts go no further."""
    k = len(table)
    by_code = np.ascontiguousarray(table.T)

    def judged(c: np.ndarray) -> tuple[np.ndarray, float]:
        """Mean log probability by language, and the share of windows that are unlikely for all."""
        sums, unlikely, windows = np.zeros(k), 0, 0
        edges = [*range(0, max(1, len(c) - WINDOW), PIECE), len(c)]  # a very long text in pieces
        for a, z in zip(edges, edges[1:]) if len(c) else ():
            starts = np.arange(max(1, (z - a) // WINDOW)) * WINDOW
            size = np.diff(starts, append=z - a)
            each = np.add.reduceat(by_code[c[a:z]], starts, axis=0, dtype=np.float64)
            least = floor[:, np.minimum(np.log2(size).astype(int), len(LENGTHS) - 1)].T
            unlikely += int((each / size[:, None] < least).all(axis=1).sum())
            windows += len(size)
            sums += each.sum(axis=0)
        return sums / max(1, len(c)), unlikely / max(1, windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, mean, odd = [], [], []
            for t in b.column("text").to_pylist():
                c = trigrams(t)
                n.append(len(c))
                m, share = judged(c)
                if share > ODD:
                    prose = trigrams(" ".join(w for w in t.split() if not NO_PROSE.search(w)))
                    share = judged(prose)[1] if len(prose) else share
                mean.append(m.tolist())
                odd.append(share)
            yield pa.record_batch([*(b.column(x) for x in keep), pa.array(n, pa.int64()), pa.array(mean, pa.list_(pa.float64())), pa.array(odd, pa.float64())],
                                  names=[*keep, "n_grams", "mean", "odd"])
    kinds = dict(records.dtypes)
    return records.select(*keep, "text").transform(map_batches, run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_grams long, mean array<double>, odd double")


def normal(log: Column) -> Column:
    """Probabilities of an array of log weights."""
    e = F.transform(log, lambda x: F.exp(x - F.array_max(log)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def soft_counts(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """Per key an array of summed posteriors; partial sums are built before the shuffle, so a hot host is cheap."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(k)])
    return sums.select(*keys, F.array(*[f"_{i}" for i in range(k)]).alias(name))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def identify(records: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], ids: list[str]) -> DataFrame:
    """`ids` and language, confidence, rejected, text_language, declared, host, posterior of records with text, declared, suffix,
    domain and host."""
    languages, table, floor = model
    if not languages:
        return records.select(*ids, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"),
                              F.lit(None).cast("string").alias("text_language"), "declared", "host", F.array().cast("array<double>").alias("posterior"))
    k, names = len(languages), F.array(*[F.lit(x) for x in languages])
    ev = text_evidence(records, table, floor, [*ids, "declared", "suffix", "domain", "host"])
    log_text = F.transform("mean", lambda m: m * F.least("n_grams", F.lit(EFFECTIVE)))
    ev = cut_lineage(ev.withColumn("log_text", log_text).withColumn("p", F.when(F.col("n_grams") > 0, normal(F.col("log_text"))).otherwise(F.array(*[F.lit(1.0 / k)] * k))))
    read = ev.filter("n_grams > 0")
    everywhere = soft_counts(read.withColumn("_all", F.lit(1)), ["_all"], k, "c_all").select("c_all")
    per_declared = soft_counts(read.filter("declared IS NOT NULL"), ["declared"], k, "c_declared")
    per_suffix = soft_counts(read.filter("suffix IS NOT NULL"), ["suffix"], k, "c_suffix")
    per_domain = soft_counts(read.filter("domain IS NOT NULL"), ["domain"], k, "c_domain")
    per_host = soft_counts(read.filter("host IS NOT NULL"), ["domain", "host"], k, "c_host")
    # tables of one row per declared language, suffix, domain and host: Spark broadcasts small ones and splits hot keys of large ones
    j = ev.join(per_declared, "declared", "left").join(per_suffix, "suffix", "left").join(per_domain, "domain", "left")
    j = j.join(per_host.withColumnsRenamed({"domain": "_d", "host": "_h"}), F.col("host").eqNullSafe(F.col("_h")) & F.col("domain").eqNullSafe(F.col("_d")), "left")
    sums = everywhere.first()
    c_all = F.array(*[F.lit(float(x or 0) + 1.0) for x in (sums.c_all if sums else [0.0] * k)])  # one number per language
    own = F.when(F.col("n_grams") > 0, F.col("p")).otherwise(F.array(*[F.lit(0.0)] * k))

    def given(counts: str) -> Column:
        """log P(value | language) up to a constant: the share of the value's records in a language against the language's share of all."""
        left = F.zip_with(F.col(counts), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        smoothed = F.zip_with(left, c_all, lambda c, a: (c + STRENGTH * a / total(c_all)) / a)
        return F.when(F.col(counts).isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(F.transform(smoothed, lambda x: F.log(x)))

    def below(counts: str, prior: Column) -> Column:
        """Shares of a level, smoothed by the level above it."""
        left = F.zip_with(F.coalesce(F.col(counts), F.array(*[F.lit(0.0)] * k)), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        left = F.when(F.col(counts).isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(left)
        return F.zip_with(left, prior, lambda c, q: (c + STRENGTH * q) / (total(left) + STRENGTH))

    j = j.withColumn("_declared", given("c_declared")).withColumn("_suffix", given("c_suffix"))
    j = j.withColumn("_prior", below("c_domain", F.transform(c_all, lambda a: a / total(c_all))))
    j = j.withColumn("_prior", below("c_host", F.col("_prior")))
    log = F.zip_with(F.zip_with("log_text", F.transform("_prior", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with("_declared", "_suffix", lambda a, b: a + b), lambda a, b: a + b)
    j = j.withColumn("posterior", normal(log)).withColumn("confidence", F.array_max("posterior"))
    best = F.array_position("posterior", F.col("confidence")).cast("int")
    rejected = (F.col("n_grams") == 0) | (F.col("confidence") < SURE) | (F.col("odd") > ODD)
    return j.withColumn("rejected", rejected).select(
        *ids, F.when(~F.col("rejected"), F.element_at(names, best)).alias("language"), "confidence", "rejected",
        F.when(F.col("n_grams") > 0, F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))).alias("text_language"), "declared", "host", "posterior")


def primary(tag: Column) -> Column:
    """Primary subtag in lower case, null if it is none."""
    t = F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(t != "", t)


def some(c: Column) -> Column:
    return F.when(c != "", c)


def document_records(docs: DataFrame) -> DataFrame:
    """The source of a document is its host; its language column is what is declared."""
    return docs.select(F.col("doc_id").cast("long"), "text", primary(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.lit("documents").alias("domain"), F.col("source").alias("host"))


def page_records(pages: DataFrame) -> DataFrame:
    """Declared language from the markup; suffix, registered domain and host from the address; the text between tags."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # what is never closed takes the rest of the page, so no part of it is scanned twice
    text = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript)\b.*?(?:</\1\s*+>|\z)|<[^<>]*+>|&#?\w++;", " ")
    host = some(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select(F.col("page_id").cast("long"), text.alias("text"), primary(F.regexp_extract(html, r"""(?i)<html\b[^<>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1)).alias("declared"),
                        some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"), F.when(host.contains("."), F.substring_index(host, ".", -2)).alias("domain"), host.alias("host"))


def identify_all(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages together: doc_id or page_id says which; hosts and declarations of both inform each other's priors."""
    none = F.lit(None).cast("long")
    both = document_records(docs).withColumn("page_id", none).unionByName(page_records(pages).withColumn("doc_id", none))
    return identify(both, train(docs), ["doc_id", "page_id"])
