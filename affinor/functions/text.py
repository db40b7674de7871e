"""Text helpers as column expressions; the two Arrow functions cover what the JVM functions cannot say."""
from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from affinor.session import cut_lineage


def _accent_tables() -> tuple[str, str]:
    """Every character of the basic plane whose compatibility decomposition, marks removed, is one ASCII character."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _accent_tables()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}+", "")


@F.pandas_udf(StringType())
def plain_text(s: pd.Series) -> pd.Series:
    """Entities resolved and accents stripped, for texts with any entity or compatibility character."""
    def one(x):
        if x is None or (x.isascii() and "&" not in x):
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", html.unescape(x)) if not unicodedata.combining(c))
    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def tidy_text(s: pd.Series) -> pd.Series:
    """Entities resolved, white space collapsed, nothing left gives null."""
    def one(x):
        if x is None:
            return None
        return " ".join((html.unescape(x) if "&" in x else x).split()) or None
    return s.map(one)


def norm_title(c: Column) -> Column:
    """Entities, accents, case, tags and punctuation removed; single spaces."""
    t = F.regexp_replace(F.lower(plain_text(c)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def short_id(c: Column) -> Column:
    """Last path segment of an id given as a URL."""
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


@F.pandas_udf(StringType())
def abstract_from_positions(inverted: pd.Series) -> pd.Series:
    """Text from a map of word -> positions: tags and entities out, white space collapsed, nothing left gives null."""
    def one(m):
        if not m:
            return None
        pairs = sorted((p, w) for w, at in (m.items() if isinstance(m, dict) else m) for p in at)
        text = html.unescape(re.sub("<[^>]+>", " ", " ".join(w for _, w in pairs)))
        return " ".join(text.split()) or None
    return inverted.map(one)


def word_positions(docs: DataFrame, key: str) -> DataFrame:
    """(key, inv): word -> ascending positions of every text that has words. `docs`: key, words. A key that comes once, the rule, is inverted in the
    task that reads it, so its words are not shuffled; only words of keys that come several times, or are null, are brought together."""
    often = cut_lineage(docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, inv map<string,array<int>>"
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))

    def invert(words: list[str]) -> list[tuple[str, list[int]]]:
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        return list(at.items())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([invert(w) for w in part.column(1).to_pylist()], kind)], [key, "inv"])
    one = docs.filter(F.col(key).isNotNull() & (F.size("words") > 0)).join(often, key, "left_anti").select(key, "words").mapInArrow(run, schema)
    many = docs.join(often, key, "left_semi").select(key, "words").unionByName(docs.filter(F.col(key).isNull()).select(key, "words"))
    many = (many.select(key, F.posexplode("words").alias("pos", "word")).groupBy(key, "word").agg(F.sort_array(F.collect_list("pos")).alias("p"))
            .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "p"))).alias("inv")).filter(F.size("inv") > 0))
    return one.unionByName(many)


def doi_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^https?://(dx\.)?doi\.org/", ""))


def doi_link(c: Column) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://doi.org/"), c))


def embedding_text(title: Column, abstract: Column, sep: str = "[SEP]") -> Column:
    return F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(title, F.lit(sep), abstract)).otherwise(title)


def http_verdict(status: Column) -> Column:
    # fixed values: statuses that mean "ask a person", not "gone"
    return (F.when(status.isNull(), "unreachable").when(status < 400, "ok")
            .when(status.isin(401, 403, 405, 429, 503), "blocked").otherwise("broken"))


def citation_title(c: Column) -> Column:
    """Best-effort title of a free-text citation: the first of six shapes that fits, else its first 300 characters."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    n = F.length(s)
    quoted = F.regexp_extract(s, r'["“”](.{20,}?)["“”]', 1)
    slash = F.substring_index(s, " / ", 1)
    star = F.regexp_extract(s, r"^.*?\*\.\s+(?=[A-Z0-9])(.*)$", 1)
    star_at = F.length(F.regexp_extract(s, r"^(.*?\*\.\s+)(?=[A-Z0-9])", 1))
    year_head = F.regexp_extract(s, r"^(.*?)\((?:19|20)\d{2}[a-z]?\)\.?\s*", 1)
    year_all = F.regexp_extract(s, r"^(.*?\((?:19|20)\d{2}[a-z]?\)\.?\s*)", 1)
    year_rest = F.substr(s, F.length(year_all) + 1)
    tail_year = F.regexp_extract(s, r"^(.*?),\s*(?:19|20)\d{2}\s*,[^,]*$", 1)
    closing = F.regexp_extract(s, r"^(.*?)\((?:19|20)\d{2}\s*\)\s*$", 1)
    fields = F.split(closing, ", ")
    first = lambda x: F.element_at(F.split(x, r"(?<=[a-z0-9\)])\.\s+(?=[A-Z])", 2), 1)
    head = F.array_join(F.slice(fields, F.lit(1), F.greatest(F.size(fields) - 4, F.lit(1))), ", ")
    strip = lambda x, chars: F.trim(x, F.lit(chars))
    return (F.when(quoted != "", strip(quoted, " .,"))
            .when(s.contains(" / ") & (F.length(slash) >= 20), strip(slash, " ."))
            .when((star != "") & (star_at < n - 15), strip(first(star), " ."))
            .when((year_all != "") & (F.length(year_head) > 10) & (F.length(year_all) < n - 15), strip(first(year_rest), " ."))
            .when(tail_year != "", strip(tail_year, " .,"))
            .when((closing != "") & (F.size(fields) >= 5), strip(head, " .,"))
            .otherwise(F.substring(s, 1, 300)))
