"""Fields and links of raw web pages, in one job over the page table."""
from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from affinor.functions.text import tidy_text

ORCID = r"(?i)orcid\.org/(\d{4}-\d{4}-\d{4}-\d{3}[\dX])"
# one start per run of characters and a bounded number of labels: Java repeats a group by recursion
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,}"


def title(html: Column) -> Column:
    return tidy_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def orcid(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, ORCID, 1)), F.lit(""))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)), lambda e: F.lower(e)))


@F.pandas_udf(StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute form of a link on a page; links that lead nowhere (mail, phone, script, fragment) give null."""
    def one(b, h):
        h = (h or "").strip()
        if not h or h.startswith(("mailto:", "tel:", "javascript:", "#")):
            return None
        try:
            return urljoin(b, "http://" + h if h.startswith("www.") else h)
        except ValueError:
            return None
    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): first occurrence of every absolute link of a page."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return (found.withColumn("link", absolute("url", "href")).filter("link IS NOT NULL")
            .groupBy("page_id", "link").agg(F.min("pos").alias("pos")))


class _Cells(HTMLParser):
    """Text of every element of one tag, nested markup included."""

    def __init__(self, tag: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.depth, self.out = tag, 0, []

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            if self.depth == 0:
                self.out.append([])
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.out[-1].append(data)


def element_texts(tag: str):
    """Arrow function: texts of all elements with a tag, white space collapsed, empty ones left out."""
    @F.pandas_udf(ArrayType(StringType()))
    def run(html: pd.Series) -> pd.Series:
        def one(h):
            p = _Cells(tag)
            p.feed(h or "")
            texts = (" ".join("".join(x).split()) for x in p.out)
            return [t for t in texts if t]
        return html.map(one)
    return run


def assemble_people(listing: DataFrame, detail: DataFrame, second: DataFrame) -> DataFrame:
    """One person row from a list page, a detail page (its values first) and a second-language list matched by e-mail.
    Rows of the same page id or the same pair of names are kept once, the smallest page first."""
    j = (listing.join(detail, "page_id", "left").join(second, "email", "left")
         .select("page_id", "email", "name", "name_second", F.coalesce("detail_title", "title").alias("title")))
    return j.groupBy("name", "name_second").agg(F.min(F.struct("page_id", "email", "title")).alias("r")).select(
        "r.page_id", "r.email", "name", "name_second", "r.title")


def drop_groups(rows: DataFrame, group: str, bad: Column) -> DataFrame:
    """Leave out every row of a group that holds a disqualifying row."""
    return rows.join(rows.filter(bad).select(group).distinct(), group, "left_anti")
