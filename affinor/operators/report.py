"""Reports over the pipeline's tables: funnel, reasons, coverage, empty fields, batches, samples, links, vocabulary."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.functions.fuzzy import stretch_edits
from affinor.functions.text import http_verdict
from affinor.operators.ranking import distributed_rank, rnd, top_k
from affinor.session import cut_lineage

GRAM = 6  # characters that a segment of a title has at least
ANCHOR = 7  # characters of a segment by which titles meet citations, if it has as many


def funnel(facts: dict[str, DataFrame], dim: DataFrame, key: str) -> DataFrame:
    """One count per fact table and department, with a total row (key null). Each frame in `facts` has the key."""
    parts = [df.groupBy(key).agg(F.count("*").alias(name)) for name, df in facts.items()]
    j = reduce(lambda a, b: a.join(b, key, "left"), parts, dim.select(key)).fillna(0, list(facts))
    return j.rollup(key).agg(*[F.sum(n).alias(n) for n in facts])


def reason_counts(excluded: DataFrame, key: str) -> DataFrame:
    """Count by reason overall (key null) and by department and reason."""
    return excluded.groupingSets([["reason"], [key, "reason"]], key, "reason").agg(F.count("*").alias("n"))


def coverage(memberships: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct items of kept entities: all, senior, with abstract, with summary, in the analysis set."""
    per = memberships.groupBy("item").agg(F.max("senior").alias("senior"), F.max("at_home").alias("home"))
    a, t = F.col("abstract").isNotNull(), F.col("tldr").isNotNull()
    return per.join(items.select("item", "abstract", "tldr"), "item").agg(
        F.count("*").alias("items"), F.count_if(a).alias("with_abstract"), F.count_if("senior").alias("senior_items"),
        F.count_if(F.col("senior") & a).alias("senior_with_abstract"), F.count_if(t).alias("with_tldr"),
        F.count_if("home").alias("analysis_items"), F.count_if(F.col("home") & a).alias("analysis_with_abstract"))


def empty_fields(df: DataFrame, columns: list[str], short: dict[str, int] | None = None) -> DataFrame:
    """(field, n, empty, share): rows where a column is null, '' or []; `short` counts arrays below a length as well."""
    types = dict(df.dtypes)

    def test(c: str) -> Column:
        e = F.col(c).isNull()
        if types[c] == "string":
            return e | (F.col(c) == "")
        return e | (F.size(c) == 0) if types[c].startswith("array") else e
    tests = {c: test(c) for c in columns} | {f"{c} (<{n})": F.coalesce(F.size(c), F.lit(0)) < n for c, n in (short or {}).items()}
    flags = df.agg(F.count("*").alias("n"), *[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"c{i}").alias("empty")) for i, k in enumerate(tests)]))
    return flags.select("n", rows.alias("r")).select("r.field", "n", "r.empty", rnd(F.try_divide("r.empty", "n"), 4).alias("share"))


def batches(df: DataFrame, order: list, size: int) -> DataFrame:
    """Numbered batches of `size` rows in a fixed order over the whole table."""
    return distributed_rank(df, [], order).withColumn("batch", F.floor((F.col("rank") - 1) / size))


def spread_sample(df: DataFrame, order: list, limit: int) -> DataFrame:
    """Every (N / limit)-th row of the ordered table, at most `limit`."""
    step = df.agg(F.greatest(F.floor(F.count("*") / limit), F.lit(1))).scalar()
    r = distributed_rank(df, [], order).withColumn("step", step)
    return r.filter(((F.col("rank") - 1) % F.col("step") == 0) & ((F.col("rank") - 1) / F.col("step") < limit)).drop("step", "rank")


def seeded_sample(df: DataFrame, id: str, seed: int, n: int) -> DataFrame:
    """n rows in an order fixed by the seed."""
    return df.withColumn("_h", (F.col(id) * 7919 + seed * 104729) % 1000003).orderBy("_h", id).limit(n).drop("_h")


def link_targets(parts: list[DataFrame]) -> DataFrame:
    """First place of every (kind, target). Each part: kind, target, place, with parts in order of precedence."""
    tagged = [p.select("kind", "target", "place", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    u = reduce(DataFrame.unionByName, tagged).filter(F.coalesce("target", F.lit("")) != "")
    return u.groupBy("kind", "target").agg(F.min(F.struct("part", "place")).alias("f")).select("kind", "target", F.col("f.place").alias("place"))


def link_verdicts(checked: DataFrame) -> DataFrame:
    return checked.withColumn("verdict", http_verdict(F.col("status"))).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def existing(targets: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Found / missing against a landed id list."""
    return targets.join(found.select(key, F.lit(True).alias("found")).distinct(), key, "left").withColumn("found", F.col("found").isNotNull())


def vocabulary(columns: list[DataFrame]) -> DataFrame:
    """Distinct non-empty terms of several one-column frames (arrays are spread)."""
    flat = [d.select(F.explode(d.columns[0]).alias("term")) if d.dtypes[0][1].startswith("array") else d.toDF("term") for d in columns]
    # each source is made distinct first, so repeated terms do not travel
    return reduce(DataFrame.union, [d.filter("term <> ''").distinct() for d in flat]).distinct()


def coverage_gaps(entities: DataFrame, shown: DataFrame, have: DataFrame, fields: str = "fields") -> DataFrame:
    """Per field: shown items and how many of them have no summary; fields without a gap are left out."""
    s = shown.join(have.select("item", F.lit(True).alias("has")).distinct(), "item", "left")
    f = entities.select("entity", F.explode(fields).alias("field"))
    return (s.join(f, "entity").groupBy("field").agg(F.count("*").alias("shown"), F.count_if(F.col("has").isNull()).alias("missing"))
            .filter("missing > 0"))


def append_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def exact_runs(citations: DataFrame, items: DataFrame, min_cite: int, min_title: int) -> DataFrame:
    """(person, citation, item) where the item's normalised title stands in the citation as a run of whole words.

    Titles meet citations by equality: a citation is cut into its word runs of the lengths titles have, so no citation is
    compared with titles that only start alike."""
    t = items.filter(F.length("norm") >= min_title).select("item", F.col("norm").alias("run"))
    lengths = t.agg(F.collect_set(F.size(F.split("run", " "))).alias("l")).scalar()  # the few word counts titles have
    c = citations.filter(F.length("norm") >= min_cite).withColumn("w", F.split("norm", " ")).withColumn("n", F.explode(lengths))
    runs = (c.filter(F.size("w") >= F.col("n")).select("person", "citation", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
            .select("person", "citation", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("run"))
            .filter(F.length("run") >= min_title))
    return runs.join(t, "run").select("person", "citation", "item")


def anchors(df: DataFrame, text: str, n: int, size: int, *keep: str) -> DataFrame:
    """Every run of n characters of a text, with what stands in front of it and behind it as far as segments of `size` can reach."""
    at = df.filter(F.length(text) >= n).select(*keep, text, F.explode(F.sequence(F.lit(1), F.length(text) - n + 1)).alias("at"))
    low = F.greatest(F.lit(1), F.col("at") - 3 * size)
    return at.select(*keep, F.substring(text, F.col("at"), F.lit(n)).alias("anchor"), F.substring(text, low, F.col("at") - low).alias("front"),
                     F.substring(text, F.col("at") + n, F.lit(size + 1)).alias("back"))


def segments(titles: DataFrame) -> DataFrame:
    """The k + 1 segments of every title: `anchor` are the last characters of one and `head` those in front of them; `next`, `prev` and `prev2`
    are the segments behind it and in front of it, empty where there is none."""
    size, n = F.length("title"), F.col("k") + 1
    edge = lambda i: F.floor(size * i / n).cast("int")
    cut = lambda i: F.when((i >= 0) & (i < n), F.substring("title", edge(i) + 1, edge(i + 1) - edge(i))).otherwise("")
    i = F.col("i")
    s = titles.select("tid", "title", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select(
        "tid", "k", "i", cut(i).alias("part"), cut(i + 1).alias("next"), cut(i - 1).alias("prev"), cut(i - 2).alias("prev2"))
    w = F.least(F.lit(ANCHOR), F.length("part"))
    # a title without errors allowed is one segment of any length, of which the anchor will do
    return s.select("tid", "k", "i", "next", "prev", "prev2", w.alias("w"), F.substring("part", F.length("part") - w + 1, w).alias("anchor"),
                    F.when(F.col("k") == 0, "").otherwise(F.substring("part", F.lit(1), F.length("part") - w)).alias("head"))


def may_match() -> Column:
    """Whether a segment found in a citation can be the one that every match has. If k + 1 segments take k edits, then one of them takes none
    and the next one at most one; or, where that holds nowhere, the last takes none and the one before it one, or two with none in the one
    before that. A segment with one edit has a half without, at most one character off its place."""
    front, back, head = F.col("front"), F.col("back"), F.col("head")
    nxt, prev, prev2 = F.col("next"), F.col("prev"), F.col("prev2")
    before = F.substring(front, F.lit(1), F.length(front) - F.length(head))
    tail = lambda n: F.substring(before, F.greatest(F.lit(1), F.length(before) - n + 1), n)

    def halves(c: Column) -> tuple[Column, Column]:
        h = F.floor(F.length(c) / 2).cast("int")
        return F.substring(c, F.lit(1), h), F.substring(c, h + 1, F.length(c))
    (a, b), (c, d) = halves(nxt), halves(prev)
    low = F.greatest(F.lit(1), F.length(a))
    right = F.startswith(back, a) | F.contains(F.substring(back, low, F.length(nxt) + 2 - low), b)
    left = (F.endswith(before, d) | F.contains(tail(F.length(prev) + 1), c)
            | ((prev2 != "") & F.contains(tail(F.length(prev) + F.length(prev2) + 2), prev2)))
    return F.endswith(front, head) & F.when(F.col("k") == 0, True).when(F.col("i") == F.col("k"), left).otherwise(right)


def fuzzy_titles(citations: DataFrame, items: DataFrame, min_cite: int, min_title: int, similarity: int) -> DataFrame:
    """(norm, item, edits): citation texts and the titles that some stretch of them is up to (100 - similarity) per cent of its characters.

    With k edits allowed, a title falls into k + 1 segments, of which one at least is found unchanged in the citation with little changed beside
    it (see `may_match`). Titles meet citations by the end of that segment; a pair that can match travels on as two numbers, its texts are
    joined to it for the verification. Equal titles and equal citations are looked up once."""
    text = items.filter(F.length("norm") >= min_title).groupBy(F.col("norm").alias("title")).agg(F.min("item").alias("item"))
    text = text.withColumn("k", F.floor(F.length("title") * (100 - similarity) / 100).cast("int")).filter(F.length("title") >= GRAM * (F.col("k") + 1))
    # texts of the same number are verified one by one, so the numbers need not be unique
    text = cut_lineage(text.withColumn("tid", F.xxhash64("title")))
    cited = cut_lineage(citations.filter(F.length("norm") >= min_cite).select("norm").distinct().withColumn("cid", F.xxhash64("norm")))
    parts = cut_lineage(segments(text))
    size = math.ceil(100 / max(1, 100 - similarity))  # of the longest segment
    found = []
    for n in range(GRAM, ANCHOR + 1):
        # few titles have shorter segments; they are written by themselves, so that the optimiser knows how few
        looked = parts.filter(F.col("w") == n) if n == ANCHOR else cut_lineage(parts.filter(F.col("w") == n))
        if not looked.isEmpty():
            found.append(looked.join(anchors(cited, "norm", n, size, "cid"), "anchor").filter(may_match()).select("tid", "cid"))
    if not found:
        return text.select(F.col("title").alias("norm"), "item", F.lit(0).alias("edits")).limit(0)
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return (pairs.join(text, "tid").join(cited, "cid").withColumn("edits", stretch_edits("title", "norm")).filter(F.col("edits") <= F.col("k"))
            .select("norm", "item", "edits"))


def fuzzy_runs(citations: DataFrame, items: DataFrame, min_cite: int, min_title: int, similarity: int) -> DataFrame:
    """(person, citation, item, edits) where some stretch of the citation is the title up to (100 - similarity) per cent of its characters."""
    near = fuzzy_titles(citations, items, min_cite, min_title, similarity)
    return citations.select("person", "citation", "norm").distinct().join(near, "norm").select("person", "citation", "item", "edits")


def anchor_hits(citations: DataFrame, items: DataFrame, authors: DataFrame, min_cite: int = 15, min_title: int = 20, similarity: int | None = None) -> DataFrame:
    """(person, author, hits): authors of the items a person's citations name. An item is taken when its normalised title stands in the
    citation as a run of whole words, or, with a `similarity` in per cent, when it is that similar to a stretch of the citation. One item per
    citation counts: the one with the fewest edits, of equals the first. `citations`: person, citation, norm; `items`: item, norm."""
    # of equal titles only the first item can count
    titles = items.groupBy("norm").agg(F.min(F.struct("item")).alias("i")).select("norm", "i.item")
    hit = exact_runs(citations, titles, min_cite, min_title).withColumn("edits", F.lit(0))
    if similarity is not None:
        near = fuzzy_titles(citations, items, min_cite, min_title, similarity).groupBy("norm").agg(F.min(F.struct("edits", "item")).alias("n"))
        hit = hit.unionByName(citations.join(near, "norm").select("person", "citation", F.col("n.item").alias("item"), F.col("n.edits").alias("edits")))
    first = hit.groupBy("person", "citation").agg(F.min(F.struct("edits", "item")).alias("h")).select("person", F.col("h.item").alias("item"))
    return first.join(authors, "item").groupBy("person", "author").agg(F.count("*").alias("hits"))
