"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all rates r_d in [0, cap], take those nearest to 1 in relative entropy, sum(r ln r - r), that give every source its target of
words: sum(size_d r_d) = T. The dual has one multiplier per source and is convex; its solution tilts documents exponentially,
r_d = min(cap, exp(lam * size_d / mean)), with mean the source's mean size. Newton steps, kept inside a shrinking bracket, solve
it: each iteration is one grouped aggregate over the (source, size) histogram, which stands for all documents exactly, and writes
one row per source. Nothing but a count of unsolved sources reaches the driver.

Rates are rounded into copies: everyone gets floor(r); the rest r - floor(r) orders candidates by hash(doc_id) / rest, and the
source takes them in that order up to the point nearest to its target. The order is never built for a source as a whole: sums per
band of the order find the band where the target is met, and only that band's rows are ranked.

Defined cases: a null text has no words and is never taken; a null source is a source of its own, the last; a source without words
has target 0; repeated rows count and are taken one by one; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinor.llm.common import few_or_shuffled, spare, unit_hash
from affinor.operators.ranking import distributed_rank
from affinor.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
BANDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a reproducible number in [0, 1) per document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       unit_hash("doc_id").alias("u"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sid, source, source_size, docs, target. A target is min(cap * size, level * weight); the level rises until all words are
    shared out. Every pass fixes the sources that reach their cap, so the level is exact when no more do."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = distributed_rank(sums.select("*", F.lit(0).alias("_all")), ["_all"], [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    src = cut_lineage(ranked.select("sid", "source", "source_size", "docs", w.alias("w")))
    full = cap * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        hit = F.col("w") * level >= full
        r = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(hit, full)), F.lit(0)),
                    F.coalesce(F.sum(F.when(~hit, F.col("w"))), F.lit(0.0)), F.count(F.when(hit, 1))).first()
        if r[3] == capped or r[2] == 0:
            break
        capped, level = r[3], (r[0] - r[1]) / r[2]
    return src.select("sid", "source", "source_size", "docs", F.least(full.cast("double"), F.col("w") * level).alias("target"))


def tilt(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    """The rate of a document; the exponent is bounded first, as rates beyond the cap are cut anyway."""
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * size / mean, F.lit(50.0))))


def solve_tilts(rows: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = 1e-9, limit: int = 200) -> DataFrame:
    """lam per source. Sources at their cap need none (every rate is the cap: lam is null), nor do those without words."""
    hist = cut_lineage(rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
                       .join(targets.select("sid", F.col("source").alias("_s"), "target", "source_size", "docs"),
                             F.col("source").eqNullSafe(F.col("_s")))
                       .filter(F.col("target") < cap * F.col("source_size"))
                       .select("sid", "size", "n", "target", (F.col("source_size") / F.col("docs")).alias("mean")))
    # size >= 1 bounds the multiplier: above mean * ln(cap) all rates are at the cap, below mean * ln(T / S) the sum is under T
    state = cut_lineage(hist.groupBy("sid").agg(F.first("target").alias("target"), F.first("mean").alias("mean"), F.sum(F.col("n") * F.col("size")).alias("s"))
                        .select("sid", "target", "mean", F.lit(0.0).alias("lam"), F.least(F.lit(0.0), F.col("mean") * F.log(F.col("target") / F.col("s"))).alias("lo"),
                                (F.col("mean") * F.log(F.lit(float(cap)))).alias("hi"), F.lit(False).alias("solved")))
    for _ in range(limit):
        if state.filter(~F.col("solved")).isEmpty():
            return state.select("sid", "mean", F.round("lam", 9).alias("lam"))
        h = hist.select("sid", "size", "n").join(state.filter(~F.col("solved")), "sid")
        rate = tilt(F.col("lam"), F.col("size"), F.col("mean"), cap)
        words = F.col("n") * F.col("size") * rate
        g = h.groupBy("sid").agg(F.sum(words).alias("got"), F.sum(F.when(rate < cap, words * F.col("size") / F.col("mean"))).alias("slope"))
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        done = F.coalesce(F.abs(gap) <= tolerance * F.col("target"), F.lit(False)) | (hi - lo <= 1e-12 * (1 + F.abs(hi)))
        moved = state.join(g, "sid", "left").select(
            "sid", "target", "mean",
            F.when(F.col("solved") | done, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), (F.col("solved") | done).alias("solved"))
        state = cut_lineage(moved)
    raise RuntimeError(f"the dual was not solved in {limit} iterations")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, and source, rate, copies for every document."""
    rows = cut_lineage(sized(docs))
    targets = cut_lineage(source_targets(rows, weights, cap))
    lam = solve_tilts(rows, targets, cap)
    per_source = targets.join(lam, "sid", "left").select("sid", F.col("source").alias("_s"), "source_size", "target", "mean", "lam")
    size = F.col("size")
    rate = (F.when((size == 0) | (F.col("target") == 0), 0.0).when(F.col("lam").isNull(), float(cap))
            .otherwise(tilt(F.col("lam"), size, F.col("mean"), cap)))
    # a hot source is joined to one small row; adaptive execution broadcasts it or splits the hot side
    rated = rows.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    rest = F.col("rate") - F.floor("rate")
    order = F.when(rest > 0, (F.col("u") / rest) / (1 + F.col("u") / rest))
    rated = cut_lineage(rated.select("sid", "doc_id", "source", "size", "source_size", "target", "rate", F.floor("rate").alias("base"), order.alias("k"),
                                     F.floor(order * BANDS).cast("int").alias("band")))
    base = rated.groupBy("sid").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    w = Window.partitionBy("sid").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # at most BANDS rows per source
    bands = (rated.filter(F.col("band").isNotNull()).groupBy("sid", "band").agg(F.sum("size").alias("words"))
             .withColumn("upto", F.sum("words").over(w)))
    edge = (bands.join(base, "sid").filter(F.col("upto") > F.col("need")).groupBy("sid")
            .agg(F.min(F.struct("band", (F.col("upto") - F.col("words")).alias("before"), "need")).alias("e"))
            .select("sid", F.col("e.band").alias("edge"), F.col("e.before").alias("before"), F.col("e.need").alias("need")))
    cut = rated.join(few_or_shuffled(cut_lineage(edge)), "sid", "left")  # one row per source
    inside = Window.partitionBy("sid").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = (cut.filter(F.col("band") == F.col("edge"))
            .withColumn("run", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .withColumn("more", (F.col("run") + F.col("size") / 2 <= F.col("need")).cast("int")).drop("run"))
    far = cut.filter((F.col("band") != F.col("edge")) | F.col("band").isNull() | F.col("edge").isNull()).withColumn(
        "more", F.coalesce((F.col("band") < F.coalesce("edge", F.lit(BANDS + 1))).cast("int"), F.lit(0)))
    copies = F.col("base") + F.col("more")
    return far.unionByName(near).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", "rate", copies.alias("copies"))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it has copies. Rows that share an id share out the copies of that id in text order.
    Copies are broadcast while they are few; beyond that both sides are shuffled by id."""
    key, total, rows, copies, copy = spare(docs, "_id", "_sum", "_rows", "_copies", "_copy")
    per_id = cut_lineage(mixed.groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)))
    joined = docs.join(few_or_shuffled(per_id), F.col("doc_id").eqNullSafe(F.col(key)))
    if per_id.filter(F.col(rows) > 1).isEmpty():
        share = F.col(total)
    else:
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        share = F.floor(F.col(total) * n / F.col(rows)) - F.floor(F.col(total) * (n - 1) / F.col(rows))
    return (joined.withColumn(copies, share.cast("int")).filter(F.col(copies) > 0)
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns))
