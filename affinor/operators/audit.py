"""How far the similarity can be trusted: stability under resampling, agreement with other signals, hubs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.operators import vectors as V
from affinor.operators.ranking import distributed_rank, grouped_quantiles, rnd, top_k
from affinor.rules import SIZE_BINS
from affinor.session import cut_lineage

MOD = 1000003


def hash_order(a: Column, b: Column) -> Column:
    """Arithmetic pseudo-random order any engine can repeat."""
    return (a * 7919 + b * 104729) % MOD


def size_bin(n: str) -> Column:
    out = None
    for label, lo, hi in SIZE_BINS:
        c = F.col(n).between(lo, hi)
        out = F.when(c, label) if out is None else out.when(c, label)
    return out


def split_half(members: DataFrame, vectors: DataFrame, repeats: int, min_items: int = 4) -> DataFrame:
    """(entity, rep, n, rank): rank of an entity's own other half among all entities, for vectors of two random halves.

    `members`: entity, item, cites, v. Halves are exact: items are ranked by hash within (rep, entity) by the distributed
    rank, so an entity with very many items is never sorted in one task."""
    n = members.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= min_items)
    keyed = (members.select("entity", "item").join(n, "entity")
             .select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
             .withColumn("h", hash_order(F.col("item"), F.col("rep"))))
    r = distributed_rank(keyed, ["entity", "rep"], ["h", "item"]).select(
        "entity", "rep", "item", "n", F.when(F.col("rank") <= F.floor(F.col("n") / 2), 0).otherwise(1).alias("half"))
    halves = V.unit_means(members.join(r, ["entity", "item"]), ["entity", "rep", "half"], weight=V.citation_weight())
    a = halves.filter("half = 0").select("entity", "rep", "v")
    b = halves.filter("half = 1").select("entity", "rep", F.col("v").alias("vb"))
    q = cut_lineage(a.join(b, ["entity", "rep"]).select((F.col("entity") * repeats + F.col("rep")).alias("id"), "v",
                                                        F.col("entity").alias("own"), F.round(V.dot("v", "vb"), 9).alias("floor")))
    above = V.scores_above(q, vectors.select(F.col("entity").alias("id"), "v"))
    return (above.join(q.select(F.col("id").alias("i"), "own"), "i").join(n.withColumnRenamed("entity", "own"), "own")
            .select(F.col("own").alias("entity"), (F.col("i") % repeats).alias("rep"), "n", (F.col("above") + 1).alias("rank")))


def rank_shares(ranks: DataFrame, groups: list[tuple[str, Column]]) -> DataFrame:
    """(kind, grp, n, top1, top5) for several groupings of the ranks in one pass."""
    g = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("grp")) for k, c in groups]))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 3)
    return (ranks.select("*", g.alias("g")).groupBy("g.kind", "g.grp").agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(5).alias("top5")))


def bootstrap_vectors(members: DataFrame, repeats: int) -> DataFrame:
    """(entity, rep, v): vectors from items drawn with replacement, as many as the entity has. Each item row makes one draw per
    repeat, and drawn items enter with their multiplicity, so no list of an entity's items is ever built."""
    n = members.groupBy("entity").agg(F.count("*").alias("n"))
    idx = cut_lineage(distributed_rank(members.select("entity", "item"), ["entity"], ["item"]).join(n, "entity")
                      .select("entity", "item", "n", (F.col("rank") - 1).alias("idx")))
    draws = (idx.select("entity", "idx", "n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
             .withColumn("idx", (hash_order(F.col("idx"), F.col("rep")) + F.col("entity") * 31) % F.col("n"))
             .groupBy("entity", "rep", "idx").agg(F.count("*").alias("times")))
    rows = draws.join(idx.select("entity", "idx", "item"), ["entity", "idx"]).join(members, ["entity", "item"])
    return V.unit_means(rows, ["entity", "rep"], weight=V.citation_weight() * F.col("times"))


def kept_neighbours(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, kept): how many of the base neighbours of i appear again. `other` has the keys."""
    return other.join(base.select("i", "j"), ["i", "j"]).groupBy(*keys, "i").agg(F.count("*").alias("kept"))


def item_free_similarity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(source, target, sim): similarity of two entities with the items they share taken out of both, null where nothing is left
    on a side. Sums are linear, so only the shared items are read per edge: total minus shared, on each side."""
    w = V.citation_weight()
    tot = cut_lineage(V.vector_sums(members, ["entity"], "v", w).join(members.groupBy("entity").agg(F.count("*").alias("n")), "entity"))
    a = members.select(F.col("entity").alias("source"), "item", "cites", "v")
    shared = (edges.select("source", "target").join(a, "source")
              .join(members.select(F.col("entity").alias("target"), "item"), ["target", "item"]))
    cut = V.vector_sums(shared, ["source", "target"], "v", w).join(shared.groupBy("source", "target").agg(F.count("*").alias("m")), ["source", "target"])
    j = (cut.join(tot.select(F.col("entity").alias("source"), F.col("v").alias("va"), F.col("n").alias("na")), "source")
         .join(tot.select(F.col("entity").alias("target"), F.col("v").alias("vb"), F.col("n").alias("nb")), "target"))
    sub = lambda x: V.unit(F.zip_with(x, "v", lambda p, q: p - q))
    left = (F.col("na") > F.col("m")) & (F.col("nb") > F.col("m"))
    return j.select("source", "target", F.when(left, F.round(V.dot(sub("va"), sub("vb")), 9)).alias("sim"))


def median_percentile(values: DataFrame, vectors: DataFrame, baseline_within: list[str]) -> DataFrame:
    """One row: number of values, the median percentile of the values among all pair similarities, and that of all pairs that
    agree on some attributes. A percentile grows with its value, so the median of percentiles is the mean of the percentiles
    of the two middle values and only those few values are looked up."""
    q = grouped_quantiles(values, [], "sim", [0.5], bounds=True).select("n", F.col("q0_lo").alias("lo"), F.col("q0_hi").alias("hi"))
    b = V.pair_median(vectors, baseline_within).select(F.lit(0).alias("k"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    four = cut_lineage(q.withColumn("k", F.lit(0)).join(b, "k").drop("k"))
    ranks = V.pair_ranks(vectors, four.select(F.array_sort(F.array_distinct(F.array("lo", "hi", "blo", "bhi")))))
    pct = F.col("below") / F.col("total")
    m = ranks.agg(F.map_from_entries(F.collect_list(F.struct("value", pct.alias("p")))).alias("m"))
    f = four.withColumn("m", m.scalar())
    at = lambda c: F.col("m")[F.col(c)]
    return f.select(F.col("n").alias("pairs"), rnd((at("lo") + at("hi")) / 2, 4).alias("median_percentile"),
                    rnd((at("blo") + at("bhi")) / 2, 4).alias("baseline_percentile"))


def jaccard(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """Jaccard similarity of two entities' (at most 15) topics. `topics`: entity, list."""
    a = topics.select(F.col("entity").alias("i"), F.col("topics").alias("ta"))
    b = topics.select(F.col("entity").alias("j"), F.col("topics").alias("tb"))
    return (pairs.select("i", "j").join(a, "i").join(b, "j")
            .withColumn("jac", F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size(F.array_union("ta", "tb")), F.lit(1))))


def random_partners(entities: DataFrame, per_entity: int) -> DataFrame:
    """(i, j): distinct other entities picked by arithmetic on the entity's position in id order."""
    idx = cut_lineage(distributed_rank(entities.select("entity"), [], ["entity"]).select("entity", (F.col("rank") - 1).alias("p")))
    n = idx.agg(F.count("*").alias("n"))
    pick = (idx.withColumn("n", n.scalar()).select("*", F.explode(F.sequence(F.lit(1), F.lit(per_entity))).alias("r"))
            .withColumn("q", (F.col("p") + 1 + (F.col("p") * 7919 + F.col("r")) % (F.col("n") - 1)) % F.col("n")))
    return pick.join(idx.select(F.col("entity").alias("j"), F.col("p").alias("q")), "q").select(F.col("entity").alias("i"), "j")


def hubness(topk: DataFrame, sizes: DataFrame) -> DataFrame:
    """Largest in-degree, entities nobody lists, and the correlation of in-degree with log size."""
    indeg = topk.groupBy(F.col("j").alias("entity")).agg(F.count("*").alias("d"))
    j = sizes.join(indeg, "entity", "left").select("n_items", F.coalesce("d", F.lit(0)).alias("d"))
    return j.agg(F.max("d").alias("max_in"), F.count_if(F.col("d") == 0).alias("never"), rnd(F.corr(F.ln("n_items"), F.col("d").cast("double")), 4).alias("corr_log_size"))
