"""Recommendation, bridges between anchors, facets and comparisons, as batch jobs over many queries at once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinor.operators import vectors as V
from affinor.operators.ranking import rnd, top_k

UNRELIABLE = ("mixed_topics", "wrong_field")  # fixed values: reasons that make an entity's vector unusable


def reliable(entities: DataFrame, reason: str = "unreliable") -> DataFrame:
    return entities.filter(F.col(reason).isNull() | ~F.col(reason).isin(*UNRELIABLE))


def passes_facets(single: dict[str, list], multi: dict[str, list]) -> Column:
    """OR inside a facet, AND across facets; an empty choice admits everything."""
    tests = [F.col(c).isin(*v) for c, v in single.items() if v]
    tests += [F.arrays_overlap(F.col(c), F.array(*[F.lit(x).cast("long") for x in v])) for c, v in multi.items() if v]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def recommend(vectors: DataFrame, seeds: DataFrame, k: int, other_fields: bool = False) -> DataFrame:
    """For every query (a set of seed entities): the k reliable entities nearest to the seeds' unit mean, seeds left out,
    each with its nearest seed. With `other_fields`, only entities that share no field with any seed.

    `vectors`: entity, v, mask, unreliable; `seeds`: query, entity (a hand-sized list per query). All queries run as one
    tiled job."""
    s = seeds.join(vectors.select("entity", "v", "mask"), "entity")
    per = s.groupBy("query").agg(F.collect_set("entity").alias("skip"), F.bit_or("mask").alias("mask"))
    q = V.unit_means(s, ["query"]).join(per, "query").select(F.col("query").alias("id"), "v", "skip", "mask")
    targets = reliable(vectors).select(F.col("entity").alias("id"), "v", "mask")
    best = V.top_matches(q, targets, k, disjoint=other_fields).select(F.col("i").alias("query"), F.col("j").alias("entity"), F.col("sim").alias("score"), "rank")
    # k rows per query meet that query's few seeds
    pairs = (best.join(s.select("query", F.col("entity").alias("seed"), F.col("v").alias("sv")), "query")
             .join(vectors.select("entity", "v"), "entity").withColumn("to_seed", F.round(V.dot("v", "sv"), 9)))
    near = pairs.groupBy("query", "entity", "rank", "score").agg(
        F.max_by("seed", F.struct("to_seed", -F.col("seed"))).alias("nearest_seed"), F.max("to_seed").alias("nearest_sim"))
    return near.select("query", "entity", "rank", rnd("score").alias("score"), "nearest_seed", rnd("nearest_sim").alias("nearest_sim"))


def bridge(vectors: DataFrame, anchors: DataFrame, k: int, outside: bool = False) -> DataFrame:
    """For every query with two anchors A and B (sets of entities): the k reliable entities with the largest smaller
    similarity to the two unit means. A single-entity anchor is left out, with `outside` every anchor member is.

    `anchors`: query, side ('a' or 'b'), entity. The two means are compared with the entities inside bounded tiles; only the
    k best per tile and query leave it."""
    import numpy as np
    m = anchors.join(vectors.select("entity", "v"), "entity")
    num = m.withColumn("anchor", F.col("query") * 2 + F.when(F.col("side") == "b", 1).otherwise(0))
    means = V.unit_means(num, ["anchor"])
    wide = means.select((F.floor(F.col("anchor") / 2)).cast("long").alias("id"), (F.col("anchor") % 2).alias("s"), "v")
    q = (wide.filter("s = 0").select("id", "v").join(wide.filter("s = 1").select("id", F.col("v").alias("vb")), "id"))
    size = anchors.groupBy("query", "side").agg(F.countDistinct("entity").alias("n"))
    drop = anchors.distinct() if outside else anchors.join(size.filter("n = 1").select("query", "side"), ["query", "side"], "left_semi").distinct()
    targets = reliable(vectors).select(F.col("entity").alias("id"), "v")

    # the mean of A is the tile's left vector, the mean of B rides along
    def fn(t: V.Tile):
        vb = np.array(t.left_list("vb"), dtype=float)
        to_b = np.round(vb @ t.right_matrix().T, 9)
        ok = t.ok.copy()
        for c, gone in enumerate(t.right_list("gone")):
            if gone:
                ok[np.isin(t.i, gone), c] = False
        i, j, s = V._best(t, k, "best", ok, raw=np.minimum(t.sim, to_b))
        row = {x: n for n, x in enumerate(t.i)}
        col = {x: n for n, x in enumerate(t.j)}
        r, c = np.array([row[x] for x in i], dtype=int), np.array([col[x] for x in j], dtype=int)
        return {"query": i, "entity": j, "score": s, "to_a": t.sim[r, c] if len(i) else s, "to_b": to_b[r, c] if len(i) else s}
    # a target carries the queries it must not appear in
    gone = drop.groupBy(F.col("entity").alias("id")).agg(F.collect_set("query").alias("gone"))
    cand = V.tile_map(q, fn, "query long, entity long, score double, to_a double, to_b double",
                      right=targets.join(gone, "id", "left"), carry=["vb", "gone"])
    out = top_k(cand, ["query"], [F.col("score").desc(), F.col("entity")], k)
    lean = F.col("to_a") - F.col("to_b")
    return out.select("query", "entity", "rank", rnd("to_a").alias("to_a"), rnd("to_b").alias("to_b"),
                      F.when(F.abs(lean) < 0.01, "both").when(lean > 0, "a").otherwise("b").alias("lean"),
                      rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - lean / 0.08)), 4).alias("position"))


def anchor_topics(share: DataFrame, anchors: DataFrame) -> DataFrame:
    """Mean topic share over the members of each anchor."""
    n = anchors.groupBy("query", "side").agg(F.countDistinct("entity").alias("members"))
    return (anchors.join(share.select("entity", "topic", "share"), "entity").groupBy("query", "side", "topic").agg(F.sum("share").alias("s"))
            .join(n, ["query", "side"]).select("query", "side", "topic", (F.col("s") / F.col("members")).alias("share")))


def chosen_set(spark: SparkSession, ids: list[int], entities: DataFrame, n: int) -> DataFrame:
    """First n known ids of a hand-made list, in order, repeats and unknown ids dropped."""
    rows = spark.createDataFrame(list(enumerate(ids)), "pos int, entity long")
    known = rows.groupBy("entity").agg(F.min("pos").alias("pos")).join(entities, "entity", "left_semi")
    return known.orderBy("pos").limit(n)


def compare(chosen: DataFrame, adjacency: DataFrame, home: DataFrame) -> DataFrame:
    """Every ordered pair of the (at most four) chosen entities with its link. The pairs come from the short list itself."""
    lst = chosen.agg(F.collect_list("entity").alias("l"))
    pairs = (lst.select(F.explode("l").alias("entity"), "l").select("entity", F.explode("l").alias("other")).filter("entity <> other"))
    mine = home.join(F.broadcast(chosen.select("entity")), "entity", "left_semi")
    co = (mine.alias("a").join(mine.select("item", F.col("entity").alias("other")), "item").filter("entity <> other")
          .groupBy("entity", "other").agg(F.count("*").alias("items")))
    sim = adjacency.select("entity", "other", F.lit(True).alias("similar"))
    j = pairs.join(sim, ["entity", "other"], "left").join(co, ["entity", "other"], "left")
    s, c = F.col("similar").isNotNull(), F.col("items").isNotNull()
    return j.select("entity", "other", F.when(s & c, "similar, shared items").when(s, "similar").when(c, "shared items").otherwise("none").alias("link"),
                    F.coalesce("items", F.lit(0)).alias("items"))
