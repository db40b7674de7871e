"""Edges and what is read off them: adjacency, degree, level of detail, modularity, geometry, labels, evidence pairs."""
from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinor.functions.text import norm_title
from affinor.operators import vectors as V
from affinor.operators.ranking import distributed_rank, rnd
from affinor.operators.topics import class_tfidf, ordered_topics
from affinor.session import cut_lineage


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    a = edges.select(F.col("source").alias("entity"), F.col("target").alias("other"), *cols)
    return a.unionByName(edges.select(F.col("target").alias("entity"), F.col("source").alias("other"), *cols))


def adjacency(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Each edge under both ends; ends that are no known entity are dropped."""
    known = entities.select(F.col("entity").alias("other"))
    return both_ways(edges, "type", "sim").join(known, "other", "left_semi")


def visible(edges: DataFrame, entities: DataFrame, mode: str) -> DataFrame:
    """Edges of one type, or only those that cross fields, with both ends among the entities."""
    e = edges.filter(F.col("apart")) if mode == "cross" else edges.filter(F.col("type") == mode)
    return (e.join(entities.select(F.col("entity").alias("source")), "source", "left_semi")
            .join(entities.select(F.col("entity").alias("target")), "target", "left_semi"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).distinct().groupBy("entity").agg(F.count("*").alias("degree"))


def detail_ranks(entities: DataFrame, degrees: DataFrame) -> DataFrame:
    """Drawing order inside each cluster (no cluster = -1): degree, size, id; rank from 0, cluster size, share, hub flag."""
    e = (entities.join(degrees, "entity", "left")
         .select("entity", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "n_items", F.coalesce("degree", F.lit(0)).alias("degree")))
    r = distributed_rank(e, ["cluster"], [("degree",), ("n_items",), "entity"])
    n = e.groupBy("cluster").agg(F.count("*").alias("size"))
    return (r.join(n, "cluster").withColumn("rank", F.col("rank") - 1)
            .withColumn("share", rnd((F.col("rank") + 1) / F.col("size")))
            .withColumn("hub", (F.col("rank") == 0) & (F.col("size") >= 2)))


def drawn(ranks: DataFrame, total: DataFrame, area: float, zoom: float, area_per_entity: float = 7000) -> DataFrame:
    budget = F.lit(area / area_per_entity * max(zoom, 1.0) ** 2) / total.scalar()
    return ranks.filter((F.col("rank") == 0) | (F.col("share") <= budget))


def modularity(edges: DataFrame, partition: DataFrame, keys: tuple = (), resolution: float = 1.0, weight: str = "weight") -> DataFrame:
    """Sum over communities of L_c/m - resolution (d_c / 2m)^2. `edges` has source, target, weight (source <> target);
    `partition` has keys, node, community. Only sums per community and per node are shuffled."""
    k = list(keys)
    e = edges.select(*k, "source", "target", F.col(weight).alias("w"))
    a = partition.select(*k, F.col("node").alias("source"), F.col("community").alias("ca"))
    b = partition.select(*k, F.col("node").alias("target"), F.col("community").alias("cb"))
    j = e.join(a, [*k, "source"]).join(b, [*k, "target"])
    ends = F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("ca") == F.col("cb")), F.struct(F.col("cb").alias("c"), F.lit(False))))
    per = (j.select(*k, "w", ends.alias("x")).groupBy(*k, F.col("x.c").alias("community"))
           .agg(F.sum("w").alias("d"), F.sum(F.when(F.col("x.col2"), F.col("w")).otherwise(0.0)).alias("l")))
    # every edge adds its weight to two ends, so the degrees sum to 2m
    tot = per.groupBy(*k).agg((F.sum("d") / 2).alias("m"))
    per = per.join(tot, k) if k else per.withColumn("m", tot.select("m").scalar())
    q = F.sum(F.col("l") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2))
    return per.groupBy(*k).agg(q.alias("modularity"))


def geometry(entities: DataFrame, key: str) -> DataFrame:
    """Centre, size and drawn radius of each group."""
    c = entities.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("size"))
    d = entities.join(c, key).groupBy(key, "cx", "cy", "size").agg((F.avg(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))) * 1.5 + 14).alias("radius"))
    return d


def cluster_labels(profile: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """Keywords of every cluster and of every sub-cluster (contrasted with its siblings), the curated label where there is
    one, and whether its keywords changed since. `profile`: cluster, subcluster, topic, weight; `labels`: level, id, label,
    labelled (joined keywords at labelling time)."""
    top = ordered_topics(class_tfidf(profile, "cluster", n), ["cluster"], "kw").select(
        F.lit("cluster").alias("level"), F.col("cluster").alias("id"), F.array_join("kw", ";").alias("keywords"))
    parts = profile.groupBy("cluster").agg(F.countDistinct("subcluster").alias("parts"))
    sub = ordered_topics(class_tfidf(profile, "subcluster", n, within=["cluster"]), ["cluster", "subcluster"], "kw").select(
        "cluster", "subcluster", F.array_join("kw", ";").alias("keywords"))
    # an undivided cluster passes its own keywords on
    whole = top.select(F.col("id").alias("cluster"), F.col("keywords").alias("ck"))
    sub = (sub.join(parts, "cluster").join(whole, "cluster")
           .select(F.lit("subcluster").alias("level"), F.col("subcluster").alias("id"),
                   F.when(F.col("parts") > 1, F.col("keywords")).otherwise(F.col("ck")).alias("keywords")))
    j = top.unionByName(sub).join(labels, ["level", "id"], "left")
    return j.select("level", "id", "keywords", F.coalesce("label", F.concat(F.lit("Group "), F.col("id") + 1)).alias("label"),
                    (F.col("labelled").isNotNull() & (F.col("labelled") != F.col("keywords"))).alias("stale"))


def _enough_pairs(item_a: np.ndarray, item_b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray, sim: np.ndarray, ok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the pairs of a tile that `n` rounds can ever need: whichever n - 1 titles of either side are used up, the best
    pair left is among them. Going down from the best, a pair is taken unless one with its two titles is, or `n` with its left or `n` with its
    right title are; used titles can spoil n of the taken pairs each, so 2n(n - 1) + 1 suffice."""
    need, seen = 2 * n * (n - 1) + 1, 4 * n * n
    flat = np.where(ok, sim, -np.inf).ravel()
    there = int(ok.sum())
    while True:
        if seen < there:
            edge = -np.partition(-flat, seen - 1)[seen - 1]
            at = np.flatnonzero(flat >= edge)
        else:
            at = np.flatnonzero(flat > -np.inf)
        r, c = np.unravel_index(at, sim.shape)
        order = np.lexsort((item_b[c], item_a[r], -flat[at]))
        left, right, both, kept = Counter(), Counter(), set(), []
        for o in order:
            x, y = norm_a[r[o]], norm_b[c[o]]
            if left[x] < n and right[y] < n and (x, y) not in both:
                left[x] += 1
                right[y] += 1
                both.add((x, y))
                kept.append(o)
                if len(kept) == need:
                    return r[kept], c[kept]
        if len(at) == there:
            return r[kept], c[kept]
        seen *= 8


def closest_item_pairs(edges: DataFrame, items: DataFrame, memberships: DataFrame, n: int = 3, block: int = V.BLOCK) -> DataFrame:
    """Closest item pairs across the two ends of every edge: items both ends have, and titles found on both sides, are left out, and
    each title is used once. Equal similarities go to the smaller items. An item without a vector has no pair.

    The pairs themselves are never rows. An edge is cut into tiles of bounded size, and a tile gives the few pairs that `n` rounds can need of
    it; in each round the best pair of every edge is then one grouped maximum, and pairs with either of its titles leave."""
    edge = ["source", "target"]
    t = items.filter(F.col("v").isNotNull()).select("entity", "item", "v", F.xxhash64(norm_title(F.col("title"))).alias("norm"))
    other = memberships.select("entity", "item").distinct()

    def side(end: str, far: str) -> DataFrame:
        own = edges.select(*edge).join(t.withColumnRenamed("entity", end), end)
        return own.join(other.withColumnRenamed("entity", far), [far, "item"], "left_anti")
    a, b = cut_lineage(side("source", "target")), cut_lineage(side("target", "source"))
    a, b = (x.join(y.select(*edge, "norm").distinct(), [*edge, "norm"], "left_anti").select(*edge, F.col("item").alias("id"), "v", "norm") for x, y in ((a, b), (b, a)))

    def fn(tile: V.Tile):
        x, y = tile.left("norm"), tile.right("norm")
        r, c = _enough_pairs(tile.i, tile.j, x, y, tile.sim, tile.ok, n)
        return {"item_a": tile.i[r], "item_b": tile.j[c], "norm_a": x[r], "norm_b": y[c], "sim": tile.sim[r, c]}
    left = cut_lineage(V.tile_map(a, fn, "item_a long, item_b long, norm_a long, norm_b long, sim double", edge, right=b, carry=["norm"], block=block))
    out = None
    for rank in range(1, n + 1):
        key = F.struct("sim", (-F.col("item_a")).alias("a"), (-F.col("item_b")).alias("b"), "norm_a", "norm_b")
        best = cut_lineage(left.groupBy(*edge).agg(F.max(key).alias("k")).select(*edge, F.lit(rank).cast("long").alias("rank"), (-F.col("k.a")).alias("item_a"),
                                                                               (-F.col("k.b")).alias("item_b"), F.col("k.sim").alias("sim"), F.col("k.norm_a").alias("_x"), F.col("k.norm_b").alias("_y")))
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select(*edge, "_x", "_y"), edge).filter((F.col("norm_a") != F.col("_x")) & (F.col("norm_b") != F.col("_y"))).drop("_x", "_y")
    return out.drop("_x", "_y")
