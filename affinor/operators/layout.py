"""A two-dimensional map that keeps neighbours together: a fuzzy neighbour graph laid out in supersteps.

Neighbours pull at each other along the edges of the graph; everything else pushes, summed up per cell of a grid of bounded size. A superstep
is one aggregate over the edges and one pass over the nodes, written to the shared folder. Sums are taken over whole numbers, so a
rerun gives the same map whatever order the rows come in."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from affinor.operators import vectors as V
from affinor.operators.embed import map_xy, scaled_xy
from affinor.session import cut_lineage

GRID, FIXED, MOMENTUM, START, LONGEST = 32, 10 ** 6, 0.8, 10.0, 2.0
STATE = "node long, x double, y double, vx double, vy double, pull double"


def _membership(k: int) -> tuple[Column, Column]:
    """For a row's neighbours `l` (structs of d, j): their distances beyond the nearest, and the rate at which weights that fall with these add
    up to log2(k). The rate is found by halving an interval 40 times."""
    beyond = F.transform("l", lambda e: F.greatest(e["d"] - F.array_min(F.transform("l", lambda x: x["d"])), F.lit(0.0)))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        total = F.aggregate("beyond", F.lit(0.0), lambda t, x: t + F.exp(-x / mid))
        much = total > float(np.log2(k))
        return F.struct(F.when(much, s["lo"]).otherwise(mid).alias("lo"), F.when(much, mid).otherwise(s["hi"]).alias("hi"))
    return beyond, F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0.0).alias("lo"), F.lit(4.0).alias("hi")), halve, lambda s: s["hi"])


def fuzzy_graph(near: DataFrame, k: int) -> DataFrame:
    """(node, other, w) both ways from the `k` nearest rows (i, j, sim) of every row: w = a + b - ab of the weights in the two directions."""
    beyond, rate = _membership(k)
    rows = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct((1 - F.col("sim")).alias("d"), "j"))).alias("l"))
    rows = rows.withColumn("beyond", beyond).withColumn("rate", rate).select(F.col("i").alias("node"), F.posexplode("l").alias("p", "e"), "beyond", "rate")
    one = rows.select("node", F.col("e.j").alias("other"), F.exp(-F.get("beyond", F.col("p")) / F.col("rate")).alias("w"))
    return (one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"), "w"))
            .groupBy("node", "other").agg(F.round(1 - F.product(1 - F.col("w")), 9).alias("w")))


def _whole(c: Column) -> Column:
    return F.round(c * FIXED).cast("long")


def _cells(state: DataFrame) -> list[Row]:
    """Count and sums of the nodes in each used cell of the grid over the map: at most GRID * GRID rows."""
    box = state.agg(F.struct(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1e-9).alias("w"), (F.max("y") - F.min("y") + 1e-9).alias("h"))).scalar()
    at = lambda c, low, span: F.least(F.floor((F.col(c) - F.col(low)) / F.col(span) * GRID), F.lit(GRID - 1)).cast("int")
    return (state.select("x", "y", box.alias("b")).groupBy(at("x", "b.x", "b.w").alias("cx"), at("y", "b.y", "b.h").alias("cy"))
            .agg(F.count("*").alias("n"), F.sum(_whole(F.col("x"))).alias("sx"), F.sum(_whole(F.col("y"))).alias("sy"),
                 F.first("b.x").alias("x0"), F.first("b.y").alias("y0"), F.first("b.w").alias("bw"), F.first("b.h").alias("bh"))
            .orderBy("cx", "cy").collect())


def _moved(cells: list[Row], push: float, speed: float):
    """The pass over the nodes of one superstep: push of all cells on every node (its own cell without itself), speed kept from the step before."""
    cx, cy = (np.array([c[n] for c in cells]) for n in ("cx", "cy"))
    n = np.array([c.n for c in cells], float)
    sums = np.array([(c.sx, c.sy) for c in cells], float) / FIXED
    total, (x0, y0, w, h) = n.sum(), (cells[0].x0, cells[0].y0, cells[0].bw, cells[0].bh)
    number = np.full((GRID, GRID), -1)
    number[cx, cy] = np.arange(len(cells))

    def part(t: pa.RecordBatch) -> pa.RecordBatch:
        node, x, y, vx, vy, pull, fx, fy = (c.to_numpy(zero_copy_only=False) for c in t.columns)
        own = number[np.minimum((x - x0) / w * GRID, GRID - 1).astype(int), np.minimum((y - y0) / h * GRID, GRID - 1).astype(int)]
        row = np.arange(len(x))
        mass = np.repeat(n[None], len(x), 0)
        mass[row, own] -= 1
        rest = np.maximum(mass[row, own], 1)
        dx, dy = x[:, None] - sums[None, :, 0] / n, y[:, None] - sums[None, :, 1] / n
        dx[row, own], dy[row, own] = x - (sums[own, 0] - x) / rest, y - (sums[own, 1] - y) / rest
        r2 = dx * dx + dy * dy
        g = 2 * mass / ((0.01 + r2) * (1 + r2))
        each = np.maximum(pull, 1)
        share = push * pull / each / total
        vx = MOMENTUM * vx + fx / each + share * (g * dx).sum(1)
        vy = MOMENTUM * vy + fy / each + share * (g * dy).sum(1)
        length = np.maximum(speed * np.sqrt(vx * vx + vy * vy), 1e-12)
        go = speed * np.minimum(1.0, LONGEST / length)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (node, np.round(x + go * vx, 9), np.round(y + go * vy, 9), np.round(vx, 9), np.round(vy, 9), pull)],
                                          names=["node", "x", "y", "vx", "vy", "pull"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield part(b.slice(at, 512))
    return run


def neighbour_map(vectors: DataFrame, id: str = "entity", k: int = 10, steps: int = 24, push: float = 10.0, near: DataFrame | None = None) -> DataFrame:
    """(id, x, y): a map of unit vectors `v` in which near rows stay near, centred and scaled so that the largest coordinate is 1.

    `near` (i, j, sim), the k nearest rows of every row, is computed if not given. The layout starts from the two principal components, with
    equal vectors moved apart by a hash of their id. Rows without a vector get no place; an empty table gives an empty one."""
    rows = cut_lineage(vectors.filter(F.col("v").isNotNull()).select(F.col(id).cast("long").alias("node"), "v"))
    if rows.isEmpty():
        return rows.select(F.col("node").alias(id), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    near = V.top_neighbours(rows, k, id="node") if near is None else near
    links = cut_lineage(fuzzy_graph(near.select("i", "j", "sim"), k))
    pull = links.groupBy("node").agg((F.sum(_whole(F.col("w"))) / FIXED).alias("pull"))
    jitter = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(20001)) / 1e6 - 0.01
    place = lambda c, salt: F.round(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) * START + jitter(salt), 6).alias(c)
    lone = rows.limit(2).count() < 2  # components need two rows
    start = (rows.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")) if lone else map_xy(rows, "node")).select("node", place("x", 1), place("y", 2))
    state = cut_lineage(start.join(pull, "node", "left").select("node", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.coalesce("pull", F.lit(0.0)).alias("pull")))
    for step in range(steps):
        there = state.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        both = links.join(state.select("node", "x", "y"), "node").join(there, "other")
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        force = -4 * F.col("w") / (1 + dx * dx + dy * dy)
        drawn = both.groupBy("node").agg((F.sum(_whole(force * dx)) / FIXED).alias("fx"), (F.sum(_whole(force * dy)) / FIXED).alias("fy"))
        feel = state.join(drawn, "node", "left").fillna(0.0, ["fx", "fy"]).select("node", "x", "y", "vx", "vy", "pull", "fx", "fy")
        state = cut_lineage(feel.mapInArrow(_moved(_cells(state), push, 1 - step / steps), STATE))
    return scaled_xy(state.select(F.col("node").alias(id), "x", "y"), id)


def neighbours_kept(near: DataFrame, xy: DataFrame, k: int, id: str = "entity") -> DataFrame:
    """(id, kept): how many of the k nearest rows (i, j) of every row are among its k nearest on the map."""
    p = xy.select(F.col(id).cast("long").alias("id"), "x", "y")
    # nearest by distance = largest product of (x, y, 1) with (x, y, -r2 / 2)
    ask = p.select("id", F.array("x", "y", F.lit(1.0)).alias("v"), F.array("id").alias("skip"))
    have = p.select("id", F.array("x", "y", -(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2).alias("v"))
    close = V.top_matches(ask, have, k).select("i", "j", F.lit(1).alias("hit"))
    return (near.select("i", "j").join(close, ["i", "j"], "left").groupBy(F.col("i").alias(id)).agg(F.count("hit").alias("kept")))
