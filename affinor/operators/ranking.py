"""Ranking, quantile and list building that stay safe when one key holds a large part of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinor.session import cut_lineage


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, n: int = 6) -> Column:
    """Half-away rounding without a negative zero."""
    return F.round(col(c), n) + F.lit(0.0)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. The filter sits directly on row_number, so Spark keeps only k rows per key in every
    map task before the shuffle and a hot key never travels whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_row(df: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str) -> DataFrame:
    """One value per key, the one with the largest `order`; a plain aggregate with map-side combining."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def with_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach sum(value) per key. Sums are pre-aggregated and joined back, so adaptive execution can split a hot key."""
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias(name)), list(keys))


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """Exact row_number for every row of every key without putting a key into one task.

    Rows are range-partitioned by (key, order); a key's position is its position in its range partition plus the number
    of its rows in earlier partitions. The sorted rows are written once because both branches must see the same
    partitioning. `order` must be unique within a key."""
    aliases = [f"_o{i}" for i in range(len(order))]
    asc, src = [], df
    for a, o in zip(aliases, order):
        desc = isinstance(o, tuple)
        src = src.withColumn(a, col(o[0] if desc else o))
        asc.append(F.col(a).desc() if desc else F.col(a).asc())
    part = cut_lineage(src.repartitionByRange(*[F.col(k) for k in keys], *asc)
                       .withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_part").orderBy(*asc)
    local = part.withColumn("_local", F.row_number().over(inner))
    # one row per (key, partition): bounded by the number of partitions a key reaches
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (part.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (local.join(offsets, [*keys, "_part"])
            .withColumn(rank, F.col("_local") + F.col("_off"))
            .drop("_part", "_local", "_off", *aliases))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      bins: int = 1024, bounds: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per key: columns `n`, `q0`, `q1`, ... (with `bounds` also the two neighbouring
    values, `q0_lo`, `q0_hi`, ...).

    Pass one counts values per histogram bin (a hot key shrinks to `bins` partial counts); pass two keeps only the rows
    of the bins that hold a wanted rank, already merged by distinct value, and walks those. No task ever holds a key."""
    keys = list(keys)
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    one = F.lit(1).alias("_one")
    gk = keys or ["_one"]
    if not keys:
        df = df.select("*", one)
    span = df.groupBy(*gk).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    width = F.col("_hi") - F.col("_lo")
    binned = df.join(span.select(*gk, "_lo", "_hi"), gk).withColumn(
        "_bin", F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * bins), F.lit(bins - 1)))
        .otherwise(F.lit(0)).cast("int"))
    counts = binned.groupBy(*gk, "_bin").agg(F.count("*").alias("_c"))
    # at most `bins` rows per key from here on
    cum = Window.partitionBy(*gk).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_c").over(cum)).withColumn("_from", F.col("_upto") - F.col("_c"))
    targets = span.select(*gk, "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), e.alias("t"))
        for i, pr in enumerate(probs)
        for e in (F.floor((F.col("n") - 1) * pr).cast("long"), F.ceil((F.col("n") - 1) * pr).cast("long"))])).alias("_t"))
    targets = targets.select(*gk, "n", F.col("_t.p").alias("_p"), F.col("_t.t").alias("_rank")).distinct()
    hit = (targets.join(counts, gk).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
           .select(*gk, "n", "_p", "_rank", "_bin", "_from"))
    wanted = hit.select(*gk, "_bin", "_from").distinct()
    vals = binned.join(wanted, [*gk, "_bin"]).groupBy(*gk, "_bin", "_from", "_v").agg(F.count("*").alias("_m"))
    run = Window.partitionBy(*gk, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vals = (vals.withColumn("_end", F.col("_from") + F.sum("_m").over(run))
            .withColumn("_start", F.col("_end") - F.col("_m")).drop("_from", "_m"))
    found = (hit.drop("_from").join(vals, [*gk, "_bin"])
             .filter((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end")))
             .groupBy(*gk, "n", "_p").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")))
    cols = []
    for i, pr in enumerate(probs):
        frac = (F.col("n") - 1) * pr - F.floor((F.col("n") - 1) * pr)
        cols.append(F.max(F.when(F.col("_p") == i, F.col("_a") + (F.col("_b") - F.col("_a")) * frac)).alias(f"q{i}"))
        if bounds:
            cols += [F.max(F.when(F.col("_p") == i, F.col(c))).alias(f"q{i}_{n}") for c, n in (("_a", "lo"), ("_b", "hi"))]
    out = found.groupBy(*gk, "n").agg(*cols)
    return out if keys else out.drop("_one")


def chunked_list(df: DataFrame, keys: Sequence[str], item: Column, name: str, part_by: str, limit: int = 10000) -> DataFrame:
    """Sorted lists per key in parts of about `limit` elements: small keys have the single part 0, a hot key is spread
    over several rows instead of one unbounded array."""
    n = df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(limit)).alias("_parts"))
    return (df.join(n, list(keys))
            .withColumn("part", F.pmod(F.xxhash64(part_by), F.col("_parts")))
            .groupBy(*keys, "part").agg(F.sort_array(F.collect_list(item)).alias(name)))
