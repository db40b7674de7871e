"""Data-quality jobs: every check is a row of (rule, violations), computed by aggregates and anti-joins."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.session import cut_lineage

BROADCAST_NODES = 100_000


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules in one pass over the table."""
    one = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"c{i}").alias("violations")) for i, r in enumerate(rules)]))
    return one.select(rows.alias("r")).select("r.rule", "r.violations")


def required(c: str) -> Column:
    return F.col(c).isNotNull()


def one_of(c: str, values: list[str]) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*values)


def missing_keys(rule: str, child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    c = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    bad = c.join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def forbidden(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rows whose published JSON text holds a forbidden pattern."""
    text = F.to_json(F.struct(*df.columns))
    return rule_counts(df.select(text.alias("j")), {k: ~F.col("j").rlike(p) for k, p in patterns.items()})


def exactly_one(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): keys of the old snapshot that are missing or whose counters differ, and new keys."""
    cols = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("o"))
    b = new.select(key, F.struct(*cols).alias("n"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("n").isNull(), "missing").when(F.col("o").isNull(), "added").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return j.select(key, change.alias("change")).filter("change IS NOT NULL")


def hashed(df: DataFrame, key: str) -> DataFrame:
    """The rows with the place of their key in a hash tree and two hashes of the whole row, columns in the order of their names. A hash passes
    over nulls, so it is told where they are."""
    cols = [e for c in sorted(df.columns) for e in (F.isnull(c), F.col(c))]
    return df.withColumn("_at", F.xxhash64(key)).withColumn("_h1", F.xxhash64(F.lit(1), *cols)).withColumn("_h2", F.xxhash64(F.lit(2), *cols))


def node_of(level: int, bits: int) -> Column:
    """Node of a row at a level of the tree: the lowest bits of its place, more of them the deeper."""
    return F.col("_at").bitwiseAND(F.lit((1 << bits * (level + 1)) - 1))


def differing_nodes(old: DataFrame, new: DataFrame, level: int, bits: int) -> DataFrame:
    """Nodes of a level whose digests differ. A digest is the number of rows and the sums of both hashes, so a map task sends one row per node."""
    def digests(df: DataFrame, sign: int) -> DataFrame:
        return df.select(node_of(level, bits).alias("node"), F.lit(sign).alias("n"), *[(F.lit(sign) * F.col(h).cast("decimal(20,0)")).alias(h) for h in ("_h1", "_h2")])
    both = digests(old, 1).unionByName(digests(new, -1))
    sums = both.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "_h1", "_h2")])
    return sums.filter("n <> 0 OR _h1 <> 0 OR _h2 <> 0").select("node")


def below(rows: DataFrame, nodes: DataFrame, count: int, level: int, bits: int) -> DataFrame:
    """Rows under one of the `count` nodes. Few nodes are broadcast, so nothing else moves; many are joined by shuffle."""
    at = rows.withColumn("node", node_of(level, bits))
    return at.join(F.broadcast(nodes) if count <= BROADCAST_NODES else nodes, "node", "left_semi").drop("node")


def changed_parts(old: DataFrame, new: DataFrame, key: str, levels: int = 2, bits: int = 12) -> tuple[DataFrame, DataFrame]:
    """What is left of both snapshots after a descent through a hash tree with 2^bits children a node: rows in leaves whose digests
    differ. Every level is digested for rows below differing nodes alone. Two different leaves pass as equal only if their row counts and
    the sums of two 64-bit hashes of their rows agree. Rows without a key are all left, since they equal none."""
    old = old.select(*new.columns)
    keyed, loose = F.col(key).isNotNull(), F.col(key).isNull()
    a, b = hashed(old.filter(keyed), key), hashed(new.filter(keyed), key)
    for level in range(levels):
        nodes = cut_lineage(differing_nodes(a, b, level, bits))
        n = nodes.count()
        a, b = below(a, nodes, n, level, bits), below(b, nodes, n, level, bits)
    return a.drop("_at", "_h1", "_h2").unionByName(old.filter(loose)), b.drop("_at", "_h1", "_h2").unionByName(new.filter(loose))


def snapshot_diff_by_tree(old: DataFrame, new: DataFrame, key: str, levels: int = 2, bits: int = 12) -> DataFrame:
    """`snapshot_diff` of two snapshots with the same columns, at most one row per key, of which little differs: only rows in differing
    leaves of a hash tree are joined, so what is shuffled grows with the change. Rows without a key are compared with none."""
    return snapshot_diff(*changed_parts(old, new, key, levels, bits), key)


def title_ratio(a: Column, b: Column) -> Column:
    """Similarity of two squeezed texts in per cent: 100 (1 - distance / longer length)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def squeezed(c: Column) -> Column:
    """Lower-case letters and digits alone, of any script; a missing title is an empty one."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def reconcile(published: DataFrame, live: DataFrame, excluded: DataFrame | None = None, min_ratio: float = 90) -> DataFrame:
    """Per entity: published items compared with a second snapshot on role, identifier, year and title, the items that only the second
    one has, and the verdict. Items that were left out on purpose (`excluded`: entity, item) are none of these extra ones.

    Both: entity, item, is_last, doi, year, title (one row per entity and item)."""
    p, l = published.withColumn("_p", F.lit(True)), live.withColumn("_l", F.lit(True))
    if excluded is not None:
        aside = excluded.select("entity", "item").join(published, ["entity", "item"], "left_anti")
        l = l.join(aside, ["entity", "item"], "left_anti")
    j = p.alias("p").join(l.alias("l"), ["entity", "item"], "full_outer")
    here, found = F.col("_p").isNotNull(), F.col("_l").isNotNull()
    facts = here & found & F.col("p.doi").eqNullSafe(F.col("l.doi")) & (F.col("p.year") == F.col("l.year")) & (F.col("p.is_last") == F.col("l.is_last"))
    # titles last, and letter by letter only where they differ
    ok = F.when(facts, F.when(F.col("p.title").eqNullSafe(F.col("l.title")), True)
                .otherwise(title_ratio(squeezed(F.col("p.title")), squeezed(F.col("l.title"))) >= min_ratio)).otherwise(False)
    g = j.groupBy("entity").agg(F.count_if(here).alias("items"), F.count_if(ok).alias("good"), F.count_if(here & ~found).alias("missing"), F.count_if(~here).alias("extra"))
    return g.withColumn("verdict", F.when((F.col("good") == F.col("items")) & (F.col("extra") == 0), "ok").when(F.col("good") > 0, "partial").otherwise("fail"))


def empty_sources(dim: DataFrame, facts: DataFrame, key: str, errors: DataFrame) -> DataFrame:
    """Sources without a single row, and recorded load errors."""
    return dim.join(facts, key, "left_anti").select(key, F.lit("no rows").alias("problem")).unionByName(
        errors.select(key, F.lit("load error").alias("problem")))
