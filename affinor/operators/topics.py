"""Topic profiles in long form (entity, topic, weight) and what is derived from them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.operators.ranking import rnd, top_k, with_total


def topic_profile(members: DataFrame, item_topics: DataFrame, key: str = "entity") -> DataFrame:
    """Summed topic score per entity over its items. Topics are first combined per item, so a long item shrinks early."""
    return (members.join(item_topics.select("item", "topic", "score"), "item")
            .groupBy(key, "topic").agg(rnd(F.sum("score")).alias("weight"), F.count("*").alias("n_items")))


def topic_share(profile: DataFrame, key: str = "entity") -> DataFrame:
    return (with_total(profile, [key], "weight", "_total")
            .withColumn("share", F.try_divide("weight", "_total")).drop("_total"))


def keywords(profile: DataFrame, n: int, keys: Sequence[str] = ("entity",), weight: str = "weight") -> DataFrame:
    """Top-n topics per key as an ordered list."""
    top = top_k(profile, keys, [F.col(weight).desc(), F.col("topic")], n)
    return ordered_topics(top, keys, "keywords")


def ordered_topics(top: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))),
                                              lambda x: x["topic"]).alias(name))


def shared_topics(edges: DataFrame, share: DataFrame, n: int = 3, a: str = "source", b: str = "target") -> DataFrame:
    """Topics two ends have in common, by the smaller of their shares: top n rows per edge."""
    left = share.select(F.col("entity").alias(a), "topic", F.col("share").alias("_sa"))
    right = share.select(F.col("entity").alias(b), "topic", F.col("share").alias("_sb"))
    both = (edges.select(a, b).join(left, a).join(right, [b, "topic"])
            .withColumn("share", rnd(F.least("_sa", "_sb"), 6)))
    return top_k(both, [a, b], [F.col("share").desc(), F.col("topic")], n).drop("_sa", "_sb")


def class_tfidf(profile: DataFrame, group: str, n: int = 5, within: Sequence[str] = ()) -> DataFrame:
    """What is distinctive for a group: share of the topic in the group times ln(1 + average group weight / topic total).
    With `within`, groups are contrasted only with the other groups of the same parent."""
    keys = list(within)
    g = profile.groupBy(*keys, group, "topic").agg(F.sum("weight").alias("w"))
    per_group = g.groupBy(*keys, group).agg(F.sum("w").alias("gw"))
    per_topic = g.groupBy(*keys, "topic").agg(F.sum("w").alias("tw"))
    avg = per_group.groupBy(*keys).agg((F.sum("gw") / F.count("*")).alias("avg_w"))
    s = g.join(per_group, [*keys, group]).join(per_topic, [*keys, "topic"])
    s = s.join(avg, keys) if keys else s.withColumn("avg_w", avg.scalar())
    s = s.withColumn("score", rnd(F.try_divide("w", "gw") * F.ln(1 + F.try_divide("avg_w", "tw"))))
    return top_k(s, [*keys, group], [F.col("score").desc(), F.col("topic")], n).select(*keys, group, "topic", "score", "rank")


def keyword_timeline(members: DataFrame, items: DataFrame, item_topics: DataFrame, n: int = 3) -> DataFrame:
    dated = members.join(items.select("item", "year"), "item")
    prof = (dated.join(item_topics.select("item", "topic", "score"), "item")
            .groupBy("entity", "year", "topic").agg(rnd(F.sum("score")).alias("weight")))
    return keywords(prof, n, ["entity", "year"])


def topic_shift(period_topics: DataFrame, n: int = 3, min_items: int = 2) -> DataFrame:
    """(entity, direction, topic, diff, rank): topics whose share grew (in two or more recent items) or shrank most.

    `period_topics`: entity, period ('early' / 'recent'), item, topic, score."""
    w = period_topics.groupBy("entity", "period", "topic").agg(F.sum("score").alias("weight"), F.count("*").alias("cnt"))
    w = with_total(w, ["entity", "period"], "weight", "_t").withColumn("share", F.try_divide("weight", "_t"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    wide = w.groupBy("entity", "topic").agg(
        z(F.max(F.when(F.col("period") == "early", F.col("share")))).alias("se"),
        z(F.max(F.when(F.col("period") == "recent", F.col("share")))).alias("sr"),
        F.coalesce(F.max(F.when(F.col("period") == "early", F.col("cnt"))), F.lit(0)).alias("ne"),
        F.coalesce(F.max(F.when(F.col("period") == "recent", F.col("cnt"))), F.lit(0)).alias("nr"))
    wide = wide.withColumn("diff", rnd(F.col("sr") - F.col("se")))
    def pick(cond: Column, order: Column, name: str) -> DataFrame:
        return (top_k(wide.filter(cond), ["entity"], [order, F.col("topic")], n)
                .select("entity", F.lit(name).alias("direction"), "topic", "diff", "rank"))
    return pick((F.col("diff") > 0) & (F.col("nr") >= min_items), F.col("diff").desc(), "grew").unionByName(
        pick((F.col("diff") < 0) & (F.col("ne") >= min_items), F.col("diff").asc(), "shrank"))


def subfield_mix(members: DataFrame, first_topics: DataFrame, key: str) -> DataFrame:
    """Number of items per subfield of the first topic."""
    return members.join(first_topics, "item").groupBy(key, "subfield").agg(F.count("*").alias("n"))
