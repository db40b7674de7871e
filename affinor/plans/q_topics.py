"""Queries over topic profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import topics as T
from affinor.operators.ranking import rnd, top_k
from affinor.plans.fixtures import Fixtures
from affinor.plans.registry import query


@query("item_topics_top5", """SELECT item, topic, score, rank FROM (SELECT item, topic, coalesce(score, 0) AS score,
    row_number() OVER (PARTITION BY item ORDER BY score DESC, topic, pos) AS rank FROM (SELECT item, topic, pos, max(score) AS score
    FROM fx_item_topics GROUP BY 1, 2, 3)) WHERE rank <= 5""")
def item_topics_top5(fx: Fixtures):
    t = fx.item_topics.groupBy("item", "topic", "pos").agg(F.max("score").alias("score"))
    return (top_k(t, ["item"], [F.col("score").desc(), F.col("topic"), F.col("pos")], 5)
            .select("item", "topic", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("rank").cast("long").alias("rank")))


@query("topic_profile", "SELECT * FROM fx_profile")
def topic_profile(fx: Fixtures):
    return fx.profile


@query("topic_share", "SELECT entity, topic, round(share, 6) + 0.0 AS share FROM fx_share")
def topic_share(fx: Fixtures):
    return T.topic_share(fx.profile).select("entity", "topic", rnd("share").alias("share"))


@query("entity_keywords", """SELECT entity, string_agg(topic, ';' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER
    (PARTITION BY entity ORDER BY weight DESC, topic) AS rank FROM fx_profile) WHERE rank <= 5 GROUP BY entity""")
def entity_keywords(fx: Fixtures):
    return T.keywords(fx.profile, 5).withColumn("keywords", F.array_join("keywords", ";"))


TIMELINE = """timeline AS (SELECT entity, year, string_agg(topic, ';' ORDER BY rank) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY weight DESC, topic) AS rank FROM (
      SELECT entity, year, topic, round(sum(score), 6) AS weight FROM fx_home JOIN fx_items USING (item)
      JOIN fx_item_topics USING (item) GROUP BY 1, 2, 3)) WHERE rank <= 3 GROUP BY 1, 2)"""


@query("keyword_timeline", f"WITH {TIMELINE} SELECT * FROM timeline")
def keyword_timeline(fx: Fixtures):
    return (T.keyword_timeline(fx.home, fx.items, fx.item_topics).withColumn("keywords", F.array_join("keywords", ";")))


@query("latest_keywords", f"""WITH {TIMELINE} SELECT entity, max(year) AS year, arg_max(keywords, year) AS keywords FROM timeline GROUP BY 1""")
def latest_keywords(fx: Fixtures):
    t = T.keyword_timeline(fx.home, fx.items, fx.item_topics)
    return t.groupBy("entity").agg(F.max("year").alias("year"), F.array_join(F.max_by("keywords", "year"), ";").alias("keywords"))


@query("group_ctfidf", """WITH g AS (SELECT e.dept AS grp, topic, sum(weight) AS w FROM fx_profile JOIN fx_entities e USING (entity) GROUP BY 1, 2),
    s AS (SELECT grp, topic, w, sum(w) OVER (PARTITION BY grp) AS gw, sum(w) OVER (PARTITION BY topic) AS tw,
      (SELECT sum(w) / count(DISTINCT grp) FROM g) AS avg_w FROM g),
    r AS (SELECT grp, topic, round(w / gw * ln(1 + avg_w / tw), 6) + 0.0 AS score FROM s)
    SELECT grp, topic, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, topic) AS rank FROM r)
    WHERE rank <= 5""")
def group_ctfidf(fx: Fixtures):
    prof = fx.profile.join(fx.entities.select("entity", F.col("dept").alias("grp")), "entity")
    return T.class_tfidf(prof, "grp").withColumn("rank", F.col("rank").cast("long"))


@query("topic_shift", """WITH p AS (SELECT entity, CASE WHEN year <= 1998 THEN 'early' ELSE 'recent' END AS period, topic, score
      FROM fx_home JOIN fx_items USING (item) JOIN fx_item_topics USING (item) WHERE year IN (1997, 1998, 2000, 2001)),
    w AS (SELECT entity, period, topic, sum(score) AS weight, count(*) AS n FROM p GROUP BY 1, 2, 3),
    s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY entity, period) AS share FROM w),
    d AS (SELECT coalesce(e.entity, r.entity) AS entity, coalesce(e.topic, r.topic) AS topic,
      round(coalesce(r.share, 0) - coalesce(e.share, 0), 6) + 0.0 AS diff, coalesce(e.n, 0) AS ne, coalesce(r.n, 0) AS nr
      FROM (SELECT * FROM s WHERE period = 'early') e FULL JOIN (SELECT * FROM s WHERE period = 'recent') r
      ON e.entity = r.entity AND e.topic = r.topic)
    SELECT entity, 'grew' AS direction, topic, diff, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY diff DESC, topic) AS rank
      FROM d WHERE diff > 0 AND nr >= 2) WHERE rank <= 3
    UNION ALL SELECT entity, 'shrank', topic, diff, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY diff, topic) AS rank
      FROM d WHERE diff < 0 AND ne >= 2) WHERE rank <= 3""")
def topic_shift(fx: Fixtures):
    p = (fx.home.join(fx.items.filter(F.col("year").isin(1997, 1998, 2000, 2001)).select("item", "year"), "item")
         .join(fx.item_topics, "item")
         .withColumn("period", F.when(F.col("year") <= 1998, "early").otherwise("recent")))
    return T.topic_shift(p).withColumn("rank", F.col("rank").cast("long"))


@query("subfield_mix", """WITH f AS (SELECT item, arg_min(subfield, (pos, topic, score, subfield)) AS subfield FROM fx_item_topics GROUP BY 1)
    SELECT 'entity' AS level, entity AS id, subfield, count(*) AS n FROM fx_home JOIN f USING (item) GROUP BY 2, 3
    UNION ALL SELECT 'dept', e.dept, subfield, count(*) FROM fx_home JOIN f USING (item) JOIN fx_entities e USING (entity) GROUP BY 2, 3""")
def subfield_mix(fx: Fixtures):
    ft = first_topics(fx)
    ent = T.subfield_mix(fx.home, ft, "entity").select(F.lit("entity").alias("level"), F.col("entity").alias("id"), "subfield", "n")
    # a department's mix is the sum of its entities' mixes
    dept = (ent.join(fx.entities.select(F.col("entity").alias("id"), "dept"), "id").groupBy("dept", "subfield").agg(F.sum("n").alias("n"))
            .select(F.lit("dept").alias("level"), F.col("dept").alias("id"), "subfield", "n"))
    return ent.unionByName(dept)


def first_topics(fx: Fixtures):
    return fx.item_topics.groupBy("item").agg(F.min_by("subfield", F.struct("pos", "topic", "score", "subfield")).alias("subfield"))
