"""Queries for recommendation and bridges."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import recommend as C
from affinor.operators import topics as T
from affinor.operators.ranking import rnd
from affinor.plans.fixtures import Fixtures
from affinor.plans.registry import query

# every 40th entity starts a query seeded with itself and two followers
SEEDS = """seeds AS (SELECT q.entity AS query, s.entity FROM fx_row_vectors q JOIN fx_row_vectors s ON s.entity IN (q.entity, q.entity + 3, q.entity + 8) WHERE q.entity % 40 = 0),
    sd AS (SELECT query, dim, avg(x) AS x FROM seeds JOIN (SELECT entity, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM fx_row_vectors) USING (entity) GROUP BY 1, 2),
    sm AS (SELECT query, list(x / n ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query)) AS n FROM sd) GROUP BY 1),
    ok AS (SELECT * FROM fx_row_vectors WHERE unreliable IS NULL OR unreliable NOT IN ('mixed_topics', 'wrong_field')),
    sc AS (SELECT query, e.entity, e.fields, e.v, round(list_dot_product(sm.v, e.v), 9) AS score FROM sm JOIN ok e ON NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query = sm.query AND s.entity = e.entity)),
    sf AS (SELECT query, list_distinct(flatten(list(r.fields))) AS fields FROM seeds JOIN fx_row_vectors r USING (entity) GROUP BY 1)"""
BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) AS rank FROM {src}) WHERE rank <= 12),
    near AS (SELECT b.query, b.entity, s.entity AS seed, round(list_dot_product(b.v, r.v), 9) AS sim FROM best b JOIN seeds s ON s.query = b.query JOIN fx_row_vectors r ON r.entity = s.entity)
    SELECT b.query, b.entity, b.rank, round(b.score, 6) + 0.0 AS score, n.seed AS nearest_seed, round(n.sim, 6) + 0.0 AS nearest_sim FROM best b
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY sim DESC, seed) AS rn FROM near) WHERE rn = 1) n ON n.query = b.query AND n.entity = b.entity"""


def seeds(fx: Fixtures):
    q = fx.members.filter("entity % 40 = 0").select(F.col("entity").alias("query"), F.explode(F.array("entity", F.col("entity") + 3, F.col("entity") + 8)).alias("entity"))
    return q.join(fx.members.select("entity"), "entity", "left_semi")


@query("recommend", f"WITH {SEEDS}, " + BEST.format(src="sc"))
def recommend(fx: Fixtures):
    return C.recommend(fx.row_vectors, seeds(fx), 12).withColumn("rank", F.col("rank").cast("long"))


@query("recommend_other_field", f"WITH {SEEDS}, oth AS (SELECT sc.* FROM sc JOIN sf USING (query) WHERE len(list_intersect(sc.fields, sf.fields)) = 0), " + BEST.format(src="oth"))
def recommend_other_field(fx: Fixtures):
    return C.recommend(fx.row_vectors, seeds(fx), 12, other_fields=True).withColumn("rank", F.col("rank").cast("long"))


ANCHORS = """anc AS (SELECT DISTINCT query, side, entity FROM (SELECT f AS query, 'a' AS side, entity FROM (SELECT entity, unnest(fields) AS f FROM fx_row_vectors)
      UNION ALL SELECT subcluster % 5, 'b', entity FROM fx_row_vectors WHERE subcluster IN (1, 3, 5)
      UNION ALL SELECT entity % 5, 'b', entity FROM fx_row_vectors WHERE entity IN (12, 14)))"""
BRIDGE = f"""{ANCHORS}, ad AS (SELECT query, side, dim, avg(x) AS x FROM anc JOIN (SELECT entity, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM fx_row_vectors) USING (entity) GROUP BY 1, 2, 3),
    am AS (SELECT query, side, list(x / n ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query, side)) AS n FROM ad) GROUP BY 1, 2),
    br AS (SELECT a.query, e.entity, round(list_dot_product(a.v, e.v), 9) AS to_a, round(list_dot_product(b.v, e.v), 9) AS to_b FROM am a JOIN am b ON a.query = b.query AND a.side = 'a' AND b.side = 'b',
      (SELECT * FROM fx_row_vectors WHERE unreliable IS NULL OR unreliable NOT IN ('mixed_topics', 'wrong_field')) e),
    gone AS (SELECT query, entity FROM anc WHERE (query, side) IN (SELECT (query, side) FROM anc GROUP BY query, side HAVING count(*) = 1)),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY least(to_a, to_b) DESC, entity) AS rank FROM br b
      WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.query = b.query AND g.entity = b.entity)) WHERE rank <= 15)"""


def anchors(fx: Fixtures):
    m = fx.members
    return (m.select(F.explode("fields").alias("query"), F.lit("a").alias("side"), "entity")
            .union(m.filter("subcluster IN (1, 3, 5)").select(F.col("subcluster") % 5, F.lit("b"), "entity"))
            .union(m.filter("entity IN (12, 14)").select(F.col("entity") % 5, F.lit("b"), "entity"))).distinct()


@query("bridge", f"""WITH {BRIDGE} SELECT query, entity, rank, round(to_a, 6) + 0.0 AS to_a, round(to_b, 6) + 0.0 AS to_b,
    CASE WHEN abs(to_a - to_b) < 0.01 THEN 'both' WHEN to_a > to_b THEN 'a' ELSE 'b' END AS lean, round(greatest(0.0, least(1.0, 0.5 - (to_a - to_b) / 0.08)), 4) + 0.0 AS position FROM top""")
def bridge(fx: Fixtures):
    return C.bridge(fx.row_vectors, anchors(fx), 15).withColumn("rank", F.col("rank").cast("long"))


@query("anchor_topics", f"""WITH {BRIDGE}, atop AS (SELECT query, side, topic, sum(share) / any_value(n) AS share FROM anc JOIN fx_row_share USING (entity)
      JOIN (SELECT query, side, count(*) AS n FROM anc GROUP BY 1, 2) USING (query, side) GROUP BY 1, 2, 3)
    SELECT query, entity, side, topic, share, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, entity, side ORDER BY share DESC, topic) AS rank FROM (
      SELECT t.query, t.entity, a.side, a.topic, round(least(s.share, a.share), 6) + 0.0 AS share FROM (SELECT query, entity FROM top) t JOIN fx_row_share s USING (entity) JOIN atop a ON a.query = t.query AND a.topic = s.topic)) WHERE rank <= 2""")
def anchor_topics(fx: Fixtures):
    from affinor.operators.ranking import top_k
    a = anchors(fx)
    found = C.bridge(fx.row_vectors, a, 15).select("query", "entity")
    prof = C.anchor_topics(fx.row_share, a).withColumnRenamed("share", "as")
    both = (found.join(fx.row_share.select("entity", "topic", "share"), "entity").join(prof, ["query", "topic"])
            .withColumn("share", rnd(F.least("share", "as"))))
    return top_k(both, ["query", "entity", "side"], [F.col("share").desc(), F.col("topic")], 2).select(
        "query", "entity", "side", "topic", "share", F.col("rank").cast("long").alias("rank"))
