"""Queries over the change of topic of entities."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import trend as D
from affinor.operators.ranking import rnd
from affinor.plans.fixtures import EARLY, RECENT, Fixtures
from affinor.plans.registry import query

FLOOR = 0.0  # the supplied vectors are far apart, so the floor of real data would leave nothing


def kept(fx: Fixtures):
    from affinor.session import cut_lineage
    return cut_lineage(D.drop_outliers(D.with_period(fx.item_vectors, EARLY, RECENT), fx.entity_vectors, FLOOR))


@query("outlier_mad", "SELECT entity, period, item FROM fx_kept_core")
def outlier_mad(fx: Fixtures):
    return D.drop_outliers(D.with_period(fx.item_vectors, EARLY, RECENT), fx.entity_vectors, FLOOR).select("entity", "period", "item")


@query("period_shift", "SELECT entity, round(shift, 6) + 0.0 AS shift FROM fx_shift")
def period_shift(fx: Fixtures):
    return D.shifts(D.period_vectors(kept(fx))).select("entity", rnd("shift").alias("shift"))


@query("shift_pvalue")
def shift_pvalue(fx: Fixtures):
    return D.permutation_test(kept(fx)).select("entity", rnd("shift").alias("shift"), rnd("p_value", 4).alias("p_value"))


SMALL = """pool AS (SELECT entity, item, period = 'early' AS first, v, count(*) OVER (PARTITION BY entity) AS n, count(*) FILTER (period = 'early') OVER (PARTITION BY entity) AS k FROM fx_kept_core),
    draw AS (SELECT b, entity, item, first, v, n, k, row_number() OVER (PARTITION BY entity, b ORDER BY u * u % 2147483647 * ((u + 40503) % 2147483647) % 2147483647, item) <= k AS pick FROM (SELECT b, p.*, (item % 2147483647 * 7919 + b * 104729 + entity % 2147483647 * 15485863) % 2147483647 AS u FROM pool p, range(0, 40) r(b)) p WHERE k > 0 AND k < n
      UNION ALL SELECT -1, entity, item, first, v, n, k, first FROM pool WHERE k > 0 AND k < n),
    dd AS (SELECT b, entity, dim, coalesce(sum(x) FILTER (pick), 0) AS a, coalesce(sum(x) FILTER (NOT pick), 0) AS c FROM (SELECT b, entity, pick, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM draw) GROUP BY 1, 2, 3),
    dr AS (SELECT b, entity, 1 - sum(a * c) / (sqrt(sum(a * a)) * sqrt(sum(c * c))) AS drift FROM dd GROUP BY 1, 2)"""


@query("shift_pvalue_small", f"""WITH {SMALL} SELECT d.entity, round(o.drift, 6) + 0.0 AS shift, round((count(*) FILTER (d.drift >= o.drift - 1e-12) + 1) / 41, 6) + 0.0 AS p_value
    FROM dr d JOIN dr o ON o.entity = d.entity AND o.b = -1 WHERE d.b >= 0 GROUP BY d.entity, o.drift""")
def shift_pvalue_small(fx: Fixtures):
    return D.permutation_test(kept(fx), 40).select("entity", rnd("shift").alias("shift"), rnd("p_value").alias("p_value"))


@query("bh_fdr", """WITH p AS (SELECT vec_id AS entity, ((vec_id * 7919) % 1009 + 1) / 1010 * ((vec_id * 31) % 97 + 1) / 98 * ((vec_id * 17) % 53 + 1) / 54 AS p_value FROM embeddings),
    r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS i, count(*) OVER () AS m FROM p)
    SELECT entity, round(p_value, 9) AS p_value FROM r WHERE i <= (SELECT max(i) FROM r WHERE p_value <= 0.2 * i / m)""")
def bh_fdr(fx: Fixtures):
    i = F.col("vec_id")
    p = fx.t("embeddings").select(i.alias("entity"), (((i * 7919) % 1009 + 1) / 1010 * ((i * 31) % 97 + 1) / 98 * ((i * 17) % 53 + 1) / 54).alias("p_value"))
    return D.benjamini_hochberg(p).select("entity", F.round("p_value", 9).alias("p_value"))


@query("trend_status")
def trend_status(fx: Fixtures):
    judged = fx.places.filter("entity % 17 <> 0").select("entity")  # entities flagged as mixed are not judged
    return D.trend_status(kept(fx), judged)


PLACE = """pq AS (SELECT entity AS id, rv AS v FROM fx_shift),
    nb AS (SELECT * FROM (SELECT id, p.entity AS j, p.x, p.y, round(list_dot_product(pq.v, p.v), 9) AS s, row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(pq.v, p.v), 9) DESC, p.entity) AS r
      FROM pq JOIN fx_places p ON p.entity <> id) WHERE r <= 8), wt AS (SELECT *, exp((s - max(s) OVER (PARTITION BY id)) * 40) AS w FROM nb)"""


@query("map_place", f"WITH {PLACE} SELECT id AS entity, round(sum(w * x) / sum(w), 5) + 0.0 AS x, round(sum(w * y) / sum(w), 5) + 0.0 AS y FROM wt GROUP BY 1")
def map_place(fx: Fixtures):
    p = D.period_vectors(kept(fx))
    q = p.select(F.col("entity").alias("id"), F.col("recent").alias("v"), F.array("entity").alias("skip"))
    return D.map_place(q, fx.places).select(F.col("i").alias("entity"), rnd("x", 5).alias("x"), rnd("y", 5).alias("y"))


DIRECTION = """near AS (SELECT * FROM (SELECT s.entity, p.entity AS j, p.x, p.y, round(round(list_dot_product(rv, p.v), 9) - list_dot_product(ev, p.v), 9) AS gain,
      row_number() OVER (PARTITION BY s.entity ORDER BY round(list_dot_product(rv, p.v), 9) DESC, p.entity) AS r FROM fx_shift s JOIN fx_places p ON p.entity <> s.entity) WHERE r <= 20),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY gain DESC, j) AS g FROM near WHERE gain > 0) WHERE g <= 5),
    ends AS (SELECT entity, string_agg(j::VARCHAR, ',' ORDER BY g) AS toward, round(sum(gain * x) / sum(gain), 5) + 0.0 AS toward_x, round(sum(gain * y) / sum(gain), 5) + 0.0 AS toward_y FROM best GROUP BY 1),
    gd AS (SELECT subcluster, dim, avg(x) AS x FROM (SELECT subcluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM fx_places) GROUP BY 1, 2),
    gm AS (SELECT subcluster, list(x / n ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY subcluster)) AS n FROM gd) GROUP BY 1),
    gs AS (SELECT entity, subcluster, round(list_dot_product(rv, v), 9) AS sr, round(list_dot_product(ev, v), 9) AS se FROM fx_shift, gm),
    gr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sr DESC, subcluster) AS rr, row_number() OVER (PARTITION BY entity ORDER BY se DESC, subcluster) AS re FROM gs),
    tw AS (SELECT entity, subcluster AS t, sr - se AS td FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sr - se DESC, subcluster) AS k FROM gr WHERE rr <= 3) WHERE k = 1),
    aw AS (SELECT entity, subcluster AS a, sr - se AS ad FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sr - se, subcluster) AS k FROM gr WHERE re <= 3) WHERE k = 1)"""


@query("trend_direction", f"""WITH {DIRECTION} SELECT s.entity, toward, toward_x, toward_y, CASE WHEN td > 0 THEN t END AS toward_subcluster,
    CASE WHEN ad < 0 AND a <> t THEN a END AS away_subcluster FROM fx_shift s LEFT JOIN ends USING (entity) LEFT JOIN tw USING (entity) LEFT JOIN aw USING (entity)""")
def trend_direction(fx: Fixtures):
    return D.direction(D.period_vectors(kept(fx)), fx.places)
