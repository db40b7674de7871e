"""Queries over vectors and the similarity graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import topics as T
from affinor.operators import vectors as V
from affinor.operators.ranking import rnd, top_k
from affinor.plans.fixtures import Fixtures
from affinor.plans.registry import query
from affinor.rules import PARAMS


def dims(df, key, v="v", name="x"):
    return df.select(key, F.posexplode(v).alias("dim", name)).select(key, F.col("dim").cast("long").alias("dim"), rnd(name).alias(name))


@query("entity_vectors", """SELECT entity, dim::BIGINT - 1 AS dim, round(x, 6) + 0.0 AS x FROM (SELECT entity, unnest(v) AS x,
    generate_subscripts(v, 1) AS dim FROM fx_entity_vectors)""")
def entity_vectors(fx: Fixtures):
    return dims(fx.entity_vectors, "entity")


@query("group_unit_mean", """WITH d AS (SELECT field, dim, avg(x) AS x FROM fx_vec_dims GROUP BY 1, 2)
    SELECT field, dim::BIGINT - 1 AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY field)), 6) + 0.0 AS x FROM d""")
def group_unit_mean(fx: Fixtures):
    return dims(V.unit_means(fx.item_vectors, ["field"]), "field")


@query("entity_median_centre", """WITH d AS (SELECT entity, dim, quantile_cont(x, 0.5) AS x FROM fx_vec_dims GROUP BY 1, 2)
    SELECT entity, dim::BIGINT - 1 AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY entity)), 6) + 0.0 AS x FROM d""")
def entity_median_centre(fx: Fixtures):
    return dims(V.median_centres(fx.item_vectors), "entity", "centre")


@query("vec_topk", "SELECT i, j, round(sim, 6) + 0.0 AS sim, rank FROM fx_topk")
def vec_topk(fx: Fixtures):
    return fx.topk.select("i", "j", rnd("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("vec_pair_sims", "SELECT i, j, round(sim, 6) + 0.0 AS sim FROM fx_pairs WHERE i < j AND sim >= 0.3")
def vec_pair_sims(fx: Fixtures):
    return V.pairs_at_least(fx.row_vectors, 0.3).select("i", "j", rnd("sim").alias("sim"))


@query("sim_threshold", "SELECT threshold FROM fx_threshold")
def sim_threshold(fx: Fixtures):
    return fx.threshold


@query("knn_edges", "SELECT source, target, round(sim, 4) + 0.0 AS weight FROM fx_knn")
def knn_edges(fx: Fixtures):
    return fx.knn.select("source", "target", rnd("sim", 4).alias("weight"))


@query("vec_bridges", "SELECT source, target, round(sim, 4) + 0.0 AS weight FROM fx_bridges")
def vec_bridges(fx: Fixtures):
    b = V.undirected(fx.neighbours.filter("kind = 1"))
    return (b.withColumn("t", fx.threshold.scalar()).filter("sim >= t")
            .select("source", "target", rnd("sim", 4).alias("weight")))


@query("similarity_edges", """WITH sh AS (SELECT source, target, a.topic, row_number() OVER (PARTITION BY source, target ORDER BY
      round(least(a.share, b.share), 6) DESC, a.topic) AS rank FROM fx_edges JOIN fx_row_share a ON a.entity = source
      JOIN fx_row_share b ON b.entity = target AND b.topic = a.topic),
    why AS (SELECT source, target, string_agg(topic, ';' ORDER BY rank) AS reasons FROM sh WHERE rank <= 3 GROUP BY 1, 2)
    SELECT source, target, round(sim, 4) + 0.0 AS weight, bridge, apart AS "cross", grp, band, coalesce(reasons, '') AS reasons
    FROM fx_banded LEFT JOIN why USING (source, target)""")
def similarity_edges(fx: Fixtures):
    top = T.shared_topics(fx.edges, fx.row_share)
    why = T.ordered_topics(top, ["source", "target"], "reasons")
    return (fx.banded.join(why, ["source", "target"], "left")
            .select("source", "target", rnd("sim", 4).alias("weight"), "bridge", F.col("apart").alias("cross"), "grp", "band",
                    F.coalesce(F.array_join("reasons", ";"), F.lit("")).alias("reasons")))


@query("band_cuts", "SELECT * FROM fx_cuts")
def band_cuts(fx: Fixtures):
    return V.band_cuts(fx.edges)


@query("edge_bands", """SELECT band, grp, count(*) AS edges FROM fx_banded GROUP BY 1, 2""")
def edge_bands(fx: Fixtures):
    return fx.banded.groupBy("band", "grp").agg(F.count("*").alias("edges"))


@query("edge_shared_topics", """SELECT source, target, topic, share, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, target
    ORDER BY share DESC, topic) AS rank FROM (SELECT source, target, a.topic, round(least(a.share, b.share), 6) + 0.0 AS share
    FROM fx_edges JOIN fx_row_share a ON a.entity = source JOIN fx_row_share b ON b.entity = target AND b.topic = a.topic))
    WHERE rank <= 3""")
def edge_shared_topics(fx: Fixtures):
    return T.shared_topics(fx.edges, fx.row_share).select("source", "target", "topic", "share", F.col("rank").cast("long").alias("rank"))


MEDOID = """pair AS (SELECT a.entity, a.item, b.item AS other, round(list_dot_product(a.v, b.v), 9) AS sim
      FROM fx_item_vectors a JOIN fx_item_vectors b USING (entity)),
    med AS (SELECT entity, item, quantile_cont(sim, 0.5) AS med FROM pair GROUP BY 1, 2),
    best AS (SELECT entity, item FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(med, 9) DESC, item) AS rn FROM med)
      WHERE rn = 1),
    ms AS (SELECT p.entity, p.item, p.sim FROM pair p JOIN best b ON b.entity = p.entity AND b.item = p.other)"""


@query("medoid_similarity", f"WITH {MEDOID} SELECT entity, item, round(sim, 6) + 0.0 AS sim FROM ms")
def medoid_similarity(fx: Fixtures):
    return V.medoid_similarity(fx.item_vectors, "entity").select("entity", "item", rnd("sim").alias("sim"))


@query("outlier_screen", f"""WITH {MEDOID}, s AS (SELECT entity, count(*) AS n, round(avg(CASE WHEN sim < 0.6375 THEN 1.0 ELSE 0.0 END), 3) AS outlier_share
      FROM ms GROUP BY 1 HAVING count(*) >= 3),
    c AS (SELECT entity, string_agg(item::VARCHAR, ',' ORDER BY r) AS core FROM (SELECT *, row_number() OVER
      (PARTITION BY entity ORDER BY sim DESC, item) AS r FROM ms) WHERE r <= 8 GROUP BY 1),
    o AS (SELECT entity, string_agg(item::VARCHAR, ',' ORDER BY r) AS outliers FROM (SELECT *, row_number() OVER
      (PARTITION BY entity ORDER BY sim, item) AS r FROM ms WHERE sim < 0.6375) WHERE r <= 12 GROUP BY 1)
    SELECT entity, n, outlier_share, outlier_share >= 0.3 AS suspect, core, coalesce(outliers, '') AS outliers
    FROM s JOIN c USING (entity) LEFT JOIN o USING (entity)""")
def outlier_screen(fx: Fixtures):
    ms = V.medoid_similarity(fx.item_vectors, "entity").drop("v")
    low = F.col("sim") < PARAMS.outlier_cut
    share = (ms.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg(F.when(low, 1.0).otherwise(0.0)), 3).alias("outlier_share"))
             .filter(F.col("n") >= PARAMS.min_screen_items))

    def ids(df, order, n, name):
        t = top_k(df, ["entity"], order, n)
        return t.groupBy("entity").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"].cast("string")), ",").alias(name))
    core = ids(ms, [F.col("sim").desc(), F.col("item")], 8, "core")
    out = ids(ms.filter(low), [F.col("sim"), F.col("item")], 12, "outliers")
    return (share.join(core, "entity").join(out, "entity", "left")
            .select("entity", "n", "outlier_share", (F.col("outlier_share") >= PARAMS.suspect_share).alias("suspect"), "core",
                    F.coalesce("outliers", F.lit("")).alias("outliers")))


@query("item_flags", """WITH c AS (SELECT entity, dim, quantile_cont(x, 0.5) AS x FROM fx_vec_dims GROUP BY 1, 2),
    l AS (SELECT entity, list(x / n ORDER BY dim) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY entity)) AS n FROM c) GROUP BY 1),
    s AS (SELECT entity, item, year, round(list_dot_product(v, c), 6) + 0.0 AS cosine FROM fx_item_vectors JOIN l USING (entity))
    SELECT entity, item, year, cosine, l.quality IS NOT NULL AS reviewed FROM s LEFT JOIN labels l ON l.doc_id = item WHERE cosine < 0.7""")
def item_flags(fx: Fixtures):
    centre = V.median_centres(fx.item_vectors)
    s = fx.item_vectors.join(centre, "entity").withColumn("cosine", rnd(V.dot("v", "centre"))).filter(F.col("cosine") < PARAMS.flag_cosine)
    rev = fx.t("labels").select(F.col("doc_id").alias("item"), F.lit(True).alias("reviewed"))
    return (s.join(rev, "item", "left").select("entity", "item", "year", "cosine", F.coalesce("reviewed", F.lit(False)).alias("reviewed")))


@query("sim_percentile", """WITH p AS (SELECT sim FROM fx_pairs WHERE i < j), v AS (SELECT threshold AS value FROM fx_threshold
      UNION SELECT hi FROM fx_cuts WHERE grp = 'all' UNION SELECT lo FROM fx_cuts WHERE grp = 'all')
    SELECT value, round(count(*) FILTER (sim < value) / count(*), 6) + 0.0 AS percentile FROM v, p GROUP BY value""")
def sim_percentile(fx: Fixtures):
    cuts = V.band_cuts(fx.edges).filter("grp = 'all'")
    vals = (fx.threshold.select(F.col("threshold").alias("x")).union(cuts.select("lo")).union(cuts.select("hi"))
            .agg(F.sort_array(F.collect_set("x")).alias("vals")))
    return V.pair_ranks(fx.row_vectors, vals).select("value", rnd(F.col("below") / F.col("total")).alias("percentile"))


@query("vec_quantize_int8", """WITH m AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS m FROM fx_row_vectors)
    SELECT entity, string_agg(round(x / m * 127)::BIGINT::VARCHAR, ',' ORDER BY dim) AS q FROM (SELECT entity, unnest(v) AS x,
    generate_subscripts(v, 1) AS dim FROM fx_row_vectors), m GROUP BY entity""")
def vec_quantize_int8(fx: Fixtures):
    return V.quantize_int8(fx.row_vectors).select("entity", F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


QUANT = """m AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) AS m FROM fx_row_vectors),
    q AS (SELECT entity, list_transform(v, lambda x: round(x / m * 127)) AS q FROM fx_row_vectors, m),
    dq AS (SELECT entity, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS v FROM q)"""


@query("vec_dequantize_norm", f"""WITH {QUANT} SELECT entity, dim::BIGINT - 1 AS dim, round(x, 6) + 0.0 AS x FROM (SELECT entity, unnest(v) AS x,
    generate_subscripts(v, 1) AS dim FROM dq)""")
def vec_dequantize_norm(fx: Fixtures):
    return dims(V.quantize_int8(fx.row_vectors).select("entity", V.dequantize_unit("q").alias("v")), "entity")


@query("audit_quantize", f"""WITH {QUANT}, p AS (SELECT a.entity AS i, b.entity AS j, round(list_dot_product(a.v, b.v), 9) AS sim
      FROM dq a JOIN dq b ON a.entity <> b.entity),
    a AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM fx_pairs) WHERE r <= 10),
    b AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM p) WHERE r <= 10)
    SELECT (SELECT count(*) FROM a) AS neighbours, count(*) AS kept, round(count(*) / (SELECT count(*) FROM a), 4) + 0.0 AS share
    FROM a JOIN b USING (i, j)""")
def audit_quantize(fx: Fixtures):
    exact = V.top_neighbours(fx.row_vectors, 10).select("i", "j")
    coarse = V.top_neighbours(V.quantize_int8(fx.row_vectors).select("entity", V.dequantize_unit("q").alias("v")), 10)
    both = exact.join(coarse.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left")
    return both.agg(F.count("*").alias("neighbours"), F.count("hit").alias("kept")).select(
        "neighbours", "kept", rnd(F.col("kept") / F.col("neighbours"), 4).alias("share"))
