"""Queries over the similarity and co-membership graphs."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import graph as G
from affinor.operators.ranking import distributed_rank, rnd, top_k
from affinor.plans.fixtures import Fixtures
from affinor.plans.registry import query

ADJ = """adj AS (SELECT source AS entity, target AS other, sim, apart FROM fx_edges UNION ALL SELECT target, source, sim, apart FROM fx_edges)"""


@query("edge_adjacency", f"""WITH {ADJ} SELECT entity, other, rank, round(sim, 6) + 0.0 AS sim FROM (SELECT *, row_number() OVER (PARTITION BY entity
    ORDER BY sim DESC, other) AS rank FROM adj)""")
def edge_adjacency(fx: Fixtures):
    """Every neighbour of every entity, strongest first; a hub's list is ranked in several tasks."""
    return distributed_rank(fx.adjacency, ["entity", "type"], [("sim",), "other"]).select("entity", "other", "rank", rnd("sim").alias("sim"))


@query("edges_visible", """SELECT mode, source, target FROM (SELECT 'similarity' AS mode, * FROM fx_edges UNION ALL SELECT 'cross', * FROM fx_edges WHERE apart) e
    WHERE EXISTS (SELECT 1 FROM fx_row_vectors r WHERE r.entity = source AND r.cluster < 7) AND EXISTS (SELECT 1 FROM fx_row_vectors r WHERE r.entity = target AND r.cluster < 7)""")
def edges_visible(fx: Fixtures):
    e = fx.edges.withColumn("type", F.lit("similarity"))
    keep = fx.members.filter("cluster < 7")
    return (G.visible(e, keep, "similarity").select(F.lit("similarity").alias("mode"), "source", "target")
            .union(G.visible(e, keep, "cross").select(F.lit("cross").alias("mode"), "source", "target")))


@query("entity_degree", f"WITH {ADJ} SELECT entity, count(DISTINCT other) AS degree FROM adj GROUP BY 1")
def entity_degree(fx: Fixtures):
    return G.degree(fx.edges)


RANKS = f"""{ADJ}, deg AS (SELECT entity, count(DISTINCT other) AS degree FROM adj GROUP BY 1),
    rk AS (SELECT entity, coalesce(CASE WHEN entity % 10 <> 0 THEN cluster END, -1) AS cluster, n_items, coalesce(degree, 0) AS degree FROM fx_row_vectors LEFT JOIN deg USING (entity)),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, n_items DESC, entity) - 1 AS rank, count(*) OVER (PARTITION BY cluster) AS size FROM rk)"""


@query("detail_ranks", f"""WITH {RANKS} SELECT entity, cluster, degree, rank, size, round((rank + 1) / size, 6) + 0.0 AS share, rank = 0 AND size >= 2 AS hub,
    rank = 0 OR round((rank + 1) / size, 6) <= (800.0 * 600 / 7000 * 4) / (SELECT count(*) FROM fx_row_vectors) AS drawn FROM ranks""")
def detail_ranks(fx: Fixtures):
    e = fx.members.withColumn("cluster", F.when(F.col("entity") % 10 != 0, F.col("cluster")))
    ranks = G.detail_ranks(e, G.degree(fx.edges))
    shown = G.drawn(ranks, fx.members.agg(F.count("*").alias("n")), 800 * 600, 2.0).select("entity", F.lit(True).alias("drawn"))
    return (ranks.join(shown, "entity", "left")
            .select("entity", "cluster", "degree", "rank", "size", "share", "hub", F.coalesce("drawn", F.lit(False)).alias("drawn")))


@query("modularity", """WITH e AS (SELECT sim AS w, a.cluster AS ca, b.cluster AS cb FROM fx_knn JOIN fx_row_vectors a ON a.entity = source JOIN fx_row_vectors b ON b.entity = target),
    m AS (SELECT sum(w) AS m FROM e), d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY 1),
    l AS (SELECT ca AS c, sum(w) AS l FROM e WHERE ca = cb GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - 1.0 * (d / (2 * m)) ** 2), 6) + 0.0 AS modularity FROM d LEFT JOIN l USING (c), m""")
def modularity(fx: Fixtures):
    part = fx.members.select(F.col("entity").alias("node"), F.col("cluster").alias("community"))
    return G.modularity(fx.knn, part, weight="sim").select(rnd("modularity").alias("modularity"))


@query("cluster_geometry", """SELECT cluster, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, count(*) AS size, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) * 1.5 + 14, 6) AS radius
    FROM fx_row_vectors JOIN (SELECT cluster, avg(x) AS cx, avg(y) AS cy FROM fx_row_vectors GROUP BY 1) USING (cluster) GROUP BY cluster, cx, cy""")
def cluster_geometry(fx: Fixtures):
    return G.geometry(fx.members, "cluster").select("cluster", rnd("cx").alias("cx"), rnd("cy").alias("cy"), "size", rnd("radius").alias("radius"))


LABELS = """pr AS (SELECT r.cluster, r.subcluster, s.topic, s.weight FROM fx_row_share s JOIN fx_row_vectors r USING (entity)),
    cg AS (SELECT cluster, topic, sum(weight) AS w FROM pr GROUP BY 1, 2),
    cs AS (SELECT cluster, topic, w / sum(w) OVER (PARTITION BY cluster) * ln(1 + (SELECT sum(w) / count(DISTINCT cluster) FROM cg) / sum(w) OVER (PARTITION BY topic)) AS s FROM cg),
    ck AS (SELECT cluster, string_agg(topic, ';' ORDER BY rn) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 6) DESC, topic) AS rn FROM cs) WHERE rn <= 5 GROUP BY 1),
    sg AS (SELECT cluster, subcluster, topic, sum(weight) AS w FROM pr GROUP BY 1, 2, 3),
    av AS (SELECT cluster, sum(w) / count(DISTINCT subcluster) AS a, count(DISTINCT subcluster) AS parts FROM sg GROUP BY 1),
    ss AS (SELECT cluster, subcluster, topic, parts, w / sum(w) OVER (PARTITION BY subcluster) * ln(1 + a / sum(w) OVER (PARTITION BY cluster, topic)) AS s FROM sg JOIN av USING (cluster)),
    sk AS (SELECT cluster, subcluster, any_value(parts) AS parts, string_agg(topic, ';' ORDER BY rn) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY cluster, subcluster ORDER BY round(s, 6) DESC, topic) AS rn FROM ss) WHERE rn <= 5 GROUP BY 1, 2),
    kw AS (SELECT 'cluster' AS level, cluster AS id, keywords FROM ck UNION ALL SELECT 'subcluster', subcluster, CASE WHEN parts > 1 THEN sk.keywords ELSE ck.keywords END FROM sk JOIN ck USING (cluster)),
    lb AS (SELECT 'cluster' AS level, r_regionkey::BIGINT AS id, r_name AS label, 'an old list' AS labelled FROM region)"""


@query("cluster_labels", f"""WITH {LABELS} SELECT level, id, keywords, coalesce(label, 'Group ' || (id + 1)) AS label, labelled IS NOT NULL AND labelled <> keywords AS stale
    FROM kw LEFT JOIN lb USING (level, id)""")
def cluster_labels(fx: Fixtures):
    prof = fx.row_share.join(fx.members.select("entity", "cluster", "subcluster"), "entity").select("cluster", "subcluster", "topic", "weight")
    labels = fx.t("region").select(F.lit("cluster").alias("level"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("label"),
                                   F.lit("an old list").alias("labelled"))
    return G.cluster_labels(prof, labels)


@query("neighbour_caution", f"""WITH {ADJ} SELECT entity, other, CASE WHEN a.n_items <= b.n_items THEN a.entity ELSE b.entity END AS least,
    CASE WHEN least(a.n_items, b.n_items) <= 5 THEN 'strong' WHEN least(a.n_items, b.n_items) <= 10 THEN 'mild' ELSE 'none' END AS caution FROM (
      SELECT a.entity, x.other, a.n_items, b.n_items AS nb FROM adj x JOIN fx_row_vectors a ON a.entity = x.entity JOIN fx_row_vectors b ON b.entity = x.other)""".replace(
    "SELECT entity, other, CASE WHEN a.n_items <= b.n_items THEN a.entity ELSE b.entity END AS least", "SELECT entity, other, CASE WHEN nb < n_items THEN other ELSE entity END AS least").replace(
    "least(a.n_items, b.n_items)", "least(n_items, nb)"))
def neighbour_caution(fx: Fixtures):
    n = fx.members.select("entity", "n_items")
    j = fx.adjacency.join(n, "entity").join(n.select(F.col("entity").alias("other"), F.col("n_items").alias("nb")), "other")
    small = F.least("n_items", "nb")
    return j.select("entity", "other", F.when(F.col("nb") < F.col("n_items"), F.col("other")).otherwise(F.col("entity")).alias("least"),
                    F.when(small <= 5, "strong").when(small <= 10, "mild").otherwise("none").alias("caution"))


def _best_pair(rank: int) -> str:
    """The best pair of every edge whose titles no earlier round has used."""
    used = " ".join(f"AND NOT EXISTS (SELECT 1 FROM p{r} u WHERE u.source = p.source AND u.target = p.target AND (u.norm_a = p.norm_a OR u.norm_b = p.norm_b))" for r in range(1, rank))
    return f"""p{rank} AS (SELECT p.*, {rank}::BIGINT AS rank FROM pairs p WHERE true {used}
      QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY sim DESC, item_a, item_b) = 1)"""


CLOSEST = f"""sims AS (SELECT a.entity AS i, b.entity AS j, round(list_dot_product(a.v, b.v), 9) AS sim FROM fx_entity_vectors a JOIN fx_entity_vectors b ON a.entity <> b.entity),
    knn AS (SELECT DISTINCT least(i, j) AS source, greatest(i, j) AS target FROM (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 5)),
    newest AS (SELECT entity, item, v, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM fx_item_vectors v JOIN fx_items t USING (item)
      QUALIFY row_number() OVER (PARTITION BY entity ORDER BY v.year DESC, item) <= 30),
    sa AS (SELECT source, target, item, norm, v FROM knn JOIN newest ON entity = source WHERE NOT EXISTS (SELECT 1 FROM fx_item_vectors o WHERE o.entity = target AND o.item = newest.item)),
    sb AS (SELECT source, target, item, norm, v FROM knn JOIN newest ON entity = target WHERE NOT EXISTS (SELECT 1 FROM fx_item_vectors o WHERE o.entity = source AND o.item = newest.item)),
    pairs AS (SELECT a.source, a.target, a.item AS item_a, b.item AS item_b, a.norm AS norm_a, b.norm AS norm_b, round(list_dot_product(a.v, b.v), 9) AS sim
      FROM (SELECT * FROM sa ANTI JOIN sb USING (source, target, norm)) a JOIN (SELECT * FROM sb ANTI JOIN sa USING (source, target, norm)) b USING (source, target)),
    {_best_pair(1)}, {_best_pair(2)}, {_best_pair(3)}"""


@query("closest_item_pairs", f"""WITH {CLOSEST} SELECT source, target, rank, item_a, item_b, round(sim, 6) + 0.0 AS sim
    FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)""")
def closest_item_pairs(fx: Fixtures):
    from affinor.operators import vectors as V
    items = (fx.item_vectors.join(fx.items.select("item", "title"), "item"))
    best = top_k(items, ["entity"], [F.col("year").desc(), F.col("item")], 30)
    edges = V.undirected(V.top_neighbours(fx.entity_vectors, 5))
    return G.closest_item_pairs(edges, best, fx.item_vectors.select("entity", "item")).withColumn("sim", rnd("sim"))


CHOSEN = """chosen AS (SELECT entity, row_number() OVER (ORDER BY pos) AS ord FROM (SELECT u.e::BIGINT AS entity, min(u.p) AS pos FROM (SELECT unnest([3, 17, 99999999, 3, 40, 41, 42]) AS e,
      unnest([1, 2, 3, 4, 5, 6, 7]) AS p) u JOIN fx_row_vectors r ON r.entity = u.e GROUP BY 1) QUALIFY row_number() OVER (ORDER BY pos) <= 4)"""


@query("compare_entities", f"""WITH {CHOSEN}, {ADJ}, co AS (SELECT a.entity, b.entity AS other, count(*) AS items FROM fx_home a JOIN fx_home b ON a.item = b.item AND a.entity <> b.entity GROUP BY 1, 2)
    SELECT a.entity, b.entity AS other, CASE WHEN x.sim IS NOT NULL AND c.items IS NOT NULL THEN 'similar, shared items' WHEN x.sim IS NOT NULL THEN 'similar'
      WHEN c.items IS NOT NULL THEN 'shared items' ELSE 'none' END AS link, coalesce(c.items, 0) AS items
    FROM chosen a JOIN chosen b ON a.entity <> b.entity LEFT JOIN adj x ON x.entity = a.entity AND x.other = b.entity LEFT JOIN co c ON c.entity = a.entity AND c.other = b.entity""")
def compare_entities(fx: Fixtures):
    from affinor.operators.recommend import chosen_set, compare
    picked = chosen_set(fx.spark, [3, 17, 99999999, 3, 40, 41, 42], fx.members.select("entity"), 4)
    return compare(picked, fx.adjacency, fx.home)


@query("facet_filter", """SELECT entity FROM fx_row_vectors WHERE cluster IN (1, 2, 3, 6, 7) AND len(list_intersect(fields, [1, 2])) > 0""")
def facet_filter(fx: Fixtures):
    from affinor.operators.recommend import passes_facets
    return fx.members.filter(passes_facets({"cluster": [1, 2, 3, 6, 7], "n_items": []}, {"fields": [1, 2]})).select("entity")


@query("facet_counts", """SELECT 'cluster' AS facet, cluster AS value, count(*) AS n FROM fx_row_vectors WHERE len(list_intersect(fields, [1, 2])) > 0 GROUP BY 2
    UNION ALL SELECT 'field', f, count(*) FROM (SELECT unnest(fields) AS f FROM fx_row_vectors) GROUP BY 2""")
def facet_counts(fx: Fixtures):
    from affinor.operators.recommend import passes_facets
    under = fx.members.filter(passes_facets({}, {"fields": [1, 2]})).groupBy("cluster").agg(F.count("*").alias("n"))
    whole = fx.members.select(F.explode("fields").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    return under.select(F.lit("cluster").alias("facet"), F.col("cluster").alias("value"), "n").union(
        whole.select(F.lit("field").alias("facet"), F.col("f").alias("value"), "n"))
