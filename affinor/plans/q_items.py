"""Queries over items, memberships and counters."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.operators import items as I
from affinor.operators.ranking import rnd, top_k
from affinor.plans.fixtures import AS_OF, Fixtures
from affinor.plans.registry import query
from affinor.rules import PARAMS


@query("pub_date_fallback", "SELECT item, strftime(pub_date, '%Y-%m-%d') AS pub_date FROM fx_pub")
def pub_date_fallback(fx: Fixtures):
    return fx.items.select("item", I.publication_date().cast("string").alias("pub_date"))


@query("cites_per_year", """SELECT item, round(cites / greatest(datediff('day', pub_date, DATE '2001-08-01') / 365.25, 1.0), 6) + 0.0 AS per_year
    FROM fx_pub""")
def cites_per_year(fx: Fixtures):
    return (fx.items.withColumn("pub_date", I.publication_date())
            .select("item", rnd(I.cites_per_year(AS_OF)).alias("per_year")))


@query("authors_alphabetical", "SELECT item, n_authors, alphabetical FROM fx_item_authors")
def authors_alphabetical(fx: Fixtures):
    return I.author_stats(fx.author_names)


@query("membership_roles", "SELECT item, entity, position, is_corr, at_home FROM fx_roles")
def membership_roles(fx: Fixtures):
    return fx.roles


@query("membership_flags", "SELECT item, entity, order_agnostic, senior, at_home AS in_analysis FROM fx_memberships")
def membership_flags(fx: Fixtures):
    return fx.memberships.select("item", "entity", "order_agnostic", "senior", F.col("at_home").alias("in_analysis"))


@query("items_eligible", "SELECT item, entity, field, year, type, n_authors FROM fx_eligible")
def items_eligible(fx: Fixtures):
    return fx.eligible.select("item", "entity", "field", "year", "type", "n_authors")


@query("items_not_excluded", "SELECT item, entity FROM fx_kept")
def items_not_excluded(fx: Fixtures):
    return I.drop_excluded(fx.eligible, fx.exclusions).select("item", "entity")


@query("entity_counters", "SELECT * FROM fx_counters")
def entity_counters(fx: Fixtures):
    return fx.counters


@query("item_entities", """SELECT item, entity, position, is_corr, at_home, order_agnostic, count(*) OVER w AS n_entities, max(title) OVER w AS title, max(year) OVER w AS year,
    max(cites) OVER w AS cites FROM fx_kept WINDOW w AS (PARTITION BY item)""")
def item_entities(fx: Fixtures):
    return I.item_entities(I.drop_excluded(fx.eligible, fx.exclusions))


@query("items_merged", """SELECT item, 0::BIGINT AS part, count(*) AS n_entities, any_value(title) AS title, any_value(year) AS year,
    any_value(cites) AS cites, string_agg(entity || ':' || position, ',' ORDER BY entity) AS roles FROM fx_kept GROUP BY item""")
def items_merged(fx: Fixtures):
    return (I.items_merged(I.drop_excluded(fx.eligible, fx.exclusions))
            .withColumn("roles", F.array_join(F.transform(
                "roles", lambda r: F.concat_ws(":", r["entity"].cast("string"), r["position"])), ",")))


@query("membership_qualified", """SELECT k.item, k.entity FROM fx_kept k JOIN fx_counters c USING (entity) WHERE c.meets_criterion""")
def membership_qualified(fx: Fixtures):
    kept = I.drop_excluded(fx.eligible, fx.exclusions)
    return kept.select("item", "entity").join(fx.counters.filter("meets_criterion").select("entity"), "entity", "left_semi")


@query("items_for_vector", """SELECT entity, item, rank FROM (SELECT entity, item, row_number() OVER
    (PARTITION BY entity ORDER BY senior DESC, pub_date DESC, item DESC) AS rank FROM fx_eligible WHERE at_home) WHERE rank <= 30""")
def items_for_vector(fx: Fixtures):
    return I.items_for_vector(fx.eligible, PARAMS.vector_items).select("entity", "item", F.col("rank").cast("long").alias("rank"))


REPRESENTATIVES = """cand AS (SELECT entity, item, year, cites, pub_date,
      round(cites / greatest(datediff('day', pub_date, DATE '2001-08-01') / 365.25, 1.0), 6) AS per_year
      FROM fx_eligible WHERE at_home AND senior AND abstract IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY per_year DESC, cites DESC, pub_date DESC, item) AS rn FROM cand),
    late AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rn) AS ln FROM ranked WHERE year >= 2000 AND rn > 3),
    state AS (SELECT entity, bool_or(year >= 2000) AS ok, count(*) AS n FROM ranked WHERE rn <= 3 GROUP BY entity),
    reps AS (SELECT entity, item, per_year, year, rn AS rank FROM ranked r JOIN state USING (entity)
        WHERE rn <= 3 AND (ok OR rn < 3 OR NOT EXISTS (SELECT 1 FROM late l WHERE l.entity = r.entity))
      UNION ALL SELECT l.entity, l.item, l.per_year, l.year, 3 FROM late l JOIN state USING (entity) WHERE ln = 1 AND NOT ok)"""


@query("representatives", f"""WITH {REPRESENTATIVES} SELECT entity, item, per_year, year, rank FROM reps""")
def representatives(fx: Fixtures):
    return (I.representatives(fx.eligible, AS_OF, PARAMS.representatives, PARAMS.recent_years)
            .withColumn("rank", F.col("rank").cast("long")))


@query("newest_titles", """SELECT entity, count(*) AS n, string_agg(title, ' | ' ORDER BY rank) AS titles FROM (SELECT entity, title,
    row_number() OVER (PARTITION BY entity ORDER BY pub_date DESC, item DESC) AS rank FROM fx_eligible WHERE at_home AND senior)
    WHERE rank <= 12 GROUP BY entity""")
def newest_titles(fx: Fixtures):
    return I.newest_titles(fx.eligible, 12)


@query("coauthor_edges", """SELECT a.entity AS source, b.entity AS target, count(*) AS weight
    FROM fx_home a JOIN fx_home b ON a.item = b.item AND a.entity < b.entity GROUP BY 1, 2""")
def coauthor_edges(fx: Fixtures):
    return I.coauthor_edges(fx.home)


@query("coauthor_items", """SELECT a.entity AS source, b.entity AS target, a.item FROM fx_home a JOIN fx_home b ON a.item = b.item AND a.entity < b.entity""")
def coauthor_items(fx: Fixtures):
    return I.coauthor_items(fx.home.select("item", "entity"))


@query("enrich_left_coalesce", "SELECT i.item, coalesce(n.text, i.tldr) AS tldr FROM fx_items i LEFT JOIN documents n ON n.doc_id = i.item")
def enrich_left_coalesce(fx: Fixtures):
    new = fx.t("documents").select(F.col("doc_id").alias("item"), F.col("text").alias("new"))
    return fx.items.join(new, "item", "left").select("item", F.coalesce("new", "tldr").alias("tldr"))


@query("export_items", """WITH keep AS (SELECT entity FROM fx_counters WHERE meets_criterion)
    SELECT item, 0::BIGINT AS part, any_value(title) AS title, any_value(abstract) IS NOT NULL AS has_abstract,
    any_value(tldr) IS NOT NULL AS has_tldr, string_agg(entity || '=' || position || '/' || is_corr::VARCHAR, ';' ORDER BY entity) AS roles
    FROM fx_kept JOIN keep USING (entity) WHERE at_home GROUP BY item""")
def export_items(fx: Fixtures):
    kept = I.drop_excluded(fx.eligible, fx.exclusions).filter("at_home")
    keep = fx.counters.filter("meets_criterion").select("entity")
    pub = I.items_merged(kept.join(keep, "entity", "left_semi"))
    attrs = fx.items.select("item", F.col("abstract").isNotNull().alias("has_abstract"), F.col("tldr").isNotNull().alias("has_tldr"))
    # the roles become a map keyed by entity in the published shape; text columns are left out
    as_map = F.map_from_entries(F.transform("roles", lambda r: F.struct(r["entity"], F.struct(r["position"], r["is_corr"]))))
    out = pub.join(attrs, "item").withColumn("m", as_map)
    return out.select("item", "part", "title", "has_abstract", "has_tldr", F.array_join(F.transform(
        F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]["position"], F.lit("/"),
                                                             e["value"]["is_corr"].cast("string"))), ";").alias("roles"))
