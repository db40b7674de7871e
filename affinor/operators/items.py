"""Items and memberships: roles, field rules, counters, selections (long tables, one row per item and entity)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.operators.ranking import chunked_list, top_k


def publication_date(pub_raw: str = "pub_raw", year: str = "year") -> Column:
    """ISO date where it parses, else the middle of the publication year."""
    return F.coalesce(F.col(pub_raw).try_cast("date"), F.make_date(F.col(year), F.lit(7), F.lit(1)))


def cites_per_year(as_of: str, cites: str = "cites", pub: str = "pub_date") -> Column:
    return F.col(cites) / F.greatest(F.datediff(F.lit(as_of).cast("date"), F.col(pub)) / F.lit(365.25), F.lit(1.0))


def is_senior(position: str = "position", corr: str = "is_corr", agnostic: str | None = "order_agnostic") -> Column:
    c = (F.col(position) == "last") | F.col(corr)
    return c | F.coalesce(F.col(agnostic), F.lit(False)) if agnostic else c


def with_positions(authorships: DataFrame) -> DataFrame:
    """first / last / middle from the order number. The ends come from a combinable aggregate, not a window."""
    ends = authorships.groupBy("item").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    return authorships.join(ends, "item").withColumn(
        "position", F.when(F.col("pos") == F.col("_first"), "first").when(F.col("pos") == F.col("_last"), "last")
        .otherwise("middle")).drop("_first", "_last")


def own_roles(positioned: DataFrame) -> DataFrame:
    """The entity's first authorship on each item; a missing position counts as middle."""
    role = F.struct(F.coalesce("position", F.lit("middle")).alias("position"), "is_corr",
                    F.coalesce("at_home", F.lit(True)).alias("at_home"))
    return (positioned.groupBy("item", "entity").agg(F.min_by(role, F.col("pos")).alias("r"))
            .select("item", "entity", "r.position", "r.is_corr", "r.at_home"))


def author_stats(authors: DataFrame) -> DataFrame:
    """Per item: number of authors and whether three or more stand in name order. The author list of an item arrives as
    one record of the landed works, so the list rebuilt here is never longer than that record."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "name", last_token(F.col("name")).alias("last"))))
    return (authors.groupBy("item").agg(F.count("*").alias("n_authors"), listed.alias("l"))
            .select("item", "n_authors", in_order(F.col("l.last")).alias("alphabetical")))


def last_token(name: Column) -> Column:
    return F.element_at(F.split(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"\s+"), -1)


def in_order(last: Column) -> Column:
    """Three or more tokens, none of them empty, in order."""
    return (F.size(last) >= 3) & ~F.array_contains(last, "") & (last == F.sort_array(last))


def alphabetical(names: str | Column) -> Column:
    """Three or more authors in the order of the last token of their names; any author without a token means no."""
    c = F.col(names) if isinstance(names, str) else names
    return in_order(F.transform(c, last_token))


def credit_roles(roles: DataFrame, entity_field: DataFrame, rules: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the order-agnostic credit of the entity's field and the senior flag. `rules` is one row per field."""
    plain = is_senior(agnostic=None)
    by_rule = F.col("position_agnostic") | (F.col("alphabetical_counts") & F.col("alphabetical"))
    return (roles.join(entity_field, "entity").join(F.broadcast(rules), "field").join(stats, "item")
            .withColumn("order_agnostic", ~plain & by_rule).withColumn("senior", plain | by_rule))


def eligible_memberships(roles: DataFrame, items: DataFrame, entity_field: DataFrame, rules: DataFrame,
                         stats: DataFrame, year_from: int, year_to: int) -> DataFrame:
    """Field rule: counted type, year in the window, fewer authors than the field's limit."""
    inside = items.filter(F.col("year").between(year_from, year_to)).withColumn("pub_date", publication_date())
    return (credit_roles(roles, entity_field, rules, stats).join(inside, "item")
            .filter(F.array_contains("types", F.col("type"))
                    & (F.col("max_authors").isNull() | (F.col("n_authors") < F.col("max_authors")))))


def drop_excluded(memberships: DataFrame, exclusions: DataFrame) -> DataFrame:
    return memberships.join(exclusions, ["entity", "item"], "left_anti")


def entity_counters(m: DataFrame) -> DataFrame:
    has = F.col("abstract").isNotNull()
    return m.groupBy("entity", "field").agg(
        F.count("*").alias("n_all"), F.count_if("senior").alias("n_senior"), F.count_if(has).alias("n_abstract"),
        F.count_if(F.col("senior") & has).alias("n_senior_abstract"), F.count_if("at_home").alias("n_home"),
        F.count_if(F.col("at_home") & F.col("senior") & has).alias("n_home_senior_abstract"),
        (F.count_if("senior") >= F.first("min_items")).alias("meets_criterion"))


def items_for_vector(m: DataFrame, limit: int) -> DataFrame:
    """Analysis items per entity, senior ones first, then the newest, at most `limit`."""
    return top_k(m.filter("at_home"), ["entity"], [F.col("senior").desc(), F.col("pub_date").desc(), F.col("item").desc()],
                 limit)


def representatives(m: DataFrame, as_of: str, n: int, recent_years: int) -> DataFrame:
    """Up to n items per entity by citations per year; when none of them is recent, the best recent one takes the last
    place (or is added). Both candidate lists are top-k per entity, so a large entity is cut before the shuffle."""
    c = (m.filter(F.col("at_home") & F.col("senior") & F.col("abstract").isNotNull())
         .withColumn("per_year", F.round(cites_per_year(as_of), 6)))
    order = [F.col("per_year").desc(), F.col("cites").desc(), F.col("pub_date").desc(), F.col("item")]
    recent_from = int(as_of[:4]) - recent_years + 1
    top = top_k(c, ["entity"], order, n).select("entity", "item", "per_year", "year", "rank")
    best = top_k(c.filter(F.col("year") >= recent_from), ["entity"], order, 1).select(
        "entity", F.col("item").alias("_item"), F.col("per_year").alias("_py"), F.col("year").alias("_year"))
    state = top.groupBy("entity").agg(F.count("*").alias("_n"), F.max(F.col("year") >= recent_from).alias("_ok"))
    swap = state.filter(~F.col("_ok")).join(best, "entity")
    kept = (top.join(swap.select("entity", F.lit(True).alias("_swap")), "entity", "left")
            .filter(F.col("_swap").isNull() | (F.col("rank") < n)).drop("_swap"))
    added = swap.select("entity", F.col("_item").alias("item"), F.col("_py").alias("per_year"),
                        F.col("_year").alias("year"), F.least(F.col("_n") + 1, F.lit(n)).cast("int").alias("rank"))
    return kept.unionByName(added)


def item_entities(m: DataFrame) -> DataFrame:
    """One row per item and entity: the entity's role, the item's attributes and how many entities it has. An item of any number of entities
    is never one list; a hot item's count is summed in the map tasks and joined back to its rows."""
    per = m.groupBy("item").agg(F.count("*").alias("n_entities"), F.max("title").alias("title"), F.max("year").alias("year"), F.max("cites").alias("cites"))
    return m.select("item", "entity", "position", "is_corr", "at_home", "order_agnostic").join(per, "item")


def items_merged(m: DataFrame) -> DataFrame:
    """The export view of `item_entities`: one row per item with the list of its entities and their roles. A list of more than 10,000 comes in
    several rows (parts), each of them with the whole count; who needs all roles of such items as they are takes `item_entities`."""
    entry = F.struct("entity", "position", "is_corr", "at_home", "order_agnostic")
    first = m.groupBy("item").agg(F.count("*").alias("n_entities"), F.max("title").alias("title"), F.max("year").alias("year"),
                                  F.max("cites").alias("cites"))
    return chunked_list(m, ["item"], entry, "roles", "entity").join(first, "item")


def newest_titles(m: DataFrame, n: int) -> DataFrame:
    rows = top_k(m.filter(F.col("at_home") & F.col("senior")), ["entity"], [F.col("pub_date").desc(), F.col("item").desc()], n)
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), " | ").alias("titles"))


def coauthor_items(home: DataFrame, block: int = 1000) -> DataFrame:
    """(source, target, item): every pair of entities that share an item. Members of an item are dealt into blocks of about `block`
    and joined block by block, so an item with very many members becomes many tasks; other items have one block."""
    n = home.groupBy("item").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    m = home.join(n, "item").withColumn("_own", F.pmod(F.xxhash64("entity"), F.col("_n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    a = m.select("item", F.col("entity").alias("source"), F.col("_own").alias("_a"), every.alias("_b"))
    b = m.select("item", F.col("entity").alias("target"), every.alias("_a"), F.col("_own").alias("_b"))
    return a.join(b, ["item", "_a", "_b"]).filter(F.col("source") < F.col("target")).select("source", "target", "item")


def coauthor_edges(home: DataFrame, block: int = 1000) -> DataFrame:
    """Co-membership edges: one row per pair of entities sharing items, weight = number of shared items, counted in the map tasks."""
    return coauthor_items(home, block).groupBy("source", "target").agg(F.count("*").alias("weight"))
