"""Views that map the supplied tables onto the engine's vocabulary (entities, items, memberships, topics, vectors)."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinor.operators import items as I
from affinor.operators import resolve as R
from affinor.operators import topics as T
from affinor.operators import vectors as V
from affinor.operators.ranking import grouped_quantiles
from affinor.rules import PARAMS, rules_frame
from affinor.session import cut_lineage

YEAR_FROM, YEAR_TO = 1997, 2001
AS_OF = "2001-08-01"
EARLY, RECENT = (1997, 1998), (2000, 2001)
RULE_ROWS = [
    (0, 5, False, False, None, ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    (1, 5, False, False, None, ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    (2, 5, False, False, 6, ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    (3, 4, True, False, None, ["1-URGENT", "2-HIGH", "3-MEDIUM"]),
    (4, 5, False, True, 6, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]),
]


def field_mask(fields: str):
    """Fields as bits of a long, so that two sets are compared with one AND. A field that has no bit is an error."""
    bit = lambda f: F.when((f >= 0) & (f < 63), F.call_function("shiftleft", F.lit(1).cast("long"), f.cast("int"))).otherwise(F.raise_error(F.lit("fields must be numbered from 0 to 62")).cast("long"))
    return F.aggregate(fields, F.lit(0).cast("long"), lambda m, f: m.bitwiseOR(bit(f)))


MIDDLES = ("Jo", "Min")


def letters(c):
    """Digits of a key spelled as letters."""
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def full_name(b):
    mid = F.element_at(F.array(*[F.lit(m) for m in MIDDLES]), (b % 8 / 4).cast("int") + 1)
    return F.concat_ws(" ", F.initcap(F.split("p_name", " ")[0]), mid, F.concat(F.initcap(F.split("p_name", " ")[1]), letters(b)))


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---------------------------------------------------------------- entities, rules
    @cached_property
    def entities(self) -> DataFrame:
        s, n = self.t("supplier"), self.t("nation")
        r = F.col("n_regionkey").cast("long")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("entity"), F.col("s_name").alias("name"),
            F.col("s_nationkey").cast("long").alias("dept"), r.alias("univ"), r.alias("field"),
            F.when(F.col("s_suppkey") % 7 == 0, F.array(r, (r + 1) % 5)).otherwise(F.array(r)).alias("fields"),
            F.col("s_acctbal").alias("balance"))

    @cached_property
    def rules(self) -> DataFrame:
        return rules_frame(self.spark, RULE_ROWS)

    # ---------------------------------------------------------------- items, authorships, memberships
    @cached_property
    def items(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.t("orders").select(
            k.alias("item"),
            F.concat(F.lit("On "), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit(" case No. "), k).alias("title"),
            F.year("o_orderdate").alias("year"),
            F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("n/a"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("pub_raw"),
            F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cites"),
            F.col("o_orderpriority").alias("type"),
            F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Abstract of "), k)).alias("abstract"),
            F.when(k % 5 == 0, F.concat(F.lit("Short of "), k)).alias("tldr"))

    @cached_property
    def authorships(self) -> DataFrame:
        """(item, pos) rows: line numbers run from 1 to 7, so an item has at most seven of them after the aggregate. Written once: positions read
        them twice, author lists once more."""
        return cut_lineage(self.t("lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("pos")).agg(
            F.min("l_suppkey").alias("entity"),
            F.max(F.col("l_returnflag") == "R").alias("is_corr"),
            F.max(F.col("l_linestatus") == "O").alias("at_home")))

    @cached_property
    def roles(self) -> DataFrame:
        """Written once: memberships, exclusions and the analysis set all read them."""
        return cut_lineage(I.own_roles(I.with_positions(self.authorships)))

    @cached_property
    def eligible(self) -> DataFrame:
        """(item, entity) pairs that the entity's field rule admits, with role and rule columns. Written once: counters and selections read them."""
        return cut_lineage(I.eligible_memberships(self.roles, self.items, self.entities.select("entity", "field"), self.rules,
                                                  I.author_stats(self.author_names), YEAR_FROM, YEAR_TO))

    @cached_property
    def author_names(self) -> DataFrame:
        given = F.get(F.array(*[F.lit(x) for x in ("Zoe", "Amy", "Bob", "Mia", "Cal")]), (F.col("entity") % 5).cast("int"))
        surname = F.get(F.array(*[F.lit(x) for x in ("Ames", "Boyle", "Cox", "Dunn", "Egan", "Frey", "Gale")]), (F.col("entity") % 7).cast("int"))
        return self.authorships.join(self.entities.select("entity", F.concat_ws(" ", given, surname).alias("name")), "entity")

    @cached_property
    def memberships(self) -> DataFrame:
        """All roles with the order-agnostic credit of the field rule; no eligibility filter."""
        return I.credit_roles(self.roles, self.entities.select("entity", "field"), self.rules,
                              I.author_stats(self.author_names))

    @cached_property
    def exclusions(self) -> DataFrame:
        return self.roles.filter((F.col("item") * 31 + F.col("entity")) % 97 == 0).select("entity", "item")

    @cached_property
    def counters(self) -> DataFrame:
        return I.entity_counters(I.drop_excluded(self.eligible, self.exclusions))

    # ---------------------------------------------------------------- topics
    @cached_property
    def item_topics(self) -> DataFrame:
        li, p = self.t("lineitem"), self.t("part")
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.col("l_orderkey").alias("item"), F.col("p_name").alias("topic"), F.col("p_type").alias("subfield"),
            F.col("p_brand").alias("topic_field"), (F.col("l_quantity") / 50).alias("score"),
            F.col("l_linenumber").alias("pos"))

    @cached_property
    def home(self) -> DataFrame:
        """Analysis set: roles written at home (needs neither the field rule nor the author list)."""
        return self.roles.filter("at_home").select("item", "entity")

    @cached_property
    def profile(self) -> DataFrame:
        return T.topic_profile(self.home, self.item_topics)

    # ---------------------------------------------------------------- people and author profiles
    @cached_property
    def people(self) -> DataFrame:
        """Every fourth part is a person; the name is built from the part's words and its number."""
        b = F.col("p_partkey")
        return self.t("part").filter(b % 4 == 0).select(
            b.alias("person"), full_name(b).alias("name"), (b % 25).alias("dept"), (b % 5).alias("univ"), (b % 5).alias("field"),
            F.when(b % 20 == 0, F.concat(F.lit("O"), b)).alias("orcid"), (b % 12 == 0).alias("has_anchors"),
            F.when(b % 28 == 0, F.lit(None)).otherwise(F.concat(F.lit("p"), b - b % 8, F.lit("@example.org"))).alias("email"))

    @cached_property
    def profiles(self) -> DataFrame:
        """Author profiles: four per person with other spellings of the name, and attributes arithmetic in the key."""
        p = self.t("part")
        c = F.col("p_partkey")
        base = p.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("base"), F.col("p_name").alias("base_name"))
        j = p.select("p_partkey").withColumn("base", c - c % 4).join(base, "base")
        w1 = F.initcap(F.split("base_name", " ")[0])
        mid = F.element_at(F.array(*[F.lit(m) for m in MIDDLES]), (F.col("base") % 8 / 4).cast("int") + 1)
        last = F.concat(F.initcap(F.split("base_name", " ")[1]), letters(F.col("base")))
        name = (F.when(c % 4 == 0, F.concat(last, F.lit(", "), w1, F.lit("-"), mid))
                .when(c % 4 == 1, F.concat_ws(" ", F.concat(F.substring(w1, 1, 1), F.lit(".")), mid, last))
                .when(c % 4 == 2, F.concat_ws(" ", w1, F.concat(F.substring(mid, 1, 1), F.lit(".")), mid, last))
                .otherwise(F.concat_ws(" ", F.lit("Other"), mid, last)))
        inst = F.when(c % 6 == 0, (F.col("base") + 1) % 5).otherwise(F.col("base") % 5)
        topic = lambda n, f, d: F.struct(n.alias("count"), f.alias("field"), d.alias("domain"))
        return j.select(
            c.alias("candidate"), F.col("base").alias("person"), name.alias("name"),
            F.array(F.concat_ws(" ", w1, mid, last)).alias("alternatives"), (c % 97 * 3).alias("works"),
            F.when(c % 3 == 0, F.concat(F.lit("O"), c - c % 8)).alias("orcid"),
            F.array(F.struct(inst.alias("inst"), F.array(1990 + c % 12, 1991 + c % 12).alias("years")),
                    F.struct(((c + 2) % 5).alias("inst"), F.array(F.lit(1985).cast("long")).alias("years"))).alias("affiliations"),
            F.array(F.when(c % 3 < 2, F.col("base") % 5).otherwise((F.col("base") + 3) % 5)).alias("last_known"),
            F.array(topic(c % 7, c % 5, c % 2), topic(F.when(c % 3 != 0, c % 11), (c + 1) % 5, (c + 1) % 2),
                    topic(F.lit(2).cast("long"), F.col("base") % 5, F.col("base") % 2)).alias("topics"),
            F.when(c % 9 == 1, 3).when(c % 9 == 5, 1).when(c % 10 == 3, 7).otherwise(0).cast("long").alias("anchor_hits"))

    @cached_property
    def field_scope(self) -> DataFrame:
        """Topic fields (or, where none are given, domains) that count as inside a field: one row per field."""
        rows = [(f, [f, (f + 1) % 5] if f % 2 == 0 else None, [f % 2]) for f in range(5)]
        return self.spark.createDataFrame(rows, "field long, topic_fields array<long>, domains array<long>")

    @cached_property
    def evidence(self) -> DataFrame:
        pairs = self.profiles.join(self.people.select("person", F.col("name").alias("person_name"), "univ", "field",
                                                      F.col("orcid").alias("person_orcid")), "person")
        return cut_lineage(R.evidence(pairs, self.field_scope, YEAR_TO))

    @cached_property
    def profile_names(self) -> DataFrame:
        """(candidate, name): the display name and all alternatives."""
        return self.profiles.select("candidate", F.explode(F.concat(F.array("name"), "alternatives")).alias("name"))

    @cached_property
    def pool(self) -> DataFrame:
        """Candidates found from names: even departments go by the roster of their university, all others by a search among the
        profiles affiliated with it; every sixteenth person's publications also name somebody else's profile."""
        people = self.people.select("person", "name", "univ", (F.col("dept") % 2 == 0).alias("by_roster"))
        at = self.profiles.select("candidate", F.explode(F.array_distinct(F.transform("affiliations", lambda a: a["inst"]))).alias("univ"))
        listed = self.profiles.select("candidate", F.explode("last_known").alias("univ"))
        own = self.profiles.filter("anchor_hits > 0").select("person", "candidate", F.col("anchor_hits").alias("hits"))
        other = (self.people.filter("person % 16 = 0").select("person", (F.col("person") + 5).alias("candidate"), F.lit(2).cast("long").alias("hits"))
                 .join(self.profiles.select("candidate"), "candidate", "left_semi").select("person", "candidate", "hits"))
        return cut_lineage(R.candidate_pool(people, self.profile_names.join(listed, "candidate"), self.profile_names.join(at, "candidate"), own.unionByName(other), "univ"))

    @cached_property
    def pool_evidence(self) -> DataFrame:
        p = self.people.select("person", F.col("name").alias("person_name"), "univ", "field", F.col("orcid").alias("person_orcid"))
        pairs = self.pool.join(self.profiles.drop("person", "anchor_hits"), "candidate").join(p, "person")
        return cut_lineage(R.evidence(pairs, self.field_scope, YEAR_TO))

    @cached_property
    def decisions(self) -> DataFrame:
        return R.decide(self.people, self.evidence)

    # ---------------------------------------------------------------- vectors
    @cached_property
    def item_vectors(self) -> DataFrame:
        i = F.col("vec_id")
        return self.t("embeddings").select(
            i.alias("item"), (i % 50).alias("entity"), (1997 + F.floor(i / 50) % 5).cast("int").alias("year"),
            (i % 17).alias("cites"), (F.col("label") % 5).cast("long").alias("field"),
            F.col("embedding").cast("array<double>").alias("v"))

    @cached_property
    def row_vectors(self) -> DataFrame:
        """Every embedding as one entity; field = label % 5, fixed cluster and map position."""
        l = F.col("label").cast("long")
        return self.t("embeddings").select(
            F.col("vec_id").alias("entity"), (l % 5).alias("field"), l.alias("cluster"),
            (l * 2 + F.col("vec_id") % 2).alias("subcluster"),
            F.when(F.col("vec_id") % 7 == 0, F.array(l % 5, (l + 1) % 5)).otherwise(F.array(l % 5)).alias("fields"),
            F.when(F.col("vec_id") % 7 == 0, F.shiftleft(F.lit(1), 0) * 0).otherwise(F.lit(0)).alias("_z"), (F.col("vec_id") % 23 + 1).alias("n_items"),
            F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"),
            F.when(F.col("vec_id") % 29 == 0, F.lit("mixed_topics")).when(F.col("vec_id") % 31 == 0, F.lit("wrong_field"))
            .when(F.col("vec_id") % 37 == 0, F.lit("insufficient_papers")).alias("unreliable"),
            F.col("embedding").cast("array<double>").alias("v")).withColumn("mask", field_mask("fields"))

    @cached_property
    def vector_members(self) -> DataFrame:
        """Item rows of the vector entities; every fourth item belongs to a second entity too."""
        e = self.item_vectors
        return e.unionByName(e.filter("item % 4 = 0").withColumn("entity", (F.col("item") * 7 + 1) % 50)
                             .filter((F.col("item") * 7 + 1) % 50 != F.col("item") % 50))

    @cached_property
    def entity_vectors(self) -> DataFrame:
        return V.entity_vectors(self.item_vectors)

    @cached_property
    def places(self) -> DataFrame:
        """Entity vectors with a field, a university, a sub-cluster and a map position."""
        e = F.col("entity")
        return cut_lineage(self.entity_vectors).select("entity", "v", (e % 5).alias("field"), (e % 3).alias("univ"), (e % 6).alias("subcluster"),
                                                       F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))

    @cached_property
    def row_share(self) -> DataFrame:
        """Topic shares of the row entities: the topics of the item with the same number."""
        return T.topic_share(T.topic_profile(self.row_vectors.select("entity", F.col("entity").alias("item")), self.item_topics))

    @cached_property
    def knn(self) -> DataFrame:
        return V.undirected(self.topk)

    @cached_property
    def threshold(self) -> DataFrame:
        q = grouped_quantiles(self.topk, [], "sim", [PARAMS.threshold_quantile])
        return cut_lineage(q.select(F.round("q0", 4).alias("threshold")))

    @cached_property
    def edges(self) -> DataFrame:
        """Shown similarity edges with the two notions of crossing fields: no field in common, and different first fields."""
        bridges = V.undirected(self.neighbours.filter("kind = 1"))
        e = V.similarity_edges(self.knn, bridges, self.threshold)
        r = self.row_vectors
        a = r.select(F.col("entity").alias("source"), F.col("field").alias("fa"), F.col("mask").alias("ma"))
        b = r.select(F.col("entity").alias("target"), F.col("field").alias("fb"), F.col("mask").alias("mb"))
        return cut_lineage(e.join(a, "source").join(b, "target").select(
            "source", "target", "sim", "bridge", (F.col("ma").bitwiseAND(F.col("mb")) == 0).alias("apart"),
            F.when(F.col("fa") == F.col("fb"), F.concat(F.lit("f"), "fa")).otherwise("cross").alias("grp")))

    @cached_property
    def banded(self) -> DataFrame:
        return V.with_bands(self.edges, self.cuts, self.threshold)

    @cached_property
    def cuts(self) -> DataFrame:
        return cut_lineage(V.band_cuts(self.edges))

    @cached_property
    def neighbours(self) -> DataFrame:
        """Nearest rows and bridge candidates: the costly table, written once and read by everything built on it."""
        return cut_lineage(V.neighbours_and_bridges(self.row_vectors, PARAMS.k))

    @cached_property
    def topk(self) -> DataFrame:
        return self.neighbours.filter("kind = 0").drop("kind")

    # ---------------------------------------------------------------- the published graph and its reports
    @cached_property
    def members(self) -> DataFrame:
        """Row entities without their vectors."""
        return self.row_vectors.drop("v")

    @cached_property
    def adjacency(self) -> DataFrame:
        from affinor.operators import graph as G
        return G.adjacency(self.edges.withColumn("type", F.lit("similarity")), self.members.select("entity"))
