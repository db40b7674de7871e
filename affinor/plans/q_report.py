"""Reports, exports and data-quality queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.functions.text import norm_title
from affinor.operators import items as I
from affinor.operators import quality as K
from affinor.operators import report as E
from affinor.operators.ranking import rnd, top_k
from affinor.operators.resolve import affiliation_recent
from affinor.plans.fixtures import AS_OF, YEAR_TO, Fixtures
from affinor.plans.q_items import REPRESENTATIVES
from affinor.plans.q_text import CITES, STATUS, citations
from affinor.plans.q_topics import TIMELINE
from affinor.plans.registry import query
from affinor.rules import PARAMS

FUNNEL = """li AS (SELECT dept, count(*) AS listed, count(*) FILTER (person % 3 <> 0) AS full_time FROM fx_people GROUP BY 1),
    ma AS (SELECT dept, count(*) AS matched, count(*) FILTER (confidence = 'high') AS matched_high FROM fx_decisions JOIN fx_people USING (person) WHERE status = 'matched' GROUP BY 1),
    cr AS (SELECT e.dept, count(*) AS meets FROM fx_counters c JOIN fx_entities e USING (entity) WHERE meets_criterion GROUP BY 1),
    fu AS (SELECT n_nationkey::BIGINT AS dept, coalesce(listed, 0) AS listed, coalesce(full_time, 0) AS full_time, coalesce(matched, 0) AS matched, coalesce(matched_high, 0) AS matched_high,
      coalesce(meets, 0) AS meets FROM nation LEFT JOIN li ON li.dept = n_nationkey LEFT JOIN ma ON ma.dept = n_nationkey LEFT JOIN cr ON cr.dept = n_nationkey)"""


@query("funnel_rollup", f"""WITH {FUNNEL} SELECT dept, sum(listed)::BIGINT AS listed, sum(full_time)::BIGINT AS full_time, sum(matched)::BIGINT AS matched,
    sum(matched_high)::BIGINT AS matched_high, sum(meets)::BIGINT AS meets FROM fu GROUP BY ROLLUP (dept)""")
def funnel_rollup(fx: Fixtures):
    d = fx.people.select("person", "dept")
    m = fx.decisions.filter("status = 'matched'").join(d, "person")
    crit = fx.counters.filter("meets_criterion").select("entity").join(fx.entities.select("entity", "dept"), "entity")
    return E.funnel({"listed": d, "full_time": d.filter("person % 3 <> 0"), "matched": m, "matched_high": m.filter("confidence = 'high'"), "meets": crit},
                    fx.t("nation").select(F.col("n_nationkey").cast("long").alias("dept")), "dept")


EXCLUDED = """ex AS (SELECT p.dept, d.person AS id, d.reason FROM fx_decisions d JOIN fx_people p USING (person) WHERE status = 'excluded'
    UNION ALL SELECT e.dept, -c.entity - 1, 'below_paper_threshold' FROM fx_counters c JOIN fx_entities e USING (entity) WHERE NOT meets_criterion)"""


def excluded(fx: Fixtures):
    a = fx.decisions.filter("status = 'excluded'").join(fx.people.select("person", "dept"), "person").select("dept", F.col("person").alias("id"), "reason")
    b = fx.counters.filter("NOT meets_criterion").join(fx.entities.select("entity", "dept"), "entity").select(
        "dept", (-F.col("entity") - 1).alias("id"), F.lit("below_paper_threshold").alias("reason"))
    return a.unionByName(b)


@query("exclusion_report", f"WITH {EXCLUDED} SELECT dept, id, reason FROM ex")
def exclusion_report(fx: Fixtures):
    return excluded(fx)


@query("reason_counts", f"WITH {EXCLUDED} SELECT dept, reason, count(*) AS n FROM ex GROUP BY GROUPING SETS ((reason), (dept, reason))")
def reason_counts(fx: Fixtures):
    return E.reason_counts(excluded(fx), "dept")


@query("coverage_counts", """WITH k AS (SELECT item, bool_or(senior) AS senior, bool_or(at_home) AS home FROM fx_kept JOIN fx_counters c USING (entity) WHERE meets_criterion GROUP BY 1),
    j AS (SELECT k.*, abstract IS NOT NULL AS a, tldr IS NOT NULL AS t FROM k JOIN fx_items USING (item))
    SELECT count(*) AS items, count(*) FILTER (a) AS with_abstract, count(*) FILTER (senior) AS senior_items, count(*) FILTER (senior AND a) AS senior_with_abstract,
    count(*) FILTER (t) AS with_tldr, count(*) FILTER (home) AS analysis_items, count(*) FILTER (home AND a) AS analysis_with_abstract,
    (SELECT count(*) FROM fx_counters WHERE meets_criterion AND n_home_senior_abstract < 3) AS entities_short FROM j""")
def coverage_counts(fx: Fixtures):
    from affinor.session import cut_lineage
    counters = cut_lineage(fx.counters)
    keep = counters.filter("meets_criterion").select("entity")
    kept = I.drop_excluded(fx.eligible, fx.exclusions).select("item", "entity", "senior", "at_home").join(keep, "entity", "left_semi")
    short = counters.filter("meets_criterion AND n_home_senior_abstract < 3").agg(F.count("*"))
    return E.coverage(kept, fx.items).withColumn("entities_short", short.scalar())


@query("empty_fields", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (abstract IS NULL OR abstract = '') AS a, count(*) FILTER (tldr IS NULL OR tldr = '') AS t,
      count(*) FILTER (pub_raw IS NULL OR pub_raw = '') AS p FROM fx_items), s AS (SELECT count(*) AS n, count(*) FILTER (len(fields) = 0) AS e, count(*) FILTER (len(fields) < 2) AS f FROM fx_row_vectors)
    SELECT 'abstract' AS field, n, a AS empty, round(a / n, 4) + 0.0 AS share FROM n UNION ALL SELECT 'tldr', n, t, round(t / n, 4) + 0.0 FROM n UNION ALL SELECT 'pub_raw', n, p, round(p / n, 4) + 0.0 FROM n
    UNION ALL SELECT 'fields', n, e, round(e / n, 4) + 0.0 FROM s UNION ALL SELECT 'fields (<2)', n, f, round(f / n, 4) + 0.0 FROM s""")
def empty_fields(fx: Fixtures):
    return E.empty_fields(fx.items, ["abstract", "tldr", "pub_raw"]).unionByName(E.empty_fields(fx.members, ["fields"], {"fields": 2}))


@query("entity_list", """SELECT entity, name, field, n_all, row_number() OVER (ORDER BY n_all DESC, name) AS by_items, row_number() OVER (ORDER BY name) AS by_name
    FROM fx_counters JOIN (SELECT entity, name FROM fx_entities) USING (entity)""")
def entity_list(fx: Fixtures):
    from affinor.operators.ranking import distributed_rank
    e = fx.counters.select("entity", "field", "n_all").join(fx.entities.select("entity", "name"), "entity")
    r = distributed_rank(e, [], [("n_all",), "name"], "by_items")
    return distributed_rank(r, [], ["name"], "by_name")


@query("batches", """SELECT entity, (row_number() OVER (ORDER BY univ, name) - 1) // 10 AS batch FROM fx_entities""")
def batches(fx: Fixtures):
    return E.batches(fx.entities, ["univ", "name"], 10).select("entity", "batch")


@query("spread_sample", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)
    SELECT 'spread' AS kind, doc_id FROM r WHERE rn % greatest(n // 40, 1) = 0 AND rn // greatest(n // 40, 1) < 40
    UNION ALL SELECT 'seeded', doc_id FROM (SELECT doc_id FROM documents ORDER BY (doc_id * 7919 + 2026 * 104729) % 1000003, doc_id LIMIT 10)""")
def spread_sample(fx: Fixtures):
    d = fx.t("documents").select("doc_id", "source")
    return E.spread_sample(d, ["source", "doc_id"], 40).select(F.lit("spread").alias("kind"), "doc_id").union(
        E.seeded_sample(d, "doc_id", 2026, 10).select(F.lit("seeded"), "doc_id"))


# ------------------------------------------------------------------ links
LINKS = """ln AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link FROM fx_links
      WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')),
    tg AS (SELECT kind, target, place FROM (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY part, place) AS rn FROM (SELECT 'web' AS kind, url AS target, page_id AS place, 0 AS part FROM pages
      UNION ALL SELECT 'web', link, page_id, 1 FROM ln UNION ALL SELECT 'item', item::VARCHAR, entity, 2 FROM fx_home)) WHERE rn = 1)"""


def link_targets_of(fx: Fixtures):
    from affinor.operators.pages import links
    p = fx.t("pages")
    a = p.select(F.lit("web").alias("kind"), F.col("url").alias("target"), F.col("page_id").alias("place"))
    b = links(p).select(F.lit("web").alias("kind"), F.col("link").alias("target"), F.col("page_id").alias("place"))
    c = fx.home.select(F.lit("item").alias("kind"), F.col("item").cast("string").alias("target"), F.col("entity").alias("place"))
    return E.link_targets([a, b, c])


@query("link_targets", f"WITH {LINKS} SELECT * FROM tg")
def link_targets(fx: Fixtures):
    return link_targets_of(fx)


@query("link_verdicts", f"""WITH s AS (SELECT event_type AS kind, {STATUS} AS s FROM events) SELECT kind, CASE WHEN s IS NULL THEN 'unreachable' WHEN s < 400 THEN 'ok'
    WHEN s IN (401, 403, 405, 429, 503) THEN 'blocked' ELSE 'broken' END AS verdict, count(*) AS n FROM s GROUP BY 1, 2""")
def link_verdicts(fx: Fixtures):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 403, 404, 503, 500, None)]), (F.col("event_id") % 7 + 1).cast("int"))
    return E.link_verdicts(fx.t("events").select(F.col("event_type").alias("kind"), status.alias("status")))


@query("links_exist", f"WITH {LINKS} SELECT target, o.o_orderkey IS NOT NULL AS found FROM tg LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = target::BIGINT WHERE kind = 'item'")
def links_exist(fx: Fixtures):
    found = fx.t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("target"))
    return E.existing(link_targets_of(fx).filter("kind = 'item'").select("target"), found, "target")


# ------------------------------------------------------------------ vocabulary
VOCAB = f"""{TIMELINE}, kws AS (SELECT unnest(string_split(keywords, ';')) AS term FROM timeline),
    voc AS (SELECT DISTINCT term FROM (SELECT term FROM kws UNION ALL SELECT topic FROM fx_item_topics UNION ALL SELECT subfield FROM fx_item_topics) WHERE term <> '')"""


def vocab(fx: Fixtures):
    from affinor.operators.topics import keyword_timeline
    return E.vocabulary([keyword_timeline(fx.home, fx.items, fx.item_topics).select("keywords"), fx.item_topics.select("topic"), fx.item_topics.select("subfield")])


@query("vocabulary", f"WITH {VOCAB} SELECT term FROM voc")
def vocabulary(fx: Fixtures):
    return vocab(fx)


@query("terms_used", f"WITH {VOCAB} SELECT term, rendering FROM (SELECT DISTINCT p_name AS term, 'k' || p_brand AS rendering FROM part UNION SELECT p_brand, 'x' FROM part) JOIN voc USING (term)")
def terms_used(fx: Fixtures):
    p = fx.t("part")
    d = p.select(F.col("p_name").alias("term"), F.concat(F.lit("k"), "p_brand").alias("rendering")).union(p.select("p_brand", F.lit("x"))).distinct()
    return d.join(vocab(fx), "term", "left_semi")


@query("todo_terms", f"WITH {VOCAB} SELECT term FROM voc WHERE term NOT IN (SELECT p_name FROM part WHERE p_partkey % 9 = 0)")
def todo_terms(fx: Fixtures):
    done = fx.t("part").filter("p_partkey % 9 = 0").select(F.col("p_name").alias("term"))
    return vocab(fx).join(done, "term", "left_anti")


@query("embed_todo", """SELECT item, sha1(CASE WHEN coalesce(abstract, '') <> '' THEN title || '[SEP]' || abstract ELSE title END) AS key FROM fx_items WHERE item % 3 <> 0""")
def embed_todo(fx: Fixtures):
    from affinor.operators.embed import keyed, todo
    k = keyed(fx.items)
    return todo(k, k.filter("item % 3 = 0").select("key")).select("item", "key")


@query("append_absent", """SELECT entity, item, 'old' AS reason FROM fx_exclusions UNION ALL SELECT entity, item, 'new' FROM (SELECT DISTINCT entity, item FROM fx_roles WHERE (item + entity) % 31 = 0) n
    WHERE NOT EXISTS (SELECT 1 FROM fx_exclusions x WHERE x.entity = n.entity AND x.item = n.item)""")
def append_absent(fx: Fixtures):
    new = fx.roles.filter((F.col("item") + F.col("entity")) % 31 == 0).select("entity", "item", F.lit("new").alias("reason"))
    return E.append_absent(fx.exclusions.withColumn("reason", F.lit("old")), new, ["entity", "item"])


@query("coverage_gaps", f"""WITH {REPRESENTATIVES}, s AS (SELECT f.f AS field, tldr FROM reps JOIN fx_items USING (item) JOIN (SELECT entity, unnest(fields) AS f FROM fx_entities) f USING (entity))
    SELECT field, count(*) AS shown, count(*) FILTER (tldr IS NULL) AS missing FROM s GROUP BY 1 HAVING count(*) FILTER (tldr IS NULL) > 0""")
def coverage_gaps(fx: Fixtures):
    reps = I.representatives(fx.eligible, AS_OF, PARAMS.representatives, PARAMS.recent_years)
    return E.coverage_gaps(fx.entities.select("entity", "fields"), reps.select("entity", "item"), fx.items.filter("tldr IS NOT NULL"))


@query("flag_crosstab", """WITH f AS (SELECT doc_id, CASE WHEN l.toxic = 1 THEN 'mixed' WHEN l.quality = 0 THEN 'review' ELSE 'none' END AS hand, CASE WHEN d.n_chars > 800 THEN 'mixed'
      WHEN d.n_chars > 400 THEN 'unclear' ELSE 'one_person' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT hand, count(*) FILTER (verdict = 'mixed') AS mixed, count(*) FILTER (verdict = 'unclear') AS unclear, count(*) FILTER (verdict = 'one_person') AS one_person FROM f GROUP BY 1""")
def flag_crosstab(fx: Fixtures):
    hand = F.when(F.col("toxic") == 1, "mixed").when(F.col("quality") == 0, "review").otherwise("none").alias("hand")
    verdict = F.when(F.col("n_chars") > 800, "mixed").when(F.col("n_chars") > 400, "unclear").otherwise("one_person").alias("verdict")
    j = fx.t("documents").select("doc_id", "n_chars").join(fx.t("labels"), "doc_id", "left").select(hand, verdict)
    return j.groupBy("hand").pivot("verdict", ["mixed", "unclear", "one_person"]).count().fillna(0)


@query("anchor_hits", f"""WITH c AS (SELECT item % 40 AS person, item AS cid, lower({CITES}) AS cit FROM fx_items), n AS (SELECT person, cid, trim(regexp_replace(cit, '[^a-z0-9]+', ' ', 'g')) AS norm FROM c),
    t AS (SELECT item, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM fx_items),
    l AS (SELECT DISTINCT len(string_split(norm, ' ')) AS k FROM t WHERE length(norm) >= 20),
    w AS (SELECT person, cid, array_to_string(ws[i:i + k - 1], ' ') AS run FROM (SELECT person, cid, string_split(norm, ' ') AS ws FROM n WHERE length(norm) >= 15), l, range(1, 60) r(i) WHERE i + k - 1 <= len(ws)),
    h AS (SELECT person, cid, min(item) AS item FROM w JOIN t ON run = norm WHERE length(norm) >= 20 GROUP BY 1, 2)
    SELECT person, entity AS author, count(*) AS hits FROM h JOIN fx_roles USING (item) GROUP BY 1, 2""")
def anchor_hits(fx: Fixtures):
    c = citations(fx).select((F.col("item") % 40).alias("person"), F.col("item").alias("citation"), norm_title(F.col("citation")).alias("norm"))
    t = fx.items.select("item", norm_title(F.col("title")).alias("norm"))
    return E.anchor_hits(c, t, fx.roles.select("item", F.col("entity").alias("author")))


# Titles are the first eight words of the documents; a citation names one with an error that follows from its number: none, a misspelt
# letter, a word split in two, letters dropped, another order of words.
NOTES = """norm AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS s FROM documents),
    t AS (SELECT doc_id AS item, array_to_string(string_split(s, ' ')[:8], ' ') AS title FROM norm),
    cit AS (SELECT item AS citation, item % 40 AS person, 'smith and lee ' || CASE item % 5 WHEN 0 THEN title WHEN 1 THEN title[:7] || 'q' || title[9:]
      WHEN 2 THEN title[:9] || ' ' || title[10:] WHEN 3 THEN title[:11] || title[14:] ELSE array_to_string(list_reverse(string_split(title, ' ')), ' ') END || ' journal of notes 1999' AS norm FROM t)"""


def notes(fx: Fixtures):
    """(titles, citations) of the documents."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")), " ")
    t = fx.t("documents").select(F.col("doc_id").alias("item"), F.array_join(F.slice(words, 1, 8), " ").alias("norm"))
    k, s = F.col("item") % 5, F.col("norm")
    cut = lambda a, n=None: F.substring(s, F.lit(a), F.lit(n) if n else F.length(s))
    wrong = (F.when(k == 0, s).when(k == 1, F.concat(cut(1, 7), F.lit("q"), cut(9))).when(k == 2, F.concat(cut(1, 9), F.lit(" "), cut(10)))
             .when(k == 3, F.concat(cut(1, 11), cut(14))).otherwise(F.array_join(F.reverse(F.split(s, " ")), " ")))
    return t, t.select((F.col("item") % 40).alias("person"), F.col("item").alias("citation"), F.concat(F.lit("smith and lee "), wrong, F.lit(" journal of notes 1999")).alias("norm"))


@query("anchor_hits_fuzzy", f"""WITH {NOTES}, u AS (SELECT title, min(item) AS item, length(title) // 10 AS k FROM t WHERE length(title) >= 20 GROUP BY title),
    seg AS (SELECT title, item, k, title[(length(title) * i + k) // (k + 1) + 1:(length(title) * (i + 1) + k) // (k + 1)] AS part FROM u, range(0, 30) r(i) WHERE i <= k),
    pair AS (SELECT DISTINCT title, item, k, c.person, c.citation, c.norm FROM seg JOIN cit c ON contains(c.norm, part) WHERE length(c.norm) >= 15),
    win AS (SELECT person, citation, item, min(levenshtein(title, substr(norm, a.i, length(title) + b.j - k))) AS edits, any_value(k) AS k
      FROM pair, range(1, 400) a(i), range(0, 60) b(j) WHERE a.i <= length(norm) AND b.j <= 2 * k GROUP BY 1, 2, 3),
    h AS (SELECT person, citation, arg_min(item, (edits, item)) AS item FROM win WHERE edits <= k GROUP BY 1, 2)
    SELECT person, item * 7 % 50 + o AS author, count(*) AS hits FROM h, range(0, 2) x(o) GROUP BY 1, 2""")
def anchor_hits_fuzzy(fx: Fixtures):
    t, c = notes(fx)
    authors = t.select("item", F.explode(F.array(F.col("item") * 7 % 50, F.col("item") * 7 % 50 + 1)).alias("author"))
    return E.anchor_hits(c, t, authors, similarity=PARAMS.anchor_similarity)


# ------------------------------------------------------------------ exports
@query("export_entities", f"""WITH {REPRESENTATIVES}, r AS (SELECT entity, string_agg(item::VARCHAR, ',' ORDER BY rank) AS reps FROM reps GROUP BY 1),
    k AS (SELECT entity, string_agg(topic, ';' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, topic) AS rank FROM fx_profile) WHERE rank <= 5 GROUP BY 1),
    p AS (SELECT person // 4 AS entity, name, email, d.confidence FROM fx_people JOIN fx_decisions d USING (person))
    SELECT e.entity, coalesce(nullif(CASE WHEN e.entity % 3 = 0 THEN '' ELSE p.name END, ''), p2.name, e.name) AS name, e.dept, c.n_all, c.n_senior, c.meets_criterion, k.keywords, coalesce(r.reps, '') AS representatives,
    CASE WHEN p.confidence = 'high' OR p2.confidence = 'high' THEN 'high' ELSE 'medium' END AS confidence
    FROM fx_entities e JOIN fx_counters c USING (entity) LEFT JOIN k USING (entity) LEFT JOIN r USING (entity) LEFT JOIN p ON p.entity = e.entity LEFT JOIN p p2 ON p2.entity = e.entity + 1""")
def export_entities(fx: Fixtures):
    from affinor.operators.topics import keywords
    reps = I.representatives(fx.eligible, AS_OF, PARAMS.representatives, PARAMS.recent_years).groupBy("entity").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"].cast("string")), ",").alias("reps"))
    kw = keywords(fx.profile, 5).withColumn("keywords", F.array_join("keywords", ";"))
    p = fx.people.join(fx.decisions.select("person", "confidence"), "person").select(F.floor(F.col("person") / 4).alias("entity"), "name", "confidence")
    first = p.select("entity", F.col("name").alias("name1"), F.col("confidence").alias("conf1"))
    # the second department's person fills what the first leaves empty
    second = p.select((F.col("entity") - 1).alias("entity"), F.col("name").alias("name2"), F.col("confidence").alias("conf2"))
    j = fx.entities.select("entity", "name", "dept").join(fx.counters.drop("field"), "entity")
    for part in (kw, reps, first, second):
        j = j.join(part, "entity", "left")
    blank = F.nullif(F.when(F.col("entity") % 3 == 0, "").otherwise(F.col("name1")), F.lit(""))
    high = F.coalesce(F.col("conf1") == "high", F.lit(False)) | F.coalesce(F.col("conf2") == "high", F.lit(False))
    return j.select("entity", F.coalesce(blank, "name2", "name").alias("name"), "dept", "n_all", "n_senior", "meets_criterion", "keywords",
                    F.coalesce("reps", F.lit("")).alias("representatives"), F.when(high, "high").otherwise("medium").alias("confidence"))


@query("export_sources", """WITH s AS (SELECT entity, 'https://list.example.org/' || dept AS list_url, CASE WHEN entity % 4 = 0 THEN 'https://list.example.org/' || dept ELSE 'https://page.example.org/' || entity END AS page_url,
      entity % 5 = 0 AS short FROM fx_entities)
    SELECT entity, 'faculty_page' AS kind, list_url AS url FROM s UNION ALL SELECT entity, 'faculty_detail', page_url FROM s WHERE page_url <> list_url
    UNION ALL SELECT entity, 'author', 'https://authors.example.org/' || entity FROM s UNION ALL SELECT entity, 'works', 'https://works.example.org/?author=' || entity FROM s
    UNION ALL SELECT entity, 'summary', 'https://summaries.example.org/' FROM s WHERE short""")
def export_sources(fx: Fixtures):
    e = F.col("entity").cast("string")
    lst = F.concat(F.lit("https://list.example.org/"), "dept")
    page = F.when(F.col("entity") % 4 == 0, lst).otherwise(F.concat(F.lit("https://page.example.org/"), e))
    src = lambda k, u: F.struct(F.lit(k).alias("kind"), u.alias("url"))
    rows = F.array(src("faculty_page", lst), F.when(page != lst, src("faculty_detail", page)), src("author", F.concat(F.lit("https://authors.example.org/"), e)),
                   src("works", F.concat(F.lit("https://works.example.org/?author="), e)),
                   F.when(F.col("entity") % 5 == 0, src("summary", F.lit("https://summaries.example.org/"))))
    return fx.entities.select("entity", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("s")).select("entity", "s.kind", "s.url")


@query("export_meta", f"""WITH {REPRESENTATIVES} SELECT 1997::BIGINT AS year_from, 2001::BIGINT AS year_to, (SELECT count(*) FROM fx_counters WHERE meets_criterion) AS entities,
    (SELECT count(DISTINCT item) FROM fx_kept WHERE at_home) AS items, (SELECT count(*) FROM fx_edges) AS edges_similarity, (SELECT threshold FROM fx_threshold) AS threshold,
    (SELECT count(*) FROM reps) AS representative_items, (SELECT count(*) FROM reps JOIN fx_items USING (item) WHERE tldr IS NOT NULL) AS with_summary,
    (SELECT strftime(max(o_orderdate), '%Y-%m-%d') FROM orders) AS data_date""")
def export_meta(fx: Fixtures):
    n = lambda df: df.agg(F.count("*")).scalar()
    reps = I.representatives(fx.eligible, AS_OF, PARAMS.representatives, PARAMS.recent_years)
    kept = I.drop_excluded(fx.eligible, fx.exclusions).filter("at_home")
    out = fx.t("orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("data_date"))
    return (out.withColumn("year_from", F.lit(1997).cast("long")).withColumn("year_to", F.lit(2001).cast("long"))
            .withColumn("entities", n(fx.counters.filter("meets_criterion"))).withColumn("items", kept.agg(F.countDistinct("item")).scalar())
            .withColumn("edges_similarity", n(fx.edges)).withColumn("threshold", fx.threshold.scalar()).withColumn("representative_items", n(reps))
            .withColumn("with_summary", n(reps.join(fx.items.filter("tldr IS NOT NULL").select("item"), "item", "left_semi"))))


# ------------------------------------------------------------------ data quality
@query("dq_schema", """SELECT 'orders.status' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders UNION ALL SELECT 'orders.date', count(*) FILTER (o_orderdate IS NULL) FROM orders
    UNION ALL SELECT 'labels.quality', count(*) FILTER (quality NOT IN (0, 1)) FROM labels UNION ALL SELECT 'embeddings.size', count(*) FILTER (len(embedding) <> 64) FROM embeddings
    UNION ALL SELECT 'documents.lang', count(*) FILTER (lang NOT IN ('en', 'de')) FROM documents UNION ALL SELECT 'documents.chars', count(*) FILTER (n_chars <> length(text)) FROM documents
    UNION ALL SELECT 'entities.fields<=3', count(*) FILTER (len(fields) > 3) FROM fx_row_vectors""")
def dq_schema(fx: Fixtures):
    return K.together([
        K.rule_counts(fx.t("orders"), {"orders.status": K.one_of("o_orderstatus", ["F", "O"]), "orders.date": K.required("o_orderdate")}),
        K.rule_counts(fx.t("labels"), {"labels.quality": F.col("quality").isin(0, 1)}),
        K.rule_counts(fx.t("embeddings"), {"embeddings.size": F.size("embedding") == 64}),
        K.rule_counts(fx.t("documents"), {"documents.lang": K.one_of("lang", ["en", "de"]), "documents.chars": F.col("n_chars") == F.length("text")}),
        K.rule_counts(fx.members, {"entities.fields<=3": F.size("fields") <= 3})])


@query("dq_references", """SELECT 'labels to documents' AS rule, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS violations
    UNION ALL SELECT 'items to customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0))
    UNION ALL SELECT 'conversations to documents', (SELECT count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0))
    UNION ALL SELECT 'edges to entities', (SELECT count(*) FROM fx_edges WHERE target NOT IN (SELECT entity FROM fx_row_vectors WHERE entity % 11 <> 0))
    UNION ALL SELECT 'edge order', (SELECT count(*) FROM fx_edges WHERE source >= target)
    UNION ALL SELECT 'subcluster inside cluster', (SELECT count(*) FROM fx_row_vectors WHERE subcluster // 2 <> cluster)""")
def dq_references(fx: Fixtures):
    return K.together([
        K.missing_keys("labels to documents", fx.t("labels"), "doc_id", fx.t("documents"), "doc_id"),
        K.missing_keys("items to customers", fx.t("orders"), "o_custkey", fx.t("customer").filter("c_custkey % 7 <> 0"), "c_custkey"),
        K.missing_keys("conversations to documents", fx.t("conversations"), "conv_id", fx.t("documents").filter("doc_id % 2 = 0"), "doc_id"),
        K.missing_keys("edges to entities", fx.edges, "target", fx.members.filter("entity % 11 <> 0"), "entity"),
        K.rule_counts(fx.edges, {"edge order": F.col("source") < F.col("target")}),
        K.rule_counts(fx.members, {"subcluster inside cluster": F.floor(F.col("subcluster") / 2) == F.col("cluster")})])


@query("dq_forbidden", """SELECT 'address' AS rule, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS violations FROM documents UNION ALL SELECT 'source 7', count(*) FILTER (source = 'src7') FROM documents""")
def dq_forbidden(fx: Fixtures):
    return K.forbidden(fx.t("documents").select("text", "source"), {"address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "source 7": '"source":"src7"'})


@query("dq_exactly_one", """SELECT 'text xor reason' AS rule, count(*) FILTER ((abstract IS NULL) = (tldr IS NULL)) AS violations FROM fx_items""")
def dq_exactly_one(fx: Fixtures):
    return K.rule_counts(fx.items, {"text xor reason": K.exactly_one("abstract", "tldr")})


@query("dq_vectors", """SELECT 'entities without vector' AS rule, (SELECT count(*) FROM fx_people WHERE person NOT IN (SELECT entity FROM fx_row_vectors)) AS violations
    UNION ALL SELECT 'vectors without entity', (SELECT count(*) FROM fx_row_vectors WHERE entity NOT IN (SELECT person FROM fx_people)) UNION ALL SELECT 'vector size', (SELECT count(*) FROM fx_row_vectors WHERE len(v) <> 64)""")
def dq_vectors(fx: Fixtures):
    return K.together([K.missing_keys("entities without vector", fx.people, "person", fx.members, "entity"),
                       K.missing_keys("vectors without entity", fx.members, "entity", fx.people, "person"),
                       K.rule_counts(fx.row_vectors, {"vector size": F.size("v") == 64})])


@query("dq_empty_sources", """SELECT n_nationkey::BIGINT AS dept, 'no rows' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT dept FROM fx_entities WHERE entity % 3 = 0)
    UNION ALL SELECT n_nationkey, 'load error' FROM nation WHERE n_nationkey % 6 = 1""")
def dq_empty_sources(fx: Fixtures):
    n = fx.t("nation").select(F.col("n_nationkey").cast("long").alias("dept"))
    return K.empty_sources(n, fx.entities.filter("entity % 3 = 0").select("dept"), "dept", n.filter("dept % 6 = 1"))


@query("snapshot_diff", """WITH nw AS (SELECT entity, count(*) AS n_all, count(*) FILTER (senior) AS n_senior, count(*) FILTER (at_home) AS n_home FROM fx_eligible WHERE item % 50 <> 0 AND entity % 9 <> 4 GROUP BY 1),
    od AS (SELECT entity, count(*) AS n_all, count(*) FILTER (senior) AS n_senior, count(*) FILTER (at_home) AS n_home FROM fx_eligible WHERE entity % 9 <> 5 GROUP BY 1)
    SELECT coalesce(o.entity, n.entity) AS entity, CASE WHEN n.entity IS NULL THEN 'missing' WHEN o.entity IS NULL THEN 'added' ELSE 'changed' END AS change FROM od o FULL JOIN nw n ON o.entity = n.entity
    WHERE o.entity IS NULL OR n.entity IS NULL OR (o.n_all, o.n_senior, o.n_home) IS DISTINCT FROM (n.n_all, n.n_senior, n.n_home)""")
def snapshot_diff(fx: Fixtures):
    counts = lambda df: df.groupBy("entity").agg(F.count("*").alias("n_all"), F.count_if("senior").alias("n_senior"), F.count_if("at_home").alias("n_home"))
    e = fx.eligible.select("item", "entity", "senior", "at_home")
    return K.snapshot_diff(counts(e.filter("entity % 9 <> 5")), counts(e.filter("item % 50 <> 0 AND entity % 9 <> 4")), "entity")


ORDER_STATE = "o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price"


@query("snapshot_diff_by_tree", f"""WITH od AS (SELECT {ORDER_STATE} FROM orders WHERE o_orderkey % 997 <> 3),
    nw AS (SELECT k, cust, CASE WHEN k % 499 = 5 THEN NULL ELSE status END AS status, CASE WHEN k % 613 = 2 THEN price + 1 ELSE price END AS price FROM (SELECT {ORDER_STATE} FROM orders) WHERE k % 887 <> 4)
    SELECT coalesce(od.k, nw.k) AS k, CASE WHEN nw.k IS NULL THEN 'missing' WHEN od.k IS NULL THEN 'added' ELSE 'changed' END AS change FROM od FULL JOIN nw ON od.k = nw.k
    WHERE od.k IS NULL OR nw.k IS NULL OR (od.cust, od.status, od.price) IS DISTINCT FROM (nw.cust, nw.status, nw.price)""")
def snapshot_diff_by_tree(fx: Fixtures):
    """Two states of all orders, of which about one in 150 was dropped, added or altered."""
    state = fx.t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    k = F.col("k")
    new = state.filter(k % 887 != 4).withColumns({"status": F.when(k % 499 != 5, F.col("status")), "price": F.col("price") + F.when(k % 613 == 2, 1).otherwise(0)})
    return K.snapshot_diff_by_tree(state.filter(k % 997 != 3), new, "k")


@query("reconcile_items", """WITH p AS (SELECT entity, item, position = 'last' AS is_last, 'd' || item AS doi, year, title FROM fx_eligible),
    l AS (SELECT entity, item, CASE WHEN item % 17 = 0 THEN NOT is_last ELSE is_last END AS is_last, CASE WHEN item % 19 = 0 THEN NULL ELSE doi END AS doi, year,
      CASE WHEN item % 23 = 0 THEN 'Another thing' WHEN item % 5 = 0 THEN title || '.' ELSE title END AS title FROM p WHERE item % 29 <> 0),
    j AS (SELECT p.entity, l.title IS NOT NULL AS found, coalesce(p.doi IS NOT DISTINCT FROM l.doi AND p.year = l.year AND p.is_last = l.is_last
      AND 100.0 * (1 - levenshtein(p.title, l.title) / greatest(length(p.title), length(l.title))) >= 90, false) AS ok FROM p LEFT JOIN l ON p.entity = l.entity AND p.item = l.item)
    SELECT entity, count(*) AS items, count(*) FILTER (found AND ok) AS good, count(*) FILTER (NOT found) AS missing,
    CASE WHEN count(*) FILTER (found AND ok) = count(*) THEN 'ok' WHEN count(*) FILTER (found AND ok) > 0 THEN 'partial' ELSE 'fail' END AS verdict FROM j GROUP BY 1""")
def reconcile_items(fx: Fixtures):
    i = F.col("item")
    p = fx.eligible.select("entity", "item", (F.col("position") == "last").alias("is_last"), F.concat(F.lit("d"), "item").alias("doi"), "year", "title")
    live = p.filter(i % 29 != 0).select(
        "entity", "item", F.when(i % 17 == 0, ~F.col("is_last")).otherwise(F.col("is_last")).alias("is_last"), F.when(i % 19 != 0, F.col("doi")).alias("doi"), "year",
        F.when(i % 23 == 0, "Another thing").when(i % 5 == 0, F.concat("title", F.lit("."))).otherwise(F.col("title")).alias("title"))
    return K.reconcile(p, live).drop("extra")  # the SQL has no such column, and the fixture no such rows


@query("reconcile_snapshots", """WITH a AS (SELECT entity, item, position = 'last' AS is_last, 'd' || item AS doi, year, title FROM fx_eligible),
    x AS (SELECT entity, item FROM a WHERE item % 13 = 0), p AS (SELECT * FROM a WHERE item % 13 <> 0 AND item % 31 <> 7),
    l AS (SELECT entity, item, CASE WHEN item % 17 = 0 THEN NOT is_last ELSE is_last END AS is_last, CASE WHEN item % 19 = 0 THEN NULL ELSE doi END AS doi, year,
      CASE WHEN item % 23 = 0 THEN 'Another thing' WHEN item % 5 = 0 THEN upper(replace(title, ' ', ' - ')) || '.' WHEN item % 7 = 0 THEN replace(title, 'case', 'cse') ELSE title END AS title
      FROM a WHERE item % 29 <> 0 AND NOT (item % 13 = 0 AND item % 2 = 1)),
    k AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.entity = l.entity AND x.item = l.item)),
    s AS (SELECT p.entity AS pe, k.entity AS ke, coalesce(p.entity, k.entity) AS entity, p.doi IS NOT DISTINCT FROM k.doi AND p.year = k.year AND p.is_last = k.is_last AS facts,
      regexp_replace(lower(p.title), '[^a-z0-9]', '', 'g') AS pt, regexp_replace(lower(k.title), '[^a-z0-9]', '', 'g') AS kt FROM p FULL JOIN k ON p.entity = k.entity AND p.item = k.item),
    j AS (SELECT *, pe IS NOT NULL AS here, ke IS NOT NULL AS found, coalesce(facts AND 100.0 * (1 - levenshtein(pt, kt) / greatest(length(pt), length(kt))) >= 90, false) AS ok FROM s),
    g AS (SELECT entity, count(*) FILTER (here) AS items, count(*) FILTER (here AND found AND ok) AS good, count(*) FILTER (here AND NOT found) AS missing, count(*) FILTER (NOT here) AS extra FROM j GROUP BY 1),
    e AS (SELECT entity, count(*) AS aside FROM x GROUP BY 1), n AS (SELECT entity, count(*) AS live FROM l GROUP BY 1)
    SELECT g.entity, items, good, missing, extra, CASE WHEN good = items AND extra = 0 THEN 'ok' WHEN good > 0 THEN 'partial' ELSE 'fail' END AS verdict,
      items + coalesce(aside, 0) AS published, coalesce(live, 0) AS live, g.entity % 12 + 1991 >= 1999 AS recent
    FROM g LEFT JOIN e USING (entity) LEFT JOIN n USING (entity)""")
def reconcile_snapshots(fx: Fixtures):
    """Items left out on purpose are put back into the counts; every thirteenth item is, and half of those are in the second snapshot.
    Of the others some are only there, and titles differ in case, marks and letters. Recency as the spot check defines it: a year tighter."""
    i = F.col("item")
    every = fx.eligible.select("entity", "item", (F.col("position") == "last").alias("is_last"), F.concat(F.lit("d"), "item").alias("doi"), "year", "title")
    aside = every.filter(i % 13 == 0).select("entity", "item")
    published = every.filter((i % 13 != 0) & (i % 31 != 7))
    t = F.col("title")
    live = every.filter((i % 29 != 0) & ~((i % 13 == 0) & (i % 2 == 1))).select(
        "entity", "item", F.when(i % 17 == 0, ~F.col("is_last")).otherwise(F.col("is_last")).alias("is_last"), F.when(i % 19 != 0, F.col("doi")).alias("doi"), "year",
        F.when(i % 23 == 0, "Another thing").when(i % 5 == 0, F.concat(F.upper(F.replace(t, F.lit(" "), F.lit(" - "))), F.lit("."))).when(i % 7 == 0, F.replace(t, F.lit("case"), F.lit("cse")))
        .otherwise(t).alias("title"))
    counts = lambda df, name: df.groupBy("entity").agg(F.count("*").alias(name))
    checked = K.reconcile(published, live, aside).join(counts(aside, "aside"), "entity", "left").join(counts(live, "live"), "entity", "left")
    years = F.array(F.struct(F.lit(0).alias("inst"), F.array((F.col("entity") % 12 + 1991).cast("int")).alias("years")))
    recent = affiliation_recent(years, F.array(F.lit(1)), F.lit(0), YEAR_TO, PARAMS.affiliation_years - 1)
    return checked.select("entity", "items", "good", "missing", "extra", "verdict", (F.col("items") + F.coalesce("aside", F.lit(0))).alias("published"),
                          F.coalesce("live", F.lit(0)).alias("live"), recent.alias("recent"))
