"""Queries over texts, pages, files and small dimensions."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.functions import names as N
from affinor.functions import text as X
from affinor.operators import items as I
from affinor.operators import pages as P
from affinor.operators.ranking import rnd, top_k
from affinor.plans.fixtures import Fixtures
from affinor.plans.registry import query
from affinor.rules import SIZE_BINS
from affinor.sources import files as S


@query("page_short_id", "SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS short_id FROM pages")
def page_short_id(fx: Fixtures):
    return fx.t("pages").select("page_id", X.short_id(F.col("url")).alias("short_id"))


@query("text_inverted_rebuild", """SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS text FROM (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM fx_words WHERE word <> '' GROUP BY 1)""")
def text_inverted_rebuild(fx: Fixtures):
    # word -> positions is rebuilt from the text first: a whole document per row, as the landed index has it
    words = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    inv = X.word_positions(fx.t("documents").select("doc_id", words.alias("words")), "doc_id")
    return inv.select("doc_id", X.abstract_from_positions(F.col("inv")).alias("text"))


@query("text_norm", """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(replace(replace(replace(text, '&lt;', '<'),
    '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def text_norm(fx: Fixtures):
    return fx.t("documents").select("doc_id", X.norm_title(F.col("text")).alias("norm"))


@query("profile_compact", """SELECT candidate, alternative AS alternatives, CASE WHEN inst1 = person % 5 THEN year1 - 1 || ',' || year1 ELSE '' END
    || CASE WHEN inst2 = person % 5 THEN CASE WHEN inst1 = person % 5 THEN ',' ELSE '' END || year2 ELSE '' END AS years FROM fx_profiles""")
def profile_compact(fx: Fixtures):
    kept = F.filter("affiliations", lambda a: a["inst"] == F.col("person") % 5)
    return fx.profiles.select("candidate", F.array_join(F.slice("alternatives", 1, 20), "|").alias("alternatives"),
                              F.array_join(F.flatten(F.transform(kept, lambda a: a["years"])).cast("array<string>"), ",").alias("years"))


CITES = """CASE item % 6 WHEN 0 THEN 'Kim J*, Kang C# (' || year || ') ' || title || ' and more. Journal of Things 60(3), 1-9'
    WHEN 1 THEN title || ' and some more, Journal, , 58, 1217-1235 (' || year || ' )' WHEN 2 THEN title || ', ' || year || ', Journal'
    WHEN 3 THEN 'A, B. (' || year || ') "' || title || ' in full", Journal' WHEN 4 THEN title || ' and its parts. / Park D. Journal ' || year
    ELSE title END"""


@query("citation_title", f"""SELECT item, {CITES} AS citation, CASE item % 6 WHEN 0 THEN title || ' and more' WHEN 1 THEN title || ' and some more'
    WHEN 2 THEN title WHEN 3 THEN title || ' in full' WHEN 4 THEN title || ' and its parts' ELSE title END AS title FROM fx_items""")
def citation_title(fx: Fixtures):
    c = citations(fx)
    return c.select("item", "citation", X.citation_title(F.col("citation")).alias("title"))


def citations(fx: Fixtures):
    t, y, i = F.col("title"), F.col("year").cast("string"), F.col("item") % 6
    s = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    return fx.items.select("item", "title", (
        F.when(i == 0, s("Kim J*, Kang C# (", y, ") ", t, " and more. Journal of Things 60(3), 1-9"))
        .when(i == 1, s(t, " and some more, Journal, , 58, 1217-1235 (", y, " )")).when(i == 2, s(t, ", ", y, ", Journal"))
        .when(i == 3, s("A, B. (", y, ') "', t, ' in full", Journal')).when(i == 4, s(t, " and its parts. / Park D. Journal ", y))
        .otherwise(t)).alias("citation"))


@query("category_normalize", """SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)econ') THEN 'budget' WHEN regexp_matches(p_type, '(?i)^s') THEN 'small'
    WHEN regexp_matches(p_type, '(?i)promo') THEN NULL WHEN regexp_matches(p_type, '(?i)e') THEN 'usual' END AS category FROM part""")
def category_normalize(fx: Fixtures):
    table = [("(?i)econ", "budget"), ("(?i)^s", "small"), ("(?i)promo", None), ("(?i)e", "usual")]
    return fx.t("part").select("p_partkey", N.first_matching(F.col("p_type"), table).alias("category"))


@query("url_normalize", """SELECT page_id, lower(regexp_replace(CASE WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1/' || url ELSE url END, '^https?://(dx\\.)?doi\\.org/', '')) AS key,
    CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://doi.org/' || url END AS link FROM pages""")
def url_normalize(fx: Fixtures):
    doi = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), "url")).otherwise(F.col("url"))
    return fx.t("pages").select("page_id", X.doi_key(doi).alias("key"), X.doi_link(F.col("url")).alias("link"))


@query("text_content_key", """SELECT item, sha1(CASE WHEN coalesce(abstract, '') <> '' THEN title || '[SEP]' || abstract ELSE title END) AS key FROM fx_items""")
def text_content_key(fx: Fixtures):
    return fx.items.select("item", F.sha1(X.embedding_text(F.col("title"), F.col("abstract"))).alias("key"))


STATUS = "CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 503 WHEN 5 THEN 500 END"


@query("verdict_case", f"""SELECT event_id, CASE WHEN s IS NULL THEN 'unreachable' WHEN s < 400 THEN 'ok' WHEN s IN (401, 403, 405, 429, 503) THEN 'blocked'
    ELSE 'broken' END AS verdict FROM (SELECT event_id, {STATUS} AS s FROM events)""")
def verdict_case(fx: Fixtures):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 301, 403, 404, 503, 500, None)]), (F.col("event_id") % 7 + 1).cast("int"))
    return fx.t("events").select("event_id", X.http_verdict(status).alias("verdict"))


@query("size_bins", """SELECT b.label AS size_bin, count(*) AS entities FROM fx_row_vectors JOIN (VALUES ('5 or fewer', 0, 5), ('6-10', 6, 10), ('11-20', 11, 20),
    ('21 or more', 21, 9223372036854775807)) b(label, lo, hi) ON n_items BETWEEN lo AND hi GROUP BY 1""")
def size_bins(fx: Fixtures):
    return with_size_bin(fx.row_vectors, "n_items").groupBy("size_bin").agg(F.count("*").alias("entities"))


def with_size_bin(df, n):
    """Label from the fixed four-row range table."""
    out = None
    for label, lo, hi in SIZE_BINS:
        c = F.col(n).between(lo, hi)
        out = F.when(c, label) if out is None else out.when(c, label)
    return df.withColumn("size_bin", out)


# ------------------------------------------------------------------ pages
@query("page_fields", """SELECT 'page' AS kind, page_id AS id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html,
      '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title,
      '' AS emails, nullif(upper(regexp_extract(html, '(?i)orcid\\.org/(\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX])', 1)), '') AS orcid FROM pages
    UNION ALL SELECT 'document', doc_id, NULL, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text,
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'), lambda x: lower(x)))), ','),
      nullif(upper(regexp_extract(text, '(?i)orcid\\.org/(\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX])', 1)), '') FROM documents""")
def page_fields(fx: Fixtures):
    a = fx.t("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), P.title(F.col("html")).alias("title"), F.lit("").alias("emails"),
                             P.orcid(F.col("html")).alias("orcid"))
    b = fx.t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"),
                                 F.array_join(F.array_sort(P.emails(F.col("text"))), ",").alias("emails"), P.orcid(F.col("text")).alias("orcid"))
    return a.union(b)


@query("page_links", """WITH l AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS link
      FROM fx_links WHERE href <> '' AND NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)'))
    SELECT page_id, link, min(pos) AS pos FROM l GROUP BY 1, 2""")
def page_links(fx: Fixtures):
    return P.links(fx.t("pages")).select("page_id", "link", F.col("pos").cast("long").alias("pos"))


@query("script_split", """WITH n AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '김철수' WHEN 1 THEN 'Kim, Ann (chair)' END AS other FROM documents),
    b AS (SELECT doc_id, nullif(trim(regexp_replace(text, '\\s*\\(.*?\\)\\s*', '', 'g')), '') AS a, nullif(trim(regexp_replace(other, '\\s*\\(.*?\\)\\s*', '', 'g')), '') AS b FROM n)
    SELECT doc_id, coalesce(CASE WHEN regexp_matches(a, '[가-힣]') THEN a END, CASE WHEN regexp_matches(b, '[가-힣]') THEN b END) AS native,
      length(coalesce(CASE WHEN NOT regexp_matches(a, '[가-힣]') THEN a END, CASE WHEN NOT regexp_matches(b, '[가-힣]') THEN b END)) > 0 AS has_latin FROM b""")
def script_split(fx: Fixtures):
    other = F.when(F.col("doc_id") % 3 == 0, "김철수").when(F.col("doc_id") % 3 == 1, "Kim, Ann (chair)")
    native, latin = N.split_scripts(F.col("text"), other)
    return fx.t("documents").select("doc_id", native.alias("native"), (F.length(latin) > 0).alias("has_latin"))


@query("rows_keyword_excluded", """SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(the|und)\\b') OR source = 'src3'""")
def rows_keyword_excluded(fx: Fixtures):
    return fx.t("documents").filter(~F.col("text").rlike(r"(?i)\b(the|und)\b") | (F.col("source") == "src3")).select("doc_id")


@query("group_excluded", """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_totalprice > 480000)""")
def group_excluded(fx: Fixtures):
    return P.drop_groups(fx.t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice") > 480000).select("o_orderkey")


@query("people_assemble", """WITH l AS (SELECT person AS page_id, name, email, 'listed' AS title FROM fx_people),
    d AS (SELECT person AS page_id, CASE WHEN person % 12 = 0 THEN NULL ELSE 'detail ' || person END AS detail_title FROM fx_people WHERE person % 3 = 0),
    s AS (SELECT email, min(name) AS name_second FROM fx_people WHERE email IS NOT NULL GROUP BY 1),
    j AS (SELECT l.page_id, l.email, l.name, name_second, coalesce(detail_title, title) AS title FROM l LEFT JOIN d USING (page_id) LEFT JOIN s ON s.email = l.email)
    SELECT page_id, email, name, name_second, title FROM (SELECT *, row_number() OVER (PARTITION BY name, name_second ORDER BY page_id) AS rn FROM j) WHERE rn = 1""")
def people_assemble(fx: Fixtures):
    p = F.col("person")
    listing = fx.people.select(p.alias("page_id"), "name", "email", F.lit("listed").alias("title"))
    detail = fx.people.filter(p % 3 == 0).select(p.alias("page_id"), F.when(p % 12 != 0, F.concat(F.lit("detail "), p)).alias("detail_title"))
    second = fx.people.filter("email IS NOT NULL").groupBy("email").agg(F.min("name").alias("name_second"))
    return P.assemble_people(listing, detail, second)


# ------------------------------------------------------------------ files
@query("src_json_roundtrip", """SELECT item, title, year, abstract, strftime(coalesce(try_cast(pub_raw AS DATE), make_date(year, 7, 1)), '%Y-%m-%d') AS pub_date,
    (SELECT count(*) FROM orders) AS rows_written FROM fx_items""")
def src_json_roundtrip(fx: Fixtures):
    df = fx.items.select("item", "title", "year", "abstract", I.publication_date().alias("pub_date"))
    path = S.scratch_path(fx.spark, "json")
    n = S.write_json_lines(df, path)
    back = S.read_json_lines(fx.spark, path, df.schema)
    return back.withColumn("pub_date", F.col("pub_date").cast("string")).withColumn("rows_written", F.lit(n).cast("long"))


@query("src_csv_roundtrip", "SELECT entity::VARCHAR AS entity, item::VARCHAR AS item FROM fx_exclusions")
def src_csv_roundtrip(fx: Fixtures):
    path = S.scratch_path(fx.spark, "csv")
    S.write_csv(fx.exclusions.withColumn("note", F.lit("left out")), path, ["entity", "item"])
    return S.read_csv(fx.spark, path).select("entity", "item")


@query("vec_roundtrip", "SELECT vec_id::VARCHAR AS key, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def vec_roundtrip(fx: Fixtures):
    path = S.scratch_path(fx.spark, "vectors")
    S.write_vectors(fx.t("embeddings"), path, "vec_id", "embedding")
    return S.read_vectors(fx.spark, path).select(
        "key", F.size("v").cast("long").alias("dim"), rnd(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("total"))


@query("src_nested_events", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def src_nested_events(fx: Fixtures):
    return fx.t("events").select("event_id", F.from_json("props", "k long").k.alias("k"))


@query("src_latest_by_file", """SELECT user_id AS key, arg_max(event_type || ':' || value, ('batch_' || lpad((event_id % 7)::VARCHAR, 2, '0'), event_id)) AS text FROM events GROUP BY 1""")
def src_latest_by_file(fx: Fixtures):
    """Curated batches written as files batch_00 ... batch_06, then merged with the later file winning."""
    e = fx.t("events").select("user_id", F.col("event_id"), F.concat_ws(":", "event_type", F.col("value").cast("string")).alias("text"),
                              F.concat(F.lit("batch_"), F.lpad((F.col("event_id") % 7).cast("string"), 2, "0")).alias("batch"))
    path = S.scratch_path(fx.spark, "batches")
    e.write.partitionBy("batch").json(path)
    schema = "user_id long, event_id long, text string"
    rows = S.read_response_tree(fx.spark, path, schema).withColumn("ord", F.struct(F.regexp_extract("file", r"(batch_\d+)", 1), "event_id"))
    return S.latest_by_file(rows.withColumnRenamed("user_id", "key"), "key", "text", "ord")


@query("dim_registry_check", """WITH d AS (SELECT n_name AS code, n_regionkey + CASE WHEN n_nationkey % 9 = 0 THEN 100 ELSE 0 END AS univ, n_nationkey % 6 AS field FROM nation
      UNION ALL SELECT n_name, n_regionkey, 0 FROM nation WHERE n_nationkey % 8 = 0)
    SELECT 'duplicate code' AS problem, code FROM d GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'unknown university', code FROM d WHERE univ NOT IN (SELECT r_regionkey FROM region)
    UNION ALL SELECT 'unknown field', code FROM d WHERE field > 4""")
def dim_registry_check(fx: Fixtures):
    n = fx.t("nation")
    k = F.col("n_nationkey")
    d = n.select(F.col("n_name").alias("code"), (F.col("n_regionkey") + F.when(k % 9 == 0, 100).otherwise(0)).alias("univ"), (k % 6).cast("long").alias("field"))
    again = n.filter(k % 8 == 0).select(F.col("n_name").alias("code"), F.col("n_regionkey").alias("univ"), F.lit(0).cast("long").alias("field"))
    return S.check_registry(d.union(again), fx.t("region").select(F.col("r_regionkey").alias("univ")), fx.rules.select("field"))


@query("pick_preferred", """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY
    (o_orderstatus = 'O') DESC, (o_orderpriority IN ('1-URGENT', '2-HIGH')) DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def pick_preferred(fx: Fixtures):
    """Exact match first, else an allowed type, else any; then the largest."""
    order = F.struct(F.col("o_orderstatus") == "O", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_totalprice", -F.col("o_orderkey"))
    return fx.t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("o_orderkey"))
