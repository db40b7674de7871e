"""The same views as SQL text for the oracle engine, written independently of the DataFrame forms."""
from __future__ import annotations

#: The decision ladder over a view of candidates.
DECISIONS = """WITH st AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY anchor_hits DESC, candidate) AS ra,
          row_number() OVER (PARTITION BY person ORDER BY works DESC, candidate) AS rw FROM fx_cands WHERE strong),
        agg AS (SELECT person, count(*) AS n, bool_or(affiliation_ok) AS any_aff, bool_or(affiliation_ok AND name_ok) AS any_name,
          count(*) FILTER (orcid_match) AS n_orcid, max(candidate) FILTER (orcid_match) AS c_orcid, coalesce(bool_or(orcid_match AND affiliation_ok), false) AS orcid_aff
          FROM fx_cands GROUP BY 1),
        sa AS (SELECT person, count(*) AS n_strong, count(*) FILTER (anchor_hits > 0) AS n_anch, max(candidate) FILTER (ra = 1) AS top_anch,
          max(anchor_hits) FILTER (ra = 1) AS a1, coalesce(max(anchor_hits) FILTER (ra = 2), 0) AS a2, max(candidate) FILTER (rw = 1) AS big,
          max(works) FILTER (rw = 1) AS w1, coalesce(max(works) FILTER (rw = 2), 0) AS w2, max(orcid) FILTER (rw = 1) AS big_orcid,
          min(orcid) AS omin, max(orcid) AS omax FROM st GROUP BY 1),
        d AS (SELECT p.person, p.has_anchors, a.*, s.*, CASE WHEN p.orcid IS NOT NULL AND n_orcid = 1 AND orcid_aff THEN c_orcid
            WHEN n_strong = 1 THEN big WHEN n_strong > 1 AND n_anch = 1 THEN top_anch
            WHEN n_strong > 1 AND n_anch > 1 AND a1 >= 3 AND a1 >= 2 * a2 THEN top_anch
            WHEN n_strong > 1 AND w2 <= 0.10 * greatest(w1, 1) AND NOT coalesce(omin <> big_orcid OR omax <> big_orcid, false) THEN big END AS choice
          FROM fx_people p LEFT JOIN agg a ON a.person = p.person LEFT JOIN sa s ON s.person = p.person)
        SELECT d.person AS person, d.choice AS candidate, CASE WHEN d.choice IS NOT NULL THEN 'matched' ELSE 'excluded' END AS status,
          CASE WHEN d.choice IS NOT NULL THEN NULL WHEN coalesce(n_strong, 0) > 1 THEN 'ambiguous_multiple_candidates' WHEN n IS NULL THEN 'no_candidate'
            WHEN NOT any_aff THEN 'affiliation_mismatch' WHEN NOT any_name THEN 'name_mismatch' ELSE 'topic_mismatch' END AS reason,
          CASE WHEN d.choice IS NOT NULL THEN CASE WHEN c.orcid_match OR c.anchor_hits >= 1 THEN 'high' ELSE 'medium' END END AS confidence
        FROM d LEFT JOIN fx_cands c ON c.person = d.person AND c.candidate = d.choice"""

VIEWS: dict[str, str] = {
    "fx_entities": """SELECT s_suppkey AS entity, s_name AS name, s_nationkey::BIGINT AS dept, n_regionkey::BIGINT AS univ,
        n_regionkey::BIGINT AS field, s_acctbal AS balance,
        CASE WHEN s_suppkey % 7 = 0 THEN [n_regionkey::BIGINT, ((n_regionkey + 1) % 5)::BIGINT]
             ELSE [n_regionkey::BIGINT] END AS fields
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "fx_rules": """SELECT * FROM (VALUES
        (0::BIGINT, 5, false, false, NULL::INT, ['1-URGENT', '2-HIGH', '3-MEDIUM']),
        (1, 5, false, false, NULL::INT, ['1-URGENT', '2-HIGH', '3-MEDIUM']),
        (2, 5, false, false, 6, ['1-URGENT', '2-HIGH', '3-MEDIUM']),
        (3, 4, true, false, NULL::INT, ['1-URGENT', '2-HIGH', '3-MEDIUM']),
        (4, 5, false, true, 6, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'])
        ) r(field, min_items, position_agnostic, alphabetical_counts, max_authors, types)""",
    "fx_items": """SELECT o_orderkey AS item,
        'On ' || lower(substr(o_orderpriority, 3)) || ' case No. ' || o_orderkey AS title,
        year(o_orderdate)::INT AS year,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'n/a'
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pub_raw,
        floor(o_totalprice / 1000)::BIGINT AS cites, o_orderpriority AS type,
        CASE WHEN o_orderstatus <> 'P' THEN 'Abstract of ' || o_orderkey END AS abstract,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Short of ' || o_orderkey END AS tldr FROM orders""",
    "fx_pub": """SELECT *, coalesce(try_cast(pub_raw AS DATE), make_date(year, 7, 1)) AS pub_date FROM fx_items""",
    "fx_authorships": """SELECT l_orderkey AS item, l_linenumber AS pos, min(l_suppkey) AS entity,
        bool_or(l_returnflag = 'R') AS is_corr, bool_or(l_linestatus = 'O') AS at_home
        FROM lineitem GROUP BY 1, 2""",
    "fx_item_authors": """SELECT item, count(*) AS n_authors,
        count(*) >= 3 AND list(surname ORDER BY pos) = list(surname ORDER BY surname) AS alphabetical
        FROM fx_authorships JOIN fx_entities USING (entity) JOIN (VALUES (0, 'ames'), (1, 'boyle'), (2, 'cox'), (3, 'dunn'), (4, 'egan'), (5, 'frey'), (6, 'gale')) s(k, surname)
          ON s.k = entity % 7 GROUP BY item""",
    "fx_roles": """SELECT item, entity, position, is_corr, at_home FROM (
        SELECT *, CASE WHEN pos = min(pos) OVER (PARTITION BY item) THEN 'first'
                       WHEN pos = max(pos) OVER (PARTITION BY item) THEN 'last' ELSE 'middle' END AS position,
               row_number() OVER (PARTITION BY item, entity ORDER BY pos) AS rn FROM fx_authorships) WHERE rn = 1""",
    "fx_memberships": """SELECT m.item, m.entity, position, is_corr, at_home, r.field,
        NOT (position = 'last' OR is_corr) AND (position_agnostic OR (alphabetical_counts AND alphabetical)) AS order_agnostic,
        (position = 'last' OR is_corr) OR (position_agnostic OR (alphabetical_counts AND alphabetical)) AS senior,
        n_authors, alphabetical
        FROM fx_roles m JOIN fx_entities e USING (entity) JOIN fx_rules r ON e.field = r.field
        JOIN fx_item_authors a ON a.item = m.item""",
    "fx_eligible": """SELECT m.*, i.title, i.year, i.pub_date, i.cites, i.type, i.abstract, i.tldr, r.min_items
        FROM fx_memberships m JOIN fx_pub i ON i.item = m.item JOIN fx_rules r ON r.field = m.field
        WHERE list_contains(r.types, i.type) AND i.year BETWEEN 1997 AND 2001
          AND (r.max_authors IS NULL OR m.n_authors < r.max_authors)""",
    "fx_exclusions": "SELECT entity, item FROM fx_roles WHERE (item * 31 + entity) % 97 = 0",
    "fx_kept": "SELECT * FROM fx_eligible e WHERE NOT EXISTS (SELECT 1 FROM fx_exclusions x WHERE x.entity = e.entity AND x.item = e.item)",
    "fx_counters": """SELECT entity, field, count(*) AS n_all, count(*) FILTER (senior) AS n_senior,
        count(*) FILTER (abstract IS NOT NULL) AS n_abstract, count(*) FILTER (senior AND abstract IS NOT NULL) AS n_senior_abstract,
        count(*) FILTER (at_home) AS n_home, count(*) FILTER (at_home AND senior AND abstract IS NOT NULL) AS n_home_senior_abstract,
        count(*) FILTER (senior) >= any_value(min_items) AS meets_criterion FROM fx_kept GROUP BY entity, field""",
    "fx_item_topics": """SELECT l_orderkey AS item, p_name AS topic, p_type AS subfield, p_brand AS topic_field,
        l_quantity / 50 AS score, l_linenumber AS pos FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_home": "SELECT item, entity FROM fx_memberships WHERE at_home",
    "fx_profile": """SELECT entity, topic, round(sum(score), 6) AS weight, count(*) AS n_items
        FROM fx_home JOIN fx_item_topics USING (item) GROUP BY 1, 2""",
    "fx_share": """SELECT entity, topic, weight, weight / sum(weight) OVER (PARTITION BY entity) AS share FROM fx_profile""",
    "fx_item_vectors": """SELECT vec_id AS item, vec_id % 50 AS entity, (1997 + vec_id // 50 % 5)::INT AS year, vec_id % 17 AS cites,
        (label % 5)::BIGINT AS field, embedding::DOUBLE[] AS v FROM embeddings""",
    "fx_vec_dims": """SELECT item, entity, year, cites, field, unnest(v) AS x, generate_subscripts(v, 1) AS dim
        FROM fx_item_vectors""",
    "fx_row_vectors": """SELECT vec_id AS entity, (label % 5)::BIGINT AS field, label::BIGINT AS cluster,
        (label * 2 + vec_id % 2)::BIGINT AS subcluster, vec_id % 23 + 1 AS n_items,
        CASE WHEN vec_id % 7 = 0 THEN [(label % 5)::BIGINT, ((label + 1) % 5)::BIGINT] ELSE [(label % 5)::BIGINT] END AS fields,
        embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
        CASE WHEN vec_id % 29 = 0 THEN 'mixed_topics' WHEN vec_id % 31 = 0 THEN 'wrong_field'
             WHEN vec_id % 37 = 0 THEN 'insufficient_papers' END AS unreliable,
        embedding::DOUBLE[] AS v FROM embeddings""",
    "fx_entity_dims": """SELECT entity, dim, sum(x * (1 + ln(1 + cites))) / sum(1 + ln(1 + cites)) AS x
        FROM fx_vec_dims GROUP BY 1, 2""",
    "fx_entity_vectors": """SELECT entity, list(x / n ORDER BY dim) AS v FROM (
        SELECT *, sqrt(sum(x * x) OVER (PARTITION BY entity)) AS n FROM fx_entity_dims) GROUP BY 1""",
    "fx_pairs": """SELECT a.entity AS i, b.entity AS j, round(list_dot_product(a.v, b.v), 9) AS sim, a.field AS field_i, b.field AS field_j,
        len(list_intersect(a.fields, b.fields)) = 0 AS apart
        FROM fx_row_vectors a JOIN fx_row_vectors b ON a.entity <> b.entity""",
    "fx_topk": """SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank
        FROM fx_pairs) WHERE rank <= 5""",
    "fx_row_share": """SELECT item AS entity, topic, round(sum(score), 6) AS weight, round(sum(score), 6) /
        sum(round(sum(score), 6)) OVER (PARTITION BY item) AS share FROM fx_item_topics JOIN fx_row_vectors ON entity = item GROUP BY item, topic""",
    "fx_knn": "SELECT least(i, j) AS source, greatest(i, j) AS target, max(sim) AS sim FROM fx_topk GROUP BY 1, 2",
    "fx_bridges": """SELECT least(i, j) AS source, greatest(i, j) AS target, max(sim) AS sim FROM (SELECT *, row_number() OVER
        (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM fx_pairs WHERE apart) WHERE rank = 1
        AND sim >= (SELECT threshold FROM fx_threshold) GROUP BY 1, 2""",
    "fx_shown": """SELECT source, target, sim, false AS bridge FROM fx_knn WHERE sim >= (SELECT threshold FROM fx_threshold)
        UNION ALL SELECT source, target, sim, true FROM fx_bridges b WHERE NOT EXISTS (SELECT 1 FROM fx_knn k
        WHERE k.source = b.source AND k.target = b.target AND k.sim >= (SELECT threshold FROM fx_threshold))""",
    "fx_edges": """SELECT e.*, len(list_intersect(a.fields, b.fields)) = 0 AS apart,
        CASE WHEN a.field = b.field THEN 'f' || a.field ELSE 'cross' END AS grp
        FROM fx_shown e JOIN fx_row_vectors a ON a.entity = source JOIN fx_row_vectors b ON b.entity = target""",
    "fx_cuts": """SELECT grp, round(quantile_cont(sim, 1/3), 4) AS lo, round(quantile_cont(sim, 2/3), 4) AS hi FROM fx_edges GROUP BY grp
        UNION ALL SELECT 'all', round(quantile_cont(sim, 1/3), 4), round(quantile_cont(sim, 2/3), 4) FROM fx_edges""",
    "fx_banded": """SELECT e.*, CASE WHEN sim < t.threshold THEN 'distant' WHEN sim >= c.hi THEN 'upper'
        WHEN sim >= c.lo THEN 'middle' ELSE 'lower' END AS band FROM fx_edges e JOIN fx_cuts c USING (grp), fx_threshold t""",
    "fx_threshold": "SELECT round(quantile_cont(sim, 0.25), 4) AS threshold FROM fx_topk",
    "fx_base": """SELECT p_partkey AS base, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS w1,
        CASE WHEN p_partkey % 8 = 0 THEN 'Jo' ELSE 'Min' END AS mid,
        upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] ||
          translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS last FROM part WHERE p_partkey % 4 = 0""",
    "fx_people": """SELECT base AS person, w1 || ' ' || mid || ' ' || last AS name, base % 25 AS dept, base % 5 AS univ, base % 5 AS field,
        CASE WHEN base % 20 = 0 THEN 'O' || base END AS orcid, base % 12 = 0 AS has_anchors,
        CASE WHEN base % 28 <> 0 THEN 'p' || (base - base % 8) || '@example.org' END AS email FROM fx_base""",
    "fx_profiles": """SELECT p_partkey AS candidate, base AS person,
        CASE p_partkey % 4 WHEN 0 THEN last || ', ' || w1 || '-' || mid WHEN 1 THEN w1[1] || '. ' || mid || ' ' || last
          WHEN 2 THEN w1 || ' ' || mid[1] || '. ' || mid || ' ' || last ELSE 'Other ' || mid || ' ' || last END AS name,
        w1 || ' ' || mid || ' ' || last AS alternative, p_partkey % 97 * 3 AS works,
        CASE WHEN p_partkey % 3 = 0 THEN 'O' || (p_partkey - p_partkey % 8) END AS orcid,
        CASE WHEN p_partkey % 6 = 0 THEN (base + 1) % 5 ELSE base % 5 END AS inst1, (p_partkey + 2) % 5 AS inst2,
        1991 + p_partkey % 12 AS year1, 1985 AS year2, CASE WHEN p_partkey % 3 < 2 THEN base % 5 ELSE (base + 3) % 5 END AS last_known,
        [{'n': p_partkey % 7, 'f': p_partkey % 5, 'd': p_partkey % 2},
         {'n': CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 11 END, 'f': (p_partkey + 1) % 5, 'd': (p_partkey + 1) % 2},
         {'n': 2, 'f': base % 5, 'd': base % 2}] AS topics,
        (CASE WHEN p_partkey % 9 = 1 THEN 3 WHEN p_partkey % 9 = 5 THEN 1 WHEN p_partkey % 10 = 3 THEN 7 ELSE 0 END)::BIGINT AS anchor_hits
        FROM part JOIN fx_base ON base = p_partkey - p_partkey % 4""",
    "fx_shares": """SELECT candidate, round(sum(CASE WHEN CASE WHEN field % 2 = 0 THEN t.f IN (field, (field + 1) % 5) ELSE t.d = field % 2 END
          THEN n ELSE 0 END) / sum(n), 3) + 0.0 AS field_share FROM (
        SELECT c.candidate, p.field, t, CASE WHEN coalesce(t.n, 0) = 0 THEN 1 ELSE t.n END AS n
        FROM fx_profiles c JOIN fx_people p USING (person), unnest(c.topics) u(t)) GROUP BY candidate""",
    "fx_tokens": """SELECT kind, id, name, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(lower(
        strip_accents(name)), '([a-z])-([a-z])', '\\1\\2', 'g'), '([a-z])-([a-z])', '\\1\\2', 'g'), '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '') AS toks
        FROM (SELECT 'person' AS kind, person AS id, name FROM fx_people UNION ALL SELECT 'candidate', candidate, name FROM fx_profiles
          UNION ALL SELECT 'short', person, regexp_replace(name, '\\s+[A-Za-z]\\.\\s', ' ', 'g') FROM fx_people
          UNION ALL SELECT 'cshort', candidate, regexp_replace(name, '\\s+[A-Za-z]\\.\\s', ' ', 'g') FROM fx_profiles)""",
    "fx_keys": """SELECT DISTINCT CASE kind WHEN 'short' THEN 'person' WHEN 'cshort' THEN 'candidate' ELSE kind END AS kind, id, key FROM (
        SELECT kind, id, array_to_string(list_sort(toks), ' ') AS key FROM fx_tokens WHERE len(toks) > 0
        UNION ALL SELECT kind, id, array_to_string(list_sort([toks[i], array_to_string(list_concat(toks[:i-1], toks[i+1:]), '')]), ' ')
        FROM fx_tokens, range(1, 20) r(i) WHERE i <= len(toks) AND len(toks) > 1)""",
    "fx_key_pairs": "SELECT DISTINCT p.id AS person, c.id AS candidate FROM fx_keys p JOIN fx_keys c USING (key) WHERE p.kind = 'person' AND c.kind = 'candidate'",
    "fx_initial_pairs": """WITH p AS (SELECT id AS person, toks, list_filter(toks, lambda t: len(t) > 1) AS fullt FROM fx_tokens WHERE kind = 'person'),
        c AS (SELECT id AS candidate, toks, list_filter(toks, lambda t: len(t) > 1) AS fullt FROM fx_tokens WHERE kind = 'candidate'),
        pt AS (SELECT DISTINCT person, unnest(fullt) AS t FROM p), ct AS (SELECT DISTINCT candidate, unnest(fullt) AS t FROM c),
        two AS (SELECT person, candidate FROM pt JOIN ct USING (t) GROUP BY 1, 2 HAVING count(*) >= 2),
        x AS (SELECT person, candidate, p.fullt AS pf, c.fullt AS cf,
          list_filter(p.toks, lambda t: len(t) = 1) AS pi, list_filter(c.toks, lambda t: len(t) = 1) AS ci
          FROM two JOIN p USING (person) JOIN c USING (candidate))
        SELECT person, candidate, len(list_filter(list_filter(pf, lambda t: NOT list_contains(cf, t)), lambda t: NOT list_contains(ci, t[1]))) = 0
          AND len(list_filter(list_filter(cf, lambda t: NOT list_contains(pf, t)), lambda t: NOT list_contains(pi, t[1]))) = 0 AS explained FROM x""",
    "fx_name_pairs": "SELECT person, candidate FROM fx_key_pairs UNION SELECT person, candidate FROM fx_initial_pairs WHERE explained",
    "fx_evidence": """SELECT person, c.candidate, p.univ, p.field, c.works, c.orcid, c.anchor_hits, s.field_share,
        (c.inst1 = p.univ AND c.year1 >= 1998) OR c.last_known = p.univ AS affiliation_ok,
        n.person IS NOT NULL OR c.anchor_hits >= 1 AS name_ok, s.field_share >= 0.4 AS topic_ok,
        CASE WHEN p.orcid IS NOT NULL AND c.orcid IS NOT NULL THEN p.orcid = c.orcid END AS orcid_match
        FROM fx_profiles c JOIN fx_people p USING (person) JOIN fx_shares s USING (candidate)
        LEFT JOIN fx_name_pairs n USING (person, candidate)""",
    "fx_cands": """SELECT *, affiliation_ok AND name_ok AND (topic_ok OR anchor_hits >= 1) AS strong FROM fx_evidence
        WHERE name_ok OR anchor_hits > 0 OR affiliation_ok""",
    "fx_decisions": DECISIONS,
    "fx_pool": """WITH n AS (SELECT p.person, p.dept, p.univ, c.candidate, c.inst1, c.inst2, c.last_known FROM fx_people p JOIN fx_profiles c ON c.alternative = p.name
          UNION SELECT p.person, p.dept, p.univ, c.candidate, c.inst1, c.inst2, c.last_known FROM fx_name_pairs JOIN fx_people p USING (person) JOIN fx_profiles c USING (candidate)),
        r AS (SELECT person, candidate FROM n WHERE dept % 2 = 0 AND last_known = univ),
        s AS (SELECT p.person, c.candidate FROM fx_people p JOIN fx_profiles c ON c.alternative = p.name AND (c.inst1 = p.univ OR c.inst2 = p.univ) WHERE p.person NOT IN (SELECT person FROM r)),
        a AS (SELECT person, candidate, anchor_hits AS hits FROM fx_profiles WHERE anchor_hits > 0
          UNION ALL SELECT p.person, p.person + 5, 2 FROM fx_people p WHERE p.person % 16 = 0 AND p.person + 5 IN (SELECT candidate FROM fx_profiles))
        SELECT person, candidate, bool_or(roster) AS roster, bool_or(searched) AS searched, sum(hits)::BIGINT AS anchor_hits FROM (
          SELECT person, candidate, true AS roster, false AS searched, 0 AS hits FROM r UNION ALL SELECT person, candidate, false, true, 0 FROM s
          UNION ALL SELECT person, candidate, false, false, hits FROM a) GROUP BY 1, 2""",
    "fx_pool_cands": """SELECT *, affiliation_ok AND name_ok AND (topic_ok OR anchor_hits >= 1) AS strong FROM (
        SELECT o.person, o.candidate, c.works, c.orcid, o.anchor_hits, (c.inst1 = p.univ AND c.year1 >= 1998) OR c.last_known = p.univ AS affiliation_ok,
          n.person IS NOT NULL OR (o.anchor_hits >= 1 AND c.alternative = p.name) AS name_ok, s.share >= 0.4 AS topic_ok,
          CASE WHEN p.orcid IS NOT NULL AND c.orcid IS NOT NULL THEN p.orcid = c.orcid END AS orcid_match
        FROM fx_pool o JOIN fx_people p USING (person) JOIN fx_profiles c USING (candidate) LEFT JOIN fx_name_pairs n ON n.person = o.person AND n.candidate = o.candidate
        JOIN (SELECT candidate, field, round(sum(CASE WHEN CASE WHEN field % 2 = 0 THEN t.f IN (field, (field + 1) % 5) ELSE t.d = field % 2 END THEN n ELSE 0 END) / sum(n), 3) + 0.0 AS share
          FROM (SELECT c.candidate, f.field, t, CASE WHEN coalesce(t.n, 0) = 0 THEN 1 ELSE t.n END AS n FROM fx_profiles c, range(0, 5) f(field), unnest(c.topics) u(t)) GROUP BY 1, 2) s
          ON s.candidate = o.candidate AND s.field = p.field)
        WHERE name_ok OR anchor_hits > 0 OR affiliation_ok""",
    "fx_pool_decisions": DECISIONS.replace("fx_cands", "fx_pool_cands"),
    "fx_words": """SELECT doc_id, lang, source, n_chars, word, pos FROM (SELECT doc_id, lang, source, n_chars,
        unnest(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word,
        generate_subscripts(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1) - 1 AS pos FROM documents)""",
    "fx_links": """SELECT page_id, url, href, pos FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages)""",
    "fx_vector_members": """SELECT * FROM fx_item_vectors UNION ALL SELECT item, (item * 7 + 1) % 50, year, cites, field, v FROM fx_item_vectors
        WHERE item % 4 = 0 AND (item * 7 + 1) % 50 <> item % 50""",
    "fx_places": """SELECT entity, v, entity % 5 AS field, entity % 3 AS univ, entity % 6 AS subcluster, v[1] AS x, v[2] AS y FROM fx_entity_vectors""",
    "fx_place_pairs": """SELECT a.entity AS i, b.entity AS j, round(list_dot_product(a.v, b.v), 9) AS sim, a.field AS field_i, b.field AS field_j,
        a.univ AS univ_i, b.univ AS univ_j FROM fx_places a JOIN fx_places b ON a.entity <> b.entity""",
    "fx_place_topk": """SELECT i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM fx_place_pairs) WHERE rank <= 5""",
    "fx_core": """SELECT t.item, t.entity, CASE WHEN year <= 1998 THEN 'early' ELSE 'recent' END AS period, t.v, round(list_dot_product(t.v, e.v), 9) AS sim
        FROM fx_item_vectors t JOIN fx_entity_vectors e USING (entity) WHERE year IN (1997, 1998, 2000, 2001)""",
    "fx_mad": """SELECT entity, period, med, coalesce(nullif(quantile_cont(abs(sim - med), 0.5), 0), 1e-6) AS mad FROM fx_core
        JOIN (SELECT entity, period, quantile_cont(sim, 0.5) AS med FROM fx_core GROUP BY 1, 2) USING (entity, period) GROUP BY 1, 2, 3""",
    "fx_kept_core": """SELECT c.* FROM fx_core c JOIN fx_mad m USING (entity, period) WHERE round(sim, 6) >= round(med - 2.5 * 1.4826 * mad, 6) AND sim >= 0.0""",
    "fx_period_dims": """SELECT entity, period, dim, sum(x) AS x FROM (SELECT entity, period, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM fx_kept_core) GROUP BY 1, 2, 3""",
    "fx_period_vectors": """SELECT entity, period, list(x / n ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY entity, period)) AS n FROM fx_period_dims) GROUP BY 1, 2""",
    "fx_shift": """SELECT e.entity, 1 - list_dot_product(e.v, r.v) AS shift, e.v AS ev, r.v AS rv FROM fx_period_vectors e JOIN fx_period_vectors r USING (entity)
        WHERE e.period = 'early' AND r.period = 'recent'""",
}
