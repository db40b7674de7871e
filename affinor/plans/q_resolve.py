"""Queries over people, author profiles and match decisions."""
from __future__ import annotations

from pyspark.sql import functions as F

from affinor.functions import korean as H
from affinor.functions import names as N
from affinor.operators import resolve as R
from affinor.operators.ranking import rnd, top_k
from affinor.plans.fixtures import YEAR_TO, Fixtures
from affinor.plans.q_iterative import KO, PAT, korean, latin_full
from affinor.plans.registry import query
from affinor.rules import PARAMS


@query("name_tokens", """SELECT kind, id, array_to_string(toks, ' ') AS tokens FROM fx_tokens WHERE kind IN ('person', 'candidate')""")
def name_tokens(fx: Fixtures):
    a = fx.people.select(F.lit("person").alias("kind"), F.col("person").alias("id"), "name")
    b = fx.profiles.select(F.lit("candidate").alias("kind"), F.col("candidate").alias("id"), "name")
    return a.union(b).select("kind", "id", F.array_join(N.tokens(F.col("name")), " ").alias("tokens"))


@query("name_keys", "SELECT kind, id, key FROM fx_keys")
def name_keys(fx: Fixtures):
    a = fx.people.select(F.lit("person").alias("kind"), F.col("person").alias("id"), "name")
    b = fx.profiles.select(F.lit("candidate").alias("kind"), F.col("candidate").alias("id"), "name")
    return a.union(b).select("kind", "id", F.explode(N.all_keys(F.col("name"))).alias("key"))


@query("name_block_pairs", "SELECT person, candidate FROM fx_key_pairs UNION SELECT person, candidate FROM fx_initial_pairs")
def name_block_pairs(fx: Fixtures):
    return R.block_pairs(fx.people, fx.profiles)


@query("name_match_pairs", "SELECT person, candidate FROM fx_key_pairs")
def name_match_pairs(fx: Fixtures):
    return R.key_pairs(fx.people, fx.profiles)


@query("name_initial_pairs", "SELECT person, candidate, explained FROM fx_initial_pairs")
def name_initial_pairs(fx: Fixtures):
    return R.initial_pairs(fx.people, fx.profiles)


@query("name_spellings", """WITH b AS (SELECT candidate, trim(regexp_replace(replace(name, ',', ' '), '\\s+', ' ', 'g')) AS s0 FROM fx_profiles),
    v AS (SELECT candidate, s0, regexp_replace(s0, '\\s+[A-Za-z]\\.(\\s)', '\\1', 'g') AS s1 FROM b),
    l AS (SELECT candidate, s0, s1, string_split(s0, ' ') AS t FROM v),
    f AS (SELECT candidate, [s0, s1, replace(s1, '-', ' ')] || CASE WHEN len(t) >= 2 AND len(t[1]) > 1 AND t[1] = upper(t[1]) AND t[1] <> lower(t[1])
      THEN [array_to_string(t[2:], ' ') || ' ' || t[1]] ELSE [] END AS x FROM l)
    SELECT candidate, array_to_string(list_filter(x, lambda e, i: list_position(x, e) = i)[:3], '|') AS spellings FROM f""")
def name_spellings(fx: Fixtures):
    return fx.profiles.select("candidate", F.array_join(N.search_spellings(F.col("name")), "|").alias("spellings"))


@query("name_flip", """SELECT candidate, CASE WHEN contains(name, ',') THEN trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1))
    ELSE name END AS name FROM fx_profiles""")
def name_flip(fx: Fixtures):
    return fx.profiles.select("candidate", N.flip_comma(F.col("name")).alias("name"))


@query("affiliation_recent", """SELECT candidate, (inst1 = p.univ AND year1 >= 1998) OR last_known = p.univ AS recent,
    (inst1 = p.univ AND year1 >= 1999) OR last_known = p.univ AS recent_strict FROM fx_profiles c JOIN fx_people p USING (person)""")
def affiliation_recent(fx: Fixtures):
    j = fx.profiles.join(fx.people.select("person", "univ"), "person")
    args = (F.col("affiliations"), F.col("last_known"), F.col("univ"), YEAR_TO)
    # the live check uses a window one year tighter
    return j.select("candidate", R.affiliation_recent(*args, PARAMS.affiliation_years).alias("recent"),
                    R.affiliation_recent(*args, PARAMS.affiliation_years - 1).alias("recent_strict"))


@query("field_share", "SELECT candidate, field_share FROM fx_shares")
def field_share(fx: Fixtures):
    j = fx.profiles.join(fx.people.select("person", "field"), "person").join(F.broadcast(fx.field_scope), "field")
    return j.select("candidate", R.field_share(F.col("topics"), F.col("topic_fields"), F.col("domains")).alias("field_share"))


@query("match_candidates", "SELECT person, candidate, affiliation_ok, name_ok, topic_ok, orcid_match, strong FROM fx_cands")
def match_candidates(fx: Fixtures):
    return fx.evidence.select("person", "candidate", "affiliation_ok", "name_ok", "topic_ok", "orcid_match", "strong")


@query("match_decide", "SELECT * FROM fx_decisions")
def match_decide(fx: Fixtures):
    return fx.decisions


@query("match_pool", "SELECT person, candidate, roster, searched, anchor_hits FROM fx_pool")
def match_pool(fx: Fixtures):
    return fx.pool


@query("match_pool_candidates", "SELECT person, candidate, anchor_hits, affiliation_ok, name_ok, topic_ok, orcid_match, strong FROM fx_pool_cands")
def match_pool_candidates(fx: Fixtures):
    return fx.pool_evidence.select("person", "candidate", "anchor_hits", "affiliation_ok", "name_ok", "topic_ok", "orcid_match", "strong")


@query("match_pool_decide", "SELECT * FROM fx_pool_decisions")
def match_pool_decide(fx: Fixtures):
    return R.decide(fx.people, fx.pool_evidence)


@query("match_kept", """SELECT person, rank::INT AS rank, candidate FROM (SELECT person, candidate, row_number() OVER (PARTITION BY person
    ORDER BY strong DESC, anchor_hits DESC, affiliation_ok DESC, works DESC, candidate) AS rank FROM fx_pool_cands) WHERE rank <= 8""")
def match_kept(fx: Fixtures):
    return R.kept_candidates(fx.pool_evidence)


LEADING = """lead_n AS (SELECT c.candidate, count(*) AS n FROM fx_profiles c JOIN fx_memberships m ON m.entity = c.candidate
    JOIN fx_items i USING (item) WHERE senior AND i.year BETWEEN 1997 AND 2001 GROUP BY 1)"""


def leading(fx: Fixtures):
    inside = fx.items.filter("year BETWEEN 1997 AND 2001").select("item")
    return (fx.memberships.filter("senior").join(inside, "item", "left_semi")
            .groupBy(F.col("entity").alias("candidate")).agg(F.count("*").alias("n")))


@query("leading_items", "SELECT entity, n_senior AS n FROM (SELECT entity, count(*) FILTER (senior) AS n_senior FROM fx_eligible GROUP BY 1) WHERE n_senior > 0")
def leading_items(fx: Fixtures):
    return fx.eligible.filter("senior").groupBy("entity").agg(F.count("*").alias("n"))


@query("match_tiebreak", f"""WITH {LEADING}, c AS (SELECT f.*, coalesce(l.n, 0) AS n FROM fx_cands f JOIN fx_decisions d ON d.person = f.person
      AND d.reason = 'ambiguous_multiple_candidates' LEFT JOIN lead_n l ON l.candidate = f.candidate WHERE strong),
    r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY works DESC, candidate) AS rw,
      row_number() OVER (PARTITION BY person ORDER BY n DESC, candidate) AS rn FROM c),
    a AS (SELECT person, any_value(field) AS field, count(DISTINCT orcid) AS ids, count(*) FILTER (orcid IS NULL) AS no_id,
      max(candidate) FILTER (rw = 1) AS big, max(candidate) FILTER (rn = 1) AS lead, max(n) FILTER (rn = 1) AS n1,
      coalesce(max(n) FILTER (rn = 2), 0) AS n2 FROM r GROUP BY 1)
    SELECT person, CASE WHEN ids = 1 AND no_id = 0 THEN big WHEN n1 >= min_items AND n1 >= 3 * n2 THEN lead END AS candidate,
    CASE WHEN ids = 1 AND no_id = 0 THEN 'one id' WHEN n1 >= min_items AND n1 >= 3 * n2 THEN 'leads items' ELSE 'ambiguous' END AS why
    FROM a JOIN fx_rules USING (field)""")
def match_tiebreak(fx: Fixtures):
    amb = fx.decisions.filter("reason = 'ambiguous_multiple_candidates'")
    return R.tiebreak(amb, fx.evidence.filter("strong"), leading(fx), fx.rules)


# people whose number is a multiple of three have an English name on their page; of all others only the Korean one is known
EVIDENCE = f"""{KO}, pt AS (SELECT * FROM (VALUES {PAT}) t(ch, pat)), sl AS (SELECT surname, list(spelling) AS sp FROM sd GROUP BY 1),
    nm AS (SELECT candidate, string_split(name, ' ') AS toks FROM kc
      UNION ALL SELECT kn.candidate, [lower(sur), lower(one || two)] FROM kn JOIN fx_profiles c ON c.candidate = kn.candidate WHERE c.anchor_hits >= 1),
    jd AS (SELECT c.person, c.candidate, sp IS NOT NULL AS known, len(list_intersect(toks, sp)) > 0 AS has, array_to_string(list_filter(toks, lambda t: NOT list_contains(sp, t)), '') AS given,
        a.pat || b.pat AS pat
      FROM fx_profiles c JOIN kp w ON w.person = c.person JOIN nm ON nm.candidate = c.candidate LEFT JOIN sl ON surname = sur AND w.person % 11 <> 0 JOIN pt a ON a.ch = one JOIN pt b ON b.ch = two),
    kd AS (SELECT person, candidate, CASE WHEN bool_or(known) THEN coalesce(bool_or(has), false) END AS surname, CASE WHEN bool_or(has AND length(given) >= 2 AND regexp_full_match(given, pat)) THEN true
      WHEN bool_or(has AND length(given) < 2) THEN NULL WHEN bool_or(has) THEN false END AS given FROM jd GROUP BY 1, 2),
    e AS (SELECT c.candidate, c.anchor_hits, CASE WHEN c.person % 3 = 0 THEN n.person IS NOT NULL OR (c.anchor_hits >= 1 AND c.alternative = p.name) END AS english, surname, given,
        dept % 2 = 0 AS roster
      FROM fx_profiles c JOIN fx_people p USING (person) LEFT JOIN fx_name_pairs n USING (person, candidate) LEFT JOIN kd ON kd.person = c.person AND kd.candidate = c.candidate)"""


@query("name_evidence", f"""WITH {EVIDENCE} SELECT candidate, CASE WHEN english IS NOT NULL THEN english WHEN surname AND given THEN anchor_hits >= 1 OR roster
      WHEN surname AND given IS NULL THEN anchor_hits >= 2 WHEN surname IS NULL THEN anchor_hits >= 3 ELSE false END AS name_ok FROM e""")
def name_evidence(fx: Fixtures):
    """Names judged down the ladder: an English name by the display name, and by the alternatives of a profile that publications confirm;
    where there is none, the Korean one by the romanised surname and given name of the same names."""
    k = F.col("person")
    seen = R.names_seen(fx.profiles)
    english = R.compatible_pairs(fx.people.filter(k % 3 == 0), seen).withColumn("hit", F.lit(True))
    ko, latin = korean_profiles(fx)
    pairs = fx.profiles.filter(k % 3 != 0).select("person", "candidate").distinct()
    native = H.native_names(pairs, ko, R.names_seen(latin)).select("person", "candidate", "surname_ok", "given_ok")
    roster = fx.people.select("person", (F.col("dept") % 2 == 0).alias("roster")).distinct()
    c = (fx.profiles.join(english, ["person", "candidate"], "left").join(native, ["person", "candidate"], "left").join(roster, "person", "left"))
    return c.select("candidate", R.name_verdict(F.when(k % 3 == 0, F.coalesce("hit", F.lit(False))), F.col("surname_ok"), F.col("given_ok"),
                                                F.col("anchor_hits"), F.col("roster")).alias("name_ok"))


def korean_profiles(fx: Fixtures):
    """People by their Korean names, every eleventh with a surname that the dictionary does not hold, and profiles with the Latin name shown,
    the full spelling as alternative, and their anchors."""
    ko, latin = korean(fx)
    ko = ko.withColumn("name_ko", F.when(F.col("person") % 11 == 0, F.concat(F.lit("뷁"), F.substring("name_ko", 2, 9))).otherwise(F.col("name_ko")))
    full = latin_full(fx).select("candidate", F.array("name").alias("alternatives")).distinct()
    return ko, latin.join(full, "candidate").join(fx.profiles.select("candidate", "anchor_hits").distinct(), "candidate")


# ------------------------------------------------------------------ colleagues, features, scores
FEATURES = """win AS (SELECT m.item, m.entity, m.at_home, e.dept FROM fx_memberships m JOIN fx_entities e USING (entity) JOIN fx_items i USING (item)
      WHERE i.year BETWEEN 1997 AND 2001),
    co AS (SELECT entity, count(*) AS colleague_items FROM win w WHERE EXISTS (SELECT 1 FROM win o WHERE o.item = w.item AND o.dept = w.dept
      AND o.entity <> w.entity) GROUP BY 1),
    feat AS (SELECT entity, count(*) AS works_window, count(*) FILTER (at_home) AS home_items FROM win GROUP BY 1)"""


def window_members(fx: Fixtures):
    return (fx.memberships.select("item", "entity", "at_home").join(fx.entities.select("entity", "dept"), "entity")
            .join(fx.items.filter("year BETWEEN 1997 AND 2001").select("item"), "item"))


def colleague_items(win):
    """Items shared with another entity of the same department, from the number of the department's entities per item."""
    crowd = win.groupBy("item", "dept").agg(F.countDistinct("entity").alias("_n")).filter("_n > 1")
    return win.join(crowd, ["item", "dept"], "left_semi").groupBy("entity").agg(F.count("*").alias("colleague_items"))


@query("dept_coauthor_count", f"WITH {FEATURES} SELECT entity, colleague_items FROM co")
def dept_coauthor_count(fx: Fixtures):
    return colleague_items(window_members(fx))


MIXES = """f AS (SELECT item, arg_min(subfield, (pos, topic, score, subfield)) AS subfield FROM fx_item_topics GROUP BY 1),
    em AS (SELECT h.entity, e.dept, subfield, count(*) AS n FROM fx_home h JOIN f USING (item) JOIN fx_entities e USING (entity) GROUP BY 1, 2, 3)"""


def mixes(fx: Fixtures):
    from affinor.plans.q_topics import first_topics
    return (fx.home.join(first_topics(fx), "item").groupBy("entity", "subfield").agg(F.count("*").alias("n"))
            .join(fx.entities.select("entity", "dept"), "entity"))


@query("group_mix_cosine", f"""WITH {MIXES}, dm AS (SELECT dept, subfield, sum(n) AS n FROM em GROUP BY 1, 2),
    o AS (SELECT a.entity, d.subfield, d.n - coalesce(b.n, 0) AS m, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT entity, dept FROM em) a
      JOIN dm d USING (dept) LEFT JOIN em b ON b.entity = a.entity AND b.subfield = d.subfield)
    SELECT entity, coalesce(round(sum(n * m) / nullif(sqrt(sum(n * n)) * sqrt(sum(m * m)), 0), 3), 0.0) + 0.0 AS subfield_sim FROM o GROUP BY 1""")
def group_mix_cosine(fx: Fixtures):
    em = mixes(fx)
    dm = em.groupBy("dept", "subfield").agg(F.sum("n").alias("d"))
    # |dept - own|^2 = |dept|^2 - 2 dept.own + |own|^2, so the entity is never crossed with its department's full list
    own = em.join(dm, ["dept", "subfield"]).groupBy("entity", "dept").agg(
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("d")).alias("nd"))
    dd = dm.groupBy("dept").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    rest = F.col("dd") - 2 * F.col("nd") + F.col("nn")
    cos = F.try_divide(F.col("nd") - F.col("nn"), F.sqrt("nn") * F.sqrt(rest))
    return own.join(dd, "dept").select("entity", (F.coalesce(F.round(cos, 3), F.lit(0.0)) + 0.0).alias("subfield_sim"))


NEAREST = """nr AS (SELECT a.entity, b.entity AS other, sum(a.n * b.n) AS ab FROM em a JOIN em b ON a.dept = b.dept AND a.subfield = b.subfield
      AND a.entity <> b.entity GROUP BY 1, 2), nm AS (SELECT entity, sqrt(sum(n * n)) AS nn, sum(n) AS total FROM em GROUP BY 1)"""


@query("nearest_colleague", f"""WITH {MIXES}, {NEAREST} SELECT nr.entity, round(max(ab / (a.nn * b.nn)), 3) + 0.0 AS subfield_near
    FROM nr JOIN nm a ON a.entity = nr.entity JOIN nm b ON b.entity = other WHERE b.total >= 3 GROUP BY 1""")
def nearest_colleague(fx: Fixtures):
    return nearest(mixes(fx))


def nearest(em):
    """Largest cosine of an entity's subfield mix with that of a colleague holding three or more items."""
    from affinor.operators import vectors as V
    # the mix as a dense vector over the sorted subfield list (a short vocabulary), compared inside bounded tiles per department
    vocab = em.agg(F.array_sort(F.collect_set("subfield")).alias("l"))
    m = em.groupBy("entity", "dept").agg(F.map_from_entries(F.collect_list(F.struct("subfield", "n"))).alias("m"), F.sum("n").alias("total"))
    vec = m.withColumn("l", vocab.scalar()).select(
        F.col("entity").alias("id"), "dept", "total",
        V.unit(F.transform("l", lambda s: F.coalesce(F.col("m")[s], F.lit(0)).cast("double"))).alias("v"))

    def fn(t):
        import numpy as np
        big = lambda n: np.where(n >= 3, 0.0, -np.inf)
        s = np.where(t.ok, t.sim, -np.inf)
        i, b = t.i, (s + big(t.right("total"))[None, :]).max(1, initial=-np.inf)
        if not t.diagonal:
            i, b = np.r_[i, t.j], np.r_[b, (s.T + big(t.left("total"))[None, :]).max(1, initial=-np.inf)]
        keep = b > -np.inf
        return {"entity": i[keep], "best": b[keep]}
    best = V.tile_map(vec, fn, "entity long, best double", ["dept"], carry=["total"])
    return best.groupBy("entity").agg(rnd(F.max("best"), 3).alias("subfield_near")).filter("subfield_near > 0")


TITLES = """tl AS (SELECT entity, string_agg(substr(title, 1, 110), ' | ' ORDER BY r) AS titles FROM (SELECT w.entity, title, row_number() OVER
      (PARTITION BY w.entity ORDER BY pub_date DESC, item DESC) AS r FROM win w JOIN fx_pub USING (item)) WHERE r <= 8 GROUP BY 1)"""


@query("candidate_features", f"""WITH {FEATURES}, {TITLES}, {MIXES}, {NEAREST}, led AS (SELECT entity, count(*) FILTER (senior) AS n FROM fx_eligible GROUP BY 1),
    nc AS (SELECT nr.entity, round(max(ab / (a.nn * b.nn)), 3) + 0.0 AS subfield_near FROM nr JOIN nm a ON a.entity = nr.entity JOIN nm b
      ON b.entity = other WHERE b.total >= 3 GROUP BY 1)
    SELECT entity, works_window, home_items, coalesce(colleague_items, 0) AS colleague_items, coalesce(subfield_near, 0.0) AS subfield_near,
    coalesce(led.n, 0) AS leading_items, titles FROM feat LEFT JOIN co USING (entity) LEFT JOIN nc USING (entity) LEFT JOIN led USING (entity)
    LEFT JOIN tl USING (entity)""")
def candidate_features(fx: Fixtures):
    from affinor.operators.items import publication_date
    win = window_members(fx)
    base = win.groupBy("entity").agg(F.count("*").alias("works_window"), F.count_if("at_home").alias("home_items"))
    led = fx.eligible.filter("senior").groupBy("entity").agg(F.count("*").alias("leading_items"))
    dated = win.join(fx.items.select("item", "title", publication_date().alias("pub_date")), "item")
    top = top_k(dated, ["entity"], [F.col("pub_date").desc(), F.col("item").desc()], 8)
    titles = top.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))),
                                                                lambda x: F.substring(x["title"], 1, 110)), " | ").alias("titles"))
    out = base
    for part in (colleague_items(win), nearest(mixes(fx)), led, titles):
        out = out.join(part, "entity", "left")
    z = lambda c, v=0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select("entity", "works_window", "home_items", z("colleague_items"), z("subfield_near", 0.0), z("leading_items"), "titles")


SCORED = """sc AS (SELECT person, candidate, name_ok, field_share, anchor_hits, candidate % 13 AS works_window,
      candidate % 13 * (candidate % 4) // 3 AS home_items, candidate % 8 AS colleague_items FROM fx_cands),
    scored AS (SELECT *, CASE WHEN NOT name_ok OR works_window = 0 THEN -1.0::DOUBLE ELSE least(colleague_items, 5) / 5 + field_share
      + (home_items / works_window) * least(works_window, 10) / 10 + CASE WHEN anchor_hits > 0 THEN 1.0 ELSE 0.0 END END AS score0 FROM sc),
    ranked AS (SELECT *, round(score0, 6) + 0.0 AS score, row_number() OVER (PARTITION BY person ORDER BY round(score0, 6) DESC, candidate) AS rn FROM scored),
    best AS (SELECT person, max(candidate) FILTER (rn = 1) AS candidate, max(score) FILTER (rn = 1) AS score, coalesce(max(score) FILTER (rn = 2), 0.0) AS second,
      max(works_window) FILTER (rn = 1) AS w, max(home_items) FILTER (rn = 1) AS h, max(colleague_items) FILTER (rn = 1) AS c, max(anchor_hits) FILTER (rn = 1) AS a
      FROM ranked GROUP BY 1),
    dec AS (SELECT person, CASE WHEN score > 0 THEN candidate END AS choice, CASE WHEN score > 0 THEN round(score - greatest(second, 0.0), 3) + 0.0 ELSE 0.0 END AS margin,
      score > 0 AND NOT (h < 0.3 * w AND c = 0 AND a = 0) AND (round(score - greatest(second, 0.0), 3) >= 0.8 OR a > 0) AS certain FROM best)"""


def scored(fx: Fixtures):
    c = F.col("candidate")
    e = fx.evidence.select("person", "candidate", "name_ok", "field_share", "anchor_hits", (c % 13).alias("works_window"),
                           F.floor(c % 13 * (c % 4) / 3).alias("home_items"), (c % 8).alias("colleague_items"))
    return e.withColumn("score", rnd(R.candidate_score(F.col("name_ok"), F.col("works_window"), F.col("home_items"),
                                                       F.col("colleague_items"), F.col("field_share"), F.col("anchor_hits"))))


@query("candidate_score", f"WITH {SCORED} SELECT person, candidate, score FROM ranked")
def candidate_score(fx: Fixtures):
    return scored(fx).select("person", "candidate", "score")


@query("candidate_decide", f"WITH {SCORED} SELECT person, choice, margin, certain FROM dec")
def candidate_decide(fx: Fixtures):
    return R.score_decide(scored(fx))


ROUTE = """ans AS (SELECT person, CASE WHEN person % 3 = 0 THEN NULL ELSE person + 1 END AS answer,
      CASE person % 16 WHEN 0 THEN 'high' WHEN 4 THEN 'medium' ELSE 'low' END AS conf FROM fx_people),
    old AS (SELECT person, CASE WHEN person % 24 = 4 THEN person + 1 END AS old_choice, person % 24 = 0 AS old_excluded FROM fx_people WHERE person % 6 <> 2),
    j AS (SELECT d.person, CASE WHEN certain THEN d.choice ELSE answer END AS final, CASE WHEN certain THEN 'certain' ELSE conf END AS confidence,
      m.candidate AS current, old_choice, coalesce(old_excluded, false) AS old_excluded FROM dec d LEFT JOIN ans USING (person)
      LEFT JOIN fx_decisions m ON m.person = d.person LEFT JOIN old ON old.person = d.person)"""


@query("review_route", f"""WITH {SCORED}, {ROUTE} SELECT person, final AS choice, confidence, CASE WHEN confidence = 'low' THEN 'review'
    WHEN final IS DISTINCT FROM current OR (final IS NOT NULL AND old_choice IS NOT DISTINCT FROM final) OR (final IS NULL AND old_excluded)
    THEN CASE WHEN final IS NOT NULL THEN 'force' ELSE 'exclude' END ELSE 'unchanged' END AS action FROM j""")
def review_route(fx: Fixtures):
    p = F.col("person")
    ans = fx.people.select("person", F.when(p % 3 != 0, p + 1).alias("answer"),
                           F.when(p % 16 == 0, "high").when(p % 16 == 4, "medium").otherwise("low").alias("answer_confidence"))
    old = fx.people.filter(p % 6 != 2).select("person", F.when(p % 24 == 4, p + 1).alias("old_choice"), (p % 24 == 0).alias("old_excluded"))
    return R.route(R.score_decide(scored(fx)), ans, fx.decisions.select("person", F.col("candidate").alias("current")), old)


# ------------------------------------------------------------------ overrides
OVER = """hand AS (SELECT person, CASE WHEN person % 40 = 0 THEN 'exclude' ELSE 'force' END AS action, CASE WHEN person % 40 <> 0 THEN person + 2 END AS forced
      FROM fx_people WHERE person % 20 = 0 UNION ALL SELECT -p_partkey - 1, 'exclude', NULL FROM part WHERE p_partkey % 50 = 0),
    auto AS (SELECT person, 'force' AS action, person + 3 AS forced FROM fx_people WHERE person % 8 = 0),
    over AS (SELECT *, 'hand' AS layer FROM hand UNION ALL SELECT *, 'auto' FROM auto a WHERE NOT EXISTS (SELECT 1 FROM hand h WHERE h.person = a.person))"""


def overrides(fx: Fixtures):
    p = F.col("person")
    hand = fx.people.filter(p % 20 == 0).select("person", F.when(p % 40 == 0, "exclude").otherwise("force").alias("action"),
                                                F.when(p % 40 != 0, p + 2).alias("forced"))
    gone = fx.t("part").filter("p_partkey % 50 = 0").select((-F.col("p_partkey") - 1).alias("person"), F.lit("exclude").alias("action"),
                                                            F.lit(None).cast("long").alias("forced"))
    auto = fx.people.filter(p % 8 == 0).select("person", F.lit("force").alias("action"), (p + 3).alias("forced"))
    return R.layer_overrides(hand.unionByName(gone), auto)


@query("override_layers", f"WITH {OVER} SELECT person, action, forced, layer FROM over")
def override_layers(fx: Fixtures):
    return overrides(fx)


@query("override_apply", f"""WITH {OVER} SELECT d.person, CASE action WHEN 'exclude' THEN NULL WHEN 'force' THEN forced ELSE candidate END AS candidate,
    CASE action WHEN 'exclude' THEN 'excluded' WHEN 'force' THEN 'matched' ELSE status END AS status,
    CASE action WHEN 'exclude' THEN 'manual_review' WHEN 'force' THEN NULL ELSE reason END AS reason,
    CASE action WHEN 'exclude' THEN NULL WHEN 'force' THEN 'medium' ELSE confidence END AS confidence,
    action = 'force' AND NOT EXISTS (SELECT 1 FROM fx_cands c WHERE c.person = d.person AND c.candidate = forced) AS candidate_added
    FROM fx_decisions d LEFT JOIN over o ON o.person = d.person""".replace("action = 'force' AND NOT", "coalesce(action = 'force', false) AND NOT"))
def override_apply(fx: Fixtures):
    o = overrides(fx)
    added = R.missing_candidates(fx.evidence, o).select("person", F.lit(True).alias("candidate_added"))
    return (R.apply_overrides(fx.decisions, o).join(added, "person", "left")
            .withColumn("candidate_added", F.coalesce("candidate_added", F.lit(False))))


@query("override_stale", f"WITH {OVER} SELECT person, action FROM over o WHERE NOT EXISTS (SELECT 1 FROM fx_people p WHERE p.person = o.person)")
def override_stale(fx: Fixtures):
    return R.stale_overrides(overrides(fx), fx.people).select("person", "action")


@query("conflict_groups", """WITH m AS (SELECT person, person // 16 AS candidate, CASE WHEN person % 160 = 0 THEN 99 ELSE person // 16 % 5 END AS univ,
      dept, CASE WHEN person % 48 = 4 THEN NULL WHEN person % 32 = 12 THEN lower(name) ELSE name END AS name, CASE WHEN person % 12 = 0 THEN NULL ELSE email END AS email FROM fx_people),
    k AS (SELECT m.person, candidate, dept, email, key FROM m JOIN fx_keys ON kind = 'person' AND id = m.person WHERE m.name IS NOT NULL),
    same AS (SELECT a.person, b.dept AS d2, b.person AS p2 FROM m a JOIN m b ON a.candidate = b.candidate AND a.email = b.email
      UNION ALL SELECT a.person, b.dept, b.person FROM k a JOIN k b ON a.candidate = b.candidate AND a.key = b.key AND (a.email IS NULL OR b.email IS NULL)
      UNION ALL SELECT person, dept, person FROM m),
    g AS (SELECT m.*, s.leader, s.ld FROM m JOIN (SELECT person, (min((d2, p2)))[2] AS leader, (min((d2, p2)))[1] AS ld FROM same GROUP BY 1) s USING (person)),
    per AS (SELECT candidate, count(DISTINCT univ) AS nu, count(DISTINCT leader) AS np, count(DISTINCT leader) FILTER (name IS NOT NULL) AS ne,
      max((ld, leader)) FILTER (name IS NOT NULL) AS el FROM g GROUP BY 1)
    SELECT person, g.candidate, leader, CASE WHEN nu > 1 THEN 'excluded' WHEN np = 1 OR (ne = 1 AND el[2] = leader)
      THEN CASE WHEN leader = person THEN 'entity' ELSE 'merged' END ELSE 'excluded' END AS verdict FROM g JOIN per USING (candidate)""")
def conflict_groups(fx: Fixtures):
    p = F.col("person")
    m = fx.people.select("person", F.floor(p / 16).alias("candidate"),
                         F.when(p % 160 == 0, 99).otherwise(F.floor(p / 16) % 5).alias("univ"), "dept",
                         F.when(p % 48 == 4, F.lit(None)).when(p % 32 == 12, F.lower("name")).otherwise(F.col("name")).alias("name"),
                         F.when(p % 12 != 0, F.col("email")).alias("email"))
    return R.conflict_groups(m)


# ------------------------------------------------------------------ evaluation
@query("gold_eval", f"""WITH {SCORED}, truth AS (SELECT person, CASE WHEN person % 20 = 0 THEN 'hand' ELSE 'silver' END AS kind,
      CASE WHEN person % 40 = 0 THEN NULL WHEN person % 20 = 0 THEN person + 2 ELSE d.candidate END AS truth FROM fx_decisions d
      WHERE person % 20 = 0 OR (d.status = 'matched' AND (SELECT count(*) FROM fx_cands c WHERE c.person = d.person) >= 2))
    SELECT kind, count(*) AS n, count(*) FILTER (choice IS NOT DISTINCT FROM truth) AS correct, count(*) FILTER (certain) AS certain,
    count(*) FILTER (certain AND choice IS NOT DISTINCT FROM truth) AS correct_certain, count(*) FILTER (NOT certain) AS to_review
    FROM truth JOIN dec USING (person) GROUP BY 1""")
def gold_eval(fx: Fixtures):
    p = F.col("person")
    several = fx.evidence.groupBy("person").agg(F.count("*").alias("n")).filter("n >= 2").select("person", F.lit(True).alias("several"))
    truth = (fx.decisions.join(several, "person", "left")
             .filter((p % 20 == 0) | ((F.col("status") == "matched") & F.coalesce("several", F.lit(False))))
             .select("person", F.when(p % 20 == 0, "hand").otherwise("silver").alias("kind"),
                     F.when(p % 40 == 0, F.lit(None)).when(p % 20 == 0, p + 2).otherwise(F.col("candidate")).alias("truth")))
    j = truth.join(R.score_decide(scored(fx)), "person").withColumn("ok", F.col("choice").eqNullSafe(F.col("truth")))
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"), F.count_if("certain").alias("certain"),
                                 F.count_if(F.col("certain") & F.col("ok")).alias("correct_certain"), F.count_if(~F.col("certain")).alias("to_review"))


@query("confidence_eval", """WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
      quality = 1 AS correct, n_chars // 4 AS tok_in, n_chars // 40 AS tok_out FROM labels JOIN documents USING (doc_id))
    SELECT confidence, count(*) AS n, count(*) FILTER (correct) AS correct, sum(tok_in)::BIGINT AS tokens_in, sum(tok_out)::BIGINT AS tokens_out,
    round((sum(tok_in) * 4.0 + sum(tok_out) * 20.0) / 1e6, 6) + 0.0 AS cost FROM a GROUP BY 1""")
def confidence_eval(fx: Fixtures):
    d = F.col("doc_id")
    a = fx.t("labels").join(fx.t("documents").select("doc_id", "n_chars"), "doc_id").select(
        F.when(d % 3 == 0, "high").when(d % 3 == 1, "medium").otherwise("low").alias("confidence"), (F.col("quality") == 1).alias("correct"),
        F.floor(F.col("n_chars") / 4).alias("i"), F.floor(F.col("n_chars") / 40).alias("o"))
    return a.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.sum("i").alias("tokens_in"),
                                       F.sum("o").alias("tokens_out"), rnd((F.sum("i") * 4.0 + F.sum("o") * 20.0) / 1e6).alias("cost"))
