"""Entity resolution: name joins on keys, evidence, decision ladder, scores, overrides, conflicts.

Name candidates are found by equality only - a shared order-free key, or a shared pair of full tokens - so a very common
single token never multiplies the two sides."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.functions import names as N
from affinor.operators.ranking import top_k
from affinor.rules import PARAMS


# ------------------------------------------------------------------ name joins
def _exploded(df: DataFrame, id: str, expr: Column, name: str) -> DataFrame:
    return _names(df, id).select(id, F.explode(expr).alias(name)).distinct()


def _names(df: DataFrame, id: str, *more: str) -> DataFrame:
    """Each name once per id, dealt over all tasks: what is made of names costs far more than to read them, and few files hold many."""
    return df.select(id, *more, "name").distinct()


def key_pairs(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person, candidate) sharing any order-free name key."""
    a = _exploded(people, "person", N.all_keys(F.col("name")), "key")
    b = _exploded(profiles, "candidate", N.all_keys(F.col("name")), "key")
    return a.join(b, "key").select("person", "candidate").distinct()


PART = 8192  # names that share a pair of tokens, from which on they meet in parts


def _paired(a: DataFrame, b: DataFrame, on: list[str], size: int = PART) -> DataFrame:
    """Inner join on `on`, a key of many rows dealt into parts of about `size` on both sides: every part of one side meets every part of the
    other in one task at a time. `a` has the column person, `b` the column candidate."""
    many = lambda df, n: df.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(n))
    n = many(a, "_na").join(many(b, "_nb"), on)
    own = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(n, on).withColumn("_a", own("person", "_na")).withColumn("_b", every("_nb")).drop("_na", "_nb")
    right = b.join(n, on).withColumn("_b", own("candidate", "_nb")).withColumn("_a", every("_na")).drop("_na", "_nb")
    return left.join(right, [*on, "_a", "_b"])


def _twos(df: DataFrame, id: str, side: str, block: list[str]) -> DataFrame:
    """One row per id and pair of its full tokens, beside the pairs of that id that come before it."""
    one = _names(df, id, *block).select(id, *block, F.explode(N.token_pairs(N.full_tokens(N.tokens(F.col("name"))))).alias("two")).distinct()
    every = one.groupBy(id, *block).agg(F.array_sort(F.collect_list("two")).alias("l"))
    return every.select(id, *block, F.posexplode("l").alias("at", "two"), "l").select(id, *block, "two", F.slice("l", F.lit(1), F.col("at")).alias(f"before_{side}"))


def token_pair_blocks(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person, candidate) with two common full tokens. Of all shared pairs the first gives the row, so the result, which is quadratic in a
    pair that many share, is never shuffled to remove repeats."""
    j = _paired(_twos(people, "person", "a", []), _twos(profiles, "candidate", "b", []), ["two"])
    return j.filter(~F.arrays_overlap("before_a", "before_b")).select("person", "candidate")


def _letters(toks: Column) -> Column:
    """First letters of the tokens as bits."""
    return F.aggregate(toks, F.lit(0), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(t) - 97)))


def _judged(df: DataFrame, id: str, side: str) -> DataFrame:
    """One row per pair of full tokens: the other full tokens, their first letters, the initials, all tokens and the pairs before."""
    t = df.select(id, N.tokens(F.col("name")).alias("t")).select(id, "t", F.array_distinct(N.full_tokens(F.col("t"))).alias("full"))
    t = t.withColumn("i", _letters(N.initials(F.col("t")))).select(id, "t", "full", "i", N.token_pairs(F.col("full")).alias("l"))
    t = t.select(id, "t", "full", "i", "l", F.posexplode("l").alias("at", "two"))
    t = t.withColumn("rest", F.array_except("full", F.split("two", " ")))
    return t.select(id, "two", F.col("t").alias(f"t{side}"), F.col("rest").alias(f"rest_{side}"), _letters(F.col("rest")).alias(f"need_{side}"),
                    F.col("i").alias(f"has_{side}"), F.slice(F.array_sort("l"), F.lit(1), F.array_position(F.array_sort("l"), F.col("two")).cast("int") - 1).alias(f"before_{side}"))


def initial_pairs(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """Token-pair blocks with the verdict whether initials explain the other tokens.

    Pairs that share just two tokens, the many, are judged by letters held as bits where they meet, and never shuffled; those that
    share more by their tokens. Ids with several names (`_several`) give a verdict for each two names, as long as any two names meet."""
    people, profiles = people.filter("person IS NOT NULL"), profiles.filter("candidate IS NOT NULL")
    once = lambda df, id: df.groupBy(id).agg(F.count("*").alias("_n"), F.first("name").alias("name")).filter("_n = 1").drop("_n")
    more = lambda df, id: df.join(df.groupBy(id).agg(F.count("*").alias("_n")).filter("_n > 1").select(id), id, "left_semi")
    p1, c1, pn, cn = once(people, "person"), once(profiles, "candidate"), more(people, "person"), more(profiles, "candidate")
    j = _paired(_judged(p1, "person", "a"), _judged(c1, "candidate", "b"), ["two"])
    beyond = F.arrays_overlap("rest_a", "rest_b")
    lack = lambda need, has: F.col(need).bitwiseAND(F.bitwise_not(has)) == 0
    just = j.filter(~beyond).select("person", "candidate", (lack("need_a", "has_b") & lack("need_b", "has_a")).alias("explained"))
    wide = (j.filter(beyond & ~F.arrays_overlap("before_a", "before_b"))
            .select("person", "candidate", N.initials_explain(F.col("ta"), F.col("tb")).alias("explained")))
    return just.unionByName(wide).unionByName(_several(pn, profiles)).unionByName(_several(p1, cn))


def _several(people: DataFrame, profiles: DataFrame) -> DataFrame:
    pt = people.select("person", N.tokens(F.col("name")).alias("ta"))
    ct = profiles.select("candidate", N.tokens(F.col("name")).alias("tb"))
    return (token_pair_blocks(people, profiles).join(pt, "person").join(ct, "candidate")
            .select("person", "candidate", N.initials_explain(F.col("ta"), F.col("tb")).alias("explained")))


FULL, SHORT = 6, 4  # names of more full tokens or initials meet by pairs of tokens


def _signatures(df: DataFrame, id: str, mine: str, theirs: str, block: list[str]) -> DataFrame:
    """One row per set of full tokens that a name may share and set of its initials that may explain the other name: the shared tokens, the
    first letters of this name's other tokens (`mine`) and the letters of the initials (`theirs`), each as one string."""
    d = df.select(id, *block, "t").select(id, *block, F.array_sort(F.array_distinct(N.full_tokens(F.col("t")))).alias("full"),
                                          F.array_sort(F.array_distinct(N.initials(F.col("t")))).alias("short"))
    inside = lambda c, bits: F.filter(c, lambda x, i: F.call_function("shiftright", bits, i).bitwiseAND(F.lit(1)) == 1)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(c)) - 1))
    d = d.filter(F.size("full") >= 2).withColumn("_f", every("full")).filter(F.bit_count("_f") >= 2).withColumn("_s", every("short"))
    rest = F.transform(F.array_except("full", "shared"), lambda t: F.substring(t, 1, 1))
    return (d.withColumn("shared", inside(F.col("full"), F.col("_f")))
            .select(id, *block, F.array_join("shared", " ").alias("shared"), F.array_join(F.array_sort(F.array_distinct(rest)), "").alias(mine),
                    F.array_join(inside(F.col("short"), F.col("_s")), "").alias(theirs)).distinct())


def explained_pairs(people: DataFrame, profiles: DataFrame, block: list[str] | None = None) -> DataFrame:
    """(person, candidate) of a block with two common full tokens and initials for all others, found by equality: both names share a set
    of tokens, and the first letters of either's other tokens are a set of the other's initials. So names meet only if they match, however
    many share two tokens. The few names with very many tokens meet by pairs of tokens."""
    block = block or []
    with_t = lambda df, id: _names(df, id, *block).select(id, *block, "name", N.tokens(F.col("name")).alias("t"))
    p, c = with_t(people, "person"), with_t(profiles, "candidate")
    long = (F.size(F.array_distinct(N.full_tokens(F.col("t")))) > FULL) | (F.size(F.array_distinct(N.initials(F.col("t")))) > SHORT)
    near = _signatures(p.filter(~long), "person", "_x", "_y", block).join(_signatures(c.filter(~long), "candidate", "_y", "_x", block), [*block, "shared", "_x", "_y"])
    out = near.select("person", "candidate")
    two = lambda df, id, t: df.select(id, *block, F.col("t").alias(t), F.explode(N.token_pairs(N.full_tokens(F.col("t")))).alias("two"))
    for a, b in ((p.filter(long), c), (p.filter(~long), c.filter(long))):
        met = _paired(two(a, "person", "ta"), two(b, "candidate", "tb"), [*block, "two"])
        out = out.union(met.filter(N.initials_explain(F.col("ta"), F.col("tb"))).select("person", "candidate"))
    return out.distinct()


def names_seen(profiles: DataFrame) -> DataFrame:
    """(candidate, name): the name a profile shows, and its alternatives only where publications of the person confirm it, since merged
    profiles carry other people's names. `profiles`: candidate, name, alternatives, anchor_hits."""
    more = F.when(F.col("anchor_hits") >= 1, F.col("alternatives")).otherwise(F.array().cast("array<string>"))
    return profiles.select("candidate", F.explode(F.concat(F.array("name"), F.coalesce(more, F.array().cast("array<string>")))).alias("name")).filter("name IS NOT NULL")


def compatible_pairs(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person, candidate) where any name of the person is compatible with any of the candidate's; several rows an id."""
    return key_pairs(people, profiles).union(explained_pairs(people, profiles).filter("person IS NOT NULL AND candidate IS NOT NULL")).distinct()


def block_pairs(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """(person, candidate) sharing an order-free key or two full tokens: the latter as they meet, and of the former those without two."""
    full = lambda df, id, n: (df.select(id, F.explode_outer(N.token_pairs(N.full_tokens(N.tokens(F.col("name"))))).alias("two"))
                              .groupBy(id).agg(F.collect_set("two").alias(n)))
    a, b = full(people, "person", "_a").withColumnRenamed("person", "_p"), full(profiles, "candidate", "_b").withColumnRenamed("candidate", "_c")
    k = key_pairs(people, profiles)
    keyed = k.join(a, k.person.eqNullSafe(a["_p"])).join(b, k.candidate.eqNullSafe(b["_c"]))
    return token_pair_blocks(people, profiles).union(keyed.filter(~F.arrays_overlap("_a", "_b")).select("person", "candidate"))


def names_compatible(a: Column, b: Column) -> Column:
    """The same test for two names already side by side."""
    return (F.arrays_overlap(N.all_keys(a), N.all_keys(b)) | N.initials_explain(N.tokens(a), N.tokens(b)))


# ------------------------------------------------------------------ candidate pool
SPLIT = 50_000  # names that share a token and an institution, from which on they are looked up in parts


def compatible_names(people: DataFrame, names: DataFrame, block: str) -> DataFrame:
    """(person, candidate) of the same block (institution) where any name of the candidate is compatible with the person's: a shared
    order-free key, or two shared full tokens with initials for the rest. `names`: candidate, name, block; several rows a candidate."""
    p = people.filter("name IS NOT NULL").select("person", block, "name")
    c = names.select("candidate", block, "name")
    spread = lambda df, id: _names(df, id, block).select(id, block, F.explode(N.all_keys(F.col("name"))).alias("k")).distinct()
    equal = spread(p, "person").join(spread(c, "candidate"), [block, "k"]).select("person", "candidate")
    return equal.union(explained_pairs(p, c, [block])).distinct()


def search_queries(people: DataFrame, block: str) -> DataFrame:
    """(person, block, query): the sorted tokens of each spelling of a name, and of its first and last word alone."""
    s = N.search_spellings(F.col("name"))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("name", ",", " "), r"\s+", " ")), " ")
    ends = F.when(F.size(words) >= 3, F.array(F.concat_ws(" ", F.get(words, F.lit(0)), F.element_at(words, -1)))).otherwise(F.array().cast("array<string>"))
    q = _names(people.filter("name IS NOT NULL"), "person", block).select("person", block, F.explode(F.array_distinct(F.concat(s, ends))).alias("spelling"))
    return q.select("person", block, F.array_sort(F.array_distinct(N.tokens(F.col("spelling")))).alias("query")).filter(F.size("query") > 0).distinct()


def name_search(people: DataFrame, names: DataFrame, block: str, split: int = SPLIT) -> DataFrame:
    """(person, candidate) of the same block where a name holds every token of some spelling of the person's.

    An index gives the names of each token and block, and how many they are. A query is looked up by its rarest token; one with a token that no
    name holds is not looked up at all. Names of a frequent token lie in parts of about `split`, and a query visits all of them."""
    index = _names(names, "candidate", block).select("candidate", block, F.array_distinct(N.tokens(F.col("name"))).alias("held")).distinct()
    index = index.select("candidate", block, "held", F.explode("held").alias("token"))
    counts = index.groupBy(block, "token").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / split).cast("int"))
    queries = search_queries(people, block)
    known = (queries.select("person", block, "query", F.explode("query").alias("token")).join(counts, [block, "token"])
             .groupBy("person", block, "query").agg(F.count("*").alias("found"), F.min(F.struct("n", "token", "parts")).alias("r"))
             .filter(F.col("found") == F.size("query")))
    ask = known.select("person", block, "query", F.col("r.token").alias("token"), F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part"))
    wanted = index.join(counts.drop("n"), [block, "token"]).withColumn("part", F.pmod(F.xxhash64("candidate"), F.col("parts")).cast("int"))
    hit = ask.join(wanted, [block, "token", "part"]).filter(F.size(F.array_except("query", "held")) == 0)
    return hit.select("person", "candidate").distinct()


def candidate_pool(people: DataFrame, roster: DataFrame, names: DataFrame, anchored: DataFrame, block: str) -> DataFrame:
    """(person, candidate, roster, searched, anchor_hits), one row per pair: the candidates of the institution's roster whose names are
    compatible, those of a name search for people whom the roster gives nobody, and the authors of a person's own publications.

    `people`: person, name, block, by_roster; `roster`, `names`: candidate, name, block; `anchored`: person, candidate, hits."""
    listed = compatible_names(people.filter("by_roster"), roster, block)
    rest = people.join(listed.select("person").distinct(), "person", "left_anti")
    tagged = lambda df, r, s: df.select("person", "candidate", F.lit(r).alias("roster"), F.lit(s).alias("searched"), F.lit(0).cast("long").alias("hits"))
    every = (tagged(listed, True, False).unionByName(tagged(name_search(rest, names, block), False, True))
             .unionByName(anchored.select("person", "candidate", F.lit(False).alias("roster"), F.lit(False).alias("searched"), F.col("hits").cast("long"))))
    return every.groupBy("person", "candidate").agg(F.max("roster").alias("roster"), F.max("searched").alias("searched"), F.sum("hits").alias("anchor_hits"))


def kept_candidates(cands: DataFrame, n: int = 8) -> DataFrame:
    """(person, rank, candidate): at most n candidates of a person, strong ones first, then by own publications, affiliation and size."""
    order = [F.col(c).desc() for c in ("strong", "anchor_hits", "affiliation_ok", "works")] + [F.col("candidate")]
    return top_k(cands, ["person"], order, n).select("person", "rank", "candidate")


# ------------------------------------------------------------------ evidence
def field_share(topics: Column, topic_fields: Column, domains: Column, top_n: int = 10) -> Column:
    """Share of a profile's first topics inside the allowed fields, or domains where no fields are given."""
    top = F.slice(topics, 1, top_n)
    n = lambda t: F.when(F.coalesce(t["count"], F.lit(0)) == 0, F.lit(1)).otherwise(t["count"]).cast("long")
    zero = F.lit(0).cast("long")
    inside = lambda t: F.when(topic_fields.isNotNull(), F.array_contains(topic_fields, t["field"])).otherwise(
        F.array_contains(domains, t["domain"]))
    total = F.aggregate(top, zero, lambda s, t: s + n(t))
    hit = F.aggregate(top, zero, lambda s, t: s + F.when(inside(t), n(t)).otherwise(zero))
    return F.round(F.coalesce(F.try_divide(hit, total), F.lit(0.0)), 3) + F.lit(0.0)


def affiliation_years(affiliations: Column, home: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.filter(affiliations, lambda a: a["inst"] == home), lambda a: a["years"]))))


def affiliation_recent(affiliations: Column, last_known: Column, home: Column, year_to: int, years: int) -> Column:
    newest = F.array_max(affiliation_years(affiliations, home))
    return F.coalesce(newest >= year_to - years, F.lit(False)) | F.array_contains(last_known, home)


def evidence(pairs: DataFrame, scope: DataFrame, year_to: int) -> DataFrame:
    """Per person and profile: affiliation, name, topic and id evidence. `scope` is one row per field.

    Alternative spellings count only for profiles confirmed by the person's own publication list."""
    display = names_compatible(F.col("person_name"), F.col("name"))
    alt = (F.col("anchor_hits") >= 1) & F.exists("alternatives", lambda n: names_compatible(F.col("person_name"), n))
    share = field_share(F.col("topics"), F.col("topic_fields"), F.col("domains"))
    recent = affiliation_recent(F.col("affiliations"), F.col("last_known"), F.col("univ"), year_to, PARAMS.affiliation_years)
    # A filter on plain columns would move below the repartition and judge every pair there, in as few tasks as the profiles have files, and the
    # pairs it lets through once more above. What a generator gives is judged once.
    judged = F.inline(F.array(F.struct(recent.alias("affiliation_ok"), (display | alt).alias("name_ok"), share.alias("field_share"))))
    return (pairs.repartition("person", "candidate").join(F.broadcast(scope), "field")  # names cost more than rows: over all tasks
            .select("*", judged)
            .withColumn("orcid_match", F.when(F.col("person_orcid").isNotNull() & F.col("orcid").isNotNull(),
                                              F.col("person_orcid") == F.col("orcid")))
            .withColumn("topic_ok", F.col("field_share") >= PARAMS.topic_share)
            .withColumn("strong", F.col("affiliation_ok") & F.col("name_ok") & (F.col("topic_ok") | (F.col("anchor_hits") >= 1)))
            .filter(F.col("name_ok") | (F.col("anchor_hits") > 0) | F.col("affiliation_ok"))
            .select("person", "candidate", "name", "univ", "field", "works", "orcid", "anchor_hits", "field_share",
                    "affiliation_ok", "name_ok", "topic_ok", "orcid_match", "strong"))


def name_verdict(english: Column, surname: Column, given: Column, anchors: Column, roster: Column) -> Column:
    """Name evidence of one candidate: an English match decides; else the romanised surname and given name, where what
    cannot be judged needs more anchors. `surname` and `given` are true, false or null (not judgeable)."""
    return (F.when(english.isNotNull(), english)
            .when(surname & given, (anchors >= 1) | roster)
            .when(surname & given.isNull(), anchors >= 2)
            .when(surname.isNull(), anchors >= 3).otherwise(F.lit(False)))


# ------------------------------------------------------------------ decision ladder
def _first_two(c: DataFrame, by: str, prefix: str, *cols: str) -> DataFrame:
    """Largest and second largest `by` per person, with columns of the first."""
    t = top_k(c, ["person"], [F.col(by).desc(), F.col("candidate")], 2)
    first = F.col("rank") == 1
    return t.groupBy("person").agg(
        F.max(F.when(first, F.col("candidate"))).alias(f"{prefix}_candidate"), F.max(F.when(first, F.col(by))).alias(f"{prefix}_1"),
        F.coalesce(F.max(F.when(~first, F.col(by))), F.lit(0)).alias(f"{prefix}_2"),
        *[F.max(F.when(first, F.col(x))).alias(f"{prefix}_{x}") for x in cols])


def decide(people: DataFrame, cands: DataFrame) -> DataFrame:
    """One row per person: the chosen profile, or the reason there is none. Everything is an aggregate or a top-2 per
    person, so a name with very many candidates is reduced before it is shuffled."""
    every = cands.groupBy("person").agg(
        F.count("*").alias("n"), F.max("affiliation_ok").alias("any_aff"),
        F.max(F.col("affiliation_ok") & F.col("name_ok")).alias("any_name"), F.count_if("orcid_match").alias("n_orcid"),
        F.max(F.when(F.col("orcid_match"), F.col("candidate"))).alias("c_orcid"),
        F.coalesce(F.max(F.col("orcid_match") & F.col("affiliation_ok")), F.lit(False)).alias("orcid_aff"))
    strong = cands.filter("strong")
    s = strong.groupBy("person").agg(F.count("*").alias("n_strong"), F.count_if(F.col("anchor_hits") > 0).alias("n_anch"),
                                     F.min("orcid").alias("omin"), F.max("orcid").alias("omax"))
    anch = _first_two(strong, "anchor_hits", "a")
    big = _first_two(strong, "works", "w", "orcid")
    d = (people.select("person", "has_anchors", F.col("name").isNotNull().alias("named"), F.col("orcid").isNotNull().alias("has_orcid"))
         .join(every, "person", "left").join(s, "person", "left").join(anch, "person", "left").join(big, "person", "left"))
    several = F.col("n_strong") > 1
    dominant = (F.col("n_anch") > 1) & (F.col("a_1") >= 3) & (F.col("a_1") >= 2 * F.col("a_2"))
    conflict = F.coalesce((F.col("omin") != F.col("w_orcid")) | (F.col("omax") != F.col("w_orcid")), F.lit(False))
    split = (F.col("w_2") <= PARAMS.split_ratio * F.greatest(F.col("w_1"), F.lit(1))) & ~conflict
    choice = (F.when(F.col("has_orcid") & (F.col("n_orcid") == 1) & F.col("orcid_aff"), F.col("c_orcid"))
              .when(F.col("n_strong") == 1, F.col("w_candidate"))
              .when(several & ((F.col("n_anch") == 1) | dominant), F.col("a_candidate"))
              .when(several & split, F.col("w_candidate")))
    reason = (F.when(F.col("candidate").isNotNull(), F.lit(None))
              .when(several, "ambiguous_multiple_candidates")
              .when(F.col("n").isNull(), F.when(~F.col("named") & ~F.col("has_anchors"), "no_english_name_no_anchor").otherwise("no_candidate"))
              .when(~F.col("any_aff"), "affiliation_mismatch").when(~F.col("any_name"), "name_mismatch").otherwise("topic_mismatch"))
    chosen = cands.select("person", "candidate", (F.coalesce("orcid_match", F.lit(False)) | (F.col("anchor_hits") >= 1)).alias("sure"))
    return (d.withColumn("candidate", choice).withColumn("reason", reason).join(chosen, ["person", "candidate"], "left")
            .select("person", "candidate", F.when(F.col("candidate").isNotNull(), "matched").otherwise("excluded").alias("status"),
                    "reason", F.when(F.col("candidate").isNotNull(), F.when(F.col("sure"), "high").otherwise("medium")).alias("confidence")))


def tiebreak(ambiguous: DataFrame, strong: DataFrame, leading: DataFrame, rules: DataFrame) -> DataFrame:
    """For people left with several strong profiles: one shared id -> the largest; else the profile that leads enough items
    and three times as many as any other. `leading`: candidate, n."""
    c = (strong.join(ambiguous.select("person"), "person", "left_semi").join(leading, "candidate", "left")
         .withColumn("n", F.coalesce("n", F.lit(0))))
    ids = c.groupBy("person").agg(F.countDistinct("orcid").alias("ids"), F.count_if(F.col("orcid").isNull()).alias("no_id"),
                                  F.first("field").alias("field"))
    big, lead = _first_two(c, "works", "w"), _first_two(c, "n", "n")
    one_id = (F.col("ids") == 1) & (F.col("no_id") == 0)
    leads = (F.col("n_1") >= F.col("min_items")) & (F.col("n_1") >= 3 * F.col("n_2"))
    return (ids.join(F.broadcast(rules.select("field", "min_items")), "field").join(big, "person").join(lead, "person")
            .select("person", F.when(one_id, F.col("w_candidate")).when(leads, F.col("n_candidate")).alias("candidate"),
                    F.when(one_id, "one id").when(leads, "leads items").otherwise("ambiguous").alias("why")))


# ------------------------------------------------------------------ score and routing
def candidate_score(name_ok: Column, works: Column, home: Column, colleagues: Column, share: Column, anchors: Column) -> Column:
    """-1 without a name match or items; else colleagues (up to 5), field share, home share damped for small profiles, anchor."""
    home_part = F.try_divide(home, works) * F.least(works, F.lit(10)) / 10
    full = F.least(colleagues, F.lit(5)) / 5 + share + home_part + F.when(anchors > 0, 1.0).otherwise(0.0)
    return F.when(~name_ok | (works == 0), F.lit(-1.0)).otherwise(full)


def score_decide(scored: DataFrame) -> DataFrame:
    """Best candidate per person, margin to the second (floored at zero) and whether the rule is certain of it."""
    t = top_k(scored, ["person"], [F.col("score").desc(), F.col("candidate")], 2)
    first = F.col("rank") == 1
    cols = ("candidate", "score", "works_window", "home_items", "colleague_items", "anchor_hits")
    d = t.groupBy("person").agg(*[F.max(F.when(first, F.col(c))).alias(c) for c in cols],
                                F.coalesce(F.max(F.when(~first, F.col("score"))), F.lit(0.0)).alias("second"))
    usable = F.col("score") > 0
    weak = (F.col("home_items") < 0.3 * F.col("works_window")) & (F.col("colleague_items") == 0) & (F.col("anchor_hits") == 0)
    margin = F.round(F.col("score") - F.greatest("second", F.lit(0.0)), 3) + F.lit(0.0)
    return d.select("person", F.when(usable, F.col("candidate")).alias("choice"), F.when(usable, margin).otherwise(0.0).alias("margin"),
                    (usable & ~weak & ((margin >= PARAMS.certain_margin) | (F.col("anchor_hits") > 0))).alias("certain"))


def route(decided: DataFrame, answers: DataFrame, current: DataFrame, old: DataFrame) -> DataFrame:
    """Where each decision goes. Certain rule decisions and answers of high or medium confidence are accepted, low ones go
    to review; an accepted decision equal to the present match is dropped unless an earlier decision says the same.

    `answers`: person, answer, answer_confidence; `current`: person, current; `old`: person, old_choice, old_excluded."""
    j = decided.join(answers, "person", "left").join(current, "person", "left").join(old, "person", "left")
    final = F.when(F.col("certain"), F.col("choice")).otherwise(F.col("answer"))
    conf = F.when(F.col("certain"), "certain").otherwise(F.col("answer_confidence"))
    j = j.withColumn("final", final).withColumn("confidence", conf)
    keep = (~F.col("final").eqNullSafe(F.col("current")) | (F.col("final").isNotNull() & F.col("old_choice").eqNullSafe(F.col("final")))
            | (F.col("final").isNull() & F.coalesce("old_excluded", F.lit(False))))
    action = (F.when(F.col("confidence") == "low", "review").when(keep & F.col("final").isNotNull(), "force")
              .when(keep, "exclude").otherwise("unchanged"))
    return j.select("person", F.col("final").alias("choice"), "confidence", action.alias("action"))


# ------------------------------------------------------------------ overrides
def layer_overrides(hand: DataFrame, auto: DataFrame, key: str = "person") -> DataFrame:
    """Hand decisions over automatic ones, per key."""
    return hand.withColumn("layer", F.lit("hand")).unionByName(
        auto.join(hand.select(key), key, "left_anti").withColumn("layer", F.lit("auto")))


def apply_overrides(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """exclude clears a match, force replaces its profile. `overrides`: person, action, forced."""
    j = matches.join(overrides.select("person", "action", "forced"), "person", "left")
    ex, fo = F.col("action") == "exclude", F.col("action") == "force"
    return j.select(
        "person", F.when(ex, F.lit(None)).when(fo, F.col("forced")).otherwise(F.col("candidate")).alias("candidate"),
        F.when(ex, "excluded").when(fo, "matched").otherwise(F.col("status")).alias("status"),
        F.when(ex, "manual_review").when(fo, F.lit(None)).otherwise(F.col("reason")).alias("reason"),
        F.when(ex, F.lit(None)).when(fo, "medium").otherwise(F.col("confidence")).alias("confidence"))


def missing_candidates(cands: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidate rows to add for forced profiles that were not among the person's candidates."""
    forced = overrides.filter("action = 'force'").select("person", F.col("forced").alias("candidate"))
    return forced.join(cands, ["person", "candidate"], "left_anti")


def stale_overrides(overrides: DataFrame, people: DataFrame) -> DataFrame:
    return overrides.join(people.select("person"), "person", "left_anti")


# ------------------------------------------------------------------ profiles chosen by several people
def conflict_groups(matched: DataFrame) -> DataFrame:
    """People whose match chose the same profile: entity leader, merged member, or excluded.

    `matched`: person, candidate, univ, dept, name, email (null or empty = none). The same person listed twice has the same
    e-mail, or - where one side has none - a shared name key. A profile chosen at two universities, or by two people of whom
    not exactly one has an English name, goes to nobody. Groups are formed by aggregates on (profile, e-mail) and (profile,
    name key), never by comparing all choosers of a profile with each other."""
    m = matched.withColumn("ord", F.struct("dept", "person"))
    by_mail = m.filter(F.col("email").isNotNull()).groupBy("candidate", "email").agg(F.min("ord").alias("lead_mail"))
    keyed = m.select("person", "candidate", "email", "ord", F.explode_outer(N.all_keys(F.col("name"))).alias("key"))
    by_key = keyed.filter(F.col("key").isNotNull()).groupBy("candidate", "key").agg(
        F.min("ord").alias("lead_any"), F.min(F.when(F.col("email").isNull(), F.col("ord"))).alias("lead_bare"))
    lead_key = (keyed.join(by_key, ["candidate", "key"])
                .groupBy("person", "candidate").agg(F.min(F.when(F.col("email").isNull(), F.col("lead_any"))
                                                          .otherwise(F.col("lead_bare"))).alias("lead_key")))
    g = (m.join(by_mail, ["candidate", "email"], "left").join(lead_key, ["person", "candidate"], "left")
         .withColumn("lead", F.least("ord", "lead_mail", "lead_key")))
    per = g.groupBy("candidate").agg(
        F.countDistinct("univ").alias("n_univ"), F.countDistinct("lead").alias("n_people"),
        F.countDistinct(F.when(F.col("name").isNotNull(), F.col("lead"))).alias("n_english"),
        F.max(F.when(F.col("name").isNotNull(), F.col("lead"))).alias("english"))
    role = F.when(F.col("lead") == F.col("ord"), "entity").otherwise("merged")
    verdict = (F.when(F.col("n_univ") > 1, "excluded").when(F.col("n_people") == 1, role)
               .when((F.col("n_english") == 1) & (F.col("lead") == F.col("english")), role).otherwise("excluded"))
    return g.join(per, "candidate").select("person", "candidate", F.col("lead.person").alias("leader"), verdict.alias("verdict"))
