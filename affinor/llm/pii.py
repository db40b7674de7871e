"""Personal data replaced by surrogates, in DataFrame operations only.

Entities are found by pattern: e-mail and network addresses, telephone, card, account and social security numbers, long hexadecimal
secrets, and names that begin with a known given name. A name runs over further given names, initials, particles and up to NAME_WORDS
other capitalised words, all with hyphens and apostrophes; each of these other words is a surname. Each is brought to a canonical form, so spellings of one entity meet, and its
surrogate is drawn from a keyed hash of type and canonical form: the same entity gets the same surrogate everywhere, and without
the key nothing leads back. A surrogate has the type, length, separators and letter case of what it replaces: digits for digits,
vowels and consonants of the same script for theirs, a valid check digit for a valid one, a given name of the same gender and
script, a surname with the same gendered ending. Given names and initials are exchanged by a keyed rotation of their list. Once a name is
found in a document, its surnames alone are replaced there too.

Collision check: over all distinct entities, surrogates that two entities share, or that equal an entity of the corpus, are drawn
again, until none is left. Only drawn-again entities are looked up when texts are rewritten; texts without entities are never
shuffled.

Defined cases: a null text stays null; an empty one stays empty; rows without an id and repeated rows are rewritten one by one; an empty
table gives an empty result; further columns are ignored. The result holds no entity that these patterns find.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinor.llm.common import few_or_shuffled
from affinor.session import cut_lineage

# Given names by script and gender, and endings of surnames that tell a gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Emma Julia Sofia Clara Elena Nina Helena Marta Ingrid Claire Alice Lucia Carmen".split(),
    ("latin", "m"): "Peter Paul Thomas Martin David Lucas Simon Daniel Victor Felix Anton Oscar Marco Pierre Carlos Erik".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Светлана Татьяна".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας".split(),
}
ENDINGS = "(?:ova|eva|ov|ev|ska|ski|ина|ова|ева|ская|ов|ев|ин|ский|ου|ης|ος)$"
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
           "áàâäãåāąæéèêëēěęíìîïīóòôöõøōőœúùûüūůűý", "çćčďđğłľñńňřŕśšşťţžźżß", "ёйъь", "άέήίόύώϊϋ", "ς")
HEX = "abcdef"

PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "TOKEN": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "CARD": r"(?<![0-9])(?:[0-9]{4}(?<sep>[ -]?)[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|3[47][0-9]{2}(?<gap>[ -]?)[0-9]{6}\k<gap>[0-9]{5})(?![0-9])",
    "SSN": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "PHONE": r"(?<![0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "IP": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
}
NAME_WORDS = 2
PARTICLES = "(?:von|vom|van|de|del|della|di|da|dos|do|du|des|la|le|ter|ten|bin|ibn|al|el)(?:[ \u00a0](?:und|zu|der|den|dem|de|la|las|los|het))*+"
# Java repeats a group by recursion unless it may not give anything back, so every repeat here is possessive or bounded
CAPITALISED = r"(?:(?:al|el)-|[dl]['’])?\p{Lu}[\p{L}\p{M}]++(?:[-‑'’]\p{Lu}[\p{L}\p{M}]++)*+|\p{Lu}(?:[-‑'’]\p{Lu}[\p{L}\p{M}]++)++"
INITIALS = r"\p{Lu}\.(?:[ \u00a0-]?\p{Lu}\.)*+|\p{Lu}(?=[ \u00a0]\p{Lu}\p{L})"
WORD = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"


def entity(given: dict[tuple[str, str], list[str]] = GIVEN) -> str:
    """The pattern of every kind of entity, with these given names."""
    known = "(?:" + "|".join(re.escape(n) for n in sorted({n for v in given.values() for n in v}, key=lambda n: (-len(n), n))) + r")(?![\p{L}\p{M}])"
    gap, more = "[ \u00a0]", r"(?:[-‑]\p{Lu}[\p{L}\p{M}]++)*+"
    name = rf"(?<!\p{{L}}){known}{more}(?:{gap}(?:{known}{more}|{INITIALS})(?!\p{{L}}))*+(?:{gap}(?:{PARTICLES}{gap})?(?:{CAPITALISED})){{0,{NAME_WORDS}}}(?!\p{{L}})"
    return "|".join([*PATTERNS.values(), name])


def kind_of(e: Column) -> Column:
    """The pattern that found an entity, told by its shape."""
    return (F.when(F.contains(e, F.lit("@")), "EMAIL").when(F.rlike(e, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), "IP").when(F.rlike(e, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "SSN")
            .when(F.rlike(e, F.lit(r"^[0-9a-fA-F]{32,}$")), "TOKEN").when(F.rlike(e, F.lit(r"^[A-Z]{2}[0-9]{2}")), "IBAN")
            .when(F.startswith(e, F.lit("+1")) & (F.length(F.regexp_replace(e, "[^0-9]", "")) == 11), "PHONE").when(F.startswith(e, F.lit("+")), "PHONE_INTL")
            .when(F.rlike(e, F.lit(r"^(?:\(|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$)")), "PHONE").when(F.rlike(e, F.lit("^[0-9]")), "CARD").otherwise("NAME"))


def canonical(e: Column, kind: Column) -> Column:
    """One form for all spellings: digits or letters alone, lower case, a national telephone number without its country."""
    bare = F.lower(F.regexp_replace(e, "[^0-9A-Za-z]", ""))
    return F.when(kind.isin("EMAIL"), F.lower(e)).when(kind == "IP", e).when(kind == "PHONE", F.right(bare, F.lit(10))).otherwise(bare)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 512)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a stream, from 0, round and round."""
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _swap(c: Column, r: Column, kind: Column) -> Column:
    """Another character of c's class and case; what is of no class stays."""
    low = F.lower(c)
    pick = lambda s: F.substring(F.lit(s), F.pmod(r, F.lit(len(s))) + 1, F.lit(1))
    out = F.when((kind == "TOKEN") & F.contains(F.lit(HEX), low), pick(HEX))
    for s in CLASSES:
        out = out.when(F.contains(F.lit(s), low), pick(s))
    out = F.coalesce(out, F.when((kind == "SURNAME") & F.rlike(low, F.lit(r"\p{L}")), pick(CLASSES[2])), low)  # a surname of any script
    return F.when(c != low, F.upper(out)).otherwise(out)


def luhn_sum(digits: Column) -> Column:
    """The sum of the check digit rule over digits that a check digit will follow."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.pmod(c.try_cast("int") * 2, F.lit(10)) + F.floor(c.try_cast("int") / 5).cast("int")).otherwise(c.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, of the same length."""
    s = _stream(key, kind, canon, attempt)
    chars = F.split(canon, "")
    n = F.length(canon)
    tld = n - F.length(F.substring_index(canon, ".", -1))  # the top-level domain of an address stays
    ending = F.length(F.regexp_extract(canon, ENDINGS, 0))
    stem = F.when(n - ending < 2, n).otherwise(n - ending)  # a name that is hardly more than an ending needs other letters too
    # a first digit keeps being zero or not; a card keeps its network, an account its country, a foreign number its country code
    keep = F.when(kind == "CARD", 1).when(kind.isin("IBAN", "PHONE_INTL"), 2).otherwise(0)
    until = F.when(kind == "EMAIL", tld).when(kind == "SURNAME", stem).otherwise(n)
    # NANP numbers have area codes and exchanges from 2 to 9
    swapped = F.transform(chars, lambda c, i: F.when((i < keep) | (i >= until), c).when((kind == "PHONE") & i.isin(0, 3), (2 + F.pmod(_byte(s, i), F.lit(8))).cast("string"))
                          .when((i == 0) & F.rlike(c, F.lit("[1-9]")), (1 + F.pmod(_byte(s, i), F.lit(9))).cast("string")).otherwise(_swap(c, _byte(s, i), kind)))
    plain = F.array_join(swapped, "")
    body = F.left(plain, n - 1)
    check = lambda d: F.pmod(10 - luhn_sum(d), F.lit(10))
    valid = check(F.left(canon, n - 1)) == F.right(canon, F.lit(1)).try_cast("int")
    card = F.concat(body, F.pmod(check(body) + F.when(valid, 0).otherwise(1 + F.pmod(_byte(s, n), F.lit(9))), F.lit(10)).cast("string"))
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda c, i: (1 + F.pmod(_byte(s, i), F.lit(254))).cast("string")), ".")
    return F.when(kind == "CARD", card).when(kind == "IP", octets).otherwise(plain)


def dressed(e: Column, kind: Column, s: Column) -> Column:
    """A surrogate in the spelling of the mention it replaces: its separators, its case, its country code."""
    sign = "[^0-9A-Za-z]"
    spare = F.length(F.regexp_replace(e, sign, "")) - F.length(s)
    at = lambda i: F.when(kind == "EMAIL", i + 1).otherwise(F.length(F.regexp_replace(F.left(e, i + 1), sign, "")) - spare)
    chars = F.transform(F.split(e, ""), lambda c, i: F.when((kind != "EMAIL") & F.rlike(c, F.lit(sign)), c).when(at(i) < 1, c)
                        .otherwise(F.when(c != F.lower(c), F.upper(F.substring(s, at(i), F.lit(1)))).otherwise(F.substring(s, at(i), F.lit(1)))))
    return F.when(kind == "IP", s).otherwise(F.array_join(chars, ""))


def _rotated(key: str, kind: str, lists: Iterable[Iterable[str]]) -> dict[str, str]:
    """Each list rotated by one in an order that the key decides."""
    out = {}
    for names in lists:
        order = sorted(names, key=lambda n: hashlib.sha512(f"{key}\0{kind}\0{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def given_names(key: str, given: dict[tuple[str, str], list[str]] = GIVEN) -> dict[str, str]:
    """No name stays, no two become one."""
    return _rotated(key, "GIVEN", given.values())


def initials(key: str) -> dict[str, str]:
    """Capital letters, by class."""
    return _rotated(key, "INITIAL", [[c.upper() for c in s if len(c.upper()) == 1] for s in CLASSES[1:] if len(s) > 1])


def given_lists(names: DataFrame) -> dict[tuple[str, str], list[str]]:
    """GIVEN from a table of name, script and gender. A name in several lists counts in the first; a list of a single name, which could
    only be exchanged for itself, takes part in the next list of its script, or else in the largest of all."""
    out, seen = {}, set()
    # a lexicon; it has to fit the driver and a pattern
    for r in names.select("script", "gender", "name").filter("name <> ''").distinct().orderBy("script", "gender", "name").collect():
        if r.name not in seen:
            seen.add(r.name)
            out.setdefault((r.script, r.gender), []).append(r.name)
    for k in [k for k, v in out.items() if len(v) == 1]:
        others = [o for o in out if o != k and out[o]]
        if len(out[k]) == 1 and others:
            out[min(others, key=lambda o: (o[0] != k[0], -len(out[o]), str(o)))] += out.pop(k)
    if len(seen) == 1:
        raise ValueError("a single given name has no other to be exchanged for")
    return out


def draw(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate collided. In every round the smallest of the entities that share a
    surrogate keeps it, the others draw again; a surrogate that is itself an entity is given up by all."""
    surr = surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    state = cut_lineage(entities.withColumn("attempt", F.lit(0)).withColumn("s", surr))
    real = entities.select("kind", F.col("canon").alias("s"))
    while True:
        first = state.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min("canon").alias("first")).filter("n > 1")
        lost = (state.join(first, ["kind", "s"]).filter(F.col("canon") != F.col("first")).select("kind", "canon")
                .unionByName(state.join(real, ["kind", "s"], "left_semi").select("kind", "canon")).distinct())
        lost = cut_lineage(lost)
        if lost.isEmpty():
            return state.filter("attempt > 0").select("kind", "canon", "attempt")
        again = state.join(lost, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1).withColumn("s", surr)
        state = cut_lineage(state.join(lost, ["kind", "canon"], "left_anti").unionByName(again))


def replace_personal_data(docs: DataFrame, key: str, given: DataFrame | None = None) -> DataFrame:
    """doc_id, text, n_entities and the number of entities by kind, for every document. `given`: name, script, gender of the given names
    that begin a name, instead of the fixed ones."""
    lists = GIVEN if given is None else given_lists(given) or GIVEN
    pattern = entity(lists)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    has = F.coalesce(F.rlike("text", F.lit(pattern)), F.lit(False))
    found = cut_lineage(source.filter(has).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("ents")))
    mentions = found.select("row", F.posexplode("ents").alias("pos", "e")).withColumn("shown", kind_of(F.col("e")))
    # a name falls into its words and what stands between them; everything else is one part
    parts = F.when(F.col("shown") == "NAME", F.regexp_extract_all("e", F.lit(WORD), F.lit(0))).otherwise(F.array("e"))
    mentions = mentions.select("row", "pos", "shown", F.posexplode(parts).alias("at", "e"))
    name = F.col("shown") == "NAME"
    exchanged = F.create_map(*[F.lit(x) for kv in (initials(key) | given_names(key, lists)).items() for x in kv])[F.col("e")]
    surname = name & exchanged.isNull() & F.rlike("e", F.lit(r"^\p{Lu}[\p{L}\p{M}]"))
    mentions = mentions.select("row", "pos", "at", "e", "shown", F.when(name, exchanged).alias("exchanged"), F.when(name, "SURNAME").otherwise(F.col("shown")).alias("kind"),
                               F.when(surname, F.lower("e")).when(name, "").otherwise(canonical(F.col("e"), F.col("shown"))).alias("canon"))
    redrawn = few_or_shuffled(draw(cut_lineage(mentions.filter("canon <> ''").select("kind", "canon").distinct()), key))
    drawn = mentions.join(redrawn, ["kind", "canon"], "left").withColumn("s", F.when(F.col("canon") != "", surrogate(key, F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0)))))
    cased = F.array_join(F.transform(F.split("e", ""), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring("s", i + 1, F.lit(1)))).otherwise(F.substring("s", i + 1, F.lit(1)))), "")
    drawn = drawn.withColumn("out", F.when(F.col("kind") != "SURNAME", dressed(F.col("e"), F.col("kind"), F.col("s"))).when(F.col("canon") != "", cased).otherwise(F.coalesce("exchanged", "e")))
    # dealt by row once, for mentions and rows alike
    per_mention = drawn.repartition("row").groupBy("row", "pos").agg(
        F.array_sort(F.collect_list(F.struct("at", "out"))).alias("outs"), F.first("shown").alias("shown"),
        F.collect_set(F.when((F.col("kind") == "SURNAME") & (F.col("canon") != ""), F.struct(F.col("e").alias("surname"), F.col("out").alias("to")))).alias("surnames"))
    per_mention = per_mention.withColumn("out", F.array_join(F.transform("outs", lambda o: o["out"]), ""))
    per_row = per_mention.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("outs"), F.array_sort(F.collect_list("shown")).alias("kinds"),
                                             F.array_distinct(F.flatten(F.collect_list("surnames"))).alias("surnames"))
    gaps = F.split("text", pattern, -1)
    named = F.map_from_entries("surnames")
    gaps = F.when(F.size("surnames") > 0, F.transform(gaps, lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(WORD), F.lit(0)), lambda w: F.coalesce(named[w], w)), ""))).otherwise(gaps)
    rebuilt = F.array_join(F.zip_with(gaps, F.array_append(F.transform("outs", lambda o: o["out"]), F.lit("")), lambda g, o: F.concat(g, o)), "")
    counts = F.transform(F.array_distinct("kinds"), lambda k: F.struct(k.alias("kind"), F.size(F.filter("kinds", lambda x: x == k)).alias("n")))
    done = found.join(per_row, "row").select("doc_id", rebuilt.alias("text"), F.size("outs").alias("n_entities"), counts.alias("kinds"))
    return done.unionByName(source.filter(~has).select("doc_id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<struct<kind:string,n:int>>").alias("kinds")))
