"""Personal names as column expressions: tokens, order-free keys, spellings, romanised given names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinor.functions.binding import let
from affinor.functions.text import strip_accents

INITIAL = r"\s+[A-Za-z]\.(?=\s)"
# fixed values: words in brackets that are roles, not part of a name
ROLE_NOISE = r"(?i)\([^)]*?(?:chair|head|학과장|전공책임|책임교수|department|major)[^)]*?\)|학과장|전공책임교수"


def tokens(name: Column) -> Column:
    """Lower-case letter runs; hyphenated given names become one token."""
    s = F.regexp_replace(F.lower(strip_accents(name)), "(?<=[a-z])-(?=[a-z])", "")
    return F.filter(F.split(F.trim(F.regexp_replace(s, r"[^a-z]+", " ")), " "), lambda t: t != "")


def full_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: F.length(t) > 1)


def initials(toks: Column) -> Column:
    return F.filter(toks, lambda t: F.length(t) == 1)


def drop_middle_initials(name: Column) -> Column:
    return F.regexp_replace(name, INITIAL, "")


def keys(toks: Column) -> Column:
    """Order-free keys: all tokens sorted, and each token beside the concatenation of the others."""
    return let(toks, _keys)


def _keys(toks: Column) -> Column:
    n = F.size(toks)
    merged = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.array_sort(F.array(
        F.get(toks, i - 1),
        F.array_join(F.concat(F.slice(toks, F.lit(1), i - 1), F.slice(toks, i + 1, n)), ""))), " "))
    whole = F.array(F.array_join(F.array_sort(toks), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, whole).otherwise(
        F.array_distinct(F.concat(whole, merged)))


def all_keys(name: Column) -> Column:
    """Keys of the name with and without its middle initials."""
    return F.array_distinct(F.concat(keys(tokens(name)), keys(tokens(drop_middle_initials(name)))))


def token_pairs(full: Column) -> Column:
    """Unordered pairs of a name's distinct full tokens (a name has a handful of tokens)."""
    return let(F.array_sort(F.array_distinct(full)), lambda d: F.flatten(F.transform(d, lambda a: F.transform(
        F.filter(d, lambda b: b > a), lambda b: F.concat_ws(" ", a, b)))))


def initials_explain(ta: Column, tb: Column) -> Column:
    """Two or more common full tokens, and every other full token explained by an initial on the other side."""
    return let(ta, lambda a: let(tb, lambda b: _initials_explain(a, b)))


def _initials_explain(ta: Column, tb: Column) -> Column:
    fa, fb = full_tokens(ta), full_tokens(tb)
    common = F.array_intersect(fa, fb)
    def explained(rest: Column, other: Column) -> Column:
        return F.forall(rest, lambda t: F.exists(other, lambda i: F.substring(t, 1, 1) == i))
    return ((F.size(common) >= 2) & explained(F.array_except(fa, common), initials(tb))
            & explained(F.array_except(fb, common), initials(ta)))


def clean_display_name(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(name, ROLE_NOISE, ""), r"\s+", " ")
    return F.nullif(F.trim(s, F.lit(" ,/")), F.lit(""))


def search_spellings(name: Column) -> Column:
    """Up to three query spellings: cleaned, without middle initials, without hyphens, surname-first flipped."""
    base = F.regexp_replace(F.coalesce(clean_display_name(name), F.lit("")), ",", " ")
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    short = drop_middle_initials(base)
    toks = F.filter(F.split(base, r"\s+"), lambda t: t != "")
    head = F.get(toks, F.lit(0))
    flip = F.when((F.size(toks) >= 2) & (F.length(head) > 1) & (head == F.upper(head)) & (head != F.lower(head)),
                  F.array_join(F.concat(F.slice(toks, F.lit(2), F.size(toks)), F.array(head)), " "))
    every = F.array(tidy(base), tidy(short), tidy(F.regexp_replace(short, "-", " ")), flip)
    return F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))), 1, 3)


def flip_comma(name: Column) -> Column:
    """'Last, First' -> 'First Last'; other names unchanged."""
    s = F.trim(F.regexp_replace(name, r"\s+", " "), F.lit(" ,"))
    flipped = F.trim(F.concat_ws(" ", F.trim(F.regexp_extract(s, r"^([^,]*),(.*)$", 2)), F.trim(F.regexp_extract(s, r"^([^,]*),(.*)$", 1))))
    return F.nullif(F.when(s.contains(","), flipped).otherwise(s), F.lit(""))


def first_matching(c: Column, patterns: list[tuple[str, str | None]]) -> Column:
    """Value of the first pattern that matches, null when none does or the value is null."""
    out = None
    for p, v in patterns:
        out = F.when(c.rlike(p), F.lit(v).cast("string")) if out is None else out.when(c.rlike(p), F.lit(v).cast("string"))
    return out


# fixed values: positions in the order they are tested
POSITIONS = [
    (r"(?i)assistant\s+prof|조교수", "조교수"),
    (r"(?i)associate\s+prof|부교수", "부교수"),
    (r"(?i)emerit|명예", None),
    (r"(?i)adjunct|겸임|겸무|겸직|visiting|초빙|research\s+prof|연구교수|강의교수|lecture", None),
    (r"(?i)\bprof|교수", "교수"),
]


def normalize_position(c: Column) -> Column:
    return first_matching(c, POSITIONS)


def split_scripts(name: Column, other: Column | None = None) -> tuple[Column, Column]:
    """(Hangul part, other part) of one or two strings in either order, role text in brackets removed."""
    bare = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s*\(.*?\)\s*", "")), F.lit(""))
    a = bare(name)
    b = bare(other) if other is not None else F.lit(None).cast("string")
    hangul = lambda c: c.rlike("[가-힣]")
    ko = F.coalesce(F.when(hangul(a), a), F.when(hangul(b), b))
    en = F.coalesce(F.when(~hangul(a), a), F.when(~hangul(b), b))
    return ko, flip_comma(en)
