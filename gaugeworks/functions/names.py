"""Names as linkage keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that names spell both ways.
SHORT = {"dept": "department", "twp": "township", "co": "county", "univ": "university", "hosp": "hospital", "assn": "association", "dist": "district", "st": "saint", "ft": "fort", "mt": "mount", "ctr": "center", "auth": "authority"}
STOP = ["the", "of", "and", "for", "in", "a", "an"]
# Fixed values of applicant names: abbreviations, kinds of places, words that mark a record as retired.
APPLICANT_SHORT = {
    "dept": "department", "depts": "departments", "hwy": "highway", "twp": "township", "assn": "association", "assoc": "association", "coop": "cooperative", "co op": "cooperative",
    "comm": "commission", "dist": "district", "util": "utility", "svc": "service", "svcs": "services",
}
PLACES = ["city", "county", "township", "town", "village", "borough"]
RETIRED = ["duplicate", "obsolete", "delete"]
_MARK = r"(?i)\(?\s*do\s*not\s*use\s*\)?(?:\s*-\s*)?|\b(?:" + "|".join(RETIRED) + r")\b"


def county_key(name: Column) -> Column:
    """Lower case without ``county``, dots, quotes, blanks and hyphens."""
    return F.translate(F.regexp_replace(F.lower(name), r"\(county\)|county", ""), ".' -", "")


def words(text: Column) -> Column:
    """Runs of a-z of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))


def normalized(name: Column, short: dict[str, str] = SHORT) -> Column:
    """Lower-cased words with abbreviations spelled out, immediate repeats and a repeated ending of 3, 2 or 1 words removed."""
    table = F.create_map(*(F.lit(v) for p in short.items() for v in p))
    spelled = F.transform(words(name), lambda w: F.coalesce(F.element_at(table, w), w))
    once = F.filter(spelled, lambda w, i: (i == 0) | (w != F.coalesce(F.get(spelled, i - 1), F.lit(""))))
    return F.array_join(without_repeated_ending(once), " ")


def _with(value: Column, to: Callable[[Column], Column]) -> Column:
    """``to(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), to), F.lit(0))


def without_repeated_ending(tokens: Column, longest: int = 3) -> Column:
    """Tokens without a last run of ``longest`` tokens, then of fewer, that repeats the run just before it."""

    def shorter(k: int) -> Callable[[Column], Column]:
        def of(t: Column) -> Column:
            n = F.size(t)
            start = F.greatest(n - 2 * k + 1, F.lit(1))
            twice = (n >= 2 * k) & (F.slice(t, start, k) == F.slice(t, F.greatest(n - k + 1, F.lit(1)), k))
            return F.when(twice, F.slice(t, F.lit(1), F.greatest(n - k, F.lit(0)))).otherwise(t)

        return of

    for k in range(longest, 0, -1):
        tokens = _with(tokens, shorter(k))
    return tokens


def retired(name: Column) -> Column:
    """Whether a name is marked as not to be used any more."""
    return name.rlike(_MARK)


def applicant_key(name: Column) -> Column:
    """A name as a key: marks, a final number in brackets and punctuation gone, abbreviations spelled out, a repeated ending once, places as ``kind of name``.

    A kind of place moves to the front wherever it ends the name, with or
    without ``of``; ``kind of name`` stays.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, _MARK, " ")), r"\([0-9]+\)\s*$", " "), r"[.,/()'\"&]", " ")
    text = F.concat(F.lit(" "), F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), " "), F.lit(" "))
    for short, whole in APPLICANT_SHORT.items():
        text = F.regexp_replace(text, rf"(?<![a-z0-9_]){short}(?![a-z0-9_])", whole)

    def placed(tokens: Column) -> Column:
        n = F.size(tokens)
        last, before = F.get(tokens, n - 1), F.get(tokens, n - 2)
        places = F.array(*map(F.lit, PLACES))
        tail = F.when(F.array_contains(places, last), 1).when((last == "of") & F.array_contains(places, before), 2).otherwise(0)
        kind = F.when(tail == 1, last).otherwise(before)
        moved = F.concat(F.array(kind, F.lit("of")), F.slice(tokens, F.lit(1), F.greatest(n - tail, F.lit(0))))
        return F.when((tail > 0) & (n > tail), moved).otherwise(tokens)

    return F.array_join(_with(without_repeated_ending(F.filter(F.split(text, " "), lambda w: w != "")), placed), " ")


def resolved_entity(raw: Column, footnotes: Column, states: Column, tribes: Column) -> Column:
    """(kind, code, name, state, region) of an entity as a list prints it: a state's code, or a nation named by a footnote.

    A final number is a footnote's.  Two letters that ``states`` (code to
    region) knows are a state; anything else is ``tribal``, named by
    ``footnotes`` (number to name) and placed in the state of the first key of
    ``tribes`` (part of a name to state) that the name holds, in the map's
    order, or else in the first state, in order of codes, that the name ends with.
    """
    text = F.trim(raw)
    code = F.trim(F.regexp_replace(text, "[0-9]+$", ""))
    number = F.nullif(F.regexp_extract(text, "([0-9]+)$", 1), F.lit(""))
    region = F.when(F.length(code) == 2, F.try_element_at(states, F.upper(code)))
    name = F.when(number.isNotNull(), F.try_element_at(footnotes, number))
    low = F.lower(name)
    by_tribe = F.try_element_at(tribes, F.get(F.filter(F.map_keys(tribes), lambda k: F.contains(low, k)), F.lit(0)))
    tribe_region = F.try_element_at(states, by_tribe)
    by_end = F.get(F.filter(F.array_sort(F.map_keys(states)), lambda k: F.endswith(low, F.lower(k))), F.lit(0))
    state = F.when(tribe_region.isNotNull(), by_tribe).otherwise(F.coalesce(by_end, by_tribe))
    tribal = F.struct(F.lit("tribal").alias("kind"), code.alias("code"), name.alias("name"), state.alias("state"), F.coalesce(tribe_region, F.try_element_at(states, by_end)).alias("region"))
    own = F.struct(F.lit("state").alias("kind"), F.upper(code).alias("code"), F.lit(None).cast("string").alias("name"), F.upper(code).alias("state"), region.alias("region"))
    return F.when(region.isNotNull(), own).otherwise(tribal)


def stems(text: Column) -> Column:
    """Distinct words without stop words, a final s dropped from words of more than three letters."""
    kept = F.array_except(words(text), F.array(*map(F.lit, STOP)))
    return F.array_distinct(F.transform(kept, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
