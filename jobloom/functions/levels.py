"""Experience levels, years of experience, categories and places of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import WS, has_keyword, normalize_text, once

# The keywords of the levels, and the least years of a senior.
INTERN_KEYWORDS = [
    "gyakornok", "intern", "internship", "trainee", "palyakezdo", "diakmunka", "tehetsegprogram", "talent", "student", "students",
    "early career",
]
JUNIOR_KEYWORDS = ["junior", "graduate"]
MID_KEYWORDS = ["medior", "mid-level", "mid level"]
SENIOR_YEARS = 5
# Places of work that name no town, and hints that keep a posting.
WORK_MODES = [
    "hibrid", "hybrid", "tavmunka", "remote", "home office", "homeoffice", "orszagos", "orszagosan", "magyarorszag", "hungary",
    "opcionalis iroda", "opcionalis", "iroda",
]
PLACE_HINTS = [
    "budapest", "bp.", "bp,", "remote", "tavmunka", "home office", "homeoffice", "orszagos", "magyarorszag", "hungary", "barhol",
]
# Categories from strong to weak, and what the rules below name.
CATEGORY_RANK = [
    "DevOps", "Security", "Data / AI", "Elemző / Analyst", "QA / Tesztelő", "Mobil", "Menedzser / PM", "UX/UI Design", "Webfejlesztés",
    "Hardware", "Mérnöki / Gyártás", "Hálózat / Infra", "Fejlesztő",
]
OTHER = "Egyéb"

_YEAR = "(?:év|éves|eves|years?|yrs?)"
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# The six kinds of phrases, in order. A phrase ends where an ASCII word character is followed by none.
_YEAR_PHRASES = [
    rf"{_B}\d+\s?(?:[-–]\s?\d+)?\s?\+?\s?{_YEAR}{_E}",
    rf"{_B}minimum\s?\d+\s?(?:év|eves|years?|yrs?){_E}",
    rf"{_B}at least\s?\d+\s?\+?\s?years?{_E}",
    rf"{_B}legal[áa]bb\s+\d+\s?(?:[ée]ves|[ée]v|years?){_E}",
    rf"{_B}tobb\s?eves{_E}",
    rf"{_B}several\s?years?{_E}",
]
MOST_YEARS = 15


def is_intern(title: Column) -> Column:
    return has_keyword(normalize_text(title), INTERN_KEYWORDS)


def is_junior(title: Column) -> Column:
    return has_keyword(normalize_text(title), JUNIOR_KEYWORDS)


def is_mid(title: Column) -> Column:
    return has_keyword(normalize_text(title), MID_KEYWORDS)


def level_of(title: Column) -> Column:
    """The level that a title states, null if none; student work before junior before medior."""
    return F.when(is_intern(title), "diákmunka").when(is_junior(title), "junior").when(is_mid(title), "medior")


def numbers_in(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))


def is_senior(experience: Column, accents: bool = False, numbers: Column | None = None) -> Column:
    """The word senior, szenior or lead, or no number below SENIOR_YEARS. With accents, they are kept. numbers: those of experience, if known."""
    n = F.lower(F.trim(F.coalesce(experience, F.lit("")))) if accents else normalize_text(experience)
    least = F.array_min(numbers_in(n) if numbers is None else numbers)
    word = (n.contains("senior") | n.contains("szenior") | n.contains("lead")) & n.rlike(f"{_B}(senior|szenior|lead){_E}")
    return word | F.coalesce(least >= SENIOR_YEARS, F.lit(False))


def _said(experience: Column) -> Column:
    return F.lower(F.trim(F.coalesce(experience, F.lit(""))))


def says_junior(experience: Column) -> Column:
    """A word for juniors. Word edges are ASCII, so one that ends in an accent needs a letter after it."""
    plain = rf"{_B}(?:junior|palyakezdo|entry\s*level|trainee|intern){_E}"
    return _said(experience).rlike(rf"{plain}|{_B}pályakezdő(?=[A-Za-z0-9_])")


def says_medior(experience: Column) -> Column:
    return _said(experience).rlike(rf"{_B}(?:medior|mid|middle){_E}")


def is_unknown(experience: Column) -> Column:
    return _said(experience).isin("", "-", "–", "—")


def _first_year(experience: Column) -> Column:
    return _said(experience).rlike(r"(^|[^0-9])(0|1)([^0-9]|$)")


def suits_junior(experience: Column) -> Column:
    """Nothing is known, or a junior's word or a lone 0 or 1 without a medior's word."""
    return is_unknown(experience) | ~says_medior(experience) & (says_junior(experience) | _first_year(experience))


def suits_medior(experience: Column) -> Column:
    """Nothing is known, or a medior's word, or neither a junior's word nor a lone 0 or 1."""
    return is_unknown(experience) | says_medior(experience) | ~says_junior(experience) & ~_first_year(experience)


def years_phrases(text: Column) -> Column:
    """Phrases of years in text, joined by ', '; null if none is left.

    A phrase with a number over MOST_YEARS goes, as does one that stands in another; order is that of the
    kinds, then of the places.
    """
    found = lambda spaced: F.flatten(F.array(*[F.regexp_extract_all(spaced, F.lit(f"(?iu)({p})"), F.lit(1)) for p in _YEAR_PHRASES]))
    sane = lambda said: F.filter(said, lambda m: ~F.exists(numbers_in(m), lambda x: x > MOST_YEARS))
    plain = lambda said: F.array_distinct(F.transform(sane(said), lambda m: F.lower(F.trim(F.regexp_replace(m, WS, " ")))))
    outer = lambda said: F.filter(said, lambda m: ~F.exists(said, lambda o: (o != m) & o.contains(m)))
    joined = once(F.regexp_replace(text, r"(\p{L})(\d)", "$1 $2"), lambda t: once(found(t), lambda said: once(plain(said), lambda x: F.array_join(outer(x), ", "))))
    # every phrase has a digit or one of two words
    return F.when(text.rlike(r"(?iu)\d|tobb\s?eves|several"), F.nullif(joined, F.lit("")))


def experience_of(title: Column, body: Column) -> Column:
    """What the title states, else the years of the body, else '-'."""
    return F.coalesce(level_of(title), years_phrases(body), F.lit("-"))


def in_budapest(location: Column) -> Column:
    """False only where another town is named: words for the way of work and districts name none."""
    n = normalize_text(location)
    rest = n
    for word in WORK_MODES:
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"[•/,;()\-–—.]", " "), r"\s+", " "))
    district = F.forall(F.split(rest, " "), lambda t: t.rlike("^[ivxlc]+$") | t.isin("kerulet", "ker"))
    return (n == "") | n.contains("budapest") | n.rlike(f"{_B}buda{_E}") | (rest == "") | district


def elsewhere(location: Column) -> Column:
    """A stated place without any of PLACE_HINTS."""
    n = normalize_text(location)
    return (n != "") & ~F.exists(F.array(*map(F.lit, PLACE_HINTS)), lambda h: n.contains(h))


def category_of(title: Column, categories: list[tuple[str, list[str]]]) -> Column:
    """The one category of a title, by the keywords of the categories (in order), OTHER for none."""
    t = F.lower(F.coalesce(title, F.lit("")))
    found = F.array_compact(F.array(*[F.when(has_keyword(t, [k.lower() for k in words]), F.lit(name)) for name, words in categories if words]))
    several = lambda a: F.size(a) > 1
    without = lambda a, name: F.filter(a, lambda x: x != name)
    general = F.when(several(found), without(found, "Fejlesztő")).otherwise(found)
    weak = F.when(F.array_contains(general, "Hálózat / Infra"), "Hálózat / Infra").otherwise("Mérnöki / Gyártás")
    kept = F.when(several(general), F.filter(general, lambda x: x != weak)).otherwise(general)
    ranks = F.array(*map(F.lit, CATEGORY_RANK))

    def ranked(x: Column, at: Column) -> Column:
        place = F.array_position(ranks, x)
        return F.struct(F.when(place == 0, len(CATEGORY_RANK) + 1).otherwise(place).alias("rank"), at.alias("at"), x.alias("name"))

    best = F.array_min(F.transform(kept, ranked))["name"]
    return (
        F.when(t.contains("analyst") | t.contains("elemző"), "Elemző / Analyst")
        .when(has_keyword(t, ["ai"]), "Data / AI")
        .when(several(found) & F.array_contains(found, "DevOps"), "DevOps")
        .otherwise(F.coalesce(best, F.lit(OTHER)))
    )
