"""Gates of sources as Column expressions: places, countries, scripts and fields of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions.text import has_keyword, keywords_in, normalize_text

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
TOWN = "budapest"


def names_budapest(place: Column) -> Column:
    """The town's name anywhere in a place."""
    return normalize_text(place).contains(TOWN)


def is_budapest(place: Column) -> Column:
    """The place is the town and nothing else."""
    return normalize_text(place) == TOWN


def budapest_or_post_code(place: Column) -> Column:
    """The town's name, or one of its post codes, 1 and three digits."""
    n = normalize_text(place)
    return n.contains(TOWN) | n.rlike(rf"{_B}1\d{{3}}{_E}")


def budapest_in_text(text: Column) -> Column:
    """The town's name at a word's start, its abbreviation, or a post code of its districts; false for no text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return t.rlike(rf"{_B}budapest|{_B}bp{_E}|{_B}1[0-2]\d{{2}}{_E}")


def budapest_by_place_or_text(place: Column, title: Column, content: Column) -> Column:
    """By the place where one is stated, else by title and content."""
    n = normalize_text(place)
    whole = normalize_text(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    return F.when(n != "", n.contains(TOWN)).otherwise(whole.contains(TOWN))


def budapest_or_home(place: Column) -> Column:
    return normalize_text(place).contains(TOWN) | normalize_text(place).contains("home office")


def budapest_among(places: Column) -> Column:
    """Any of a list of places is the town or a district; false for no list."""
    return F.coalesce(F.exists(places, lambda x: F.lower(x).contains("kerület") | F.lower(x).contains(TOWN)), F.lit(False))


def in_country(code: Column, text: Column, country: str = "hu", names: tuple[str, ...] = ("hungary", "magyarorszag")) -> Column:
    """The stated country code, or a name of the country in a text."""
    n = normalize_text(text)
    return (F.lower(F.coalesce(code, F.lit(""))) == country) | reduce(lambda a, b: a | b, [n.contains(x) for x in names])


def not_elsewhere(code: Column, country: str = "hu") -> Column:
    """False only where another country is stated."""
    return F.coalesce(F.lower(F.trim(code)) == country, F.lit(True)) | (F.trim(code) == "")


def latin_script(title: Column) -> Column:
    """Two Latin letters or more once accents are off."""
    return F.regexp_count(normalize_text(title), F.lit("[a-z]")) >= 2


def is_it_job(title: Column, keywords: list[str]) -> Column:
    """An analyst, the word ai, or any keyword of the IT categories; false for no title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    any_keyword = F.size(keywords_in(t, [k.lower() for k in keywords], digit_may_follow=False)) > 0
    return (t != "") & (t.contains("analyst") | t.contains("elemző") | has_keyword(t, ["ai"]) | any_keyword)
