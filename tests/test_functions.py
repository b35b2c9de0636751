"""Worked examples of the functions: input and what it must give."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import levels, text, urls
from jobloom.operators.listing import limit_of


def one(spark, build, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(build(*map(F.col, df.columns)).alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("said", "wanted"),
    [("…végzettség1-5 év", "1-5 év"), ("5–7+ years", "5–7+ years"), ("minimum 3 years", "minimum 3 years"), ("több mint 20 éves tapasztalattal", None), ("", None), (None, None)],
)
def test_years_phrases(spark, said, wanted):
    assert one(spark, levels.years_phrases, said) == wanted


@pytest.mark.parametrize(("t", "label", "wanted"), [("HTML5", "HTML", True), ("C++11", "C++", True), ("Vue3", "Vue", True), ("Javascript", "Java", False)])
def test_technology_may_end_in_a_digit(spark, t, label, wanted):
    assert one(spark, lambda c: text.has_technology(c, label), t) is wanted


@pytest.mark.parametrize(
    ("title", "wanted"),
    [("Internal Auditor", None), ("International Sales", None), ("Graduate Trainee Program", "diákmunka"), ("New College Graduate", "junior"), ("Mid-level dev", "medior")],
)
def test_level_of_title(spark, title, wanted):
    assert one(spark, levels.level_of, title) == wanted


@pytest.mark.parametrize(("said", "wanted"), [("3-5 év", False), ("5-10 years", True), ("7+ years", True), ("junior", False), ("Szenior", True), (None, False)])
def test_senior(spark, said, wanted):
    assert one(spark, levels.is_senior, said) is wanted


@pytest.mark.parametrize(
    ("place", "wanted"),
    [("7027 Paks, Budapest, Szeged", True), ("Távmunka / Remote • Opcionális iroda", True), ("Debrecen iroda", False), ("Hibrid • XIII", True), ("", True), (None, True)],
)
def test_budapest(spark, place, wanted):
    assert one(spark, levels.in_budapest, place) is wanted


def test_company_key_is_the_first_word(spark):
    assert one(spark, text.company_key, "SnapSoft Kft.") == one(spark, text.company_key, "SnapSoft Informatikai és Szolgáltató Kft.")
    assert one(spark, text.company_key, "The Firm") == "firm"


def test_town_slug_goes(spark):
    assert one(spark, urls.without_town, "https://x.hu/allas/dev-budapest-2895930") == "https://x.hu/allas/dev-2895930"


def test_stable_key_outlives_the_number(spark):
    keys = {one(spark, urls.stable_key, f"https://x.hu/net-fejleszto-{n}") for n in (2875224, 2899456, 2925021)}
    assert len(keys) == 1


def test_category_rules(spark):
    names = [("Elemző / Analyst", ["analyst"]), ("DevOps", ["devops"]), ("Fejlesztő", ["dev"]), ("Mobil", ["android"])]
    assert one(spark, lambda t: levels.category_of(t, names), "Elemző és DevOps") == "Elemző / Analyst"
    assert one(spark, lambda t: levels.category_of(t, names), "DevOps dev") == "DevOps"
    assert one(spark, lambda t: levels.category_of(t, names), "Android dev") == "Mobil"
    assert one(spark, lambda t: levels.category_of(t, names), "AI dev") == "Data / AI"
    assert one(spark, lambda t: levels.category_of(t, names), None) == "Egyéb"


def test_limits():
    assert [limit_of(x) for x in (None, "abc", "99999", "0", "20")] == [500, 5000, 5000, 5000, 20]


def test_date_suffix_and_year(spark):
    assert one(spark, text.strip_date_suffix, "X 2026. 07. 09.") == "X"
    assert one(spark, text.trailing_year, "Matematikai analízis I. - 2022") == 2022


def test_canonical_url_is_idempotent(spark):
    given_ = ["HTTP://A.example.com/x?utm_source=a&b=1#f", "https://a.example.com", "no url", "https://a.b/?gclid=1", "https://a.b/p?&&c=2"]
    for url in given_:
        first = one(spark, urls.canonical_url, url)
        assert one(spark, urls.canonical_url, first) == first


@settings(max_examples=10, deadline=None)
@given(st.text(alphabet="aáeéöőuű \t\nXYZ.,-0", max_size=30))
def test_normal_text_is_idempotent(spark, s):
    first = one(spark, text.normalize_text, s)
    assert one(spark, text.normalize_text, first) == first
