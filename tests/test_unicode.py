"""Decomposition and composition against the standard library, over all letters of the basic plane."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from jobloom.functions import text, unicode


def _plain(s):
    """Decomposed, without the combining diacritical marks."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F)


def test_accents_of_the_basic_plane(spark):
    letters = [c for c in unicode._planes() if len(_plain(c)) <= 1]
    rows = spark.createDataFrame([(k, f"x{c}y") for k, c in enumerate(letters)], "k int, s string")
    got = dict(map(tuple, rows.select("k", text.strip_accents(F.col("s"))).collect()))
    assert [(c, got[k]) for k, c in enumerate(letters) if got[k] != f"x{_plain(c)}y"] == []


def test_normal_forms(spark):
    said = spark.range(1).select(
        text.normalize_text(F.lit("  Škoda Řízení țară ŽLUŤOUČKÝ Ệ ")), text.normalize_text(F.lit("é ́ x")), text.normalize_text(F.lit(None).cast("string")),
        text.normalize_name(F.lit(" Café \n Å ")), text.normalize_name(F.lit(None).cast("string")), text.normalize_name(F.lit("")),
        text.trim_without_accents(F.lit(" Ősz  Ț ")),
    ).first()
    assert tuple(said) == ("skoda rizeni tara zlutoucky e", "e x", "", "Café Å", "", "", "Osz  T")


def test_composition_is_canonical(spark):
    rng = random.Random(5)
    letters = "aAeoOuyzcnsạâêọǖαωйи1 中🙂"
    marks = [chr(c) for c in (*range(0x300, 0x314), 0x31B, 0x323, 0x327, 0x328, 0x32D, 0x331, 0x342, 0x345, 0x340, 0x341, 0x343, 0x344, 0x34F)]
    made = ["".join(rng.choice(letters) + "".join(rng.choice(marks[:-5]) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))) for _ in range(600)]
    made += ["́a", "", "é" * 3000, "plain"]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, s string")
    got = dict(map(tuple, rows.select("k", unicode.composed(F.col("s"))).collect()))
    assert [(s, got[k]) for k, s in enumerate(made) if got[k] != unicodedata.normalize("NFC", s)] == []
