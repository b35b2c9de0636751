"""Keywords of any shape in one pass against one expression for each."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text

WORDS = ["c++", "c#", "c", ".net", ".net core", "asp.net", "node.js", "node", "js", "react native", "native app", "a b c", "b c", "ci/cd", "5g", "c++11", "++", "es6-next", "x.", "é-mail", "mail"]
PIECES = ["c", "c++", "C#", ".NET", "asp", "node", ".js", "js11", "React", "native", "app", "a", "b", "c4", "ci/cd", "5G", "++", "es6", "-next2", "x.", "é-", "mail", "_", "1", "é", "K", "ß"]


@pytest.mark.parametrize("digit", [True, False])
def test_keywords_of_any_shape(spark, digit):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", " ", ", ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([*((t,) for t in texts), (None,), ("a b c b c b",), ("react native native app",)], "t string")
    one = (lambda k: text.has_technology(F.col("t"), k)) if digit else (lambda k: text.has_keyword(F.col("t"), [k]))
    wanted = F.array_compact(F.array(*[F.when(one(k), F.lit(k)) for k in WORDS]))
    got = rows.select("t", text.keywords_in(F.col("t"), WORDS, digit).alias("found"), wanted.alias("wanted")).collect()
    assert [tuple(r) for r in got if r["t"] is not None and r["found"] != r["wanted"]] == []
    assert sum(len(r["wanted"]) for r in got) > 300 and [r["found"] for r in got if r["t"] is None] == [None]


def test_keyword_lists(spark):
    row = spark.range(1).select(text.keywords_in(F.lit("x"), []), text.canonical_labels(F.lit("Node.js, react-native"), [("react native", "RN"), ("node.js", "Node"), ("react", "React")]), text.canonical_labels(F.lit(""), [("c++", "C++")])).first()
    assert tuple(row) == ([], "Node, React", None)
