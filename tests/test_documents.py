"""JSON documents: equality whatever the order and spacing, merges of nested ones, and broken ones."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from jobloom.functions import documents
from jobloom.operators import state


def _made(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind < 5:
        return [None, True, rng.randrange(-5, 5), rng.choice(["", "a", 'é"\\', "{}"]), [rng.randrange(3), {"a": 1}]][kind]
    return {k: _made(rng, depth + 1) for k in rng.sample("abcdé", rng.randrange(5))}


def _over(old, new):
    if not (isinstance(old, dict) and isinstance(new, dict)):
        return new
    return {k: _over(old[k], new[k]) if k in old and k in new else new.get(k, old.get(k)) for k in {*old, *new}}


def test_merges_and_equality(spark):
    rng = random.Random(3)
    rows = []
    for k in range(250):
        a, b = ({"r": _made(rng), "s": _made(rng)} if rng.random() < 0.8 else _made(rng) for _ in range(2))
        again = {x: a[x] for x in rng.sample(sorted(a), len(a))} if isinstance(a, dict) else a
        rows.append((k, json.dumps(a), json.dumps(b, indent=2), json.dumps(again, indent=1)))
    df = spark.createDataFrame(rows, "k int, a string, b string, again string")
    a, b, again = F.col("a"), F.col("b"), F.col("again")
    for r in df.select("*", documents.merged_json(a, b).alias("merged"), documents.same_json(a, again).alias("same"), documents.same_json(a, b).alias("other")).collect():
        old, new = json.loads(r["a"]), json.loads(r["b"])
        assert json.loads(r["merged"]) == _over(old, new), r
        assert r["same"] and r["other"] == (old == new and str(old) == str(new) or old == new)


def test_broken_and_empty_documents(spark):
    texts = ['{"a":1', None, "", "{}", " { } ", "[ ]", "null", '{"a":1,"a":2}', "0", '""']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t, one = F.col("t"), F.lit('{"b": [2, 1]}')
    got = df.select(documents.canonical_json(t), documents.is_empty_json(t), documents.merged_json(t, one), documents.merged_json(one, t), documents.same_json(t, t)).orderBy("k").collect()
    kept = '{"b":[2,1]}'
    assert list(map(tuple, got)) == [
        (None, False, kept, kept, True), (None, True, kept, kept, True), (None, True, kept, kept, True), ("{}", True, kept, kept, True), ("{}", True, kept, kept, True),
        ("[]", True, kept, "[]", True), ("null", True, kept, "null", True), (None, False, kept, kept, True), ("0", False, kept, "0", True), ('""', False, kept, '""', True),
    ]
    deep = F.lit('{"a":' * 8 + '{"x":1}' + "}" * 8), F.lit('{"a":' * 8 + '{"y":1}' + "}" * 8)
    assert spark.range(1).select(documents.merged_json(*deep, levels=3)).first()[0] == '{"a":' * 8 + '{"y":1}' + "}" * 8
    assert spark.range(1).select(documents.field(F.lit('{"a":[{"b":3}]}'), "$.a[0].b", "int"), documents.field(F.lit('{"a":"x"}'), "$.a", "int"), documents.field(F.lit("{"), "$.a", "int")).first()[:] == (3, None, None)


def test_empty_however_written(spark):
    table = spark.createDataFrame([(1, True, '{"a":1}'), (2, True, '{"b":1}'), (3, True, "x")], "id int, applied boolean, data string")
    change = spark.createDataFrame([(1, True, "{ }"), (2, True, '{"c": 1}'), (3, True, None), (4, True, " {}")], "id int, applied boolean, data string")
    got = state.upsert_or_delete(table, change, ["id"], ["applied"], "data")
    assert sorted(map(tuple, got.collect())) == [(1, True, '{"a":1}'), (2, True, '{"c": 1}'), (3, True, None), (4, True, " {}")]
