"""Mutations: idempotence, and the rules that must hold whatever the rows."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest

from jobloom.operators import cleaning, state
from jobloom.plans import snapshots
from jobloom.streaming import limits

SCHEMA = "source string, url string, first_seen timestamp, active boolean, sweep_dead boolean"
AS_OF = "2024-02-01"


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for source, active, old, found, dead in itertools.product(("plain", "sticky", "quiet"), (True, False), (True, False), (True, False), (True, False)):
        if active and dead:
            continue
        seen = dt.datetime(2024, 1, 1) if old else dt.datetime(2024, 1, 31)
        made.append((source, f"https://x/{source}/{active}{old}{found}{dead}", seen, active, dead))
    return spark.createDataFrame(made, SCHEMA)


def _set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_reconcile(spark, rows):
    found = rows.where("url RLIKE '(True|False)(True|False)True(True|False)$' AND source <> 'quiet'").select("source", "url")
    runs = spark.createDataFrame([("plain", True, False), ("sticky", True, False), ("quiet", True, False)], "source string, complete boolean, empty_is_valid boolean")
    once = state.reconcile(rows, found, runs, AS_OF, ["sticky"])
    assert _set(state.reconcile(once, found, runs, AS_OF, ["sticky"])) == _set(once)
    before = {r.url: r for r in rows.collect()}
    names = {r.url for r in found.collect()}
    for r in once.collect():
        old = before[r.url]
        assert not (r.sweep_dead and r.active)
        if r.source == "quiet":
            assert r == old  # it found nothing
        elif r.url in names:
            assert r.active is not (r.source == "sticky" and old.sweep_dead)
        elif old.first_seen > dt.datetime(2024, 1, 29):
            assert r.active == old.active  # younger than the grace
        else:
            assert not r.active


def test_insert_absent_is_idempotent(spark, rows):
    batch = rows.limit(5).unionByName(spark.createDataFrame([("new", "u", None, True, False)] * 2, SCHEMA))
    once = state.insert_absent(rows, batch, ["source", "url"], ["first_seen"])
    assert once.where("is_new").count() == 1
    again = state.insert_absent(once.drop("is_new"), batch, ["source", "url"], ["first_seen"])
    assert again.where("is_new").count() == 0 and _set(again.drop("is_new")) == _set(once.drop("is_new"))


def test_dedupe_and_validation(spark):
    made = [(1, "ab", "https://x/1"), (2, "abc", "https://x/1?utm_source=q"), (3, "abc", "https://x/1"), (4, "abc", "ftp://x/1"), (5, None, "https://x/2"), (6, "abc", None)]
    df = spark.createDataFrame(made, "seq int, title string, url string")
    assert [r.seq for r in cleaning.sanitized(df).orderBy("seq").collect()] == [2, 3]
    assert [r.seq for r in cleaning.dedupe_by_url(df).where("url = 'https://x/1'").collect()] == [1]


def test_blocklist_is_exact(spark):
    df = spark.createDataFrame([("a", "Bosch Group"), ("a", "Bosch Rexroth"), ("a", None), ("b", "bosch group")], "source string, company string")
    blocked = spark.createDataFrame([("a", "bosch  GROUP")], "source string, company string")
    assert _set(cleaning.without_blocked(df, blocked)) == _set(df.where("company IS NULL OR source = 'b' OR company LIKE '%Rexroth'"))


def test_snapshots(spark, rows, tmp_path):
    root = str(tmp_path)
    assert snapshots.commit(rows.limit(3), root, "t") == 1
    assert snapshots.commit(snapshots.current(spark, root, "t").limit(2), root, "t") == 2
    assert snapshots.current(spark, root, "t").count() == 2


def test_stream_limit(spark, tmp_path):
    events = spark.createDataFrame([(k, 1, dt.datetime(2024, 1, 1, 0, 0, k)) for k in range(6)], "event_id long, user_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = limits.sliding_limit_stream(stream, 2, 3)
    query = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == {k: k < 2 for k in range(6)}
