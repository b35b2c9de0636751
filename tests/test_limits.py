"""Sliding and fixed limits in batches and streams against an event-by-event version, with one key that holds most events."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from jobloom.operators import rollups
from jobloom.streaming import limits

START = dt.datetime(2024, 1, 1)


def _events(n, seconds, keys=("a",) * 9 + ("b", None), untimed=0.02):
    rng = random.Random(1)
    return [(k, rng.choice(keys), None if rng.random() < untimed else START + dt.timedelta(microseconds=rng.randrange(seconds * 1_000_000) // 10**6 * 10**6 if k % 3 else rng.randrange(seconds * 1_000_000))) for k in range(n)]


def _hits(rows, seconds):
    """hits and oldest of each event, one by one."""
    span = dt.timedelta(seconds=seconds)
    out = {}
    for event_id, key, ts in rows:
        seen = [t for _, k, t in rows if k == key and (t is None if ts is None else t is not None and ts - span < t <= ts)]
        out[event_id] = len(seen), None if ts is None else min(seen)
    return out


def test_sliding_limit_of_a_busy_key(spark):
    rows = _events(1500, 240)
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp").withColumn("part", F.lit("x"))
    for seconds in (1, 7, 60):
        got = rollups.sliding_limit(df, "key", "ts", 3, seconds).collect()
        wanted = _hits(rows, seconds)
        assert {r["event_id"]: r["hits"] for r in got} == {k: n for k, (n, _) in wanted.items()} and len(got) == len(rows)
        for r in got:
            n, oldest = wanted[r["event_id"]]
            assert r["allowed"] == (n <= 3) and r["part"] == "x"
            left = None if oldest is None or n <= 3 else -((r["ts"] - oldest - dt.timedelta(seconds=seconds)) // dt.timedelta(seconds=1))
            assert r["retry_after"] == left
    assert rollups.sliding_limit(df.limit(0), "key", "ts", 3, 60).count() == 0


def test_no_group_of_a_sliding_limit_holds_a_busy_key(spark):
    # 90 % of the events are of one key, spread over 64 windows: no group has more than a part of a window, and what is a window before
    df = spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("key"), F.timestamp_micros(F.col("id") * 32_000).alias("ts"))
    out = rollups.sliding_limit(df, "key", "ts", 5, 10)
    sizes = out.groupBy("key", F.floor(F.unix_micros("ts") / (10_000_000 // rollups.WINDOW_PARTS))).count()
    assert sizes.agg(F.max("count")).first()[0] <= 20
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert windows and all("_part" in x for x in windows)


def _streamed(spark, tmp_path, rows, cuts, made, name):
    """The results of a stream that gets rows in the given cuts, a batch each."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "event_id long, user_id long, ts timestamp, rows int"
    for k, (first, end) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[first:end], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        query = made(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-c"))
        query = query.outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120), k
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()


def test_ordered_streams_are_their_batches_however_cut(spark, tmp_path):
    rng = random.Random(4)
    base = [(k, 1 if k % 10 else 2 + k % 3, START + dt.timedelta(seconds=rng.randrange(900)), k % 7) for k in range(150)]
    base.sort(key=lambda r: (r[2] + dt.timedelta(seconds=rng.randrange(50)), r[0]))  # up to 50 s late
    end = (999, 9, START + dt.timedelta(hours=9), 0)  # moves the watermark over all others
    df = spark.createDataFrame(base, "event_id long, user_id long, ts timestamp, rows int")
    hits = {r["event_id"]: (r["hits"], r["allowed"], r["retry_after"]) for r in rollups.sliding_limit(df, "user_id", "ts", 4, 60).collect()}
    granted = {r["event_id"]: r["granted"] for r in rollups.budget_granted(df, "user_id", "ts", "event_id", "rows", 10, 120).collect()}
    rows = [*base, end]
    for k, cuts in enumerate(([150], [41, 120])):
        got = _streamed(spark, tmp_path, rows, cuts, lambda s: limits.ordered_sliding_limit(s, 4, 60, late="60 seconds"), f"s{k}")
        assert {r["event_id"]: (r["hits"], r["allowed"], r["retry_after"]) for r in got} == hits and len(got) == len(hits)
    got = _streamed(spark, tmp_path, rows, [41, 120], lambda s: limits.ordered_budget(s, "rows", 10, 120, late="60 seconds"), "b")
    assert {r["event_id"]: r["granted"] for r in got} == granted and len(got) == len(granted)


def test_late_and_untimed_events_of_a_stream(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, 5, at(0), 1), (2, 5, at(100), 1), (3, 5, at(1), 1), (4, 5, None, 1), (5, 5, at(95), 1), (6, 5, at(500), 1)]
    got = _streamed(spark, tmp_path, rows, [2, 5], lambda s: limits.ordered_sliding_limit(s, 1, 60, late="10 seconds"), "late")
    # 3 comes when the watermark is at 90, and is dropped; 6 still waits
    assert sorted((r["event_id"], r["hits"], r["allowed"], r["retry_after"]) for r in got) == [(1, 1, True, None), (2, 2, False, 55), (5, 1, True, None)]
